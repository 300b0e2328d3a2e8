"""The words of many texts at once, and neighbours dealt out in parts, against plain versions of both."""

from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from cairn.llm import brown

ODD = ["", None, "Plain words, in ASCII_1", "\n", "two\nlines\n", "ΌΣΟΣ ΣΑΣ́ ΑΣ", "İstanbul ǅ ß", "漢字かな 한국어", "é naïve", "𝔘𝔫𝔦 😀code😀", "²³½ ⅷ ⓐ", "a" * 5000, "x‍y z", "_", "ΑΣ", "Σ"]


@pytest.mark.parametrize("texts", [ODD, ODD[::-1], ["only plain", "", "text"], ["", None], [None], ODD * 50])
def test_words_of_many_texts_are_those_of_each(texts):
    each = [brown.WORDS.findall(t.lower()) if t else [] for t in texts]
    words, sizes = brown.words_of(pa.array(texts, type=pa.string()))
    assert words.to_pylist() == [w for x in each for w in x] and sizes.tolist() == [len(x) for x in each]


def test_counts_are_whole_beyond_what_a_task_keeps(monkeypatch):
    monkeypatch.setattr(brown, "KEPT_WORDS", 3)
    batches = [pa.RecordBatch.from_arrays([pa.array([t], type=pa.string())], ["text"]) for t in ("a b c d", "a b", None, "a a", "e f g h i a")]
    got: Counter = Counter()
    for b in brown._count.__wrapped__(iter(batches)):
        got.update(dict(zip(b.column(0).to_pylist(), b.column(1).to_pylist())))
    assert got == Counter("a b c d a b a a e f g h i a".split())


@pytest.mark.parametrize("parts, held", [(1, 10**6), (7, 10**6), (7, 5)])
def test_neighbours_in_parts_are_summed_whole(monkeypatch, spark, parts, held):
    monkeypatch.setattr(brown, "MOST_HELD", held)
    rng = np.random.default_rng(1)
    docs = [rng.integers(-1, 6, size=n).astype(np.int32) for n in (0, 1, 2, 30, 40)]
    want: Counter = Counter()
    for d in docs:
        seq = [0, *[int(x) + (x >= 0) for x in d], 0]  # words from 1, -1 is of no head
        want.update((a, b) for a, b in zip(seq, seq[1:]) if a >= 0 and b >= 0)
    heads = [np.where(d >= 0, d + 1, -1).astype(np.int32).tobytes() for d in docs]
    batches = [pa.RecordBatch.from_arrays([pa.array([h], type=pa.binary())], ["head"]) for h in heads]
    dealt = list(brown._pairs(parts)(iter(batches)))
    of = lambda bs, p: [b.filter(pa.array(b.column(0).to_numpy() == p)) for b in bs]
    sides = [x for p in range(parts) for x in brown._sides(parts)(iter(of(dealt, p)))]
    right, left, seen = Counter(), Counter(), []
    for p in range(parts):
        for b in brown._near(iter(of(sides, p))):
            for r in b.to_pylist():
                seen.append(r["w"])
                for i, n in zip(np.frombuffer(r["right"], np.int32).tolist(), np.frombuffer(r["rn"], np.int64).tolist()):
                    right[r["w"], i] += n
                for i, n in zip(np.frombuffer(r["left"], np.int32).tolist(), np.frombuffer(r["ln"], np.int64).tolist()):
                    left[i, r["w"]] += n
    assert right == left == want and len(seen) == len(set(seen))
    frame = spark.createDataFrame([(h,) for h in heads], "head binary")
    rows = brown.neighbours(frame, parts).collect()
    assert sorted(r.w for r in rows) == sorted(seen)
