"""Language-model scoring with a Brown class-based bigram model.

p(w | v) = p(class(w) | class(v)) p(w | class(w)), where every word of the corpus has a class and a count of its own, so
the model grows with the corpus. Classes come from exchange clustering. The `HEAD` most frequent words are clustered first: from a
round-robin start by frequency, words move to the class that raises the likelihood of the class bigrams most. The
search is distributed as in Uszkoreit and Brants (2008): each round, all tasks judge their words against the same
class counts, and half of the words may move; the assignment with the best likelihood is kept, and it ends when two
rounds together gain less than `LEAST_GAIN` of it, or after `ROUNDS`. Every other word then makes one exchange step: it goes to the class
that gives its neighbours among the head the best likelihood, with the class counts held (beside which its own are
nothing). HEAD says which words are looked up in a broadcast table, of that bounded size, and which in a shuffled one; it drops none.

The texts are read twice: to count words, and to write them as numbers (four bytes a token, in the shared folder). From
these: bigrams of head words, summed up by tasks and dealt out in blocks, first by pair and then by word; for the other words one row of neighbours' classes a token, by shuffle on the
word; and these tokens again, with the class of their word by a join, brought together by document. The driver holds the
head's words and classes and the class bigram table. Other words are known by 63 bits of a hash.

Smoothing: class transitions are Dirichlet-smoothed with the class frequencies (`PRIOR`), emissions by 1/2 a count.

Defined results:
* words are runs of letters, digits and _, in lower case; a document begins and ends with a boundary;
* a null or empty text has no words: n_tokens is 0, log_prob that of ending at once, perplexity null;
* texts are read whole; repeated rows count and are scored as often as they occur; null ids are carried;
* ids are whole numbers or, if of another type, strings; an empty table gives an empty table;
* ties in frequency go by the word, ties between classes to the first; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import Columns, id_kind, lean, ready, slices, written

HEAD, CLASSES, ROUNDS, LEAST_GAIN, PRIOR = 1 << 16, 64, 8, 2e-4, 50.0
WORDS = re.compile(r"\w+")
#: A task gives its counts of words away beyond so many, which bounds its memory and changes no result.
KEPT_WORDS = 400_000
#: A task sums up pairs when it holds so many.
MOST_HELD = 4_000_000
#: Head tokens and head words for each part in which pairs are dealt out; a part is held by one task.
PART_TOKENS, PART_WORDS = 2_000_000, 2048
#: Log-probabilities are summed as whole numbers of this many parts, so that the order doesn't matter.
PARTS = 10**9


def is_word() -> np.ndarray:
    """Whether a code point is one of WORDS', by code point."""
    if not _IS_WORD:
        table = np.zeros(0x110000, dtype=bool)
        for m in WORDS.finditer("".join(map(chr, range(len(table))))):
            table[m.start() : m.end()] = True
        _IS_WORD.append(table)
    return _IS_WORD[0]


_IS_WORD: list[np.ndarray] = []


def words_of(texts: pa.Array) -> tuple[pa.StringArray, np.ndarray]:
    """(all words, how many each text has): WORDS.findall(text.lower()) of all texts at once. A text without any may be null."""
    low = [t.lower() if t else "" for t in texts.to_pylist()]
    # A line's end is of no word, so no word spans two texts.
    s = "\n".join(low)
    data = np.frombuffer(s.encode(), dtype=np.uint8)
    plain = len(data) == len(s)
    points = data if plain else np.frombuffer(s.encode("utf-32-le"), dtype=np.uint32)
    inside = is_word()[points]
    edge = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    begins, ends = edge[::2], edge[1::2]
    first = np.cumsum([0, *(len(t) + 1 for t in low)])
    sizes = np.diff(np.searchsorted(begins, first))
    offsets = np.zeros(len(begins) + 1, dtype=np.int32)
    if plain:
        np.cumsum(ends - begins, out=offsets[1:])
        kept = data[inside]
    else:
        width = 1 + (points >= 0x80).astype(np.int8) + (points >= 0x800) + (points >= 0x10000)
        offsets[1:] = np.cumsum(width * inside, dtype=np.int64)[ends - 1]
        kept = data[np.repeat(inside, width)]
    return pa.StringArray.from_buffers(len(begins), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(kept))), sizes


def binaries(values: np.ndarray, sizes: np.ndarray) -> pa.BinaryArray:
    """The bytes of so many values each."""
    offsets = np.zeros(len(sizes) + 1, dtype=np.int32)
    np.cumsum(sizes * values.itemsize, out=offsets[1:])
    return pa.BinaryArray.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))])


@lean
def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def merged() -> pa.RecordBatch:
        t = pa.concat_tables(held).combine_chunks().group_by("word", use_threads=False).aggregate([("n", "sum")])
        return pa.RecordBatch.from_arrays([t.column("word").combine_chunks(), t.column("n_sum").combine_chunks()], ["word", "n"])

    held: list[pa.Table] = []
    n = 0
    for batch in batches:
        for part in slices(batch, 0):
            d = words_of(part.column(0))[0].dictionary_encode()
            held.append(pa.table({"word": d.dictionary, "n": np.bincount(d.indices.to_numpy(), minlength=len(d.dictionary)).astype(np.int64)}))
            n += len(d.dictionary)
            if n > 2 * KEPT_WORDS:
                out = merged()
                held, n = [], 0
                if len(out) > KEPT_WORDS:
                    yield out
                else:
                    held, n = [pa.Table.from_batches([out])], len(out)
    if n:
        yield merged()


def _encode(vocabulary):
    """(key, id, text) to (key, id, n_tokens, head, tail): head as int32, -1 for a word that isn't of it; those as int64 in tail."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = vocabulary.value.get
        for batch in batches:
            for part in slices(batch, 2):
                words, sizes = words_of(part.column(2))
                d = words.dictionary_encode()
                different = d.dictionary.to_pylist()
                own = np.array([get(w, -1) for w in different], dtype=np.int32)
                hashes = np.zeros(len(different), dtype=np.int64)
                other = own < 0
                hashes[other] = np.fromiter(map(xxhash.xxh3_64_intdigest, compress(different, other.tolist())), dtype=np.uint64) >> np.uint64(1)
                at = d.indices.to_numpy()
                head = own[at]
                ahead = np.concatenate([[0], np.cumsum(head < 0)])
                ends = np.concatenate([[0], np.cumsum(sizes)])
                tail = binaries(hashes[at[head < 0]], np.diff(ahead[ends]))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(sizes, type=pa.int64()), binaries(head, sizes), tail], ["key", "id", "n_tokens", "head", "tail"])

    return run


def sequences(head: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(ids with a boundary, 0, around each document; the place of each document's first boundary)."""
    parts = head.to_pylist()
    sizes = np.array([len(p) // 4 for p in parts], dtype=np.int64)
    starts = np.cumsum(sizes + 2) - sizes - 2
    seq = np.zeros(int((sizes + 2).sum()), dtype=np.int64)
    inside = np.ones(len(seq), dtype=bool)
    inside[starts] = False
    inside[starts + sizes + 1] = False
    seq[inside] = np.frombuffer(b"".join(parts), dtype=np.int32)
    return seq, starts


def summed(pairs: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different pairs in order, and the sum of each one's counts."""
    order = np.argsort(pairs)
    pairs = pairs[order]
    first = np.flatnonzero(np.concatenate([[True], pairs[1:] != pairs[:-1]])) if len(pairs) else np.zeros(0, dtype=np.int64)
    return pairs[first], np.add.reduceat(counts[order], first) if len(pairs) else counts


def dealt(to: np.ndarray, parts: int, *columns: np.ndarray) -> pa.RecordBatch:
    """(part, columns): one row for each part that has any, with the bytes of its values, which keep their order."""
    order = np.argsort(to, kind="stable")
    sizes = np.bincount(to, minlength=parts)
    some = np.flatnonzero(sizes)
    return pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), *[binaries(c[order], sizes[some]) for c in columns]], ["part", *[f"c{i}" for i in range(len(columns))]])


def part_of(pairs: np.ndarray, parts: int) -> np.ndarray:
    mixed = pairs.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((mixed >> np.uint64(32)) % np.uint64(parts)).astype(np.int32)


def _pairs(parts: int):
    """(part, pairs, counts): neighbours that are both of the head or boundaries, dealt out by the pair."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        n = 0

        def flush() -> pa.RecordBatch:
            pairs, counts = np.unique(np.concatenate(held), return_counts=True)
            return dealt(part_of(pairs, parts), parts, pairs, counts.astype(np.int64))

        for batch in batches:
            if not batch.num_rows:
                continue
            seq, starts = sequences(batch.column(0))
            a, b = seq[:-1], seq[1:]
            both = (a >= 0) & (b >= 0)
            both[starts[1:] - 1] = False
            held.append((a[both] << 32) | b[both])
            n += len(held[-1])
            if n > MOST_HELD:
                yield flush()
                held, n = [], 0
        if n:
            yield flush()

    return run


def blob(column: pa.Array, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=kind)


def _sides(parts: int):
    """Of a part's pairs: (part, words, neighbours, counts, right), each pair once with its first word and once with its second, dealt out by the word."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        n = least = 0
        for batch in batches:
            held.append((blob(batch.column(1), np.int64), blob(batch.column(2), np.int64)))
            n += len(held[-1][0])
            if n > max(MOST_HELD, 2 * least):
                held = [summed(*map(np.concatenate, zip(*held)))]
                n = least = len(held[0][0])
        if not n:
            return
        pairs, counts = summed(*map(np.concatenate, zip(*held)))
        held.clear()
        a, b = (pairs >> 32).astype(np.int32), (pairs & 0xFFFFFFFF).astype(np.int32)
        back = np.argsort(b, kind="stable")
        for right, word, other, m in ((True, a, b, counts), (False, b[back], a[back], counts[back])):
            out = dealt(word % parts, parts, word, other, m)
            yield pa.RecordBatch.from_arrays([*out.columns, pa.array(np.full(len(out), right))], ["part", "words", "others", "n", "right"])

    return run


@lean
def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a part's words: (w, right, rn, left, ln)."""
    held: dict[bool, list[tuple[np.ndarray, ...]]] = {True: [], False: []}
    for batch in batches:
        of = batch.column(4).to_numpy(zero_copy_only=False)
        for right in held:
            x = batch.filter(pa.array(of == right))
            held[right].append((blob(x.column(1), np.int32), blob(x.column(2), np.int32), blob(x.column(3), np.int64)))
    if not held[True]:
        return
    sides = []
    for right in (True, False):
        word, other, n = map(np.concatenate, zip(*held.pop(right)))
        order = np.argsort(word, kind="stable")
        sides.append((word[order], other[order], n[order]))
    words = np.union1d(sides[0][0], sides[1][0])
    for at in range(0, len(words), 256):
        w = words[at : at + 256]
        out = [pa.array(w)]
        for word, other, n in sides:
            begin, end = np.searchsorted(word, w, side="left"), np.searchsorted(word, w, side="right")
            out += [binaries(x[begin[0] : end[-1]], end - begin) for x in (other, n)]
        yield pa.RecordBatch.from_arrays(out, ["w", "right", "rn", "left", "ln"])


def around(batch: pa.RecordBatch, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each token that isn't of the head: (row, place in the row, word, class before, class after), -1 for another such token."""
    names = batch.schema.names
    seq, starts = sequences(batch.column(names.index("head")))
    at = np.flatnonzero(seq < 0)
    row = np.searchsorted(starts, at, side="right") - 1
    word = np.frombuffer(b"".join(batch.column(names.index("tail")).to_pylist()), dtype=np.int64)
    before, after = seq[at - 1], seq[at + 1]
    return row, at - starts[row], word, np.where(before < 0, -1, classes[before]), np.where(after < 0, -1, classes[after])


def _contexts(state):
    """(word, cell) of each token: cell is the class before times k + 1 and the class after, k where it is unknown."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, k = state.value
        for batch in batches:
            if batch.num_rows:
                _, _, word, before, after = around(batch, classes)
                cell = np.where(before < 0, k, before) * (k + 1) + np.where(after < 0, k, after)
                yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(cell.astype(np.int32))], ["word", "cell"])

    return run


def step_class(right: np.ndarray, left: np.ndarray, n: np.ndarray, transition: np.ndarray, size: np.ndarray, free: int) -> np.ndarray:
    """The class for words with these neighbours by class, of the first `free` ones: the likelihood with all counts held."""
    value = right @ transition[:free].T + left @ transition[:, :free] - n[:, None] * np.log(size[:free])[None, :]
    return value.argmax(axis=1)


def _assign(state):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        transition, size, free = state.value
        k = len(transition)
        for whole in batches:
            for at in range(0, whole.num_rows, 8192):
                b = whole.slice(at, 8192)
                row = np.repeat(np.arange(b.num_rows), np.diff(b.column(1).offsets.to_numpy()))
                cell, m = b.column(1).flatten().to_numpy(), b.column(2).flatten().to_numpy().astype(np.float64)
                before, after = cell // (k + 1), cell % (k + 1)
                table = lambda c: np.bincount(row[c < k] * k + c[c < k], weights=m[c < k], minlength=b.num_rows * k).reshape(-1, k)  # noqa: B023, E731
                n = np.bincount(row, weights=m, minlength=b.num_rows)
                c = step_class(table(after), table(before), n, transition, size, free)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n.astype(np.int64)), pa.array(c.astype(np.int32))], ["word", "n", "c"])

    return run


def _tokens(state):
    """(key, pos, word, before, after) of each token that isn't of the head."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes = state.value
        for batch in batches:
            if batch.num_rows:
                row, pos, word, before, after = around(batch, classes)
                key = batch.column(0).take(pa.array(row))
                yield pa.RecordBatch.from_arrays([key, pa.array(pos.astype(np.int32)), pa.array(word), pa.array(before.astype(np.int16)), pa.array(after.astype(np.int16))], ["key", "pos", "word", "before", "after"])

    return run


def steps(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """Of rows (key, tokens by place): (row, class before, class, count, class after or -1), the class of a neighbour of the same kind filled in."""
    lists = batch.column(1)
    row = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
    _, c, n, before, after = (x.to_numpy(zero_copy_only=False) for x in lists.flatten().flatten())
    before = before.astype(np.int64)
    unknown = np.flatnonzero(before < 0)
    before[unknown] = c[unknown - 1]
    return row, before, c.astype(np.int64), n, after.astype(np.int64)


def _cells(k: int):
    """Class bigrams in which a token that isn't of the head takes part."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = np.zeros(k * k, dtype=np.int64)
        for b in batches:
            if b.num_rows:
                _, before, c, _, after = steps(b)
                m += np.bincount(before * k + c, minlength=k * k)
                known = after >= 0
                m += np.bincount(c[known] * k + after[known], minlength=k * k)
        at = np.flatnonzero(m)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(m[at].astype(np.float64))], ["cell", "n"])

    return run


def xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def side(words: np.ndarray, ids: pa.Array, counts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, neighbour, count) of all neighbours in these columns."""
    sizes = np.array([len(x) // 4 for x in ids.to_pylist()], dtype=np.int64)
    return np.repeat(np.arange(len(words)), sizes), blob(ids, np.int32), blob(counts, np.int64).astype(np.float64)


def contexts(b: pa.RecordBatch, classes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(words, pairs with itself, right and left neighbours by class without these) of rows (w, right, rn, left, ln)."""
    words = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
    self_pairs = np.zeros(len(words))
    sides = []
    for ids, counts in ((b.column(1), b.column(2)), (b.column(3), b.column(4))):
        row, other, n = side(words, ids, counts)
        own = other == words[row]
        self_pairs = np.maximum(self_pairs, np.bincount(row[own], weights=n[own], minlength=len(words)))
        sides.append(np.bincount(row[~own] * k + classes[other[~own]], weights=n[~own], minlength=len(words) * k).reshape(-1, k))
    return words, self_pairs, sides[0], sides[1]


def _matrix(state):
    """Partial class bigram counts of the rows' words: of rows (w, right, rn)."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, k = state.value
        m = np.zeros(k * k)
        for b in batches:
            words = b.column(0).to_numpy(zero_copy_only=False)
            row, other, n = side(words, b.column(1), b.column(2))
            m += np.bincount(classes[words][row] * k + classes[other], weights=n, minlength=k * k)
        at = np.flatnonzero(m)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(m[at])], ["cell", "n"])

    return run


def best_moves(classes: np.ndarray, m: np.ndarray, words: np.ndarray, own: np.ndarray, right: np.ndarray, left: np.ndarray, free: int) -> tuple[np.ndarray, np.ndarray]:
    """(class, gain): for each word, the class of the first `free` ones that raises the likelihood most."""
    k = len(m)
    best, gain = np.zeros(len(words), dtype=np.int64), np.zeros(len(words))
    sums_r, sums_l = m.sum(axis=1), m.sum(axis=0)
    for at in range(0, len(words), 64):
        s = slice(at, at + 64)
        r, l, o, a = right[s], left[s], own[s], classes[words[s]]
        i = np.arange(len(a))
        without = np.broadcast_to(m, (len(a), k, k)).copy()
        without[i, a, :] -= r
        without[i, :, a] -= l
        without[i, a, a] -= o
        nr, nl = r.sum(axis=1) + o, l.sum(axis=1) + o
        sr, sl = np.broadcast_to(sums_r, (len(a), k)).copy(), np.broadcast_to(sums_l, (len(a), k)).copy()
        sr[i, a] -= nr
        sl[i, a] -= nl
        base = xlogx(np.maximum(without, 0))
        rows = (xlogx(np.maximum(without[:, :free, :] + r[:, None, :], 0)) - base[:, :free, :]).sum(axis=2)
        cols = (xlogx(np.maximum(without[:, :, :free] + l[:, :, None], 0)) - base[:, :, :free]).sum(axis=1)
        # The cell where row and column meet was counted twice, each time with a part.
        c = np.arange(free)
        cell = np.maximum(without[:, c, c], 0)
        rows -= xlogx(cell + r[:, :free]) - xlogx(cell)
        cols -= xlogx(cell + l[:, :free]) - xlogx(cell)
        both = xlogx(cell + r[:, :free] + l[:, :free] + o[:, None]) - xlogx(cell)
        out = xlogx(np.maximum(sr[:, :free], 0) + nr[:, None]) - xlogx(np.maximum(sr[:, :free], 0)) + xlogx(np.maximum(sl[:, :free], 0) + nl[:, None]) - xlogx(np.maximum(sl[:, :free], 0))
        value = rows + cols + both - out
        best[s] = value.argmax(axis=1)
        gain[s] = value[i, best[s]] - value[i, a]
    return best, gain


def _moves(state, free: int, turn: int):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, m = state.value
        for b in batches:
            words = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            # Half of the words each round; another half each time.
            turn_of = ((words * 2654435761 + turn * 40503) >> 7) & 1
            pick = (words > 0) & (turn_of == turn % 2)
            if not pick.any():
                continue
            words, own, right, left = contexts(b.filter(pa.array(pick)), classes, len(m))
            to, gain = best_moves(classes, m, words, own, right, left, free)
            moved = gain > 1e-6
            yield pa.RecordBatch.from_arrays([pa.array(words[moved]), pa.array(to[moved])], ["w", "c"])

    return run


def likelihood(m: np.ndarray) -> float:
    """The part of the log-likelihood that depends on the classes."""
    return float(xlogx(m).sum() - xlogx(m.sum(axis=1)).sum() - xlogx(m.sum(axis=0)).sum())


class Model:
    """The head's words, their classes, and log-probabilities; of bounded size. `tail`: (word, n, c) of all others, a table."""

    def __init__(self, vocabulary: list[str], counts: np.ndarray, boundaries: int, classes: int = CLASSES):
        self.ids = {w: 1 + i for i, w in enumerate(vocabulary)}
        self.counts = np.concatenate([[boundaries], counts]).astype(np.float64)
        self.free = max(1, min(classes, len(vocabulary)))
        self.k = self.free + 1
        # Classes 0..free-1 are clustered; the last is the boundary's.
        self.classes = np.concatenate([[self.free], np.arange(len(vocabulary)) % self.free]).astype(np.int64)
        self.bigrams = np.zeros((self.k, self.k))
        self.history: list[float] = []
        self.tail: DataFrame | None = None
        self.encoded: DataFrame | None = None
        self.placed: DataFrame | None = None

    def smoothed(self) -> np.ndarray:
        m = self.bigrams
        share = (m.sum(axis=0) + 0.5) / (m.sum() + 0.5 * self.k)
        return np.log((m + PRIOR * share[None, :]) / (m.sum(axis=1, keepdims=True) + PRIOR))

    def sizes(self) -> np.ndarray:
        return self.bigrams.sum(axis=1) + 0.5

    def finish(self, tail_mass: np.ndarray) -> None:
        """tail_mass: for each class the counts of its words outside of the head, each and 1/2."""
        self.transition = self.smoothed()
        n = self.counts + 0.5
        mass = np.bincount(self.classes[1:], weights=n[1:], minlength=self.k) + tail_mass
        self.log_mass = np.log(np.maximum(mass, 0.5))
        self.emission = np.log(n) - self.log_mass[self.classes]
        self.emission[0] = 0.0  # the boundary is its class's only member


def _matrix_of(near: DataFrame, model: Model) -> np.ndarray:
    cells = near.select("w", "right", "rn").mapInArrow(_matrix(near.sparkSession.sparkContext.broadcast((model.classes, model.k))), "cell bigint, n double").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    m = np.zeros(model.k * model.k)
    m[cells.column("cell").to_numpy()] = cells.column("n").to_numpy()
    return m.reshape(model.k, model.k)


def cluster(near: DataFrame, model: Model, rounds: int) -> None:
    """Exchange rounds over the head's bigrams; leaves the best classes and their bigrams in the model."""
    sc = near.sparkSession.sparkContext
    best = None
    for turn in range(rounds + 1):
        m = _matrix_of(near, model)
        model.history.append(likelihood(m))
        if best is None or model.history[-1] > best[0]:
            best = (model.history[-1], model.classes, m)
        h = model.history
        done = turn >= 2 and h[-1] - h[-3] < LEAST_GAIN * abs(h[0])
        if turn == rounds or done or len(model.classes) == 1:
            break
        moves = near.mapInArrow(_moves(sc.broadcast((model.classes, m)), model.free, turn), "w bigint, c bigint").toArrow()
        model.classes = model.classes.copy()
        model.classes[moves.column("w").to_numpy()] = moves.column("c").to_numpy()
    _, model.classes, model.bigrams = best


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS, head: int = HEAD, classes: int = CLASSES) -> Model | None:
    """The model of all documents, None if there are none."""
    spark = ready(docs.sparkSession)
    sc = spark.sparkContext
    c = Columns(docs)
    kind = id_kind(docs, id_col)
    texts = c.df.select(c[text_col].cast("string").alias("text"))
    rows = texts.count()
    if not rows:
        return None
    own = texts.mapInArrow(_count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(head).toArrow()
    model = Model(own.column("word").to_pylist(), own.column("n").to_numpy(), rows, classes)
    keyed = c.df.select(F.monotonically_increasing_id().alias("key"), c[id_col].cast(kind).alias("id"), c[text_col].cast("string").alias("text"))
    model.encoded = encoded = written(keyed.mapInArrow(_encode(sc.broadcast(model.ids)), f"key bigint, id {kind}, n_tokens bigint, head binary, tail binary"), "brown-encoded")
    tokens = int(own.column("n").to_numpy().sum()) + rows
    cluster(neighbours(encoded, max(-(-tokens // PART_TOKENS), -(-len(model.classes) // PART_WORDS))), model, rounds)
    # All other words: one exchange step each.
    rest = encoded.where(F.octet_length("tail") > 0).select("key", "head", "tail")
    seen = rest.mapInArrow(_contexts(sc.broadcast((model.classes, model.k))), "word bigint, cell int").repartition("word")
    seen = seen.groupBy("word", "cell").agg(F.count(F.lit(1)).alias("n")).groupBy("word").agg(F.collect_list("cell").alias("cell"), F.collect_list("n").alias("n"))
    step = sc.broadcast((model.smoothed(), model.sizes(), model.free))
    model.tail = tail = written(seen.mapInArrow(_assign(step), "word bigint, n bigint, c int"), "brown-tail")
    tokens = rest.mapInArrow(_tokens(sc.broadcast(model.classes)), "key bigint, pos int, word bigint, before smallint, after smallint").join(tail, "word")
    placed = tokens.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("pos", "c", "n", "before", "after"))).alias("tokens"))
    model.placed = placed = written(placed, "brown-placed")
    cells = placed.mapInArrow(_cells(model.k), "cell bigint, n double").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    m = model.bigrams.ravel().copy()
    m[cells.column("cell").to_numpy()] += cells.column("n").to_numpy()
    model.bigrams = m.reshape(model.k, model.k)
    mass = np.zeros(model.k)
    for r in tail.groupBy("c").agg((F.sum("n") + F.count(F.lit(1)) / 2).alias("mass")).collect():
        mass[r.c] = r.mass
    model.finish(mass)
    return model


def neighbours(encoded: DataFrame, parts: int) -> DataFrame:
    """(w, right, rn, left, ln): each head word's neighbours of the head (int32) and their counts (int64), written once and read each round.

    parts: in how many pairs, and then words, are dealt out. What tasks exchange is already sorted or summed up, so rows hold many of them.
    """
    pairs = encoded.select("head").mapInArrow(_pairs(parts), "part int, pairs binary, n binary").repartitionById(parts, "part")
    sides = pairs.mapInArrow(_sides(parts), "part int, words binary, others binary, n binary, right boolean").repartitionById(parts, "part")
    return written(sides.mapInArrow(_near, "w int, right binary, rn binary, left binary, ln binary"), "brown-near")


def _head_scores(state):
    """(key, log) of what is between words of the head."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, transition, emission = state.value
        for b in batches:
            if not b.num_rows:
                continue
            seq, starts = sequences(b.column(3))
            known = seq >= 0
            own = np.where(known, seq, 0)
            c = classes[own]
            step = np.where(known, emission[own], 0.0)
            step[1:] += np.where(known[1:] & known[:-1], transition[c[:-1], c[1:]], 0.0)
            step[starts] = 0.0
            log = np.add.reduceat(np.rint(step * PARTS).astype(np.int64), starts)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(log)], ["key", "id", "n_tokens", "log"])

    return run


def _tail_scores(state):
    """(key, log) of what has a word outside of the head in it."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        transition, log_mass = state.value
        for b in batches:
            if not b.num_rows:
                continue
            row, before, c, n, after = steps(b)
            log = transition[before, c] + np.log(n + 0.5) - log_mass[c] + np.where(after >= 0, transition[c, after], 0.0)
            whole = np.zeros(b.num_rows, dtype=np.int64)
            np.add.at(whole, row, np.rint(log * PARTS).astype(np.int64))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(whole)], ["key", "log"])

    return run


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS, head: int = HEAD, classes: int = CLASSES, model: Model | None = None) -> DataFrame:
    """(doc_id, n_tokens, log_prob, perplexity) of every document, under the model of all of them."""
    spark = ready(docs.sparkSession)
    sc = spark.sparkContext
    model = model or train(docs, id_col, text_col, rounds, head, classes)
    kind = id_kind(docs, id_col)
    if model is None:
        return spark.createDataFrame([], f"{id_col} {kind}, n_tokens bigint, log_prob double, perplexity double")
    mine = model.encoded.select("key", "id", "n_tokens", "head").mapInArrow(_head_scores(sc.broadcast((model.classes, model.transition, model.emission))), f"key bigint, id {kind}, n_tokens bigint, log bigint")
    rest = model.placed.mapInArrow(_tail_scores(sc.broadcast((model.transition, model.log_mass))), "key bigint, log bigint").withColumnRenamed("log", "more")
    log = (F.col("log") + F.coalesce("more", F.lit(0))) / F.lit(float(PARTS))
    x = mine.join(rest, "key", "left").select("id", "n_tokens", log.alias("log"))
    per = F.when(F.col("n_tokens") > 0, F.round(F.exp(-F.col("log") / (F.col("n_tokens") + 1)), 6))
    return x.select(F.col("id").alias(id_col), "n_tokens", F.round("log", 6).alias("log_prob"), per.alias("perplexity"))
