"""SentencePiece encoding and decoding over a shared prefix trie.

A text is cut into marked words (a word with the mark that stands for the space before it). The distinct
marked words of a batch are sorted, which makes them the depth-first order of their trie; a word keeps the
forward state of the prefix that it shares with the one before and extends only its own rest. An automaton
over the reversed-suffix relation of the vocabulary gives, at each node, the pieces that end there.

* Unigram models: the forward state is the best score, as in Viterbi's algorithm.
* BPE models: a best score doesn't give the pieces that merging gives. There, a prefix has exactly one
  encoding, and it is the one whose neighbouring pieces would all stay apart when merged by themselves; so the
  forward state is the last piece of the prefix's encoding, and a piece may follow another if that pair is stable.
  The result is what the library gives, id for id.

A model is a file of the public format; it is read here without the library. Its path, on the driver, is a parameter; its
bytes (half a MB) go to every worker, which makes its tables once. No shuffle; a word is encoded once for each task.

Defined results:
* null text gives null ids; an empty text gives no ids; texts are encoded whole, however long;
* characters out of the vocabulary become byte pieces if the model has them, else the unknown id;
* decoding gives back the text, except that U+2581 comes back as a space, and unknown ids as U+2047 between spaces;
* ids of documents are whole numbers or, if of another type, strings; repeated rows are encoded each; an empty table gives an empty table; extra columns are ignored by `encode`.
"""

from __future__ import annotations

import hashlib
import re
import struct
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession

from cairn.llm.common import Columns, id_kind, lean, list_array, ready, slices

MARK = "▁"
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
WORDS = re.compile(r"\n[^ \n]*| *[^ \n]+| +")
#: A task forgets its words beyond so many, which bounds its memory and changes no result.
KEPT_WORDS = 300_000


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protocol buffer message."""

    def varint(i: int) -> tuple[int, int]:
        out = shift = 0
        while True:
            b = data[i]
            out |= (b & 127) << shift
            i, shift = i + 1, shift + 7
            if b < 128:
                return out, i

    i = 0
    while i < len(data):
        tag, i = varint(i)
        kind = tag & 7
        if kind == 0:
            value, i = varint(i)
        else:
            size = {1: 8, 5: 4}.get(kind)
            if size is None:
                size, i = varint(i)
            value, i = data[i : i + size], i + size
        yield tag >> 3, value


@dataclass
class Model:
    pieces: list[str]
    scores: list[float]
    kinds: list[int]
    bpe: bool = False
    add_mark: bool = True
    byte_ids: dict[int, int] = field(default_factory=dict)

    @staticmethod
    def parse(data: bytes) -> Model:
        out = Model([], [], [])
        for number, value in _fields(data):
            if number == 1:
                piece, score, kind = "", 0.0, NORMAL
                for n, v in _fields(value):
                    if n == 1:
                        piece = v.decode()
                    elif n == 2:
                        score = struct.unpack("<f", v)[0]
                    elif n == 3:
                        kind = v
                out.pieces.append(piece)
                out.scores.append(score)
                out.kinds.append(kind)
            elif number == 2:
                out.bpe = dict(_fields(value)).get(3, 1) == 2
            elif number == 3:
                spec = dict(_fields(value))
                if spec.get(2) or spec.get(4, 1) or not spec.get(5, 1):
                    raise ValueError("only models with the identity normaliser that keep white space are supported")
                out.add_mark = bool(spec.get(3, 1))
        out.byte_ids = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(out.pieces, out.kinds)) if k == BYTE}
        return out


class Encoder:
    """Encodes words by one pass over their sorted list."""

    def __init__(self, model: Model):
        self.model = model
        self.ids = {p: i for i, (p, k) in enumerate(zip(model.pieces, model.kinds)) if k in (NORMAL, USER) and p}
        self.unknown = next((i for i, k in enumerate(model.kinds) if k == UNKNOWN), 0)
        none: dict[str, int] = {}  # shared by all leaves
        self.goto: list[dict[str, int]] = [{}]
        ends: list[int] = [-1]
        for piece, i in self.ids.items():
            node = 0
            for ch in piece:
                nxt = self.goto[node].get(ch)
                if nxt is None:
                    if self.goto[node] is none:
                        self.goto[node] = {}
                    nxt = self.goto[node][ch] = len(self.goto)
                    self.goto.append(none)
                    ends.append(-1)
                node = nxt
            ends[node] = i
        # Failure links, breadth first; suffixes[node]: (length, id) of the pieces that end there, longest first.
        self.fail = [0] * len(self.goto)
        self.suffixes: list[tuple[tuple[int, int], ...]] = [()] * len(self.goto)
        queue = [(0, 0)]
        for node, depth in queue:
            up = self.suffixes[self.fail[node]] if node else ()
            self.suffixes[node] = (((depth, ends[node]),) if node and ends[node] >= 0 else ()) + up
            for ch, nxt in self.goto[node].items():
                f = self.fail[node]
                while node and f and ch not in self.goto[f]:
                    f = self.fail[f]
                self.fail[nxt] = self.goto[f].get(ch, 0) if node else 0
                queue.append((nxt, depth + 1))
        if model.bpe:
            scores = sorted({model.scores[i] for i in self.ids.values()}, reverse=True)
            place = {x: k for k, x in enumerate(scores)}
            self.level = {p: place[model.scores[i]] for p, i in self.ids.items()}
            self.rank = {p: r for r, p in enumerate(sorted(self.ids, key=lambda p: (len(p) > 1, -model.scores[self.ids[p]])))}
            self.halves: dict[str, tuple[str, str] | None] = {}
            self.whole = {i for p, i in self.ids.items() if len(p) == 1 or self.merged(p) == [p]}
            # With each piece, which pieces it may follow, as far as asked.
            after: dict[int, dict[int, bool]] = {i: {} for i in self.whole}
            self.suffixes = [tuple((n, i, after[i]) for n, i in s if i in self.whole) for s in self.suffixes]

    def step(self, node: int, ch: str) -> int:
        while node and ch not in self.goto[node]:
            node = self.fail[node]
        return self.goto[node].get(ch, 0)

    def merged(self, word: str) -> list[str]:
        """Plain merging: again and again the pair with the best score, the leftmost at a tie. By a heap: n log n."""
        parts = list(word)
        n, level = len(parts), self.level
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        pairs = {word[k : k + 2] for k in range(n - 1)}
        first = {p: level[p] * n for p in pairs if p in level}
        # Level of the score, then place, in one number. An entry holds while the pair at its place still makes its level.
        heap = [first[p] + k for k in range(n - 1) if (p := word[k : k + 2]) in first]
        heapify(heap)
        get = level.get
        while heap:
            now, k = divmod(heappop(heap), n)
            o = after[k]
            left = parts[k]
            if o >= n or not left or get(whole := left + parts[o]) != now:
                continue
            parts[k], parts[o] = whole, ""
            o = after[k] = after[o]
            if o < n:
                before[o] = k
                if (i := get(whole + parts[o])) is not None:
                    heappush(heap, i * n + k)
            if (b := before[k]) >= 0 and (i := get(parts[b] + whole)) is not None:
                heappush(heap, i * n + b)
        return [p for p in parts if p]

    def split(self, piece: str) -> tuple[str, str] | None:
        """The two parts of which merging makes the piece, None for a character."""
        if piece not in self.halves:
            if len(piece) == 1:
                self.halves[piece] = None
            else:
                last = [piece[:1], piece[1:]]
                parts = list(piece)
                while len(parts) > 1:
                    last = parts
                    k = max((k for k in range(len(parts) - 1) if parts[k] + parts[k + 1] in self.ids), key=lambda k: (self.model.scores[self.ids[parts[k] + parts[k + 1]]], -k))
                    parts = [*parts[:k], parts[k] + parts[k + 1], *parts[k + 2 :]]
                self.halves[piece] = (last[0], last[1])
        return self.halves[piece]

    def stays_apart(self, a: int, b: int) -> bool:
        """Whether merging the characters of pieces a and b ends with these two pieces.

        Walks both merge histories back from the end, the later merge first; at each moment the parts
        at the border must not have had a better merge than the one that comes next.
        """
        rank, left, right = self.rank, self.model.pieces[a], self.model.pieces[b]
        limit = len(rank) * 2
        while True:
            pair = rank.get(left + right)
            if pair is not None and 2 * pair < limit:
                return False
            ra = rank[left] if len(left) > 1 else -1
            rb = rank[right] if len(right) > 1 else -1
            if ra < 0 and rb < 0:
                return True
            # At equal rank the left one is merged first, so the right one is undone first.
            if ra > rb:
                limit, left = 2 * ra, self.split(left)[1]
            else:
                limit, right = 2 * rb + 1, self.split(right)[0]

    def fallback(self, ch: str) -> list[int]:
        if self.model.byte_ids:
            return [self.model.byte_ids[b] for b in ch.encode()]
        return [self.unknown]

    def encode_words(self, words: list[str]) -> dict[str, bytes]:
        """Ids (as int32 bytes) of each distinct word; spaces in words are marks already."""
        out: dict[str, bytes] = {}
        bpe, suffixes, goto, model = self.model.bpe, self.suffixes, self.goto, self.model
        scores, stays_apart = model.scores, self.stays_apart
        lowest = min((model.scores[i] for i in self.ids.values()), default=0.0) - 10.0
        # Per prefix length: automaton node, last piece (-1: out of vocabulary, -2: none), its length, score.
        nodes, last, size, score = [0], [-2], [0], [0.0]
        before = ""
        for word in sorted(words):
            if bpe and word.startswith(MARK * 2):  # runs of marks have pieces of equal score: merge plainly
                out[word] = array("i", [i for p in self.merged(word) for i in ([self.ids[p]] if p in self.ids else self.fallback(p))]).tobytes()
                continue
            top = min(len(word), len(before))
            shared = 0
            while shared < top and word[shared] == before[shared]:
                shared += 1
            del nodes[shared + 1 :], last[shared + 1 :], size[shared + 1 :], score[shared + 1 :]
            node, j = nodes[shared], shared
            for ch in word[shared:]:
                j += 1
                nxt = goto[node].get(ch)
                node = self.step(node, ch) if nxt is None else nxt
                nodes.append(node)
                if bpe:
                    for n, i, stable in suffixes[node]:
                        p = last[j - n]
                        if p < 0:
                            break
                        apart = stable.get(p)
                        if apart is None:
                            apart = stable[p] = stays_apart(p, i)
                        if apart:
                            break
                    else:
                        n, i = 1, -1
                    last.append(i)
                    size.append(n)
                else:
                    best, bi, bn = score[j - 1] + lowest, -1, 1
                    for n, i in suffixes[node]:
                        s = score[j - n] + scores[i]
                        if s > best or bi < 0 and n == 1:
                            best, bi, bn = s, i, n
                    last.append(bi)
                    size.append(bn)
                    score.append(best)
            before = word
            ids: list[int] = []
            while j:
                i = last[j]
                if i >= 0:
                    ids.append(i)
                else:
                    ids.extend(reversed(self.fallback(word[j - 1])))
                j -= size[j]
            ids.reverse()
            out[word] = array("i", ids).tobytes()
        return out

    def words(self, text: str) -> list:
        """The text's words: a str goes with a mark before it, unless it begins with a line break; a tuple has no mark."""
        if MARK in text:
            text = text.replace(MARK, " ")
        lines = text.replace("\n", " \n")
        if self.model.add_mark and text[:1] != " " and "  " not in lines:
            return lines.split(" ")
        return [x[1:] if x[0] == " " else x if x[0] == "\n" else (x,) for x in WORDS.findall((" " if self.model.add_mark else "") + text)]

    def encode_texts(self, texts: list[str | None], known: dict) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, number of ids of each)."""
        if len(known) > KEPT_WORDS:
            known.clear()
        cut = [self.words(t) if t else [] for t in texts]
        get = known.get
        found = [list(map(get, words)) for words in cut]
        new = {w for words, ids in zip(cut, found) if None in ids for w, i in zip(words, ids) if i is None}
        marked = {w: w[0] if isinstance(w, tuple) else w if w[:1] == "\n" else MARK + w.replace(" ", MARK) for w in new}
        ids = self.encode_words(list(set(marked.values())))
        for w, m in marked.items():
            known[w] = ids[m]
        parts = [b"".join(map(known.__getitem__, words)) if None in ids else b"".join(ids) for words, ids in zip(cut, found)]
        sizes = np.array([len(p) // 4 for p in parts], dtype=np.int64)
        return np.frombuffer(b"".join(parts), dtype=np.int32), sizes


class Decoder:
    def __init__(self, model: Model):
        self.add_mark = model.add_mark
        self.bytes = []
        for p, k in zip(model.pieces, model.kinds):
            if k == BYTE:
                self.bytes.append(bytes([int(p[3:5], 16)]))
            elif k == UNKNOWN:
                self.bytes.append(" ⁇ ".encode())
            elif k == CONTROL:
                self.bytes.append(b"")
            else:
                self.bytes.append(p.replace(MARK, " ").encode())

    def decode(self, ids: list[int]) -> str:
        out = b"".join(map(self.bytes.__getitem__, ids))
        if self.add_mark and out.startswith(b" "):
            out = out[1:]
        return out.decode(errors="replace")


@cache
def model(path: str) -> Model:
    with open(path, "rb") as f:
        return Model.parse(f.read())


#: Of the models of a worker's tasks, by their bytes.
_ENCODERS: dict[bytes, tuple[Encoder, Decoder]] = {}


def coders(data: bytes) -> tuple[Encoder, Decoder]:
    key = hashlib.sha256(data).digest()
    if key not in _ENCODERS:
        m = Model.parse(data)
        _ENCODERS[key] = Encoder(m), Decoder(m)
    return _ENCODERS[key]


def shipped(spark: SparkSession, path: str) -> Broadcast:
    """The model's file, read by the driver; executors get its bytes."""
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def _encode(data: Broadcast):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, dec = coders(data.value)
        known: dict[str, bytes] = {}
        for batch in batches:
            for part in slices(batch, 1):
                texts = part.column(1).to_pylist()
                ids, sizes = enc.encode_texts(texts, known)
                valid = np.array([t is not None for t in texts], dtype=bool)
                ends = np.cumsum(sizes)
                same = [None if t is None else dec.decode(ids[e - n : e].tolist()) == t.replace(MARK, " ") for t, e, n in zip(texts, ends, sizes)]
                counts = pa.array([int(n) if v else None for n, v in zip(sizes, valid)], type=pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), list_array(ids, sizes, pa.int32(), valid), counts, pa.array(same, type=pa.bool_())], ["doc_id", "ids", "n_ids", "round_trip"])

    return run


def encode(docs: DataFrame, path: str = MODEL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids, n_ids, round_trip): round_trip says that decoding the ids gave the text back."""
    spark = ready(docs.sparkSession)
    kind = id_kind(docs, id_col)
    c = Columns(docs)
    narrow = c.df.select(c[id_col].cast(kind).alias("doc_id"), c[text_col].cast("string").alias("text"))
    return narrow.mapInArrow(_encode(shipped(spark, path)), f"doc_id {kind}, ids array<int>, n_ids bigint, round_trip boolean").withColumnRenamed("doc_id", id_col)


def _decode(data: Broadcast):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dec = coders(data.value)[1]
        for batch in batches:
            texts = [None if x is None else dec.decode(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, type=pa.string())], ["doc_id", "text"])

    return run


def decode(encoded: DataFrame, path: str = MODEL, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, text) of encoded documents."""
    spark = ready(encoded.sparkSession)
    kind = id_kind(encoded, id_col)
    c = Columns(encoded)
    narrow = c.df.select(c[id_col].cast(kind).alias("doc_id"), c[ids_col].cast("array<int>").alias("ids"))
    return narrow.mapInArrow(_decode(shipped(spark, path)), f"doc_id {kind}, text string").withColumnRenamed("doc_id", id_col)
