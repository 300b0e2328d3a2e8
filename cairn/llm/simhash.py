"""SimHash near-duplicates by covering locality-sensitive hashing.

Each document has `PRINTS` independent 64-bit SimHash fingerprints of its words. Two documents are
near-duplicates when one of the fingerprints differs in at most `radius` bits; groups are the
connected components of that relation.

Candidates come from the covering construction of Pagh (2016): every bit position gets a random
vector of radius + 1 bits, and for every nonzero vector v of that length there is a table whose mask
keeps the positions whose vector has an odd product with v. Any `radius` positions span a space of
at most `radius` dimensions, so some v is orthogonal to all of them and its mask drops exactly what
differs: every pair within the radius meets in one of the 2^(radius+1) - 1 tables. There is no
false negative, whatever the data.

What moves: one row of 12 bytes or so for each table and distinct fingerprint; texts never move, and equal fingerprints are
one row, so thousands of copies cost as much as one.
Within a bucket a search from each fingerprint visits only those not reached yet, which keeps connectivity exactly and
makes a bucket of m copies of one text cost O(m) comparisons rather than O(m^2).

Features are the words of a text, weighted by the root of their count and by the square of their length up to four letters:
function words, which would make all texts of one language alike, are short. So every word counts, in texts of any length.

Defined results:
* null, empty or white-space-only texts have no fingerprint and match nothing;
* a text without any word (only signs) has the hash of its characters as fingerprint, so that exact
  copies match and nothing else does;
* repeated rows (same doc_id and text) are one document: they never show up as a pair with themselves,
  and `drop_duplicates` keeps one of them; rows with a null doc_id are left alone;
* ties: the smallest doc_id of a group is the one that stays; an empty table gives an empty result;
* ids are whole numbers or, if of another type, strings;
* extra columns are ignored by `duplicates` and kept by `drop_duplicates`.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from cairn.llm.common import Columns, cut_lineage, id_kind, lean, ready, slices

#: Four fingerprints with a radius of 5 have as many tables as two with 6 (252), and find more of the near copies.
RADIUS, PRINTS = 5, 4
#: So many ids (16 bytes each) are broadcast to drop documents; more of them are joined by shuffle.
BROADCAST_IDS = 2_000_000
WORDS = re.compile(r"\w+")


def masks(radius: int, seed: int = 7) -> np.ndarray:
    """The 2^(radius+1) - 1 masks of 64 bits."""
    dim = radius + 1
    if dim <= 6:
        codes = np.tile(np.arange(1 << dim), 64 >> dim)
    elif dim == 7:  # a constant bit and all of the other six: every mask but one keeps 32 positions
        codes = np.arange(64) | 64
    else:
        codes = np.random.default_rng(seed).choice(1 << dim, 64, replace=False)
    out = []
    for v in range(1, 1 << dim):
        keep = [bin(int(c) & v).count("1") & 1 for c in codes]
        out.append(sum(b << i for i, b in enumerate(keep)))
    return np.array(out, dtype=np.uint64)


def popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def fingerprints(texts: list[str | None], prints: int = PRINTS) -> tuple[np.ndarray, np.ndarray]:
    """(valid, prints): a uint64 row for each text."""
    n = len(texts)
    out, valid = np.zeros((n, prints), dtype=np.uint64), np.zeros(n, dtype=bool)
    known: dict[str, int] = {}
    cols: list[int] = []
    counts: list[int] = []
    sizes: list[int] = []
    rows: list[int] = []
    for i, text in enumerate(texts):
        if text is None or not text.strip():
            continue
        valid[i] = True
        found = Counter(WORDS.findall(text.lower()))
        if not found:
            out[i] = [xxhash.xxh3_64_intdigest(text, seed=99 + p) for p in range(prints)]
            continue
        rows.append(i)
        sizes.append(len(found))
        cols.extend([known.setdefault(w, len(known)) for w in found])
        counts.extend(found.values())
    if rows:
        digest = b"".join([b"".join([xxhash.xxh3_64_digest(w, seed=p) for p in range(prints)]) for w in known])
        bits = np.unpackbits(np.frombuffer(digest, dtype=np.uint8).reshape(-1, 8 * prints), axis=1)
        signs = bits.astype(np.int16) * 2 - 1
        # Whole numbers, so that the sum doesn't depend on its order.
        at = np.array(cols, dtype=np.int32)
        length = np.array([min(len(w), 4) ** 2 for w in known], dtype=np.int32)
        weight = np.floor(np.sqrt(np.array(counts, dtype=np.float64)) * 16).astype(np.int32) * length[at]
        ends = np.cumsum(sizes)
        sums = np.empty((len(rows), 64 * prints), dtype=np.int32)
        part = 0
        while part < len(rows):  # about 16,000 features at a time, 8 MB
            begin = int(ends[part - 1]) if part else 0
            last = max(part + 1, int(np.searchsorted(ends, begin + 16_000, side="right")))
            end = int(ends[last - 1])
            starts = np.concatenate([[0], ends[part : last - 1] - begin])
            sums[part:last] = np.add.reduceat(signs[at[begin:end]] * weight[begin:end, None], starts, axis=0)
            part = last
        packed = np.packbits(sums > 0, axis=1)
        out[rows] = packed.view(">u8").astype(np.uint64).reshape(-1, prints)
    return valid, out


def _prints(prints: int):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                valid, out = fingerprints(part.column(1).to_pylist(), prints)
                ids = part.column(0).filter(pa.array(valid))
                yield pa.RecordBatch.from_arrays([ids, *[pa.array(out[valid, p].view(np.int64)) for p in range(prints)]], ["id", *[f"p{p}" for p in range(prints)]])

    return run


def links_in_run(values: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Pairs within the radius that connect what all such pairs would connect."""
    left, out = values, []
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            x = queue.pop()
            near = popcount(left ^ x) <= radius
            if near.any():
                hit = left[near]
                out.extend((int(x), int(y)) for y in hit)
                queue.extend(hit)
                left = left[~near]
    return out


def _links(kept: np.ndarray, radius: int):
    """Rows (t, p) of whole buckets to pairs (a, b) of fingerprints, a < b as signed numbers."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ts, ps = [], []
        for b in batches:
            ts.append(b.column(0).to_numpy(zero_copy_only=False).astype(np.int16))
            ps.append(b.column(1).to_numpy(zero_copy_only=False).view(np.uint64))
        if not ts:
            return
        t, p = np.concatenate(ts), np.concatenate(ps)
        del ts, ps
        key = (p & kept[t % len(kept)]) ^ (t.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        order = np.argsort(key, kind="stable")
        key, p, t = key[order], p[order], t[order]
        same = np.flatnonzero((key[1:] == key[:-1]) & (t[1:] == t[:-1]))
        if not len(same):
            return
        found: list[np.ndarray] = []
        breaks = np.flatnonzero(np.diff(same) > 1)
        first, last = np.concatenate([same[:1], same[breaks + 1]]), np.concatenate([same[breaks], same[-1:]]) + 1
        two = last - first == 1
        a, b = p[first[two]], p[last[two]]
        near = popcount(a ^ b) <= radius
        found.append(np.stack([a[near], b[near]], axis=1))
        for f, e in zip(first[~two], last[~two]):
            pairs = links_in_run(p[f : e + 1], radius)
            if pairs:
                found.append(np.array(pairs, dtype=np.uint64))
        pairs = np.concatenate(found).view(np.int64)
        pairs = np.unique(np.sort(pairs, axis=1), axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], ["a", "b"])

    return run


def components(edges: DataFrame) -> DataFrame:
    """(v, root) for the vertices of edges (a, b) but the roots: root is the least vertex of a component.

    Alternating large-star and small-star steps (Kiveris et al. 2014): about log n rounds, two
    aggregations each, on edges only. Each round is checkpointed, so a lost executor costs no more
    than that round.
    """

    def star(df: DataFrame, large: bool) -> DataFrame:
        if large:
            both = df.union(df.select(F.col("b").alias("a"), F.col("a").alias("b")))
        else:
            both = df.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = both.groupBy("a").agg(F.min("b").alias("lo")).withColumn("lo", F.least("lo", "a"))
        x = both.join(least, "a")
        if large:
            return x.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("lo").alias("b")).distinct()
        return x.where(F.col("b") != F.col("lo")).select(F.col("b").alias("a"), F.col("lo").alias("b")).union(least.where(F.col("a") != F.col("lo")).select("a", F.col("lo").alias("b"))).distinct()

    edges = cut_lineage(edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = None
    while True:
        edges = cut_lineage(star(star(edges, True), False))
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen:
            return edges.select(F.col("a").alias("v"), F.col("b").alias("root"))
        seen = now


def duplicates(docs: DataFrame, radius: int = RADIUS, prints: int = PRINTS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, duplicate_of): every document of a group but the one that stays, and that one."""
    ready(docs.sparkSession)
    kind = id_kind(docs, id_col)
    c = Columns(docs)
    narrow = c.df.select(c[id_col].cast(kind).alias("id"), c[text_col].cast("string").alias("text")).where("id is not null")
    names = [f"p{p}" for p in range(prints)]
    fp = cut_lineage(narrow.mapInArrow(_prints(prints), f"id {kind}, " + ", ".join(f"{n} bigint" for n in names)))
    kept = masks(radius)
    tables = len(kept)
    entries = None
    for k, n in enumerate(names):
        one = fp.select(F.col(n).alias("p")).distinct().select(F.explode(F.sequence(F.lit(k * tables), F.lit((k + 1) * tables - 1))).alias("t"), "p")
        entries = one if entries is None else entries.union(one)
    signed = F.array(*[F.lit(int(m)) for m in kept.view(np.int64)])
    whole = entries.repartition(F.col("t"), F.col("p").bitwiseAND(F.get(signed, F.col("t") % F.lit(tables))))
    links = whole.mapInArrow(_links(kept, radius), "a bigint, b bigint").distinct()
    return cut_lineage(_groups(fp, links, names)).withColumnRenamed("doc_id", id_col)


def _groups(fp: DataFrame, links: DataFrame, names: list[str]) -> DataFrame:
    """From links between fingerprints to documents: a fingerprint stands for its least document."""
    least = [fp.groupBy(n).agg(F.min("id").alias("lo")) for n in names]
    links = cut_lineage(links)
    edges = None
    for n, lo in zip(names, least):
        own = fp.join(lo, n).where(F.col("id") != F.col("lo")).select(F.col("id").alias("a"), F.col("lo").alias("b"))
        a = lo.select(F.col(n).alias("a"), F.col("lo").alias("ia"))
        b = lo.select(F.col(n).alias("b"), F.col("lo").alias("ib"))
        far = links.join(a, "a").join(b, "b").select(F.col("ia").alias("a"), F.col("ib").alias("b"))
        edges = own.union(far) if edges is None else edges.union(own).union(far)
    return components(edges).select(F.col("v").alias("doc_id"), F.col("root").alias("duplicate_of"))


def drop_duplicates(docs: DataFrame, radius: int = RADIUS, prints: int = PRINTS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents, with one of each group: all columns stay."""
    c = Columns(docs)
    kind = id_kind(docs, id_col)
    gone = duplicates(docs, radius, prints, id_col, text_col).select(F.col(id_col).alias("x_id"))
    if gone.count() <= BROADCAST_IDS:
        gone = F.broadcast(gone)
    rest = c.df.join(gone, c[id_col].cast(kind) == F.col("x_id"), "left_anti")
    # Rows that repeat a doc_id with the same text are one document.
    narrow = c.df.select(c[id_col].alias("x_id"), F.xxhash64(c[text_col]).alias("x_h")).where("x_id is not null")
    again = cut_lineage(narrow.groupBy("x_id", "x_h").agg(F.count(F.lit(1)).alias("x_n")).where("x_n > 1").select("x_id").distinct())
    if again.isEmpty():
        return c.restore(rest)
    w = W.partitionBy(c[id_col], F.xxhash64(c[text_col])).orderBy(F.xxhash64(*rest.columns))
    once = rest.join(again, c[id_col] == F.col("x_id"), "left_semi").withColumn("x_rn", F.row_number().over(w)).where("x_rn = 1").drop("x_rn")
    return c.restore(rest.join(again, c[id_col] == F.col("x_id"), "left_anti").unionByName(once))
