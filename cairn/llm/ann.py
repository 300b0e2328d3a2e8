"""Approximate nearest neighbours: multiprobe p-stable hashing.

A table hashes a vector by M Gaussian projections cut into slots of width w = 2d. A query visits buckets of each table
in the order of their estimated success: the chance that a neighbour at the typical distance d, whose projections
differ from the query's by N(0, d^2), falls into the bucket. The perturbations of a query's own bucket, up to `REACH` slots
away in every projection, are enumerated with their chances, and it goes on in that order until the buckets visited
hold the calibrated share of the chance. That costs the same for a query whatever the number of vectors, and there is no cap on
candidates. Those of all tables are merged and ranked by exact distances.

Vectors go to parts by a hash of their bucket; a part has about `PART_ROWS` of them. A bucket of more than half of that
is split by a hash of the ids over several parts, so a hot bucket isn't one task's. Each query goes once to each part that
has some of its buckets, with their codes; a task keeps one part's vectors at a time and streams the queries past
it, and returns each query's k best. So memory depends on PART_ROWS, not on the input, and candidate pairs never become
rows. What the driver holds is the list of split buckets, at most one for each PART_ROWS / 2 vectors.

d is the median distance to the k-th neighbour within a sample of `SAMPLE` vectors (the smallest hashes of their ids), and the
share is what `TARGET` of the sample's neighbours need. The sample only sets these two numbers; every vector is indexed.
Its neighbours are farther than those among all, so what it asks for is rather too much than too little.

Queries are the rows of `queries`, or every vector. Defined results:
* null ids, null vectors, and vectors with a null, NaN or infinite entry or not of the dimension (the one given, else that of
  most vectors, the larger at a tie) are neither queries nor candidates; `rejected` lists them;
* a query isn't its own neighbour; rows that repeat an id are one vector (the least, if they differ);
* ties in distance go by id, however many there are; with fewer than k others, all that were visited come back;
* ids are whole numbers or, if of another type, strings; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import Columns, cut_lineage, id_kind, lean, list_array, ready

K, TABLES, PROJECTIONS, REACH, TARGET, SAMPLE, PART_ROWS, MOST_TASKS, SEED = 10, 2, 6, 2, 0.96, 4096, 16384, 20_000, 5
BLOCK = 128


def matrix(col: pa.Array) -> np.ndarray:
    """Rows of equal length as a matrix."""
    flat = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(col), -1)


def normal_cdf(z: np.ndarray) -> np.ndarray:
    """Abramowitz and Stegun 26.2.17, to 1e-7."""
    x = np.abs(z)
    t = 1 / (1 + 0.2316419 * x)
    tail = np.exp(-x * x / 2) / np.sqrt(2 * np.pi) * t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return np.where(z >= 0, 1 - tail, tail)


#: All perturbations of a bucket: a step for each projection.
STEPS = np.stack(np.meshgrid(*[np.arange(-REACH, REACH + 1)] * PROJECTIONS, indexing="ij"), axis=-1).reshape(-1, PROJECTIONS)
_PLACE = (2 * REACH + 1) ** np.arange(PROJECTIONS - 1, -1, -1)


class Hasher:
    def __init__(self, dim: int, d: float):
        rng = np.random.default_rng(SEED)
        self.a = rng.normal(size=(TABLES, PROJECTIONS, dim))
        self.b = rng.uniform(0, 1, size=(TABLES, PROJECTIONS))
        self.d, self.w, self.share = d, 2 * d, 1.0

    def project(self, x: np.ndarray, t: int) -> np.ndarray:
        """In slots: the integer part is the slot."""
        return (x @ self.a[t].T) / self.w + self.b[t]

    @staticmethod
    def pack(slots: np.ndarray, t: int) -> np.ndarray:
        """A code for each bucket: ten bits a projection and the table. Slots beyond are those at the edge."""
        s = np.clip(slots, -512, 511).astype(np.int64) + 512
        return (s << (10 * np.arange(PROJECTIONS))).sum(axis=-1) | (t << (10 * PROJECTIONS))

    def codes(self, x: np.ndarray, t: int) -> np.ndarray:
        return self.pack(np.clip(np.floor(self.project(x, t)), -512, 511), t)

    def chances(self, x: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray]:
        """(slots of each query, chance of each of STEPS, of a sum of 1)."""
        f = self.project(x, t)
        own = np.clip(np.floor(f), -512, 511)
        edges = own[:, :, None] + np.arange(-REACH, REACH + 2)
        p = np.maximum(np.diff(normal_cdf((edges - f[:, :, None]) * (self.w / self.d)), axis=2), 1e-12)
        chance = p[:, 0]
        for i in range(1, PROJECTIONS):
            chance = (chance[:, :, None] * p[:, i, None, :]).reshape(len(x), -1)
        return own.astype(np.int64), chance / chance.sum(axis=1, keepdims=True)

    def visits(self, x: np.ndarray, t: int) -> Iterator[np.ndarray]:
        """For each query, the codes of the buckets to visit, likeliest first."""
        for at in range(0, len(x), 64):
            own, chance = self.chances(x[at : at + 64], t)
            for slots, c in zip(own, chance):
                order = np.argsort(-c, kind="stable")
                n = int(np.searchsorted(np.cumsum(c[order]), self.share)) + 1
                codes = self.pack(slots + STEPS[order[:n]], t)
                # At the edge of the slots several perturbations are one bucket.
                yield codes[np.sort(np.unique(codes, return_index=True)[1])]

    def calibrate(self, x: np.ndarray, k: int) -> None:
        """Sets the share from a sample: for each true neighbour, what must be visited to meet it in the luckier table."""
        if len(x) < 2:
            return
        near = np.argsort(squares(x), axis=1, kind="stable")[:, : min(k, len(x) - 1)]
        needed = np.ones(near.shape)
        for t in range(TABLES):
            slots = np.clip(np.floor(self.project(x, t)), -512, 511).astype(np.int64)
            for q in range(0, len(near), 64):
                own, chance = self.chances(x[q : q + 64], t)
                for i, (mine, c) in enumerate(zip(own, chance), q):
                    step = slots[near[i]] - mine + REACH
                    there = ((step >= 0) & (step <= 2 * REACH)).all(axis=1)
                    if there.any():
                        order = np.argsort(-c, kind="stable")
                        before = np.empty(len(c))
                        before[order] = np.concatenate([[0.0], np.cumsum(c[order])[:-1]])
                        needed[i, there] = np.minimum(needed[i, there], before[step[there] @ _PLACE])
        self.share = float(np.quantile(needed, TARGET, method="higher")) + 1e-9


def squares(x: np.ndarray) -> np.ndarray:
    """Squared distances of the first 512 vectors to all, infinite to themselves."""
    d2 = (x * x).sum(axis=1)[:512, None] + (x * x).sum(axis=1)[None, :] - 2 * x[:512] @ x.T
    d2[np.arange(len(d2)), np.arange(len(d2))] = np.inf
    return d2


def _codes(hasher: Hasher):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = matrix(b.column(1))
                for t in range(TABLES):
                    yield pa.RecordBatch.from_arrays([b.column(0), pa.array(hasher.codes(x, t))], ["id", "code"])

    return run


def mixed(code: np.ndarray, salt: np.ndarray | int) -> np.ndarray:
    """A 63-bit hash of a bucket and the number of its split."""
    h = (code.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15) * np.asarray(salt, dtype=np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    return ((h ^ (h >> np.uint64(29))) >> np.uint64(1)).astype(np.int64)


ROUTED = ["part", "kind", "id", "codes", "vec"]


def _place(hasher: Hasher, hot, parts: int):
    """Vectors to (part, 0, id, [code], vec), once for each table."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, splits = hot.value
        for b in batches:
            if not b.num_rows:
                continue
            x, h = matrix(b.column(1)), b.column(2).to_numpy(zero_copy_only=False)
            for t in range(TABLES):
                own = hasher.codes(x, t)
                k = np.minimum(np.searchsorted(codes, own), max(len(codes) - 1, 0))
                n = np.where(codes[k] == own, splits[k], 1) if len(codes) else np.ones(len(own), dtype=np.int64)
                part = mixed(own, (h & 0x7FFFFFFF) % n) % parts
                yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(np.zeros(len(x), dtype=np.int32)), b.column(0), list_array(own, np.ones(len(x), dtype=np.int64), pa.int64()), b.column(1)], ROUTED)

    return run


def _route(hasher: Hasher, hot, parts: int):
    """Queries to (part, 1, id, codes to visit there, vec)."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot_codes, splits = hot.value
        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK):
                b = whole.slice(at, BLOCK)
                x = matrix(b.column(1))
                wanted = [np.concatenate(c) for c in zip(*[hasher.visits(x, t) for t in range(TABLES)])]
                row = np.repeat(np.arange(len(x)), [len(w) for w in wanted])
                code = np.concatenate(wanted)
                part = mixed(code, 0) % parts
                if len(hot_codes):
                    k = np.minimum(np.searchsorted(hot_codes, code), len(hot_codes) - 1)
                    more = np.where(hot_codes[k] == code, splits[k] - 1, 0)
                    again = np.repeat(np.arange(len(code)), more)
                    salt = np.arange(len(again)) - np.repeat(np.cumsum(more) - more, more) + 1
                    row, code, part = np.concatenate([row, row[again]]), np.concatenate([code, code[again]]), np.concatenate([part, mixed(code[again], salt) % parts])
                order = np.lexsort((code, part, row))
                row, code, part = row[order], code[order], part[order]
                once = np.concatenate([[True], (row[1:] != row[:-1]) | (code[1:] != code[:-1]) | (part[1:] != part[:-1])])
                row, code, part = row[once], code[once], part[once]
                starts = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (part[1:] != part[:-1])]))
                sizes = np.diff(np.append(starts, len(row)))
                own = pa.array(row[starts])
                yield pa.RecordBatch.from_arrays([pa.array(part[starts]), pa.array(np.ones(len(starts), dtype=np.int32)), b.column(0).take(own), list_array(code, sizes, pa.int64()), b.column(1).take(own)], ROUTED)

    return run


class Part:
    """One part's vectors by bucket."""

    def __init__(self, data: list[tuple[np.ndarray, np.ndarray, np.ndarray]]):
        code, ids, x = (np.concatenate(z) for z in zip(*data))
        order = np.argsort(code, kind="stable")
        code, self.ids, self.x = code[order], ids[order], x[order]
        self.codes, first = np.unique(code, return_index=True)
        self.first = np.append(first, len(code))
        self.x2 = (self.x * self.x).sum(axis=1)

    def best(self, b: pa.RecordBatch, k: int) -> pa.RecordBatch | None:
        """(id, dist, who): the k best of the visited for each query; None if nothing was there."""
        qid, q = b.column(2).to_numpy(zero_copy_only=False), matrix(b.column(4))
        lists = b.column(3)
        code, row = lists.flatten().to_numpy(), np.repeat(np.arange(len(q)), np.diff(lists.offsets.to_numpy()))
        at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        there = self.codes[at] == code
        at, row = at[there], row[there]
        if not len(at):
            return None
        order = np.argsort(at, kind="stable")
        at, row = at[order], row[order]
        units = np.split(np.arange(len(at)), np.flatnonzero(np.diff(at)) + 1)
        # Columns for the visited buckets only.
        sizes = [int(self.first[at[u[0]] + 1] - self.first[at[u[0]]]) for u in units]
        cols = np.concatenate([np.arange(self.first[at[u[0]]], self.first[at[u[0]] + 1]) for u in units])
        d2 = np.full((len(q), len(cols)), np.inf)
        q2, lo = (q * q).sum(axis=1), 0
        for u, n in zip(units, sizes):
            r, c = row[u], cols[lo : lo + n]
            d2[r, lo : lo + n] = q2[r][:, None] + self.x2[c][None, :] - 2 * (q[r] @ self.x[c].T)
            lo += n
        d2[qid[:, None] == self.ids[cols][None, :]] = np.inf
        # Beyond the k-th best by more than rounding explains, a candidate can't be among the k.
        error = 4 * (q.shape[1] + 4) * np.finfo(np.float64).eps * (q2 + self.x2.max())
        most = k * TABLES  # a vector is here once for each table
        limit = (np.partition(d2, most - 1, axis=1)[:, most - 1] if d2.shape[1] > most else np.full(len(q), np.inf)) + error
        r, c = np.nonzero((d2 <= limit[:, None]) & np.isfinite(d2))
        del d2
        who = self.ids[cols[c]]
        exact = np.sqrt(((self.x[cols[c]] - q[r]) ** 2).sum(axis=1))
        names = np.unique(who, return_inverse=True)[1]
        order = np.lexsort((names, exact, r))
        r, exact, who = r[order], exact[order], who[order]
        ok = np.concatenate([[True], (r[1:] != r[:-1]) | (who[1:] != who[:-1])]) if len(r) else np.zeros(0, dtype=bool)
        r, exact, who = r[ok], exact[ok], who[ok]
        place = np.arange(len(r)) - np.searchsorted(r, r, side="left")
        r, exact, who = r[place < k], exact[place < k], who[place < k]
        n = np.bincount(r, minlength=len(q))
        return pa.RecordBatch.from_arrays([b.column(2), list_array(exact, n, pa.float64()), list_array(who, n, b.column(2).type)], ["id", "dist", "who"])


def _search(k: int):
    """Parts in order, each one's vectors before its queries, to (id, dist, who)."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, data, part = -1, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            of, kind = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cuts = np.flatnonzero((of[1:] != of[:-1]) | (kind[1:] != kind[:-1])) + 1
            for a, e in zip(np.append(0, cuts), np.append(cuts, len(of))):
                if of[a] != now:
                    now, data, part = int(of[a]), [], None
                if kind[a] == 0:
                    b = batch.slice(a, e - a)
                    data.append((b.column(3).flatten().to_numpy(), b.column(2).to_numpy(zero_copy_only=False), matrix(b.column(4))))
                    continue
                if part is None and data:
                    part, data = Part(data), []
                for i in range(a, e, BLOCK):
                    if part is not None and (out := part.best(batch.slice(i, min(BLOCK, e - i)), k)) is not None:
                        yield out

    return run


def typical_distance(x: np.ndarray, k: int) -> float:
    """Median distance to the k-th neighbour within a sample."""
    if len(x) < 2:
        return 1.0
    d2 = squares(x)
    kth = np.sort(d2, axis=1)[:, min(k, len(x) - 1) - 1]
    d = float(np.sqrt(max(np.median(kth), 0.0)))
    return d if d > 1e-9 else 1.0


def _good(vec: str = "vec"):
    return F.col(vec).isNotNull() & (F.size(vec) > 0) & ~F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))


def dimension(vectors: DataFrame, vector_col: str = "embedding") -> int | None:
    """That of most vectors; the larger at a tie."""
    c = Columns(vectors)
    sizes = c.df.select(c[vector_col].cast("array<float>").alias("vec")).where(_good()).groupBy(F.size("vec").alias("dim")).agg(F.count(F.lit(1)).alias("n"))
    row = sizes.agg(F.max(F.struct("n", "dim"))["dim"].alias("dim")).first()
    return row.dim


def rejected(vectors: DataFrame, dim: int | None = None, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, reason) of the rows that are neither queries nor candidates: no_id, no_vector, bad_entry, other_dimension."""
    c = Columns(vectors)
    dim = dimension(vectors, vector_col) if dim is None else dim
    v = c.df.select(c[id_col].alias(id_col), c[vector_col].cast("array<float>").alias("vec"))
    reason = F.when(F.col(id_col).isNull(), "no_id").when(F.col("vec").isNull() | (F.size("vec") == 0), "no_vector").when(~_good(), "bad_entry")
    reason = reason.when(F.size("vec") != F.lit(dim), "other_dimension")
    return v.select(id_col, reason.alias("reason")).where("reason is not null")


def neighbours(vectors: DataFrame, queries: DataFrame | None = None, k: int = K, dim: int | None = None, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, neighbour_id, rank, distance): the k nearest of those visited, for each query."""
    spark = ready(vectors.sparkSession)
    kind = id_kind(vectors, id_col)
    dim = dimension(vectors, vector_col) if dim is None else dim
    if dim is None:
        return spark.createDataFrame([], f"{id_col} {kind}, neighbour_id {kind}, rank bigint, distance double")

    def clean(df: DataFrame) -> DataFrame:
        c = Columns(df)
        x = c.df.select(c[id_col].cast(kind).alias("id"), c[vector_col].cast("array<float>").alias("vec")).where(F.col("id").isNotNull() & _good())
        return cut_lineage(x.where(F.size("vec") == dim).groupBy("id").agg(F.min("vec").alias("vec")).select("id", "vec", F.xxhash64("id").alias("h")))

    v = clean(vectors)
    q = v if queries is None else clean(queries)
    # The smallest hashes are a uniform sample, the same at every run.
    sample = v.orderBy("h", "id").limit(SAMPLE).toArrow()
    if not sample.num_rows:
        return spark.createDataFrame([], f"{id_col} {kind}, neighbour_id {kind}, rank bigint, distance double")
    sampled = matrix(sample.column("vec").combine_chunks())
    hasher = Hasher(dim, typical_distance(sampled, k))
    hasher.calibrate(sampled, k)
    full = v.mapInArrow(_codes(hasher), f"id {kind}, code bigint").groupBy("code").agg(F.count(F.lit(1)).alias("n"))
    hot = full.where(F.col("n") > PART_ROWS // 2).orderBy("code").toArrow()
    splits = -(-hot.column("n").to_numpy() // (PART_ROWS // 2))
    shared = spark.sparkContext.broadcast((hot.column("code").to_numpy(), splits))
    parts = -(-v.count() * TABLES // PART_ROWS)
    schema = f"part bigint, kind int, id {kind}, codes array<bigint>, vec array<float>"
    routed = v.mapInArrow(_place(hasher, shared, parts), schema).unionByName(q.mapInArrow(_route(hasher, shared, parts), schema))
    tasks = min(parts, MOST_TASKS)
    routed = routed.repartitionById(tasks, (F.col("part") % tasks).cast("int")).sortWithinPartitions("part", "kind")
    best = routed.mapInArrow(_search(k), f"id {kind}, dist array<double>, who array<{kind}>")
    merged = best.groupBy("id").agg(F.flatten(F.collect_list(F.arrays_zip("dist", "who"))).alias("near"))
    merged = merged.select("id", F.slice(F.array_sort(F.array_distinct("near")), 1, k).alias("near"))
    out = merged.select("id", F.posexplode("near").alias("p", "x"))
    return out.select(F.col("id").alias(id_col), F.col("x.who").alias("neighbour_id"), (F.col("p") + 1).cast("bigint").alias("rank"), F.col("x.dist").alias("distance"))
