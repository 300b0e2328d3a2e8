"""Mixing sources to target weights.

Every document gets a hash-random key. Within its source, documents are ordered by key, and prefix sums
of their token counts say where the source's budget ends: budget = weight share of the total. A source
with fewer tokens than its budget repeats: whole epochs first, then the beginning of the order again.

The prefix sums are distributed. Keys are uniform, so the first hex digits of the key cut every source
into ranges of equal size, the hot source as well; sums per range, their prefix sums (one small row for
each source and range) and a running sum within each range add up to the exact position of each document.
Only ids and numbers move, never texts: `mix_documents` turns the result into one cut key for each source.

The document in which a budget ends is taken in part; `take_tokens` is the part of it within the budget, so that
take_tokens of a source sum to its budget exactly. `mix_documents` cuts that document's text behind this part.

Defined results:
* tokens are words between white space; null or empty texts have none and are never drawn;
* a null source is a source like others; a source without tokens gets nothing, and its share goes unused;
* rows that repeat a doc_id get the same key; the order is by key, doc_id, tokens, so rows that tie in all
  of these are interchangeable; a null doc_id has the key of the empty string;
* ids are whole numbers or, if of another type, strings; an empty table gives an empty mixture; extra columns are ignored by `mixture`, kept by `mix_documents`;
* a weight of 0 drops the source; sources without a given weight have weight 1.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from cairn.llm.common import Columns, cut_lineage, id_kind

SEED = "mix-1"
#: Production weights: the hot source is asked for less than it has, small ones for more. Others weigh 1.
WEIGHTS: dict[str, float] = {"src0": 4.0, "src1": 2.0, "src2": 2.0, "src3": 0.5}


def _tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit("[^ \\n\\t\\r]+")), F.lit(0)).cast("bigint")


def _weight(source: Column, weights: dict[str, float]) -> Column:
    out = F.lit(1.0)
    for name, w in weights.items():
        out = F.when(source == name, F.lit(float(w))).otherwise(out)
    return out


def _keyed(c: Columns, id_col: str, text_col: str, source_col: str, seed: str) -> DataFrame:
    doc_id = c[id_col].cast(id_kind(c.df, c.at(id_col)))
    key = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit(""))))
    return c.df.select(doc_id.alias("doc_id"), c[source_col].cast("string").alias("source"), key.alias("mix_key"), _tokens(c[text_col]).alias("n_tokens"))


def placed(keyed: DataFrame) -> DataFrame:
    """Adds `before`: the tokens of the source that come before the document."""
    x = keyed.withColumn("r", F.conv(F.substring("mix_key", 1, 3), 16, 10).cast("int"))
    sums = x.groupBy("source", "r").agg(F.sum("n_tokens").alias("s"))
    ahead = W.partitionBy("source").orderBy("r").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select(F.col("source").alias("s_source"), F.col("r").alias("s_r"), F.coalesce(F.sum("s").over(ahead), F.lit(0)).alias("ahead"))
    within = W.partitionBy("source", "r").orderBy("mix_key", "doc_id", "n_tokens").rowsBetween(W.unboundedPreceding, -1)
    x = x.withColumn("inner", F.coalesce(F.sum("n_tokens").over(within), F.lit(0)))
    x = x.join(sums, F.col("source").eqNullSafe(F.col("s_source")) & (F.col("r") == F.col("s_r")))
    return x.select("doc_id", "source", "mix_key", "n_tokens", (F.col("ahead") + F.col("inner")).alias("before"))


def budgets(keyed: DataFrame, weights: dict[str, float], total_tokens: int | None) -> DataFrame:
    """(b_source, own, budget): tokens that the source has and is to give."""
    own = keyed.groupBy("source").agg(F.sum("n_tokens").alias("own")).withColumn("w", _weight(F.col("source"), weights))
    every = own.agg(F.sum("w").alias("sw"), F.sum("own").alias("all"))
    total = F.col("all") if total_tokens is None else F.lit(int(total_tokens))
    return own.crossJoin(every).where("own > 0").select(F.col("source").alias("b_source"), "own", F.floor(total * F.col("w") / F.col("sw")).cast("bigint").alias("budget"))


def _draws(keyed: DataFrame, weights: dict[str, float], total_tokens: int | None) -> DataFrame:
    x = placed(keyed.where("n_tokens > 0")).join(budgets(keyed, weights, total_tokens), F.col("source").eqNullSafe(F.col("b_source")))
    x = x.withColumn("epochs", F.ceil((F.col("budget") - F.col("before")) / F.col("own")).cast("bigint"))
    return x.where("budget > before")


def mixture(docs: DataFrame, weights: dict[str, float] | None = None, total_tokens: int | None = None, seed: str = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, source, epoch, n_tokens, start_token, take_tokens): a row for each time a document is drawn.

    start_token is the place within the source's part of the mixture.
    """
    keyed = cut_lineage(_keyed(Columns(docs), id_col, text_col, source_col, seed))
    x = _draws(keyed, WEIGHTS if weights is None else weights, total_tokens)
    x = x.withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("epochs") - 1)))
    start = F.col("epoch") * F.col("own") + F.col("before")
    return x.select(F.col("doc_id").alias(id_col), F.col("source").alias(source_col), "epoch", "n_tokens", start.alias("start_token"), F.least("n_tokens", F.col("budget") - start).alias("take_tokens"))


def _cut(text: Column, tokens: Column) -> Column:
    """The text up to the end of its first tokens."""
    pieces = F.regexp_extract_all(text, F.lit("[ \\n\\t\\r]*[^ \\n\\t\\r]+"), F.lit(0))
    return F.array_join(F.slice(pieces, F.lit(1), tokens.cast("int")), "")


def mix_documents(docs: DataFrame, weights: dict[str, float] | None = None, total_tokens: int | None = None, seed: str = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The documents of the mixture with all their columns, one row for each time they are drawn.

    Each source's plan is one row: whole epochs, the key of the last document of the last, partial one, and how much of
    it is taken. It joins to the documents by source, so that texts stay where they are. Where several rows tie with that document, a
    window over these alone says which of them are still within the budget.
    """
    c = Columns(docs)
    kind = id_kind(docs, id_col)
    keyed = cut_lineage(_keyed(c, id_col, text_col, source_col, seed))
    x = _draws(keyed, WEIGHTS if weights is None else weights, total_tokens)
    tied = x.groupBy("source", "epochs", "mix_key", "doc_id", "n_tokens").agg(F.count(F.lit(1)).alias("ties"), F.max("before").alias("before"), F.first("own").alias("own"), F.first("budget").alias("budget"))
    last = tied.groupBy("source").agg(F.max(F.struct("epochs", "mix_key", "doc_id", "n_tokens", "ties", "before", "own", "budget")).alias("l"))
    plan = last.select(
        F.col("source").alias("p_source"),
        F.col("l.epochs").alias("p_epochs"),
        F.struct(F.col("l.mix_key").alias("k"), F.col("l.doc_id").alias("i"), F.col("l.n_tokens").alias("n")).alias("p_last"),
        F.col("l.ties").alias("p_ties"),
        F.least(F.col("l.n_tokens"), F.col("l.budget") - (F.col("l.epochs") - 1) * F.col("l.own") - F.col("l.before")).alias("p_take"),
    )
    plan = cut_lineage(plan)
    several = not plan.where("p_ties > 1").isEmpty() or not _ties_beyond(keyed, plan).isEmpty()
    d = c.df.withColumns({"m_source": c[source_col].cast("string"), "m_id": c[id_col].cast(kind), "m_n": _tokens(c[text_col])})
    d = d.withColumn("m_key", F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("m_id").cast("string"), F.lit(""))))).where("m_n > 0")
    if plan.count() <= BROADCAST_SOURCES:
        plan = F.broadcast(plan)
    d = d.join(plan, F.col("m_source").eqNullSafe(F.col("p_source")))
    own = F.struct(F.col("m_key").alias("k"), F.col("m_id").alias("i"), F.col("m_n").alias("n"))
    same = own.eqNullSafe(F.col("p_last"))
    d = d.withColumn("m_last", F.when(same, 0).when(own > F.col("p_last"), 1).otherwise(-1)).withColumn("m_rank", F.lit(1).cast("bigint"))
    if several:
        rank = F.row_number().over(W.partitionBy("p_source").orderBy(F.xxhash64(*c.df.columns)))
        d = d.where("m_last <> 0").unionByName(d.where("m_last = 0").withColumn("m_rank", rank.cast("bigint")))
    beyond = (F.col("m_last") > 0) | (F.col("m_last") == 0) & (F.col("m_rank") > F.col("p_ties"))
    d = d.withColumn("m_times", (F.col("p_epochs") - F.when(beyond, 1).otherwise(0)).cast("int")).where("m_times > 0")
    d = d.withColumn("m_e", F.explode(F.sequence(F.lit(1), F.col("m_times"))))
    part = (F.col("m_last") == 0) & (F.col("m_rank") == F.col("p_ties")) & (F.col("m_e") == F.col("p_epochs")) & (F.col("p_take") < F.col("m_n"))
    text = F.when(part, _cut(c[text_col], F.col("p_take"))).otherwise(c[text_col])
    changed = {c.at(text_col): text}
    if c.has("n_chars") and dict(docs.dtypes)["n_chars"] in ("bigint", "int"):
        changed[c.at("n_chars")] = F.when(part, F.length(text)).otherwise(c["n_chars"]).cast(dict(docs.dtypes)["n_chars"])
    return c.restore(d.withColumns(changed))


def _ties_beyond(keyed: DataFrame, plan: DataFrame) -> DataFrame:
    """Sources of which more rows tie with the last document than are drawn."""
    same = F.col("source").eqNullSafe(F.col("p_source")) & F.struct(F.col("mix_key").alias("k"), F.col("doc_id").alias("i"), F.col("n_tokens").alias("n")).eqNullSafe(F.col("p_last"))
    return keyed.join(plan, same).groupBy("p_source").agg(F.count(F.lit(1)).alias("n"), F.first("p_ties").alias("t")).where("n > t")


#: So many sources (a row of 100 bytes each) are broadcast; more of them are joined by shuffle.
BROADCAST_SOURCES = 200_000

_W = "CASE " + " ".join(f"WHEN source = '{s}' THEN {w}::DOUBLE" for s, w in WEIGHTS.items()) + " ELSE 1.0::DOUBLE END"
OP7_SQL = f"""
WITH k AS (SELECT doc_id, source, md5('{SEED}:' || coalesce(doc_id::VARCHAR, '')) AS mix_key, coalesce(len(regexp_extract_all(text, '[^ \\n\\t\\r]+')), 0)::BIGINT AS n_tokens FROM documents),
o AS (SELECT source, sum(n_tokens)::BIGINT AS own, {_W} AS w FROM k GROUP BY source),
b AS (SELECT source, own, floor((SELECT sum(own) FROM o)::BIGINT * w / (SELECT sum(w) FROM o))::BIGINT AS budget FROM o WHERE own > 0),
p AS (SELECT k.*, coalesce(sum(n_tokens) OVER (PARTITION BY source ORDER BY mix_key, doc_id, n_tokens ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM k WHERE n_tokens > 0),
d AS (SELECT p.doc_id, p.source, p.n_tokens, p.before, b.own, b.budget, unnest(range(0, CASE WHEN b.budget > p.before THEN ceil((b.budget - p.before)::DOUBLE / b.own)::BIGINT ELSE 0 END)) AS epoch
  FROM p JOIN b ON p.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, source, epoch, n_tokens, epoch * own + before AS start_token, least(n_tokens, budget - (epoch * own + before)) AS take_tokens FROM d"""
