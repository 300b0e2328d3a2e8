"""Quality rules: a ledger of failure bits.

`ledger` evaluates every rule once for each document and keeps the measurements and one bit per
failed rule. A policy is a named, versioned mask: a document is rejected when a bit of the mask is
set. Changing a policy, or asking what the corpus would look like without one rule, reads the
ledger's integers and never the texts again (`apply_policy`, `ablations`).

Everything is built-in expressions in one projection over one scan: no shuffle and no Python.

Defined results:
* null text counts as empty: it has no words and fails `no_words` only;
* empty texts fail `no_words`; texts of any length are judged by the same formulas: ratios whose chance in a short text is
  large have a constant added to what they divide by (`EASED`), so that a few words don't make a text junk;
* ids are carried as they are, null ones too; repeated rows each get their own ledger row; an empty table gives an empty ledger;
* other columns of the input are ignored by `ledger` and kept by `filter_documents`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import Columns

WORD, LINE = "[^ \\n\\t\\r]+", "[^\\n]+"

#: Rules in bit order: name, measurement, the value above which it fails. Bits are never reused.
RULES: list[tuple[str, str, float]] = [
    ("no_words", "empty", 0.0),
    ("symbol_heavy", "symbol_ratio", 0.03),
    ("shouting", "bang_per_word", 0.3),
    ("upper_case", "upper_ratio", 0.6),
    ("word_runs", "run_ratio", 0.3),
    ("repeated_words", "words_per_distinct", 20.0),
    ("repeated_lines", "dup_line_ratio", 0.5),
    ("list_marks", "mark_ratio", 0.15),
    ("digits", "digit_ratio", 0.5),
    ("long_words", "mean_word_chars", 25.0),
]
#: Added to the divisor of a ratio: what it counts has to stand out against so much more text.
EASED = {"upper_ratio": 20, "run_ratio": 5, "words_per_distinct": 1, "dup_line_ratio": 4, "mark_ratio": 12, "digit_ratio": 20}
BIT = {name: 1 << i for i, (name, _, _) in enumerate(RULES)}
POLICIES: dict[str, list[str]] = {
    "v1": ["no_words", "symbol_heavy", "shouting", "word_runs"],
    "v2": [name for name, _, _ in RULES],
}
MEASURES = ["n_words", "symbol_ratio", "bang_per_word", "upper_ratio", "run_ratio", "words_per_distinct", "dup_line_ratio", "mark_ratio", "digit_ratio", "mean_word_chars"]


def mask(policy: str, without: str | None = None) -> int:
    return sum(BIT[r] for r in POLICIES[policy] if r != without)


def _ratio(a: Column, b: Column, name: str = "") -> Column:
    return a.cast("double") / F.greatest(b.cast("double") + F.lit(float(EASED.get(name, 0))), F.lit(1.0))


def _measured(df: DataFrame, text: Column) -> DataFrame:
    """Adds the measurements of `text` to df; helper columns start with q_."""
    count = lambda kept: F.length(F.regexp_replace("q_t", kept, ""))
    df = df.withColumn("q_t", F.coalesce(text, F.lit("")))
    df = df.withColumns({"q_w": F.regexp_extract_all("q_t", F.lit(WORD), F.lit(0)), "q_l": F.regexp_extract_all("q_t", F.lit(LINE), F.lit(0)), "q_n": F.length("q_t")})
    df = df.withColumns({"n_words": F.size("q_w").cast("bigint"), "q_letters": count("[^A-Za-z]")})
    n = F.col("n_words")
    runs = F.expr("size(filter(arrays_zip(slice(q_w, 1, greatest(size(q_w) - 1, 0)), slice(q_w, 2, greatest(size(q_w) - 1, 0))), p -> p['0'] = p['1']))")
    return df.withColumns(
        {
            "empty": F.when(n == 0, 1.0).otherwise(0.0),
            "symbol_ratio": _ratio(count("[^#$%&*|<>{}~^=+\\\\]"), F.col("q_n")),
            "bang_per_word": _ratio(count("[^!?]"), n),
            "upper_ratio": _ratio(count("[^A-Z]"), F.col("q_letters"), "upper_ratio"),
            "run_ratio": _ratio(runs, n, "run_ratio"),
            "words_per_distinct": _ratio(n, F.size(F.array_distinct("q_w")), "words_per_distinct"),
            "dup_line_ratio": _ratio(F.size("q_l") - F.size(F.array_distinct("q_l")), F.size("q_l"), "dup_line_ratio"),
            "mark_ratio": _ratio(F.size(F.filter("q_w", lambda w: w.isin("|", "-", "*", "•", "·"))), n, "mark_ratio"),
            "digit_ratio": _ratio(count("[^0-9]"), F.col("q_n"), "digit_ratio"),
            "mean_word_chars": _ratio(count("[ \\n\\t\\r]"), n),
        }
    )


def _bits() -> Column:
    out = F.lit(0).cast("bigint")
    for name, measure, limit in RULES:
        out = out + F.when(F.col(measure) > limit, F.lit(BIT[name])).otherwise(F.lit(0)).cast("bigint")
    return out


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, fail_bits and every measurement."""
    c = Columns(docs)
    m = _measured(c.df.select(c[id_col].alias("q_id"), c[text_col].alias("q_src")), F.col("q_src"))
    return m.select(F.col("q_id").alias(id_col), _bits().alias("fail_bits"), *MEASURES)


def apply_policy(rows: DataFrame, policy: str = "v2") -> DataFrame:
    """Ledger rows and `keep_<policy>`: 1 where no rule of the policy failed."""
    return rows.withColumn(f"keep_{policy}", F.when(F.col("fail_bits").bitwiseAND(F.lit(mask(policy))) == 0, 1).otherwise(0))


def ablations(rows: DataFrame) -> DataFrame:
    """For each policy and rule: documents that fail the rule, that only it rejects, and that stay without it.

    One aggregation of the ledger's integers to one row (of zeros for an empty ledger), which is then laid out.
    """
    bits = F.col("fail_bits")
    has = lambda m: bits.bitwiseAND(F.lit(m)) != 0
    count = lambda when: F.count(F.when(when, 1))
    items = [
        F.struct(
            F.lit(p).alias("policy"),
            F.lit(r).alias("rule"),
            count(has(BIT[r])).alias("failed"),
            count(has(BIT[r]) & ~has(mask(p, r))).alias("only_this"),
            count(~has(mask(p))).alias("kept"),
            count(~has(mask(p, r))).alias("kept_without"),
        )
        for p in sorted(POLICIES)
        for r in POLICIES[p]
    ]
    return rows.agg(F.array(*items).alias("all")).select(F.explode("all").alias("x")).select("x.*")


def filter_documents(docs: DataFrame, policy: str = "v2", text_col: str = "text") -> DataFrame:
    """The documents that the policy keeps, with all their columns.

    The ledger's bits are made once for each document, as a column, before the policy looks at them: the one-element array keeps
    the filter from being taken apart and pushed below, where it would evaluate the rules again for every bit.
    """
    c = Columns(docs)
    m = _measured(c.df, c[text_col])
    x = m.select(*c.df.columns, F.explode(F.array(_bits())).alias("q_bits"))
    return c.restore(x.where(F.col("q_bits").bitwiseAND(F.lit(mask(policy))) == 0))


_COUNT = lambda drop: f"length(regexp_replace(t, '{drop}', '', 'g'))"
_DIV = lambda a, b, m="": f"({a})::DOUBLE / greatest(({b})::DOUBLE + {EASED.get(m, 0)}.0, 1.0)"
LEDGER_SQL = f"""
WITH a AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
b AS (SELECT doc_id, t, regexp_extract_all(t, '{WORD}') AS w, regexp_extract_all(t, '{LINE}') AS l FROM a),
m AS (SELECT doc_id, len(w)::BIGINT AS n_words,
  CASE WHEN len(w) = 0 THEN 1.0 ELSE 0.0 END AS empty,
  {_DIV(_COUNT('[^#$%&*|<>{}~^=+\\\\]'), 'length(t)')} AS symbol_ratio,
  {_DIV(_COUNT('[^!?]'), 'len(w)')} AS bang_per_word,
  {_DIV(_COUNT('[^A-Z]'), _COUNT('[^A-Za-z]'), 'upper_ratio')} AS upper_ratio,
  {_DIV('len(list_filter(range(1, len(w)), lambda i: w[i] = w[i + 1]))', 'len(w)', 'run_ratio')} AS run_ratio,
  {_DIV('len(w)', 'len(list_distinct(w))', 'words_per_distinct')} AS words_per_distinct,
  {_DIV('len(l) - len(list_distinct(l))', 'len(l)', 'dup_line_ratio')} AS dup_line_ratio,
  {_DIV("len(list_filter(w, lambda x: x IN ('|', '-', '*', '•', '·')))", 'len(w)', 'mark_ratio')} AS mark_ratio,
  {_DIV(_COUNT('[^0-9]'), 'length(t)', 'digit_ratio')} AS digit_ratio,
  {_DIV(_COUNT('[ \\n\\t\\r]'), 'len(w)')} AS mean_word_chars
  FROM b),
f AS (SELECT *, ({' + '.join(f"CASE WHEN {m} > {x} THEN {BIT[r]} ELSE 0 END" for r, m, x in RULES)})::BIGINT AS fail_bits FROM m)
"""
OP10_SQL = LEDGER_SQL + f"""SELECT doc_id, fail_bits, {', '.join(MEASURES)},
  CASE WHEN (fail_bits & {mask('v1')}) = 0 THEN 1 ELSE 0 END AS keep_v1,
  CASE WHEN (fail_bits & {mask('v2')}) = 0 THEN 1 ELSE 0 END AS keep_v2 FROM f"""
ABLATION_SQL = LEDGER_SQL + " UNION ALL ".join(
    f"""SELECT '{p}' AS policy, '{r}' AS rule, count(*) FILTER (WHERE (fail_bits & {BIT[r]}) <> 0) AS failed,
  count(*) FILTER (WHERE (fail_bits & {BIT[r]}) <> 0 AND (fail_bits & {mask(p, r)}) = 0) AS only_this,
  count(*) FILTER (WHERE (fail_bits & {mask(p)}) = 0) AS kept, count(*) FILTER (WHERE (fail_bits & {mask(p, r)}) = 0) AS kept_without FROM f"""
    for p in sorted(POLICIES)
    for r in POLICIES[p]
)
