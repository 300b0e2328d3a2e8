"""Column functions on text: case folding, terms, token estimates."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
STOP_WORDS = frozenset("with want using update through this the that should remove please our new make into have from for fix feature delete create change are and add".split())


def ascii_lower(c: Column | str) -> Column:
    """Lower case of A-Z only, as the reference's store compares text."""
    return F.translate(F.col(c) if isinstance(c, str) else c, UPPER, LOWER)


def fold(text: str) -> str:
    return text.translate(str.maketrans(UPPER, LOWER))


def contains(c: Column | str, term: str) -> Column:
    return F.coalesce(F.instr(ascii_lower(c), fold(term)) > 0, F.lit(False))


def search_terms(query: str, most: int = 12) -> list[str]:
    """The whole query, then (if it has white space) its identifiers of two characters or more."""
    query = query.strip()
    out = [query] if query else []
    if re.search(r"\s", query):
        out += [t for t in re.findall(r"[A-Za-z_][\w.:/-]*", query, re.ASCII) if len(t) >= 2]
    seen: set[str] = set()
    return [t for t in out if not (fold(t) in seen or seen.add(fold(t)))][:most]


def task_terms(task: Column | str, query: Column | None = None, most: int = 8) -> Column:
    """Identifiers of three characters or more that aren't stop words, the longest first.

    Of the query if there is one; that comes first itself if it has two such words at most, or parentheses.
    """
    task = F.col(task) if isinstance(task, str) else task
    given = F.nullif(F.trim(query), F.lit("")) if query is not None else F.lit(None).cast("string")
    words = F.transform(F.regexp_extract_all(F.coalesce(given, task), F.lit("[A-Za-z_][A-Za-z0-9_.]{2,}"), F.lit(0)), lambda w, i: F.struct((-F.length(w)).alias("n"), i.alias("i"), w.alias("w"), ascii_lower(w).alias("l")))
    stop = F.array(*[F.lit(x) for x in sorted(STOP_WORDS)])
    own = F.filter(words, lambda w: ~F.array_contains(stop, w["l"]))
    first = F.filter(own, lambda w: ~F.exists(own, lambda o: (o["l"] == w["l"]) & (o["i"] < w["i"])))
    out = F.transform(F.array_sort(first), lambda w: w["w"])
    if query is not None:
        whole = given.isNotNull() & ((F.size(own) <= 2) | given.contains("(") & given.contains(")"))
        rest = F.filter(out, lambda w: ascii_lower(w) != ascii_lower(F.coalesce(given, F.lit(""))))
        out = F.when(whole, F.concat(F.array(given), rest)).otherwise(out)
    return F.slice(out, 1, most)


def token_estimate(json: Column) -> Column:
    return F.greatest(F.lit(1), F.floor((F.length(json) + 3) / 4)).cast("bigint")
