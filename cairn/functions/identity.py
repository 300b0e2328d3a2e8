"""Stable keys and fingerprints."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.coalesce((F.col(x) if isinstance(x, str) else x).cast("string"), F.lit(""))


def stable_key(prefix: str, *parts: Column | str, sep: str = "\n") -> Column:
    """prefix:sha256 of the parts; a null part counts as empty."""
    return F.concat(F.lit(prefix + ":"), F.sha2(F.concat_ws(sep, *map(_c, parts)), 256))


def digest(*parts: Column | str, sep: str = "|") -> Column:
    return F.sha2(F.concat_ws(sep, *map(_c, parts)), 256)


def digest_of_group(line: Column, head: str | None = None) -> Column:
    """An aggregate: sha256 of the group's sorted lines, after a fixed first one."""
    lines = F.concat_ws("\n", F.array_sort(F.collect_list(line)))
    return F.sha2(F.concat_ws("\n", F.lit(head), lines) if head else lines, 256)
