"""Context packs: scores, seed decisions, greedy packing, source slices."""

from __future__ import annotations

import json
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from cairn.functions.text import ascii_lower, fold
from cairn.operators.edges import bounded
from cairn.operators.search import search_entities

CAPS = {"http_endpoint": 6, "class": 6, "constructor": 4}
KIND_BONUS = {"service_registration": 12, "interface": 15, "class": 15, "database_object": 18, "database_operation": 18, "method": 20, "http_endpoint": 25}


def base_score(item: Column, depth: Column) -> Column:
    """seed 100, related_test 95, direct 90, transitive 75 less 5 for each level, 40 at least."""
    return F.when(item == "seed", 100).when(item == "related_test", 95).when(item == "direct", 90).otherwise(F.greatest(F.lit(40), 75 - 5 * depth))


def focus_terms(terms: list[str], seed_project: str | None = None) -> list[str]:
    """Trimmed, of three characters or more, distinct in any case, not the seed's project, twelve at most."""
    out: dict[str, str] = {}
    for t in (t.strip() for t in terms):
        if len(t) >= 3 and fold(t) != fold(seed_project or ""):
            out.setdefault(fold(t), t)
    return list(out.values())[:12]


def focus_score(terms: list[str], seed_project: str | None = None, most: int = 120) -> Column:
    """Per term the best of: the name 40, in the name 28, in a kind 22, in the qualified name 20, in signature or path 18.

    Columns: name, kind, via_kind, qualified_name, signature, evidence_path.
    """
    parts = []
    for raw in map(fold, focus_terms(terms, seed_project)):
        t = raw[:-1] if len(raw) > 4 and raw.endswith("s") else raw
        has = lambda c: F.coalesce(F.instr(ascii_lower(c), t) > 0, F.lit(False))  # noqa: E731, B023
        words = lambda c: has(F.replace(F.col(c), F.lit("_"), F.lit(" ")))  # noqa: E731, B023
        parts.append(F.when(ascii_lower("name").isin(raw, t), 40).when(has("name"), 28).when(words("kind") | words("via_kind"), 22).when(has("qualified_name"), 20).when(has("signature") | has("evidence_path"), 18).otherwise(0))
    return F.least(reduce(add, parts, F.lit(0)), F.lit(most))


def ranked_candidates(candidates: DataFrame) -> DataFrame:
    """The best candidate of each entity, first come at a tie, in packing order. candidates: (entity_id, arrival, score, depth, qualified_name)."""
    best = candidates.withColumn("c_rn", F.row_number().over(W.partitionBy("entity_id").orderBy(F.desc("score"), "arrival"))).where("c_rn = 1").drop("c_rn")
    # A surface has 1,000 entities at most.
    return best.withColumn("place", F.row_number().over(W.orderBy(F.desc("score"), "depth", "qualified_name", "entity_id")))


def pack(items: list[dict], budget: int, caps: dict[str, int] | None = None) -> list[dict]:
    """Greedy: the first is always taken, later ones that don't fit are skipped, not the end. items: kind, tokens."""
    caps, used, kinds, out = CAPS if caps is None else caps, 0, {}, []
    for x in items:
        if kinds.get(x["kind"], 0) >= caps.get(x["kind"], len(items)):
            continue
        if out and used + x["tokens"] > budget:
            continue
        out.append(x)
        used += x["tokens"]
        kinds[x["kind"]] = kinds.get(x["kind"], 0) + 1
    return out


def tokens(value: object) -> int:
    return max(1, (len(json.dumps(value, separators=(",", ":"))) + 3) // 4)


def context_pack(items: list[dict], claims: list[dict], commands: list[str], projects: list[str], budget: int = 4000) -> dict:
    """Splits the budget (claims 20 %, items 70 % and what claims left), packs, and shrinks until all fits."""
    bounded(budget, 800, 32_000, "budget")
    for x in [*items, *claims]:
        x["tokens"] = tokens({k: v for k, v in x.items() if k != "tokens"})
    seed = next((x for x in items if x.get("role") == "seed"), None)
    chosen = pack(claims, budget // 5, {}) if claims else []
    left = budget // 5 - sum(x["tokens"] for x in chosen)
    taken = pack(items, budget * 7 // 10 + max(0, left))
    if seed is not None:
        taken = [seed, *(x for x in taken if x is not seed)]
    out = {"items": taken, "claims": chosen, "commands": list(commands), "projects": list(projects)}
    while tokens(out) > budget:
        for part in ("items", "claims", "commands", "projects"):
            if len(out[part]) > (part == "items"):
                out[part].pop()
                break
        else:
            break
    return out


def term_hits(rows: DataFrame, terms: list[str], per_term: int = 20) -> DataFrame:
    """(term, entity_id, kind, qualified_name, project_name, match) of the best hits of each term.

    rows as in `search.search_entities`, whose order this is. match: 0 exact, 1 prefix, 2 in the name, 3 other.
    """
    keep = rows.select("id", "project_name")
    out = None
    for t in terms:
        hit = search_entities(rows, t, limit=per_term).orderBy(F.desc("score"), "is_generated", F.length("qualified_name"), "qualified_name", "kind", "id").limit(per_term)
        name, full, f = ascii_lower("name"), ascii_lower("qualified_name"), fold(t)
        match = F.when((name == f) | (full == f), 0).when(name.startswith(f), 1).when(F.instr(name, f) > 0, 2).otherwise(3)
        # At most per_term rows, by the limit above.
        one = keep.join(F.broadcast(hit), "id").select(F.lit(t).alias("term"), F.col("id").alias("entity_id"), "kind", "qualified_name", "project_name", match.alias("match"))
        out = one if out is None else out.unionByName(one)
    return out


def seed_candidates(hits: DataFrame, terms: list[str]) -> DataFrame:
    """(entity_id, score, exact, terms, place) over the terms' search hits.

    hits: as of `term_hits`, a few hundred rows at most, which is why one window may order them. A term that is the project's name adds 90 and counts as matched.
    """
    points = F.when(F.col("match") == 0, 120).when(F.col("match") == 1, 70).when(F.col("match") == 2, 50).otherwise(30)
    bonus = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in KIND_BONUS.items() for x in kv]), F.col("kind")), F.lit(5))
    x = hits.groupBy("entity_id", "qualified_name", "project_name").agg(F.sum(points + bonus).alias("score"), (F.min("match") == 0).alias("exact"), F.collect_set(ascii_lower("term")).alias("t"))
    own = F.filter(F.array(*[F.lit(fold(t)) for t in terms]), lambda t: t == ascii_lower("project_name"))
    x = x.withColumns({"score": F.col("score") + 90 * F.size(F.coalesce(own, F.array().cast("array<string>"))), "t": F.array_sort(F.array_union("t", F.coalesce(own, F.array().cast("array<string>"))))})
    place = F.row_number().over(W.orderBy(F.desc("score"), F.desc("exact"), "qualified_name", "entity_id"))
    return x.select("entity_id", "project_name", "score", "exact", F.array_join("t", ",").alias("terms"), place.alias("place"))


def seed_decision(top: list[dict]) -> str:
    """auto, needs_seed or no_match, of the candidates in order (score, exact, project_name, terms)."""
    if not top:
        return "no_match"
    if len(top) == 1:
        return "auto"
    a, b = top[0], top[1]
    lead = a["score"] - b["score"]
    project = fold(a.get("project_name") or "")
    shared = bool(project) and project == fold(b.get("project_name") or "") and project in map(fold, a.get("terms", []))
    clear = a["exact"] and lead >= 30 or a["score"] >= 100 and lead >= 70
    tie = shared and (a["exact"] and a["score"] >= 200 or a["score"] >= 250 and lead >= 30)
    return "auto" if clear or tie else "needs_seed"


#: Larger files, and those of other kinds, aren't shown.
MOST_SOURCE_BYTES, SOURCE_KINDS = 1 << 20, ["cs", "cshtml", "js", "jsx", "razor", "sql", "ts", "tsx"]


def shown_files(files: DataFrame) -> DataFrame:
    """Files whose source may be shown. files: (file_id, relative_path, text, is_generated)."""
    kind = F.lower(F.regexp_extract("relative_path", "\\.([^./]*)$", 1))
    return files.where(~F.col("is_generated") & kind.isin(SOURCE_KINDS) & (F.octet_length("text") <= MOST_SOURCE_BYTES))


def source_slices(files: DataFrame, spans: DataFrame, around: int = 3, most_lines: int = 40) -> DataFrame:
    """(file_id, first_line, last_line, slice): lines around each span, of files that aren't generated or binary.

    Where a file ends below the span, the slice reaches further up instead.
    """
    bounded(most_lines, 8, 120, "most_lines")
    x = spans.join(files.where("not is_generated and instr(text, chr(0)) = 0 and text <> ''").select("file_id", "text"), "file_id")
    lines = F.split("text", "\n")
    end_line = F.col("end_line") if "end_line" in spans.columns else F.col("start_line")
    start = F.least(F.greatest(F.lit(1), F.col("start_line")), F.size(lines))
    end = F.least(F.greatest(start, end_line), F.size(lines))
    first = F.greatest(F.lit(1), start - around)
    last = F.least(F.size(lines), end + around, first + most_lines - 1)
    short = (last - first + 1 < most_lines) & (first > 1)
    x = x.withColumns({"first_line": F.when(short, F.greatest(F.lit(1), last - most_lines + 1)).otherwise(first), "last_line": last})
    return x.select("file_id", "first_line", "last_line", F.array_join(F.slice(lines, F.col("first_line"), F.col("last_line") - F.col("first_line") + 1), "\n").alias("slice"))


def attach_sources(pack: dict, slices: dict[int, dict], budget: int) -> dict:
    """The pack with slices of its items' source, as long as it stays within the budget; one that overlaps an earlier one goes.

    slices: by item id, (file_id, first_line, last_line, slice).
    """
    items, taken = list(pack["items"]), []
    for i, x in enumerate(items):
        s = slices.get(x["id"])
        if s is None or any(s["file_id"] == o["file_id"] and s["first_line"] <= o["last_line"] and o["first_line"] <= s["last_line"] for o in taken):
            continue
        more = [*items[:i], {**x, "source": s}, *items[i + 1 :]]
        if tokens({**pack, "items": more}) > budget:
            continue
        items = more
        taken.append(s)
    return {**pack, "items": items, "source_slices": len(taken), "omitted_source_slices": sum(x["id"] in slices for x in items) - len(taken)}


def core_budget(budget: int, with_source: bool) -> int:
    """What a pack may take before source is attached."""
    return max(800, budget * 65 // 100) if with_source else budget
