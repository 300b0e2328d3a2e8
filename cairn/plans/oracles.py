"""DuckDB SQL of traversals, one common table expression for each step of a level."""

from __future__ import annotations

import re

from cairn.operators.traverse import PRIORITY
from cairn.sources.projection import PRELUDE

PRIO = "CASE " + " ".join(f"WHEN kind = '{k}' THEN {p}" for k, p in PRIORITY.items()) + " WHEN domain = 'framework' THEN 90 WHEN to_id IN (SELECT id FROM entities WHERE kind IN ('service_registration', 'test_case')) THEN 80 WHEN kind = 'contains' THEN 20 ELSE 50 END"


def _levels(depth: int, room: str, by_priority: bool, stop: int | None) -> str:
    order = "ord, prio DESC, id" if by_priority else "ord, id"
    out = []
    for d in range(1, depth + 1):
        fan = "AND NOT a.fan" if d > 1 and by_priority else ""
        done = f"AND NOT EXISTS (SELECT 1 FROM s{d - 1} WHERE entity_id = {stop})" if stop is not None else ""
        out.append(f"""c{d} AS (SELECT a.*, f.ord FROM f{d - 1} f JOIN adj a ON a.from_id = f.entity_id WHERE a.to_id NOT IN (SELECT entity_id FROM s{d - 1}) {fan} {done}),
d{d} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY to_id ORDER BY {order}) AS k FROM c{d}) WHERE k = 1),
a{d} AS (SELECT * FROM (SELECT *, row_number() OVER (ORDER BY {order}) - 1 AS place FROM d{d}) WHERE place < {room} - (SELECT count(*) FROM s{d - 1})),
s{d} AS (SELECT entity_id FROM s{d - 1} UNION ALL SELECT to_id FROM a{d}),
f{d} AS (SELECT to_id AS entity_id, place AS ord FROM a{d} WHERE NOT fan)""")
    return ",\n".join(out)


def surface_levels(seed: int, depth: int, cap: int, domains: list[str], prelude: str = PRELUDE, tag: str = "") -> str:
    """Common table expressions that end with items (entity_id, depth, place, direction, relation_id, kind, from_id)."""
    given = ", ".join(f"'{d}'" for d in domains)
    items = " UNION ALL ".join(f"SELECT to_id AS entity_id, {d} AS depth, place, direction, id AS relation_id, kind, from_id FROM a{d}" for d in range(1, depth + 1))
    below = [f"below1 AS (SELECT * FROM relations WHERE kind = 'contains' AND source_id = {seed})"]
    below += [f"below{d} AS (SELECT * FROM relations WHERE kind = 'contains' AND source_id IN (SELECT target_id FROM below{d - 1}))" for d in range(2, depth + 1)]
    inside = " UNION ".join(f"SELECT * FROM below{d}" for d in range(1, depth + 1))
    out = f""", {", ".join(below)}, own AS (SELECT *, domain = 'code' AND kind IN ('reads', 'writes', 'uses_type') AS fan FROM (
  SELECT * FROM (SELECT * FROM relations WHERE domain IN ({given}) AND kind <> 'contains' ORDER BY id LIMIT {max(5000, 100 * cap)})
  UNION ALL SELECT * FROM (SELECT * FROM ({inside}) ORDER BY id LIMIT {max(100, 4 * cap)}))),
adj AS (SELECT *, {PRIO} AS prio FROM (SELECT id, source_id AS from_id, target_id AS to_id, 'dependency' AS direction, domain, kind, fan FROM own UNION ALL SELECT id, target_id, source_id, 'dependent', domain, kind, fan FROM own)),
s0 AS (SELECT CAST({seed} AS BIGINT) AS entity_id), f0 AS (SELECT CAST({seed} AS BIGINT) AS entity_id, 0 AS ord),
{_levels(depth, str(cap + 1), True, None)},
items AS ({items})"""
    # Several surfaces in one statement need names of their own.
    return prelude + (re.sub(r"\b(below\d|own|adj|[scdaf]\d|items)\b", rf"\1{tag}", out) if tag else out)


def surface_sql(seed: int, depth: int, cap: int, domains: list[str]) -> str:
    return surface_levels(seed, depth, cap, domains) + " SELECT * FROM items"


def route_sql(source: int, target: int, depth: int, most: int, kinds: list[str] | None = None) -> str:
    given = f"kind IN ({', '.join(repr(k) for k in kinds)})" if kinds else "kind <> 'contains'"
    admitted = " UNION ALL ".join(f"SELECT {d} AS step, id, from_id, to_id, domain, kind FROM a{d}" for d in range(1, depth + 1))
    return f"""{PRELUDE.replace('WITH entities', 'WITH RECURSIVE entities', 1)}, adj AS (SELECT id, source_id AS from_id, target_id AS to_id, domain, kind, 0 AS prio, false AS fan FROM relations WHERE domain IN ('code', 'framework', 'database') AND {given} ORDER BY id LIMIT {max(1000, most * 20)}),
s0 AS (SELECT CAST({source} AS BIGINT) AS entity_id), f0 AS (SELECT CAST({source} AS BIGINT) AS entity_id, 0 AS ord),
{_levels(depth, str(most), False, target)},
adm AS ({admitted}),
path AS (SELECT * FROM adm WHERE to_id = {target} UNION ALL SELECT a.* FROM adm a JOIN path p ON a.to_id = p.from_id)
SELECT CAST(step AS BIGINT) AS step, id AS relation_id, from_id AS source_id, to_id AS target_id, domain, kind FROM path"""


def waypoint_sql(source: int, via: str, target: int, depth: int, most: int) -> str:
    """A route of two segments through the entity that `via` selects: the second has the depth and visits that the first left."""
    first = route_sql(source, -1, depth, most).replace("= -1)", "= (SELECT v FROM via))").replace("= -1 ", "= (SELECT v FROM via) ")
    head, rest = first.split(", adj AS", 1)
    base, steps = (head + f", via AS ({via}), adj AS" + rest).rsplit("SELECT CAST(step", 1)
    out = [base.rstrip() + ", one AS (SELECT CAST(step" + steps + ")"]
    # Each depth that the first segment may leave has its own second segment; only one of them has a source.
    for left in range(1, depth):
        k = f"_{left}"
        levels = _levels(left, f"({most} - (SELECT count(*) FROM s{depth}))", False, target)
        body = f"""s0 AS (SELECT v AS entity_id FROM via WHERE (SELECT count(*) FROM one) = {depth - left}), f0 AS (SELECT entity_id, 0 AS ord FROM s0),
{levels},
adm AS ({" UNION ALL ".join(f"SELECT {d} AS step, id, from_id, to_id, domain, kind FROM a{d}" for d in range(1, left + 1))}),
path AS (SELECT * FROM adm WHERE to_id = {target} UNION ALL SELECT a.* FROM adm a JOIN path p ON a.to_id = p.from_id)"""
        whole = f"(SELECT count(*) FROM s{depth})"
        body = body.replace(whole, "(SELECT count(*) FROM first_seen)")
        out.append(re.sub(r"\b([scdaf]\d+|adm|path)\b", rf"\1{k}", body))
    second = " UNION ALL ".join(f"SELECT step + {depth - left} AS step, id, from_id, to_id, domain, kind FROM path_{left}" for left in range(1, depth))
    out.insert(1, f"first_seen AS (SELECT entity_id FROM s{depth})")
    return ",\n".join(out) + f""", two AS ({second})
SELECT * FROM (SELECT * FROM one UNION ALL SELECT CAST(step AS BIGINT), id, from_id, to_id, domain, kind FROM two) WHERE (SELECT count(*) FROM two) > 0"""
