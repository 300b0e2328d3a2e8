"""Secret scans with a combined deterministic automaton.

The heads of all rules (what comes before their first long run) are compiled once into the arrays of one
minimal automaton (`automaton.combined`), which every task gets (some kB, fixed by the rules). A scan is one
pass over the bytes of the text, whatever the number of rules; only where it reports a head does a reversed
automaton find its starts and the exact automaton of that rule the ends. No shuffle.

A finding is a leftmost-longest match of a rule; findings of one rule don't overlap. Rules start anywhere,
within names (DB_PASSWORD=) and paths too, but for those in `APART`, which follow no letter or digit. A word
edge at a rule's end is judged on ASCII. A private key reaches from its BEGIN through its END line; where there
is none before another BEGIN, to the end of its headers and base64 lines (`BODY`). OP2_SQL only knows matches that start the text or follow a byte that
isn't one of `automaton.TOKEN_SET`, and of private keys the first line; `scan_texts` gives these unless it is told to give the `whole`.

Defined results:
* null and empty texts have no findings; texts are scanned whole, however long;
* the cost grows with a text's length, whatever the length of a secret or the number of starts in it;
* ids are whole numbers or, if of another type, strings; repeated rows are scanned each; a null doc_id is carried as null; an empty table has no findings;
* extra columns are ignored by `findings` and kept by `redact`, which replaces each secret by
  [REDACTED:rule], sets n_chars (if there is such a column) and leaves other rows as they are;
* where findings of several rules overlap, `redact` replaces their union, named by the leftmost one
  (at a tie the longer, then the first rule).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm import automaton
from cairn.llm.common import Columns, id_kind, lean, ready, slices

RULES: list[tuple[str, str]] = [
    ("aws_access_key", r"(?:AKIA|ASIA|ABIA|ACCA)[0-9A-Z]{16}\b"),
    ("private_key", r"-----BEGIN (?:(?:RSA|EC|DSA|OPENSSH|ENCRYPTED) )?PRIVATE KEY-----"),
    ("github_token", r"gh[opsru]_[0-9A-Za-z]{36,}\b"),
    ("github_fine_grained", r"github_pat_[0-9A-Za-z_]{40,}\b"),
    ("gitlab_token", r"glpat-[0-9A-Za-z_]{20,}"),
    ("slack_token", r"xox[abeoprs]-[0-9A-Za-z][0-9A-Za-z-]{9,}"),
    ("google_api_key", r"AIza[0-9A-Za-z_-]{35}"),
    ("stripe_key", r"[prs]k_(?:live|test)_[0-9A-Za-z]{16,}\b"),
    ("openai_key", r"sk-[0-9A-Za-z_-]{32,}"),
    ("sendgrid_key", r"SG\.[0-9A-Za-z_-]{22}\.[0-9A-Za-z_-]{43}"),
    ("npm_token", r"npm_[0-9A-Za-z]{36}\b"),
    ("jwt", r"eyJ[0-9A-Za-z_-]{8,}\.eyJ[0-9A-Za-z_-]{8,}\.[0-9A-Za-z_-]{8,}"),
    ("url_password", r"[a-z]{2,10}://[0-9A-Za-z._-]{1,40}:[0-9A-Za-z_.~+-]{3,60}@"),
    ("assigned_secret", r"""(?i)(?:password|passwd|pwd|secret|token|auth|api[_-]?key|access[_-]?key|secret[_-]?key|client[_-]?secret)["']?[ \t]{0,4}[:=][ \t]{0,4}["']?[0-9a-z+/=_.~-]{12,}"""),
]
#: Rules whose head also ends ordinary words (task-, risk-).
APART = frozenset(["openai_key"])
LETTERS = automaton.TOKEN_BYTES - frozenset(b"_.~+/-")
BEGIN, END = b"-----BEGIN ", re.compile(rb"-----END (?:(?:RSA|EC|DSA|OPENSSH|ENCRYPTED) )?PRIVATE KEY-----")
_BREAK = rb"""(?:[ \t\r\n"'+,;>#*|]|\\[rnt])*+"""
#: Headers and lines of base64, quoted or escaped ones too, then a shorter last line.
BODY = re.compile(rb"(?:(?:" + _BREAK + rb"(?:(?:Proc-Type|DEK-Info): ?[0-9A-Za-z,-]++|[0-9A-Za-z+/=]{16,}+))++" + rb"""(?:(?:[ \t\r\n"'+]|\\[rnt])*+[0-9A-Za-z+/=]{1,15}+(?=[ \t]*(?:[\r\n"'\\]|\Z)))?)?""")


@cache
def compiled() -> automaton.Dfa:
    return automaton.combined([p for _, p in RULES])


@cache
def exact_rule(i: int) -> tuple[automaton.Dfa, automaton.Dfa, bool]:
    """(reversed head, rule, word edge after)."""
    p = RULES[i][1]
    return automaton.backwards(p), automaton.forwards(p), automaton.parsed(p)[2]


def _edge(text: bytes, i: int) -> bool:
    left = i > 0 and text[i - 1] in automaton.WORD_BYTES
    right = i < len(text) and text[i] in automaton.WORD_BYTES
    return left != right


def key_end(text: bytes, at: int) -> int:
    """Where the private key ends whose first line ends at `at`."""
    other = text.find(BEGIN, at)
    end = END.search(text, at, other if other >= 0 else len(text)) or BODY.match(text, at)
    return end.end()


def spans(text: bytes, ends: np.ndarray, bits: np.ndarray, whole: bool) -> list[tuple[int, int, int]]:
    """(rule, start, end) of the findings in one text, from the ends of heads that the scan reported."""
    out = []
    for i, (name, _) in enumerate(RULES):
        own = ends[(bits >> i) & 1 == 1]
        if not len(own):
            continue
        heads, rule, after = exact_rule(i)
        barred = (LETTERS if name in APART else frozenset()) if whole else automaton.TOKEN_BYTES
        starts = sorted({s for e in own.tolist() for s in automaton.match_starts(heads, text, e)})
        starts = [s for s in starts if not s or text[s - 1] not in barred]
        found = automaton.longest_ends(rule, text, starts, (lambda e: _edge(text, e)) if after else lambda e: True)
        free = 0
        for s in starts:
            if s >= free and s in found:
                e = key_end(text, found[s]) if whole and name == "private_key" else found[s]
                out.append((i, s, e))
                free = e
    return sorted(out, key=lambda x: (x[1], -x[2], x[0]))


def scan_texts(col: pa.Array, whole: bool = False) -> Iterator[tuple[int, bytes, list[tuple[int, int, int]]]]:
    """(row, text, findings) for the texts of a column that have any; without `whole`, those that OP2_SQL knows."""
    buf = np.frombuffer(col.buffers()[2], dtype=np.uint8) if col.buffers()[2] is not None else np.zeros(0, dtype=np.uint8)
    if not len(buf):
        return
    offsets = np.frombuffer(col.buffers()[1], dtype=np.int32 if pa.types.is_string(col.type) else np.int64)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    base, last = int(offsets[0]), int(offsets[-1])
    if last == base:
        return
    buf, offsets = buf[base:last], offsets - base
    full = np.flatnonzero(np.diff(offsets) > 0)
    starts, stops = offsets[full], offsets[full + 1]
    ends, bits = automaton.scan(compiled(), buf, starts, stops)
    if not len(ends):
        return
    owner = np.searchsorted(starts, ends - 1, side="right") - 1
    for k in np.unique(owner):
        own = slice(*np.searchsorted(owner, [k, k + 1]))
        text = buf[starts[k] : stops[k]].tobytes()
        found = spans(text, ends[own] - starts[k], bits[own], whole)
        if found:
            yield int(full[k]), text, found


@lean
def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["id", "rule", "ordinal", "start", "end", "secret"]
    for batch in batches:
        for part in slices(batch, 1):
            rows: list[tuple] = []
            ids = part.column(0)
            for row, text, found in scan_texts(part.column(1), whole=True):
                count: dict[int, int] = {}
                before = done = 0
                for i, s, e in found:  # in order of their starts
                    count[i] = count.get(i, 0) + 1
                    before, done = before + len(text[done:s].decode()), s
                    secret = text[s:e].decode()
                    rows.append((ids[row].as_py(), RULES[i][0], count[i], before, before + len(secret), secret))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, type=t) for x, t in zip(zip(*rows), (ids.type, pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()))], names)


def findings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, rule, ordinal, start, end, secret): start and end count characters from 0."""
    ready(docs.sparkSession)
    c = Columns(docs)
    kind = id_kind(docs, id_col)
    narrow = c.df.select(c[id_col].cast(kind).alias("id"), c[text_col].cast("string").alias("text")).where("text is not null")
    out = narrow.mapInArrow(_find, f"id {kind}, rule string, ordinal bigint, start bigint, end bigint, secret string")
    return out.withColumnRenamed("id", id_col)


def redacted(text: bytes, found: list[tuple[int, int, int]]) -> bytes:
    out, free = [], 0
    for i, s, e in found:
        if s >= free:
            out += [text[free:s], b"[REDACTED:", RULES[i][0].encode(), b"]"]
        free = max(free, e)
    return b"".join([*out, text[free:]])


def _redact(at: int, count_at: int):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, at):
                new = {row: redacted(text, found).decode() for row, text, found in scan_texts(part.column(at), whole=True)}
                if new:
                    cols = part.columns
                    texts = cols[at].to_pylist()
                    counts = cols[count_at].to_pylist() if count_at >= 0 else []
                    for row, text in new.items():
                        texts[row] = text
                        if counts:
                            counts[row] = len(text)
                    cols[at] = pa.array(texts, type=cols[at].type)
                    if counts:
                        cols[count_at] = pa.array(counts, type=cols[count_at].type)
                    part = pa.RecordBatch.from_arrays(cols, schema=part.schema)
                yield part

    return run


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents with each secret replaced by its rule's name."""
    ready(docs.sparkSession)
    c = Columns(docs)
    count_at = c.names.index("n_chars") if c.has("n_chars") and dict(docs.dtypes)["n_chars"] in ("bigint", "int") else -1
    return c.restore(c.df.mapInArrow(_redact(c.names.index(text_col), count_at), c.df.schema))


_SUM = lambda x: f"coalesce(list_sum(list_transform({x}, lambda y: length(y))), 0)::BIGINT"
OP2_SQL = " UNION ALL ".join(
    f"""SELECT doc_id, '{name}' AS rule, i AS ordinal, {_SUM('x[1:i]')} + {_SUM('f[1:i]')} - length(m[i]) AS start,
  {_SUM('x[1:i]')} + {_SUM('f[1:i]')} AS "end", m[i] AS secret
FROM (SELECT doc_id, x, f, m, unnest(range(1, len(m) + 1)) AS i FROM (SELECT doc_id, string_split_regex(text, p) AS x, regexp_extract_all(text, p) AS f, regexp_extract_all(text, p, 1) AS m
  FROM (SELECT doc_id, text, $p${'(?i)' * p.startswith('(?i)')}(?:^|[^{automaton.TOKEN_SET}])({p.removeprefix('(?i)')})$p$ AS p FROM documents WHERE text IS NOT NULL)))"""
    for name, p in RULES
)
