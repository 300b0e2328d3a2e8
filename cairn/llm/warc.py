"""WARC records: segment reassembly and chunked transfer decoding.

A long record comes as segments: the first has number 1 and an id of its own, the others carry the first
one's id as origin and rising numbers, the last the total length (ISO 28500, segmentation). `reassemble`
brings the segments of an origin together by one shuffle on that id, sorted by number on the way, and
streams through them: a task holds one record at a time, however many segments it has. The joined block is
checked against the total length, its HTTP head is split off, and a chunked body is put together.

status of a result: ok; no_id (neither id nor origin); bad_number (a number below 1, or none on a
continuation); missing_segment (numbers aren't 1..n); conflict (two different segments of one number);
missing_total (several segments, none with a total); length_mismatch; no_http (no complete head);
bad_chunk (chunk framing is broken or cut off); bad_record and cut_off (see `read_warc`). The body is null unless status is ok.

Defined results:
* a repeated segment (same number and bytes) counts once; rows without id and origin each give a row;
* a null payload counts as empty; a record without number, origin and total is whole by itself;
* ties: target_uri and total are those of the segment with the lowest number that has one;
* ids of pages may be of any type and null; a null html is an empty one, a null url differs from an empty one;
* an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from typing import IO
from urllib.parse import unquote

import pyarrow as pa
import xxhash
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm.common import Columns, lean, ready

SEGMENT_BYTES, CHUNK_BYTES = 16384, 4096
HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
RECORDS = "record_id string, origin_id string, segment_number bigint, total_length bigint, target_uri string, payload binary"
READ = RECORDS + ", problem string"
RESULT = "record_id string, target_uri string, n_segments bigint, http_status int, status string, body binary"


def chunked(body: bytes, size: int = CHUNK_BYTES) -> bytes:
    """Chunked transfer framing of a body."""
    parts = [body[i : i + size] for i in range(0, len(body), size)]
    return b"".join([b"%x\r\n%s\r\n" % (len(p), p) for p in parts]) + b"0\r\n\r\n"


def dechunked(data: bytes) -> bytes | None:
    """The body of chunked framing, None if it is broken; extensions and trailers are skipped."""
    out, i = [], 0
    while True:
        end = data.find(b"\r\n", i)
        if end < 0:
            return None
        digits = data[i:end].split(b";", 1)[0].strip()
        if not digits or digits.strip(b"0123456789abcdefABCDEF"):
            return None
        size = int(digits, 16)
        i = end + 2
        if not size:
            # Trailers, if any, end with an empty line.
            return b"".join(out) if data[i : i + 2] == b"\r\n" or data.find(b"\r\n\r\n", i) >= 0 else None
        if data[i + size : i + size + 2] != b"\r\n":
            return None
        out.append(data[i : i + size])
        i += size + 2


def http_body(block: bytes) -> tuple[int | None, bytes | None, str]:
    """(HTTP status, body, status of the record)."""
    head, mark, body = block.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    first = lines[0].split(None, 2)
    if not mark or not first or not first[0].startswith(b"HTTP/") or len(first) < 2 or not first[1].isdigit():
        return None, None, "no_http"
    fields = {k.strip().lower(): v.strip().lower() for k, _, v in (x.partition(b":") for x in lines[1:])}
    if b"chunked" in fields.get(b"transfer-encoding", b""):
        whole = dechunked(body)
        return int(first[1]), whole, "ok" if whole is not None else "bad_chunk"
    return int(first[1]), body, "ok"


def joined(key: str | None, rows: list[tuple]) -> tuple:
    """A result row from the (number, is continuation, total, uri, payload, problem) of one record, by number."""
    uri = next((r[3] for r in rows if r[3] is not None), None)
    if problem := min((r[5] for r in rows if r[5] is not None), default=None):
        return key, uri, len(rows), None, problem, None
    total = next((r[2] for r in rows if r[2] is not None), None)
    if key is None:
        return None, uri, 1, None, "no_id", None
    if any(r[0] is None and r[1] or r[0] is not None and r[0] < 1 for r in rows):
        return key, uri, len(rows), None, "bad_number", None
    parts: list[bytes] = []
    numbers: list[int] = []
    for number, _, _, _, payload, _ in rows:
        number, payload = 1 if number is None else number, payload or b""
        if numbers and numbers[-1] == number:
            if parts[-1] != payload:
                return key, uri, len(numbers), None, "conflict", None
            continue
        numbers.append(number)
        parts.append(payload)
    n = len(numbers)
    if numbers != list(range(1, n + 1)):
        return key, uri, n, None, "missing_segment", None
    if n > 1 and total is None:
        return key, uri, n, None, "missing_total", None
    if total is not None and total != sum(map(len, parts)):
        return key, uri, n, None, "length_mismatch", None
    code, body, status = http_body(b"".join(parts))
    return key, uri, n, code, status, body


def _rows(out: list[tuple]) -> pa.RecordBatch:
    kinds = [("record_id", pa.string()), ("target_uri", pa.string()), ("n_segments", pa.int64()), ("http_status", pa.int32()), ("status", pa.string()), ("body", pa.binary())]
    return pa.RecordBatch.from_arrays([pa.array(x, type=t) for x, (_, t) in zip(zip(*out), kinds)], [n for n, _ in kinds])


#: A task remembers so many segments to drop their repetitions before the shuffle; more come through and are dropped behind it.
KEPT_SEGMENTS = 200_000


@lean
def _unique(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Without segments that repeat one of the task's, so that one sent a million times isn't shuffled as often."""
    seen: set[bytes] = set()
    for b in batches:
        keep = []
        for row in zip(*[c.to_pylist() for c in b.columns]):
            if row[0] is None:
                keep.append(True)
                continue
            h = xxhash.xxh3_128(repr(row[:5] + row[6:]).encode())
            h.update(row[5] or b"")
            keep.append((d := h.digest()) not in seen)
            seen.add(d)
        if len(seen) > KEPT_SEGMENTS:
            seen.clear()
        yield b if all(keep) else b.filter(pa.array(keep))


@lean
def _join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    key, rows, out, held = None, [], [], 0
    for batch in batches:
        for k, *row in zip(*[c.to_pylist() for c in batch.columns]):
            if rows and (k is None or k != key):
                out.append(joined(key, rows))
                held += len(out[-1][5] or b"")
                rows = []
                if held > 4 << 20:
                    yield _rows(out)
                    out, held = [], 0
            key = k
            # Of the segments of one number, the first and one that differs tell all there is to tell.
            same = [r for r in rows[-2:] if r[0] == row[0] and k is not None]
            if len(same) == 2 and same[0] != same[1]:
                continue
            if not same or tuple(row) != same[-1]:
                rows.append(tuple(row))
    if rows:
        out.append(joined(key, rows))
    if out:
        yield _rows(out)


def reassemble(records: DataFrame) -> DataFrame:
    """One row for each record, of its segments."""
    ready(records.sparkSession)
    c = Columns(records)
    x = c.df.select(
        F.coalesce(c["origin_id"], c["record_id"]).alias("k"),
        c["segment_number"].cast("bigint").alias("n"),
        c["origin_id"].isNotNull().alias("more"),
        c["total_length"].cast("bigint").alias("total"),
        c["target_uri"].alias("uri"),
        c["payload"].alias("payload"),
        (c["problem"] if c.has("problem") else F.lit(None)).cast("string").alias("problem"),
    )
    # A record without number goes before number 2 of its continuations.
    order = F.coalesce("n", F.when(~F.col("more"), F.lit(1)))
    x = x.mapInArrow(_unique, "k string, n bigint, more boolean, total bigint, uri string, payload binary, problem string")
    # Records without a key stand each for itself and go anywhere.
    where = F.coalesce(F.xxhash64("k", F.lit(0)), F.lit(0)) + F.when(F.col("k").isNull(), F.xxhash64("payload", "uri")).otherwise(0)
    x = x.withColumn("o", order).repartition(where).sortWithinPartitions("k", "o").drop("o")
    return x.mapInArrow(_join, RESULT)


def _segments(segment: int, chunk: int):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["record_id", "origin_id", "segment_number", "total_length", "target_uri", "payload"]
        kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
        for batch in batches:
            out, held = [], 0
            for rid, uri, html in zip(*[c.to_pylist() for c in batch.columns]):
                block = HEAD + chunked((html or "").encode(), chunk)
                cuts = range(0, len(block), segment)
                for i, at in enumerate(cuts, 1):
                    last = i == len(cuts)
                    out.append((rid if i == 1 else f"{rid}/{i}", None if i == 1 else rid, i, len(block) if last else None, uri if i == 1 else None, block[at : at + segment]))
                held += len(block)
                if held > 4 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(x, type=t) for x, t in zip(zip(*out), kinds)], names)
                    out, held = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, type=t) for x, t in zip(zip(*out), kinds)], names)

    return run


def segment_pages(pages: DataFrame, segment: int = SEGMENT_BYTES, chunk: int = CHUNK_BYTES) -> DataFrame:
    """Pages as segmented WARC response records with chunked bodies.

    A record's id is a digest of the page, in which null and text, and one column and the next, can't be taken for each other,
    and the page's id behind it (after n if that is null).
    """
    ready(pages.sparkSession)
    c = Columns(pages)
    part = lambda x: F.coalesce(F.concat(F.lit("v"), F.length(x), F.lit(":"), x), F.lit("n"))
    page_id, html = c["page_id"].cast("string"), F.coalesce(c["html"], F.lit(""))
    digest = F.md5(F.concat(part(page_id), part(c["url"]), part(html)))
    rid = F.concat(F.lit("urn:page:"), digest, F.coalesce(F.concat(F.lit(":"), page_id), F.lit("n")))
    return c.df.select(rid.alias("rid"), c["url"].alias("url"), c["html"].alias("html")).mapInArrow(_segments(segment, chunk), RECORDS)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records of .warc and .warc.gz files, and `problem`, null for a good one.

    A task streams its files and holds one record at a time. Behind a record whose head can't be read (bad_record), reading
    goes on at the next line that begins a record; one that the end of the file cuts short, or whose compressed data are
    broken, is cut_off. Both give a row, with what is known of them and no payload.
    """
    files = ready(spark).read.format("binaryFile").option("pathGlobFilter", "*.warc*").load(path)
    # The content isn't among the columns, so it isn't read here.
    return files.select("path").mapInArrow(_parse, READ)


MARK = re.compile(rb"(?:\A|\n)WARC/\d")
READ_BYTES, MOST_HEAD = 1 << 20, 1 << 20


def unpacked(stream: IO[bytes]) -> Iterator[bytes]:
    """The bytes of a file in pieces, decompressed (any number of gzip members) if they are; raises EOFError where they break off."""
    piece = stream.read(READ_BYTES)
    if piece[:2] != b"\x1f\x8b":
        while piece:
            yield piece
            piece = stream.read(READ_BYTES)
        return
    while piece:
        z = zlib.decompressobj(31)
        while not z.eof:
            if not piece:
                raise EOFError
            try:
                out = z.decompress(piece, READ_BYTES)
            except zlib.error as e:
                raise EOFError from e
            piece = z.unconsumed_tail or (b"" if z.eof else stream.read(READ_BYTES))
            if out:
                yield out
        piece = z.unused_data.lstrip(b"\0") or stream.read(READ_BYTES)


def parse_warc(stream: IO[bytes]) -> Iterator[tuple]:
    """(record_id, origin_id, segment_number, total_length, target_uri, payload, problem) of each record."""
    pieces, held, ended, broken = unpacked(stream), bytearray(), False, False

    def more() -> bool:
        nonlocal ended, broken
        if not ended:
            try:
                held.extend(next(pieces))
                return True
            except StopIteration:
                ended = True
            except EOFError:
                ended = broken = True
        return False

    while True:
        while not (at := MARK.search(held)) and more():
            pass
        if not at:
            if broken or held.strip():
                yield None, None, None, None, None, None, "cut_off" if broken else "bad_record"
            return
        start = at.end() - len(b"WARC/0")
        if held[:start].strip():
            yield None, None, None, None, None, None, "bad_record"
        del held[:start]
        while (end := held.find(b"\r\n\r\n")) < 0 and len(held) < MOST_HEAD and more():
            pass
        head = bytes(held[: end if end >= 0 else 0])
        fields = {k.strip().lower(): v.strip().decode(errors="replace") for k, _, v in (x.partition(b":") for x in head.split(b"\r\n")[1:])}
        number = lambda n: int(fields[n]) if fields.get(n, "").isdecimal() and len(fields[n]) < 19 else None  # noqa: B023, E731
        size = number(b"content-length")
        known = (fields.get(b"warc-record-id"), fields.get(b"warc-segment-origin-id"), number(b"warc-segment-number"), number(b"warc-segment-total-length"), fields.get(b"warc-target-uri"))
        if end < 0 or size is None:
            yield *known, None, "cut_off" if end < 0 and ended else "bad_record"
            del held[: len(b"WARC/")]
            if (at := MARK.search(held)) is None:
                while (at := MARK.search(held)) is None and more():
                    pass
            del held[: at.start() if at else len(held)]
            continue
        while len(held) < end + 4 + size and more():
            pass
        if len(held) < end + 4 + size:
            yield *known, None, "cut_off"
            return
        yield *known, bytes(held[end + 4 : end + 4 + size]), None
        del held[: end + 4 + size]
        # Two line ends follow a record; they stay to tell that the next one begins a line.


@lean
def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.string()]
    names = ["record_id", "origin_id", "segment_number", "total_length", "target_uri", "payload", "problem"]
    for batch in batches:
        for path in batch.column(0).to_pylist():
            files, name = filesystem(path)
            with files.open_input_stream(name, compression=None) as stream:
                rows, size = [], 0
                for row in parse_warc(stream):
                    rows.append(row)
                    size += len(row[5] or b"") + 200
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(x, type=t) for x, t in zip(zip(*rows), kinds)], names)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, type=t) for x, t in zip(zip(*rows), kinds)], names)


def filesystem(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI as Spark writes it, and the path there."""
    if path.startswith("file:"):
        return fs.LocalFileSystem(), unquote(re.sub("^file:/*", "/", path))
    return fs.FileSystem.from_uri(re.sub("^s3[an]:", "s3:", path))


def reassembled_pages(pages: DataFrame) -> DataFrame:
    """Pages through segmentation and back: page_id, url, n_segments, http_status, status, html."""
    out = reassemble(segment_pages(pages))
    # urn:page:, a digest of 32 characters, then : and the id, or n.
    tail = F.expr(f"substring(record_id, {len('urn:page:') + 33})")
    page_id = F.when(F.substring(tail, 1, 1) == ":", F.expr(f"substring(record_id, {len('urn:page:') + 34})")).cast(pages.schema["page_id"].dataType)
    return out.select(page_id.alias("page_id"), F.col("target_uri").alias("url"), "n_segments", "http_status", "status", F.col("body").cast("string").alias("html"))


OP1_SQL = f"""
WITH p AS (SELECT DISTINCT page_id, url, coalesce(html, '') AS html FROM pages),
n AS (SELECT *, strlen(html)::BIGINT AS b FROM p),
s AS (SELECT *, b % {CHUNK_BYTES} AS r FROM n)
SELECT page_id, url, ceil(({len(HEAD)} + 5 + (b // {CHUNK_BYTES}) * ({CHUNK_BYTES} + {4 + len('%x' % CHUNK_BYTES)}) + CASE WHEN r = 0 THEN 0 ELSE r + 4 + length(printf('{{:x}}', r)) END) / {SEGMENT_BYTES}.0)::BIGINT AS n_segments,
  200 AS http_status, 'ok' AS status, html FROM s"""
