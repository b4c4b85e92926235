"""WARC archives of pages: writing with payload de-duplication, and a reader that salvages damaged files.

Writing. A page becomes a response record whose block is an HTTP header and the payload (the html in UTF-8).
Of pages with equal payloads of ``min_bytes`` or more the one with the least page_id is written so, others
become revisit records that refer to it, without the payload. Payloads are compared by SHA-256; only hashes, ids and
counts are shuffled, and the payloads that occur more than once are joined to the pages by broadcast up to
``BROADCAST_ROWS`` of them. Each record is a gzip member. Members are packed into files of about ``FILE_BYTES``,
which Spark's text writer makes, a row a file: commits are atomic for each task, so a lost executor leaves no half
records in the archive. The last byte of a member, the top byte of its size, is zero; it stands for the writer's
line end. Of records of 16 MB or more each 8 MB are a member of their own.

Reading. Files come through Spark's binary reader. A record must pass its checks: version line, header,
length, end marks and payload digest. After a failed check the reader looks for the next version line
(plain files) or the next gzip member that passes, goes on from there, and logs the bytes between as a gap.
Inside a gzip member it goes on from the next version line too, and a record that goes on in the next members is
read across them. Of a member that is cut or does not inflate, what inflates is read so; there a record needs a
payload digest or another record right after it, and the member is logged as a gap after its records. A file is read
as one row.

Edge cases: a null html is an empty payload; rows with equal page_ids and payloads give one response and
revisits of it; null ids sort after all others; line breaks in a url become spaces and a null url is
empty; an empty table gives an archive without records; extra columns are not written.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foretrace.llm.common import column, stored

FILE_BYTES, MEMBER_BYTES = 32 << 20, 8 << 20
BROADCAST_ROWS = 1_000_000
DATE = "2024-01-01T00:00:00Z"
MEMBER, VERSION = b"\x1f\x8b\x08", b"WARC/1."
STEP = 1 << 16
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def base32_sha1(value: Column) -> Column:
    """Upper-case base32 of the SHA-1 of a string's UTF-8 bytes, five hex digits (20 bits) at a time."""
    digits = F.sha1(value)

    def four(i: Column) -> Column:
        bits = F.conv(F.substring(digits, i * 5 + 1, F.lit(5)), 16, 10).cast("int")
        return F.concat(*[F.substring(F.lit(_BASE32), F.shiftright(bits, shift).bitwiseAND(31) + 1, F.lit(1)) for shift in (15, 10, 5, 0)])

    return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(7)), four), "")


def records(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """(page_id, url, html, digest, size, refers_to, row): refers_to is the page of the response, null for one; row
    tells apart records of equal page_ids and payloads, and is 0 where there are none such."""
    named = pages.select(column("page_id").cast("bigint").alias("page_id"), column("url").cast("string").alias("url"), F.coalesce(column("html").cast("string"), F.lit("")).alias("html"))
    hashed = {"size": F.octet_length("html").cast("bigint"), "same": F.unhex(F.sha2("html", 256))}
    rows = named.withColumn("row", F.lit(0).cast("bigint")).withColumns(hashed)
    if not rows.groupBy("same", "page_id").count().filter("count > 1").isEmpty():
        rows = stored(named.withColumn("row", F.monotonically_increasing_id()), "pages").withColumns(hashed)
    groups = rows.filter(F.col("size") >= min_bytes).groupBy("same").agg(F.min(F.struct(F.col("page_id").isNull().alias("last"), "page_id", "row")).alias("first"), F.count("*").alias("n"))
    groups = stored(groups.filter("n > 1").select("same", "first.page_id", "first.row").toDF("same", "first_id", "first_row"), "repeated")
    if groups.count() <= BROADCAST_ROWS:
        groups = F.broadcast(groups)
    joined = rows.join(groups, "same", "left")
    original = F.col("first_row").isNull() | (F.col("page_id").eqNullSafe(F.col("first_id")) & (F.col("row") == F.col("first_row")))
    return joined.select("page_id", "url", "html", base32_sha1(F.col("html")).alias("digest"), "size", F.when(~original, F.coalesce(F.col("first_id").cast("string"), F.lit("null"))).alias("refers_to"), "row")


def record_text() -> Column:
    """The record as text."""
    page = F.coalesce(F.col("page_id").cast("string"), F.lit("null"))
    revisit = F.col("refers_to").isNotNull()
    block = F.length(F.lit(_HTTP)) + F.when(revisit, 0).otherwise(F.col("size"))
    line = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts], F.lit("\r\n"))
    return F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type: ", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID: <urn:page:", page, ":", F.col("row").cast("string"), ">"),
        line("WARC-Date: ", DATE),
        line("WARC-Target-URI: ", F.regexp_replace(F.coalesce("url", F.lit("")), "[\r\n]", " ")),
        F.when(revisit, line("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")).otherwise(""),
        F.when(revisit, line("WARC-Refers-To: <urn:page:", F.col("refers_to"), ">")).otherwise(""),
        line("WARC-Payload-Digest: sha1:", F.col("digest")),
        line("WARC-Payload-Length: ", F.col("size").cast("string")),
        line("Content-Type: application/http;msgtype=response"),
        line("Content-Length: ", block.cast("string")),
        F.lit("\r\n" + _HTTP),
        F.when(revisit, "").otherwise(F.col("html")),
        F.lit("\r\n\r\n"),
    )


def write(pages: DataFrame, path: str, min_bytes: int = 0) -> None:
    """Write an archive of the pages to the new folder ``path``."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for value in batch.column(0):
                data = value.as_buffer()
                step = MEMBER_BYTES if len(data) >= 2 * MEMBER_BYTES else len(data)
                for at in range(0, len(data), step):
                    held.append(gzip.compress(data[at : at + step], 6, mtime=0))
                    size += len(held[-1])
                if size >= FILE_BYTES:
                    yield file_row(held)
                    held, size = [], 0
        if held:
            yield file_row(held)

    def file_row(members: list[bytes]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([b"".join(members)[:-1]], pa.binary())], ["value"])

    files = records(pages, min_bytes).select(record_text().cast("binary").alias("value")).mapInArrow(packed, "value binary")
    files.select(F.col("value").cast("string").alias("value")).write.option("lineSep", "\0").option("maxRecordsPerFile", 1).text(path)


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


class Damaged(ValueError):
    """A record that fails a check."""


_LENGTH = re.compile(r"[0-9]+")


def parse_record(data: bytes, at: int) -> tuple[dict[str, str], bytes, int]:
    """Header fields (names in lower case), block and end of the record at ``at``; raises Damaged."""
    following = data.find(b"\n" + VERSION, at)
    stop = data.find(b"\r\n\r\n", at, following + 1 if following >= 0 else len(data))
    if not data.startswith(VERSION, at) or stop < 0:
        raise Damaged("no version line" if stop >= 0 else "no header end")
    fields = {}
    for line in data[at:stop].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise Damaged("header line without colon")
        fields[name.strip().lower().decode("utf-8", "replace")] = value.strip().decode("utf-8", "replace")
    if not _LENGTH.fullmatch(fields.get("content-length", "")):
        raise Damaged("no length")
    start = stop + 4
    end = start + int(fields["content-length"])
    if data[end : end + 4] != b"\r\n\r\n":
        raise Damaged("no end marks where the length says")
    block = data[start:end]
    declared = fields.get("warc-payload-digest", "")
    if declared.startswith("sha1:") and fields.get("warc-type") == "response" and payload_digest(payload_of(block)) != declared[5:]:
        raise Damaged("payload differs from its digest")
    return fields, block, end + 4


def payload_of(block: bytes) -> bytes:
    """What follows an HTTP header, or the whole block where there is none."""
    if block.startswith(b"HTTP/"):
        stop = block.find(b"\r\n\r\n")
        return block[stop + 4 :] if stop >= 0 else b""
    return block


def salvage(data: bytes) -> Iterator[tuple[int, int, dict[str, str] | None, bytes | str]]:
    """(start, end, header, block) of each record and (start, end, None, reason) of each gap, in order."""
    packed = data.startswith(b"\x1f\x8b") or (not data.startswith(VERSION) and 0 <= data.find(MEMBER) < (data.find(VERSION) if VERSION in data else len(data)))
    if not packed:
        yield from _plain(data)
        return
    at, bad, reason = 0, None, ""
    while at < len(data):
        inner, end, problem = _inflated(data, at)
        if not problem:
            inner, end = _whole(data, inner, end)
        found = [(fields, block) for _, stop, fields, block in _plain(inner) if not problem or _sure(inner, stop, fields)]
        if problem and not found:
            if bad is None:
                bad, reason = at, problem
        else:
            if bad is not None:
                yield bad, at, None, reason
            for fields, block in found:
                yield at, end, fields, block
            bad, reason = (at, problem) if problem else (None, "")
        at = end if not problem else data.find(MEMBER, at + 1)
        if at < 0:
            break
    if bad is not None:
        yield bad, len(data), None, reason


def _whole(data: bytes, inner: bytes, end: int) -> tuple[bytes, int]:
    """A member with those after it that its record goes on in, if all of them pass; else the member alone."""
    pieces, size, to, wanted = [inner], len(inner), end, _wanted(inner)
    while size < wanted and data.startswith(MEMBER, to):
        more, to, problem = _inflated(data, to)
        if problem or more.startswith(VERSION):
            return inner, end
        pieces.append(more)
        size += len(more)
        if size >= wanted:
            pieces = [b"".join(pieces)]
            wanted = _wanted(pieces[0])
    return (b"".join(pieces), to) if size >= wanted else (inner, end)


def _wanted(start: bytes) -> int:
    """The bytes of the record that starts so, as far as can be told."""
    stop = start.find(b"\r\n\r\n") if start.startswith(VERSION) else 0
    if stop < 0:
        return len(start) + 1
    length = re.search(rb"\r\ncontent-length:[\x20\t]*([0-9]+)", start[:stop], re.IGNORECASE)
    return stop + 8 + int(length[1]) if length else len(start)


def _sure(inner: bytes, stop: int, fields: dict[str, str] | None) -> bool:
    """Whether a record that ends at ``stop`` of a damaged member is vouched for, as its checksum cannot do it."""
    if fields is None:
        return False
    digest = fields.get("warc-type") == "response" and fields.get("warc-payload-digest", "").startswith("sha1:")
    return digest or inner.startswith(VERSION, stop)


def _plain(data: bytes) -> Iterator[tuple[int, int, dict[str, str] | None, bytes | str]]:
    at, bad, reason = 0, None, ""
    while at < len(data):
        try:
            fields, block, end = parse_record(data, at)
        except Damaged as problem:
            if bad is None:
                bad, reason = at, str(problem)
            at = data.find(VERSION, at + 1)
            if at < 0:
                break
            continue
        if bad is not None:
            yield bad, at, None, reason
            bad = None
        yield at, end, fields, block
        at = end
    if bad is not None:
        yield bad, len(data), None, reason


def _inflated(data: bytes, at: int) -> tuple[bytes, int, str]:
    """What the gzip member at ``at`` inflates to, its end, and what is wrong with it, if anything."""
    unpack, out, view, place = zlib.decompressobj(31), [], memoryview(data), at
    while not unpack.eof and place < len(data):
        before = unpack.copy()
        try:
            out.append(unpack.decompress(view[place : place + STEP]))
        except zlib.error as problem:
            try:
                for k in range(place, place + STEP):  # the bytes up to the fault
                    out.append(before.decompress(view[k : k + 1]))
            except zlib.error:
                place = k
            return b"".join(out), place, str(problem)
        place += STEP
    if not unpack.eof:
        return b"".join(out), len(data), "member does not end"
    return b"".join(out), min(place, len(data)) - len(unpack.unused_data), ""


_ROW = "file string, start bigint, end bigint, reason string, type string, record_id string, refers_to string, uri string, digest string, payload_bytes bigint, payload binary"


def read(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Records and gaps of all files under ``path``: a gap has a reason and no type. A revisit's digest and
    payload_bytes are those it declares; its payload is null."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows: list[tuple] = []
                size = 0
                for start, end, fields, block in salvage(content.as_py() or b""):
                    if fields is None:
                        rows.append((name, start, end, block) + (None,) * 7)
                        continue
                    kind = fields.get("warc-type", "")
                    payload = None if kind == "revisit" else payload_of(block)
                    declared = fields.get("warc-payload-digest", "").removeprefix("sha1:") or None
                    length = fields.get("warc-payload-length", "")
                    rows.append((name, start, end, None, kind, fields.get("warc-record-id"), fields.get("warc-refers-to"), fields.get("warc-target-uri"), declared if payload is None else payload_digest(payload), (int(length) if length.isdigit() else None) if payload is None else len(payload), payload if payloads else None))
                    size += len(payload or b"") * payloads
                    if len(rows) >= 1000 or size > 8 << 20:
                        yield batched(rows)
                        rows, size = [], 0
                if rows:
                    yield batched(rows)

    kinds = [pa.string(), pa.int64(), pa.int64(), *[pa.string()] * 6, pa.int64(), pa.binary()]
    names = [x.split()[0] for x in _ROW.split(", ")]

    def batched(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(column, kind) for column, kind in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return files.mapInArrow(run, _ROW)


def digests(archive: DataFrame) -> DataFrame:
    """One row per record of a page archive."""
    page = lambda column: F.regexp_extract(column, r"^<urn:page:(-?[0-9]+)[:>]", 1)
    number = lambda column: F.when(page(column) != "", page(column).cast("bigint"))
    return archive.filter(F.col("type").isNotNull()).select(
        number(F.col("record_id")).alias("page_id"),
        "payload_bytes",
        F.col("digest").alias("payload_digest"),
        F.col("type").alias("record_type"),
        number(F.col("refers_to")).alias("refers_to"),
    )
