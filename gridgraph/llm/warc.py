"""WARC writing and reading with segmented records.

Writing: a payload becomes an HTTP response whose body is sent in chunks, and a response
longer than ``segment_bytes`` becomes several WARC records: the first a ``response``, the
others ``continuation`` records that name the first by WARC-Segment-Origin-ID. Records of
equal payload become ``revisit`` records. Files are written by Spark's own writer, so
they reach whatever store the path is in, and a lost task leaves no half-written file.

Reading: the archive's files are parsed by Content-Length; segments are grouped by origin
identifier, ordered by number, joined, and held against the total length and the payload
digest; then the HTTP head is taken off and the chunked framing is decoded. Revisits are
held against the response that they refer to. What is wrong with a record is told in its
row; the others are read.

A page's number stands in its record's identifier, ``<urn:x-page:NUMBER:DIGEST>``, and so
in WARC-Refers-To.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridgraph.llm.common import as_bytes, bound_batches, for_this_session, shared_path, sliced, table, written

END = b"\r\n\r\n"
SEGMENT_BYTES = 64 << 10
CHUNK_BYTES = 8 << 10
#: Payloads below this size are stored again rather than referred to.
REVISIT_BYTES = 100
#: Records in a file: with SEGMENT_BYTES, this bounds the size of a file to be parsed.
FILE_RECORDS = 256
#: Payloads that have copies, up to which their digests are sent to all tasks (about 20 MB).
KNOWN_COPIES = 200_000
_SIZE = re.compile(rb"[0-9A-Fa-f]{1,15}")
_PAGE = r"^<urn:x-page:(-?\d+):\w+>$"


def chunked(body: bytes, size: int = CHUNK_BYTES) -> bytes:
    """A body in HTTP's chunked transfer framing."""
    parts = [b"%x\r\n%b\r\n" % (len(c), c) for c in (body[i : i + size] for i in range(0, len(body), size))]
    return b"".join(parts) + b"0\r\n\r\n"


def unchunked(framed: bytes) -> bytes:
    """The body of a chunked transfer; extensions and trailers are passed over."""
    out, at = [], 0
    while True:
        line = framed.find(b"\r\n", at)
        if line < 0 or not _SIZE.fullmatch(framed[at:line].split(b";")[0].strip()):
            raise ValueError("a chunk has no length")
        size = int(framed[at:line].split(b";")[0], 16)
        if not size:
            return b"".join(out)
        if framed[line + 2 + size : line + 4 + size] != b"\r\n":
            raise ValueError("a chunk's length and its end disagree")
        out.append(framed[line + 2 : line + 2 + size])
        at = line + 4 + size


def _record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    """A record without the two line ends behind it, which the writer adds."""
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", len(block))])
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block


def records(url: str, payload: bytes, digest: str, refers_to: str | None, record_id: str, segment_bytes: int = SEGMENT_BYTES) -> list[bytes]:
    """The WARC records of one page."""
    own = [("WARC-Record-ID", f"<{record_id}>"), ("WARC-Date", "2024-01-01T00:00:00Z")]
    whole = [("WARC-Target-URI", url), ("WARC-Payload-Digest", f"sha256:{digest}"), ("Content-Type", "application/http;msgtype=response")]
    if refers_to is not None:
        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
        profile = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
        return [_record([("WARC-Type", "revisit"), *own, *whole, ("WARC-Profile", profile), ("WARC-Refers-To", f"<{refers_to}>")], block)]
    message = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    parts = [message[i : i + segment_bytes] for i in range(0, len(message), segment_bytes)]
    if len(parts) == 1:
        return [_record([("WARC-Type", "response"), *own, *whole], message)]
    out = []
    for n, part in enumerate(parts, 1):
        number = [("WARC-Segment-Number", n)]
        if n > 1:
            number += [("WARC-Segment-Origin-ID", f"<{record_id}>")]
        if n == len(parts):
            number += [("WARC-Segment-Total-Length", len(message))]
        if n == 1:
            out.append(_record([("WARC-Type", "response"), *own, *whole, *number], part))
        else:
            out.append(_record([("WARC-Type", "continuation"), ("WARC-Record-ID", f"<{record_id}:{n}>"), own[1], whole[0], *number], part))
    return out


def parse(archive: bytes) -> Iterator[tuple[dict[str, str], bytes, str | None]]:
    """Head fields (names in lower case), block, and what is wrong (None: nothing) of each
    record of an archive. Behind a broken record, reading goes on at the next one."""
    at = 0
    while at < len(archive):
        end = archive.find(END, at)
        version, *lines = archive[at : end if end >= 0 else len(archive)].decode("utf-8", "replace").split("\r\n")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        length = fields.get("content-length", "")
        if end < 0 or not version.startswith("WARC/") or not (length.isdecimal() and length.isascii()) or "warc-record-id" not in fields or "warc-type" not in fields:
            wrong = f"no whole head of a record at byte {at}"
        else:
            begin, size = end + 4, int(length)
            if archive[begin + size : begin + size + 4] == END:
                yield fields, archive[begin : begin + size], None
                at = begin + size + 4
                continue
            wrong = f"the record at byte {at} does not end where its length says"
        yield fields if version.startswith("WARC/") else {}, b"", wrong
        next_one = archive.find(END + b"WARC/", at)
        at = next_one + 4 if next_one >= 0 else len(archive)


def _clean(value: str | None) -> str:
    """A URL for a head line, which must not hold line ends."""
    return "".join(c for c in value or "" if c not in "\r\n")


def payloads(pages: DataFrame, id_col: str, url_col: str, html_col: str, revisit_bytes: int = REVISIT_BYTES, known_copies: int = KNOWN_COPIES) -> DataFrame:
    """page_id, url, payload, digest, refers_to (page id of the response with the same
    payload), with one row for each row of ``pages``.

    A null html is an empty payload. Of equal payloads of ``revisit_bytes`` or more, rows
    of the least page id are responses, the others refer to it; where all of them have a
    null id, all are responses. Ids are whole numbers. Payloads stay where they are as long
    as no more than ``known_copies`` different ones have copies.
    """
    rows = pages.select(
        F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).cast("string").alias("url"),
        F.coalesce(F.col(html_col).cast("binary"), F.expr("cast('' as binary)")).alias("payload"),
    ).withColumn("digest", F.sha2("payload", 256))
    long_ones = rows.filter(F.octet_length("payload") >= revisit_bytes)
    # A count and a least id for each digest: partial sums, however many copies there are.
    copies = long_ones.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.min("page_id").alias("first")).filter("n > 1").select("digest", "first")
    copies = written(copies, "warc-copies")
    if copies.count() <= known_copies:
        copies = F.broadcast(copies)
    other = (F.octet_length("payload") >= revisit_bytes) & F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return rows.join(copies, "digest", "left").select("page_id", "url", "payload", "digest", F.when(other, F.col("first")).alias("refers_to"))


def write_archives(rows: DataFrame, path: str, segment_bytes: int = SEGMENT_BYTES) -> None:
    """Writes rows of page_id, url, payload, digest and refers_to as WARC files. Rows that
    repeat a page write its records again, under the same identifiers."""

    bound_batches(rows.sparkSession, 500)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 100):
            ids, urls, _, digests, refers = (c.to_pylist() for c in batch.columns)
            out: list[bytes] = []
            size = 0
            for i, u, p, d, r in zip(ids, urls, as_bytes(batch.column(2)), digests, refers, strict=True):
                made = records(_clean(u), p, d, None if r is None else _record_id(r, d), _record_id(i, d), segment_bytes)
                out += made
                size += sum(map(len, made))
                if size > 4 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])
                    out, size = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])

    # The text writer puts a string's bytes down as they are, then the line separator.
    made = rows.select("page_id", "url", "payload", "digest", "refers_to").mapInArrow(make, "value binary")
    made.select(F.col("value").cast("string").alias("value")).write.option("lineSep", END.decode()).option("maxRecordsPerFile", FILE_RECORDS).option("compression", "gzip").text(path)


def _record_id(page: int | None, digest: str) -> str:
    return f"urn:x-page:{'' if page is None else page}:{digest}"


# A parsed record, whole (number 0: framing is decoded, block is the payload) or a segment.
_PART = "record_id string, number int, total bigint, url string, record_type string, digest string, refers_id string, payload_bytes bigint, block binary, error string"
_WHOLE = "record_id string, url string, record_type string, digest string, refers_id string, payload_bytes bigint, payload binary, error string"
_TYPES = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary()}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    names, kinds = zip(*(x.split() for x in schema.split(", ")), strict=True)
    columns = zip(*rows, strict=True) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, _TYPES[k]) for c, k in zip(columns, kinds, strict=True)], names=names)


def _number(value: str | None) -> int | None:
    return int(value) if value and value.isdecimal() and value.isascii() and len(value) < 19 else None


def _decoded(kind: str | None, stated: str | None, message: bytes) -> tuple[str | None, int | None, bytes | None, str | None]:
    """Digest, length, payload and what is wrong of a whole message: its HTTP head is taken
    off, its framing decoded, and its digest held against the one that the record states.
    A revisit has the digest and length that it states."""
    head, _, body = message.partition(END)
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("latin-1").split("\r\n")[1:])}
    if kind == "revisit":
        return stated, _number(fields.get("content-length")), None, None
    try:
        payload = unchunked(body) if fields.get("transfer-encoding", "").lower() == "chunked" else body
    except ValueError as e:
        return stated, None, None, str(e)
    found = hashlib.sha256(payload).hexdigest()
    if stated is not None and found != stated:
        return found, len(payload), payload, "the payload does not have the digest that its record states"
    return found, len(payload), payload, None


def _inflated(content: bytes) -> tuple[bytes, str | None]:
    """The plain archive of a file, with one gzip member or several, as far as it is whole."""
    if not content.startswith(b"\x1f\x8b"):
        return content, None
    out = []
    while content:
        member = zlib.decompressobj(31)
        try:
            out.append(member.decompress(content))
        except zlib.error:
            return b"".join(out), "the file is not whole gzip"
        if not member.eof:
            return b"".join(out), "the file is not whole gzip"
        content = member.unused_data
    return b"".join(out), None


def _parsed(content: bytes) -> Iterator[tuple]:
    plain, broken = _inflated(content)
    for f, block, wrong in parse(plain):
        kind, stated, number = f.get("warc-type"), f.get("warc-payload-digest", "").removeprefix("sha256:") or None, _number(f.get("warc-segment-number")) or 0
        own = f.get("warc-segment-origin-id") or f.get("warc-record-id")
        head = (f.get("warc-target-uri"), kind, stated, f.get("warc-refers-to"))
        if wrong or number:
            yield own, 0 if wrong else number, _number(f.get("warc-segment-total-length")), *head, None, None if wrong else block, wrong
        elif kind in ("response", "revisit", "resource"):
            digest, size, payload, wrong = _decoded(kind, stated, block)
            yield own, 0, None, head[0], kind, digest, head[3], size, payload, wrong
    if broken:
        yield None, 0, None, None, None, None, None, None, None, broken


def join_segments(segments: list[dict]) -> list[bytes]:
    """The messages of one origin's segments (number, total, block). Records written
    twice under one identifier have every segment twice, and come out twice."""
    by_number: dict[int, list[dict]] = {}
    for s in segments:
        by_number.setdefault(s["number"], []).append(s)
    numbers, copies = sorted(by_number), {len(x) for x in by_number.values()}
    if numbers != list(range(1, len(numbers) + 1)) or len(copies) != 1 or any(len({x["block"] for x in g}) > 1 for g in by_number.values()):
        raise ValueError("segments are missing or differ")
    message = b"".join(by_number[n][0]["block"] for n in numbers)
    if by_number[numbers[-1]][0]["total"] != len(message):
        raise ValueError("the segments' total length is not the one that the last states")
    return [message] * copies.pop()


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The responses, resources and revisits of the WARC files below a path, whole again:
    record_id, page_id, url, record_type, digest, refers_to, payload_bytes, payload (null
    for revisits) and error.

    ``error`` is null where all is well. A record that ends early, a missing segment, a
    wrong total length, wrong framing, a wrong digest, a file that is not whole gzip, and a
    revisit whose response is not there or has another digest or length have a row that
    says so; page_id, refers_to and others are null where they can't be told. Records of
    other types are passed over. A file is one value in a task, so it has to be below 2 GB.

    Each file is parsed once. Records of one segment are decoded where they are read; only
    segments are shuffled, and a group is one record's segments. Revisits meet digests and
    lengths of responses, not payloads.
    """
    bound_batches(spark, 100)
    files = spark.read.format("binaryFile").load(path).select("content")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 100):
            for content in as_bytes(batch.column(0)):
                rows, size = [], 0
                for row in _parsed(content):
                    rows.append(row)
                    size += len(row[8] or b"")
                    if size > 8 << 20:
                        yield _batch(rows, _PART)
                        rows, size = [], 0
                yield _batch(rows, _PART)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 100):
            out = []
            for r in batch.to_pylist():
                head = (r["record_id"], r["url"], r["record_type"])
                try:
                    for message in join_segments(r["segments"]):
                        digest, size, payload, wrong = _decoded(r["record_type"], r["digest"], message)
                        out.append((*head, digest, r["refers_id"], size, payload, wrong))
                except ValueError as e:
                    out.append((*head, r["digest"], r["refers_id"], None, None, str(e)))
            yield _batch(out, _WHOLE)

    parsed = written(files.mapInArrow(read, _PART), "warc-records")
    first = lambda c: F.max(F.when(F.col("number") == 1, F.col(c))).alias(c)
    groups = parsed.filter("number > 0").groupBy("record_id").agg(
        F.collect_list(F.struct("number", "total", "block")).alias("segments"), *[first(c) for c in ("url", "record_type", "digest", "refers_id")]
    )
    names = [x.split()[0] for x in _WHOLE.split(", ")]
    alone = parsed.filter("number = 0").withColumnRenamed("block", "payload").select(*names)
    joined = written(groups.mapInArrow(join, _WHOLE), "warc-joined")
    whole = alone.unionAll(joined)
    there = whole.filter("record_type <> 'revisit' and error is null").groupBy(F.col("record_id").alias("refers_id")).agg(F.max("digest").alias("its_digest"), F.max("payload_bytes").alias("its_bytes"))
    revisits = whole.filter("record_type = 'revisit'").join(there, "refers_id", "left")
    wrong = F.when(F.col("its_digest").isNull(), "the response that is referred to is not there").when(
        ~F.col("its_digest").eqNullSafe(F.col("digest")) | ~F.col("its_bytes").eqNullSafe(F.col("payload_bytes")), "the response that is referred to has another digest or length"
    )
    revisits = revisits.withColumn("error", F.coalesce("error", wrong)).select(*names)
    number = lambda c: F.regexp_extract(c, _PAGE, 1).try_cast("bigint")
    every = whole.filter("record_type <> 'revisit' or record_type is null").select(*names).unionAll(revisits)
    return every.select("record_id", number("record_id").alias("page_id"), "url", "record_type", "digest", number("refers_id").alias("refers_to"), "payload_bytes", "payload", "error")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's row, as read back from the archives that were written of them."""
    path = shared_path(spark, "warc")
    write_archives(payloads(table(spark, sf_dir, "pages"), "page_id", "url", "html"), path)
    for_this_session(spark, path)
    back = read_archives(spark, path)
    return back.select("page_id", "payload_bytes", F.col("digest").alias("payload_digest"), "record_type", "refers_to", "error")


OP9_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS digest FROM pages),
f AS (SELECT digest, min(page_id) AS first FROM p WHERE n >= 100 GROUP BY digest HAVING count(*) > 1)
SELECT p.page_id, CAST(p.n AS BIGINT) AS payload_bytes, p.digest AS payload_digest,
  CASE WHEN f.first <> p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN f.first <> p.page_id THEN f.first END AS refers_to, CAST(NULL AS VARCHAR) AS error
FROM p LEFT JOIN f ON p.digest = f.digest AND p.n >= 100
"""
