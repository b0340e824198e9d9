"""Web archives: WARC records written and read back, segments joined again, chunked bodies decoded.

Archives are files of WARC 1.1 records, written through Spark's text sink so that any
file system Spark knows can hold them: a record ends with two CRLF, which is the sink's
line separator. A block longer than `segment_bytes` is cut into a first record and
continuation records. Bodies use chunked transfer framing.

Reading takes each file's records, groups segments by their origin's identifier, orders them
by segment number, checks that they are all there and that their total length is the stated
one, and decodes the chunked body. Of what does not fit, `problem` says what is wrong.

Defined results: a null html is an empty payload; a null url gives no target line; a null page
id is read back as null; every row is a capture with a record of its own, rows equal in id, url
and html too, whose records are numbered; of equal payloads the one with the smallest page id
(null last, then by url) is the response, one of the rows equal in all three; other columns are
not read; an empty table gives no records.
"""

from __future__ import annotations

import gzip
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newswatch.llm.common import text_of, written
from newswatch.session import scratch_path

END_OF_RECORD = "\r\n\r\n"
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SEGMENTS = (
    "record_id string, record_type string, target_uri string, refers_to string, declared_digest string, "
    "origin_id string, number int, total_length long, block binary, problem string"
)
RECORDS = (
    "record_id string, record_type string, target_uri string, refers_to string, "
    "payload_digest string, payload binary, problem string"
)


def record_id(page_id: int | None, url: str | None, digest: str, copy: int = 0) -> str:
    name = "null" if url is None else hashlib.sha256(url.encode()).hexdigest()[:16]
    number = f":copy:{copy}" if copy else ""
    return f"<urn:page:{'null' if page_id is None else page_id}:{name}:{digest[:32]}{number}>"


def chunked(payload: bytes, size: int) -> bytes:
    """`payload` in chunked transfer framing."""
    parts = []
    for k in range(0, len(payload), size):
        piece = payload[k : k + size]
        parts += [b"%x\r\n" % len(piece), piece, b"\r\n"]
    return b"".join([*parts, b"0\r\n\r\n"])


def unchunked(body: bytes) -> bytes:
    """The payload of a chunked body; raises ValueError if the framing is broken."""
    parts, at = [], 0
    while True:
        line = body.find(b"\r\n", at)
        if line < 0:
            raise ValueError("chunk without size")
        size = int(body[at:line].split(b";")[0], 16)
        if size == 0:
            return b"".join(parts)
        if body[line + 2 + size : line + 4 + size] != b"\r\n":
            raise ValueError("chunk without end")
        parts.append(body[line + 2 : line + 2 + size])
        at = line + 4 + size


def _head(fields: dict[str, str | None]) -> bytes:
    lines = [f"{k}: {' '.join(v.split())}" for k, v in fields.items() if v is not None]
    return ("WARC/1.1\r\n" + "\r\n".join(lines) + "\r\n\r\n").encode()


def records_of(fields: dict[str, str | None], block: bytes, segment_bytes: int) -> Iterator[bytes]:
    """The record of `block`, without its closing line ends, or its segments."""
    pieces = [block[k : k + segment_bytes] for k in range(0, len(block), segment_bytes)] or [b""]
    for k, piece in enumerate(pieces):
        own = dict(fields)
        if len(pieces) > 1:
            own["WARC-Segment-Number"] = str(k + 1)
            if k:
                origin = fields["WARC-Record-ID"]
                own = {
                    "WARC-Type": "continuation",
                    "WARC-Record-ID": f"{origin[:-1]}:segment:{k + 1}>",
                    "WARC-Date": fields["WARC-Date"],
                    "WARC-Segment-Origin-ID": origin,
                    "WARC-Segment-Number": str(k + 1),
                }
            if k == len(pieces) - 1:
                own["WARC-Segment-Total-Length"] = str(len(block))
        yield _head(own | {"Content-Length": str(len(piece))}) + piece


def write_archives(
    pages: DataFrame,
    least_bytes: int = 100,
    segment_bytes: int = 32 << 10,
    chunk_bytes: int = 8 << 10,
    records_per_file: int = 1000,
    date: str = "1970-01-01T00:00:00Z",
) -> str:
    """Write a record per row of `pages` (page_id, url, html); the folder of archives.

    A file holds at most `records_per_file` records of at most `segment_bytes` and heads.
    """
    spark = pages.sparkSession

    def render(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            out = []
            for row in batch.to_pylist():
                own = record_id(row["page_id"], row["url"], row["digest"], row["copy"])
                first = record_id(row["first_page"], row["first_url"], row["digest"]) if row["first_found"] else own
                fields = {
                    "WARC-Type": "response" if first == own else "revisit",
                    "WARC-Record-ID": own,
                    "WARC-Date": date,
                    "WARC-Target-URI": row["url"],
                    "WARC-Payload-Digest": f"sha256:{row['digest']}",
                    "Content-Type": "application/http; msgtype=response",
                }
                if first == own:
                    out += records_of(fields, HTTP_HEAD + chunked(row["payload"], chunk_bytes), segment_bytes)
                else:
                    fields |= {"WARC-Refers-To": first, "WARC-Profile": REVISIT_PROFILE}
                    fields |= {"WARC-Refers-To-Target-URI": row["first_url"], "WARC-Refers-To-Date": date}
                    out += records_of(fields, HTTP_HEAD, segment_bytes)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])

    captures = pages.select(F.col("page_id").cast("long"), "url", text_of("html").cast("binary").alias("payload")).withColumn(
        "digest", F.sha2("payload", 256)
    )
    counted = written(
        captures.groupBy("page_id", "url", "digest").agg(F.count(F.lit(1)).alias("n"), F.max(F.octet_length("payload")).alias("size")),
        "captures-counted",
    )
    shared = (
        counted.filter(F.col("size") >= least_bytes)
        .groupBy("digest")
        .agg(F.min(F.struct(F.col("page_id").isNull().alias("none"), "page_id", "url")).alias("first"), F.sum("n").alias("n"))
        .filter("n > 1")
        .select("digest", F.lit(True).alias("first_found"), F.col("first.page_id").alias("first_page"), F.col("first.url").alias("first_url"))
    )
    rows = captures.withColumn("copy", F.lit(0).cast("long"))
    equal = counted.filter("n > 1")
    if not equal.isEmpty():
        rows = numbered(captures, equal, least_bytes)
    path = scratch_path(spark, "archives")
    (
        rows.join(shared, "digest", "left")
        .select("page_id", "url", "payload", "digest", "copy", "first_found", "first_page", "first_url")
        .mapInArrow(render, "record binary")
        .select(F.col("record").cast("string"))
        .write.option("lineSep", END_OF_RECORD)
        .option("compression", "gzip")
        .option("maxRecordsPerFile", records_per_file)
        .text(path)
    )
    return path


def numbered(captures: DataFrame, equal: DataFrame, least_bytes: int, block: int = 10_000) -> DataFrame:
    """`captures` with `copy`: 0, and numbers from 1 for further rows equal to one before.

    `equal` (page_id, url, digest, n, size) counts the rows that occur more than once. One of each is kept
    with its payload, combined before the shuffle; the others are made from the count, in blocks, and carry
    a payload only where it is too small for a revisit.
    """
    keys = ["page_id", "url", "digest"]
    mine, theirs = captures.alias("c"), equal.alias("e")
    same = F.lit(True)
    for k in keys:
        same = same & F.col(f"c.{k}").eqNullSafe(F.col(f"e.{k}"))
    firsts = written(mine.join(theirs, same, "left_semi").groupBy(*keys).agg(F.first("payload").alias("payload"), F.count(F.lit(1)).alias("n")), "equal-captures")
    small = F.when(F.octet_length("payload") < least_bytes, F.col("payload"))
    blocks = firsts.select(*keys, small.alias("payload"), "n", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 2) / block))).alias("block"))
    last = F.least(F.col("n") - 1, (F.col("block") + 1) * block)
    copies = blocks.repartition("digest", "block").select(*keys, "payload", F.explode(F.sequence(F.col("block") * block + 1, last)).alias("copy"))
    order = ["page_id", "url", "payload", "digest", "copy"]
    single = mine.join(theirs, same, "left_anti").unionByName(firsts.drop("n")).withColumn("copy", F.lit(0).cast("long"))
    return single.select(*order).unionByName(copies.select(*order))


def parse_archive(raw: bytes) -> Iterator[tuple]:
    """(record_id, type, uri, refers_to, digest, origin, number, total, block, problem) of each record of a file."""
    at = 0
    while at < len(raw):
        head_end = raw.find(b"\r\n\r\n", at)
        if head_end < 0 or not raw.startswith(b"WARC/", at):
            yield (None, None, None, None, None, None, None, None, None, f"no record at byte {at}")
            return
        fields = {}
        for line in raw[at:head_end].decode("utf-8", "replace").split("\r\n")[1:]:
            name, _, value = line.partition(":")
            fields[name.strip().lower()] = value.strip()
        try:
            length = int(fields["content-length"])
        except (KeyError, ValueError):
            yield (None, None, None, None, None, None, None, None, None, f"no length at byte {at}")
            return
        block = raw[head_end + 4 : head_end + 4 + length]
        own, number = fields.get("warc-record-id"), fields.get("warc-segment-number")
        total = fields.get("warc-segment-total-length")
        origin = fields.get("warc-segment-origin-id") or (own if number else None)
        yield (
            own, fields.get("warc-type"), fields.get("warc-target-uri"), fields.get("warc-refers-to"),
            fields.get("warc-payload-digest"), origin, int(number) if number else None,
            int(total) if total else None, block, None if len(block) == length else "record cut short",
        )
        at = head_end + 4 + length + 4


def payload_of(block: bytes) -> bytes:
    """The decoded body of an HTTP response block."""
    head, _, body = block.partition(b"\r\n\r\n")
    framed = any(
        line.split(b":")[0].strip().lower() == b"transfer-encoding" and b"chunked" in line.lower() for line in head.split(b"\r\n")[1:]
    )
    return unchunked(body) if framed else body


def _finished(row: tuple) -> tuple:
    """(record_id, type, uri, refers_to, digest, payload, problem) of a whole record."""
    own, kind, uri, refers, declared, _, _, _, block, problem = row
    payload, digest = None, (declared or "").rpartition(":")[2] or None
    if kind == "response" and not problem:
        try:
            payload = payload_of(block)
            found = hashlib.sha256(payload).hexdigest()
            if digest and (declared or "").startswith("sha256:") and found != digest:
                problem = "payload differs from its digest"
            digest = found
        except ValueError as e:
            problem = str(e)
    return own, kind, uri, refers, digest, payload, problem


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


_SEGMENT = pa.schema(
    [("record_id", pa.string()), ("record_type", pa.string()), ("target_uri", pa.string()), ("refers_to", pa.string()),
     ("declared_digest", pa.string()), ("origin_id", pa.string()), ("number", pa.int32()), ("total_length", pa.int64()),
     ("block", pa.binary()), ("problem", pa.string())]
)
_RECORD = pa.schema(
    [("record_id", pa.string()), ("record_type", pa.string()), ("target_uri", pa.string()), ("refers_to", pa.string()),
     ("payload_digest", pa.string()), ("payload", pa.binary()), ("problem", pa.string())]
)


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    """Every record of the archives under `path`, segments as they are."""

    def parse(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for value in batch.column(0):
                raw = value.as_py()
                raw = gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw
                held: list[tuple] = []
                size = 0
                for row in parse_archive(raw):
                    held.append(row)
                    size += len(row[8] or b"")
                    if size > 4 << 20:
                        yield _batch(held, _SEGMENT)
                        held, size = [], 0
                if held:
                    yield _batch(held, _SEGMENT)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(parse, SEGMENTS)


def whole_records(segments: DataFrame) -> DataFrame:
    """Records with decoded payloads. Only segmented ones are shuffled, by their origin's identifier."""

    def single(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            if batch.num_rows:
                yield _batch([_finished(tuple(r.values())) for r in batch.to_pylist()], _RECORD)

    def joined(parts: list[tuple]) -> tuple:
        by_number = {p[6]: p for p in reversed(parts)}
        first, block = by_number.get(1), b"".join(by_number[k][8] for k in sorted(by_number))
        total = next((p[7] for p in parts if p[7] is not None), None)
        problem = next((p[9] for p in parts if p[9]), None)
        if first is None or sorted(by_number) != list(range(1, len(by_number) + 1)):
            problem = problem or "segments missing"
        elif total != len(block):
            problem = problem or f"total length {total}, segments hold {len(block)}"
        first = first or (parts[0][5], *parts[0][1:])
        return (*first[:8], block, problem)

    def assemble(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple] = []
        for batch in rows:
            for r in batch.to_pylist():
                row = tuple(r.values())
                if parts and parts[0][5] != row[5]:
                    yield _batch([_finished(joined(parts))], _RECORD)
                    parts = []
                parts.append(row)
        if parts:
            yield _batch([_finished(joined(parts))], _RECORD)

    alone = segments.filter(F.col("origin_id").isNull()).mapInArrow(single, RECORDS)
    cut = segments.filter(F.col("origin_id").isNotNull()).repartition("origin_id").sortWithinPartitions("origin_id", "number")
    return alone.unionByName(cut.mapInArrow(assemble, RECORDS))


def page_of(record: str) -> F.Column:
    return F.expr(f"try_cast(regexp_extract({record}, '^<urn:page:([^:]*):', 1) AS bigint)")


def captures(records: DataFrame) -> DataFrame:
    """One row per capture with the length and digest of its full payload; a revisit takes them from its response."""
    narrow = written(
        records.filter(F.col("record_type").isin("response", "revisit")).select(
            "record_id", "record_type", "refers_to", "payload_digest", F.octet_length("payload").cast("long").alias("payload_bytes"), "problem"
        ),
        "captures",
    )
    first = narrow.filter("record_type = 'response'").select(
        F.col("record_id").alias("refers_to"), F.col("payload_digest").alias("first_digest"), F.col("payload_bytes").alias("first_bytes")
    )
    # Archives of others may hold a record twice; stored, so that a response of very many revisits is split in the join.
    first = written(first.dropDuplicates(["refers_to"]), "responses")
    revisits = narrow.filter("refers_to IS NOT NULL").join(first, "refers_to", "left")
    full = narrow.filter("refers_to IS NULL").unionByName(revisits, allowMissingColumns=True)
    return full.select(
        page_of("record_id").alias("page_id"),
        F.coalesce("payload_bytes", "first_bytes").alias("payload_bytes"),
        F.coalesce("first_digest", "payload_digest").alias("payload_digest"),
        "record_type",
        page_of("refers_to").alias("refers_to"),
        F.coalesce("problem", F.when(F.col("refers_to").isNotNull() & F.col("first_digest").isNull(), "response missing")).alias("problem"),
    )
