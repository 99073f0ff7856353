"""WARC archives: writing captures, reading them back, and assembling transactions.

Each capture is three records: the response (or, for a payload that an earlier page holds, a
revisit), the request and a metadata record. The request and the metadata name the response's record in
WARC-Concurrent-To; reading joins the three through that id and emits one nested row per capture.

Archives are ordinary files that Spark's text writer makes: a record is a line, and the line
separator is the two empty lines that end a record. They are read as a stream of what stands between such separators
and put together by Content-Length, so a payload may hold anything, a task holds one record at a time, and
a file may be of any size; RECORDS a file only spreads the reading. Archives of others may have any name: those in gzip, in one member or
one a record, are read where they lie; plain ones, which Spark may split anywhere, are read as lines, whose ends are the same from any start, and
each file's lines are put in order again in one task, by a sort that spills.

Defined results: a null html is an empty payload. Among equal payloads (empty ones too) the smallest page_id is
the response, a null one before all others. Each row is a capture of its own, named by its id, its digest and its
place in the table: rows that repeat the smallest id are all responses, and revisits refer to the first of them. So pages has
to be a table or a frame that Spark computes alike each time. Further columns are ignored. On reading, header names count in
any case, a payload that doesn't match its SHA-1 is not intact but stays; a file that holds anything else than WARC records is an error, and so is
a folder without files. Files whose names begin with a dot or an underscore are not looked at.
"""

from __future__ import annotations

import re
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import prepare, shared_dir

RECORDS = 3000
SENT_ROWS, SENT_BYTES = 1000, 4 << 20
END = "\r\n\r\n"
PACKED = r"\.gz$"
RECORD = "id string, type string, concurrent_to string, refers_to string, target string, payload_digest string, payload_bytes long, payload string, intact boolean, fields map<string,string>"
_KIND = pa.schema([(c, pa.string()) for c in ("id", "type", "concurrent_to", "refers_to", "target", "payload_digest")] + [("payload_bytes", pa.int64()), ("payload", pa.string()), ("intact", pa.bool_()), ("fields", pa.map_(pa.string(), pa.string()))])


# ---- writing --------------------------------------------------------------------------------


def base32(hex_digest: Column) -> Column:
    """The 160 bits of a hex SHA-1 in base32."""
    bits = F.concat(*[F.lpad(F.conv(F.substring(hex_digest, 1 + 10 * i, 10), 16, 2), 40, "0") for i in range(4)])
    five = [F.substring(bits, 1 + 5 * i, 5) for i in range(32)]
    return F.concat(*[F.substring(F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"), F.conv(x, 2, 10).cast("int") + 1, F.lit(1)) for x in five])


def record_id(role: str, *key: Column) -> Column:
    h = F.md5(F.concat_ws("|", F.lit(role), *[F.coalesce(k.cast("string"), F.lit("null")) for k in key]))
    parts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def _record(kind: str, headers: list[tuple[str, Column | str | None]], block: Column) -> Column:
    lines = [F.lit("WARC/1.0"), F.lit(f"WARC-Type: {kind}")]
    lines += [F.concat(F.lit(f"{k}: "), F.lit(v) if isinstance(v, str) else v) for k, v in headers if v is not None]
    lines.append(F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")))
    return F.concat(F.concat_ws("\r\n", *lines), F.lit(END), block)


def write_captures(pages: DataFrame, path: str, when: str = "2024-01-01T00:00:00Z") -> None:
    """Write the records of all pages (page_id, url, html) to gzip archives under ``path``."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.regexp_replace("url", r"\s+", "%20"), F.lit("about:blank")).alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumns({"sha1": F.sha1(F.col("html").cast("binary")), "row": F.monotonically_increasing_id()})
    first = rows.groupBy("sha1").agg(F.min(F.struct("page_id", "row")).alias("first"), F.count("*").alias("n")).filter("n > 1")
    # dealt anew, so that both sides of the join are plain shuffles, which Spark may split where a digest is frequent
    first = first.select("sha1", F.col("first.page_id").alias("first"), F.col("first.row").alias("first_row")).repartition(F.col("first_row"))
    rows = rows.join(first.withColumn("copied", F.lit(True)), "sha1", "left")
    page, sha1, row = F.col("page_id"), F.col("sha1"), F.col("row")
    revisit = F.col("copied").isNotNull() & ~page.eqNullSafe(F.col("first"))
    digest = F.concat(F.lit("sha1:"), base32(sha1))
    common = [("WARC-Date", when), ("WARC-Target-URI", F.col("url"))]
    main_id, head = record_id("capture", page, sha1, row), F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n")
    main = [("WARC-Record-ID", main_id), *common, ("WARC-Payload-Digest", digest), ("Content-Type", "application/http; msgtype=response")]
    response = _record("response", main, F.concat(head, F.col("html")))
    again = _record("revisit", [*main, ("WARC-Profile", "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"), ("WARC-Refers-To", record_id("capture", F.col("first"), sha1, F.col("first_row")))], head)
    request = _record("request", [("WARC-Record-ID", record_id("request", page, sha1, row)), *common, ("WARC-Concurrent-To", main_id), ("Content-Type", "application/http; msgtype=request")], F.concat(F.lit("GET "), F.col("url"), F.lit(" HTTP/1.1\r\n\r\n")))
    note = F.concat(F.lit("page_id: "), F.coalesce(page.cast("string"), F.lit("")), F.lit("\r\n"))
    metadata = _record("metadata", [("WARC-Record-ID", record_id("metadata", page, sha1, row)), *common, ("WARC-Concurrent-To", main_id), ("Content-Type", "application/warc-fields")], note)
    records = rows.select(F.explode(F.array(F.when(revisit, again).otherwise(response), request, metadata)).alias("value"))
    records.write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", RECORDS).text(path)


# ---- reading --------------------------------------------------------------------------------


def _headers(lines: list[str]) -> dict[str, str]:
    """Header fields by lower-case name."""
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}


def _row(head: bytes, block: bytes, name: str) -> tuple:
    from base64 import b32encode
    from hashlib import sha1

    version, *lines = head.decode(errors="replace").lstrip("\r\n").split("\r\n")
    h = _headers(lines)
    kind = h.get("warc-type", "")
    payload = block.partition(b"\r\n\r\n")[2] if h.get("content-type", "").startswith("application/http") else block
    is_page = kind == "response"
    method, _, digest = h.get("warc-payload-digest", "").rpartition(":")
    intact = b32encode(sha1(payload).digest()).decode() == digest.upper() if is_page and method.lower() == "sha1" else None
    fields = [(k.strip(), v.strip()) for k, _, v in (x.partition(":") for x in block.decode(errors="replace").split("\r\n")) if k.strip()] if kind == "metadata" else []
    whole = (len(payload), payload.decode(errors="replace")) if is_page else (None, None)
    return h.get("warc-record-id"), kind, h.get("warc-concurrent-to"), h.get("warc-refers-to"), h.get("warc-target-uri"), digest or None, *whole, intact, list(dict(fields).items())


def _parsed(batches):
    """(path, part) rows in the order of the files, a part being what stands between two separators, to records."""
    file, head, parts, size, need, rows, sent = None, None, [], 0, 0, [], 0
    for batch in batches:
        for name, part in zip(batch.column("path").to_pylist(), batch.column("value").to_pylist(), strict=True):
            if name != file:
                if head is not None:
                    raise ValueError(f"the last record of {file} is cut short")
                file = name
            if head is None:
                first = part.lstrip(b"\r\n")
                if not first:
                    continue
                if not first.startswith(b"WARC/"):
                    raise ValueError(f"no WARC record where one begins in {name}")
                head, parts, size = part, [], -len(END)
                length = _headers(part.decode(errors="replace").split("\r\n")).get("content-length", "")
                need = int(length) if length.isascii() and length.isdigit() and len(length) < 19 else -1
                if need < 0:
                    raise ValueError(f"a record of {name} has no length")
                continue
            parts.append(part)
            size += len(part) + len(END)
            if size > need:
                raise ValueError(f"a record of {name} is longer than it says")
            if size == need - 2:  # a block that ends a line: the separator began there, and its other half follows
                parts[-1] += b"\r\n"
                size = need
            if size == need:
                rows.append(_row(head, END.encode().join(parts), name))
                head, sent = None, sent + size
                if len(rows) >= SENT_ROWS or sent >= SENT_BYTES:
                    yield _batch(rows)
                    rows, sent = [], 0
    if head is not None:
        raise ValueError(f"the last record of {file} is cut short")
    if rows:
        yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict(dict(zip(_KIND.names, zip(*rows, strict=True), strict=True)), schema=_KIND)


def _parts(batches):
    """Lines, ended by a single line feed, to the parts between two empty lines."""
    file, lines, names, parts, size = None, [], [], [], 0

    def sent():
        return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(parts, pa.binary())], names=["path", "value"])

    def ended(part: bytes):
        nonlocal size
        names.append(file)
        parts.append(part)
        lines.clear()
        size += len(part)

    for batch in batches:
        for name, line in zip(batch.column("path").to_pylist(), batch.column("value").to_pylist(), strict=True):
            if name != file:
                if lines:
                    ended(b"\n".join(lines))
                file = name
            if line == b"\r" and lines and lines[-1].endswith(b"\r"):
                ended(b"\n".join(lines)[:-1])
            else:
                lines.append(line)
            if len(parts) >= SENT_ROWS or size >= SENT_BYTES:
                yield sent()
                names, parts, size = [], [], 0
    if lines:
        ended(b"\n".join(lines))
    if parts:
        yield sent()


def _parsed_lines(batches):
    return _parsed(_parts(batches))


def read_records(spark, path: str) -> DataFrame:
    """One row per record of the archives under ``path``, as they are or in gzip."""
    prepare(spark)

    names = spark.read.text(path).inputFiles()
    if not names:
        raise ValueError(f"no archives in {path}")
    kinds = {bool(re.search(PACKED, name)) for name in names}

    def read(end: str, packed: bool, *more: Column) -> DataFrame:
        text, name = spark.read.option("lineSep", end).text(path), F.col("_metadata.file_path")
        if len(kinds) > 1:
            text = text.filter(name.rlike(PACKED) == F.lit(packed))
        return text.select(name.alias("path"), F.col("value").cast("binary").alias("value"), *more)

    found = []
    if True in kinds:
        found.append(read(END, True).mapInArrow(_parsed, RECORD))
    if False in kinds:
        lines = read("\n", False, F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("place"))
        in_order = lines.repartition("path").sortWithinPartitions("path", "start", "place")
        found.append(in_order.select("path", "value").mapInArrow(_parsed_lines, RECORD))
    return found[0].unionByName(found[1]) if len(found) > 1 else found[0]


def transactions(records: DataFrame) -> DataFrame:
    """One nested row per capture: page_id, response or revisit, request, metadata; a revisit carries its response's bytes.

    Records of a capture meet by the id that they are concurrent to; records with an id seen before are the same record.
    """
    is_main = F.col("type").isin("response", "revisit")

    def of(kind: Column, value: Column | str) -> Column:
        return F.first(F.when(kind, F.col(value) if isinstance(value, str) else value), ignorenulls=True)

    main = [of(is_main, c).alias(c) for c in ("type", "refers_to", "target", "payload_digest", "payload_bytes", "payload", "intact")]
    request = [of(F.col("type") == "request", c).alias(f"request_{c}") for c in ("id", "target")]
    metadata = [of(F.col("type") == "metadata", "id").alias("metadata_id"), of(F.col("type") == "metadata", F.col("fields").getItem("page_id").try_cast("long")).alias("page_id")]
    by_capture = records.withColumn("capture_id", F.coalesce("concurrent_to", "id")).groupBy("capture_id")
    whole = by_capture.agg(*main, *request, *metadata).filter("type is not null")
    whole = whole.withColumn("source_id", F.coalesce("refers_to", "capture_id"))
    source = by_capture.agg(*main, *metadata).filter("type = 'response'")
    source = source.select(F.col("capture_id").alias("source_id"), F.col("page_id").alias("source_page"), F.col("payload_bytes").alias("source_bytes")).repartition("source_page")
    whole = whole.join(source, "source_id", "left")
    return whole.select(
        "page_id",
        F.struct(F.col("capture_id").alias("id"), F.col("type").alias("record_type"), "target", "payload_digest", F.coalesce("payload_bytes", "source_bytes").alias("payload_bytes"), "payload", "intact", "refers_to", F.when(F.col("type") == "revisit", F.col("source_page")).alias("refers_to_page")).alias("capture"),
        F.struct(F.col("request_id").alias("id"), F.col("request_target").alias("target")).alias("request"),
        F.struct(F.col("metadata_id").alias("id")).alias("metadata"),
    )


def archive_pages(pages: DataFrame, path: str | None = None, payloads: bool = True) -> DataFrame:
    """Write the pages' archives to a folder (a new one of the shared folder by default) and read them back as transactions.

    Without ``payloads`` the captures carry digests and sizes alone, and no payload is shuffled after reading.
    """
    spark = prepare(pages.sparkSession)
    path = path or f"{shared_dir(spark).rstrip('/')}/warc-{uuid.uuid4()}"
    write_captures(pages, path)
    records = read_records(spark, path)
    return transactions(records if payloads else records.withColumn("payload", F.lit(None).cast("string")))
