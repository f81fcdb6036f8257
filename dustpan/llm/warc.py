"""WARC archives: written with segments and chunked transfer framing, read back whole.

Writing.  A page becomes a record whose HTTP block carries the payload in
chunked transfer framing.  Of pages with equal payloads of at least
``LEAST_REVISIT`` bytes only the one with the largest id is a response; the
others are revisits, which name its payload digest.  A block longer than
``SEGMENT`` bytes is cut into a first segment and continuation records.
Archives are written by Spark's own text sink, so that lost tasks leave no
half-written archives and any file system serves.

Reading.  Records are split at the version line by Spark's text source, so a
task holds one record at a time, however large the archive.  Payloads may
contain version lines; then a record is shorter than its declared length, and
that archive is read again as a whole, record after record by declared length.
Segments are grouped by the record that they continue, ordered by number, and
refused unless their numbers are complete and their lengths add up to the
declared total.
"""

from __future__ import annotations

import base64
import gzip
import re
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dustpan.storage import materialize, new_location

LEAST_REVISIT = 1000
CHUNK = 4096
SEGMENT = 16384
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

_CRLF = "\r\n"
_VERSION = "WARC/1.1" + _CRLF
# What stands between two records, up to the digit of the version.
_BETWEEN = _CRLF * 2 + "WARC/1."


# -- writing ----------------------------------------------------------------

def mark_revisits(pages: DataFrame, id: str = "page_id", html: str = "html", least: int = LEAST_REVISIT) -> DataFrame:
    """(id, url, payload, digest, first): ``first`` is (id, url) of the response that a revisit repeats, else null.

    A null html is an empty payload.  Rows of one id and payload are all
    responses.  A null id is no response that others could repeat.
    """
    payload = F.encode(F.coalesce(html, F.lit("")), "UTF-8")
    rows = pages.select(F.col(id).alias("id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    # Largest ids are added up per digest before the shuffle, and written, so that a payload
    # of very many pages is one row here and its pages can be dealt to several tasks in the join.
    largest = (rows.where(F.octet_length("payload") >= least)
               .groupBy("digest").agg(F.max("id").alias("id"), F.max_by("url", "id").alias("url"), F.count("*").alias("n"))
               .where("n > 1 AND id IS NOT NULL"))
    largest = materialize(largest.select("digest", F.struct("id", "url").alias("first")), "largest")
    marked = rows.join(largest, "digest", "left")
    repeats = (F.col("first.id") != F.col("id")) | (F.col("first").isNotNull() & F.col("id").isNull())
    return marked.withColumn("first", F.when(repeats, F.col("first")))


def _line(name: str, value: Column) -> Column:
    """A header line, or nothing for a null value.  Line ends inside the value would end the header."""
    clean = F.regexp_replace(value.cast("string"), r"[\r\n]", " ")
    return F.coalesce(F.concat(F.lit(name + ": "), clean, F.lit(_CRLF)), F.lit(""))


def _joined(parts: Column) -> Column:
    """The bytes of an array of strings, one after the other; strings here may be any bytes."""
    return F.array_join(parts, "").cast("binary")


def _chunked(payload: Column, chunk: int) -> Column:
    """The payload in chunked transfer framing."""
    size = F.octet_length(payload)
    starts = F.when(size > 0, F.sequence(F.lit(0), size - 1, F.lit(chunk))).otherwise(F.array().cast("array<int>"))
    framed = F.transform(starts, lambda at: F.concat(
        F.lower(F.hex(F.least(F.lit(chunk), size - at).cast("bigint"))), F.lit(_CRLF),
        F.substring(payload, at + 1, F.lit(chunk)).cast("string"), F.lit(_CRLF)))
    return F.concat(_joined(framed), F.lit("0" + _CRLF * 2).cast("binary"))


def warc_records(pages: DataFrame, id: str = "page_id", html: str = "html", least: int = LEAST_REVISIT,
                 chunk: int = CHUNK, segment: int = SEGMENT, date: str | None = None) -> DataFrame:
    """(record): the bytes of each WARC record without the last line end, a segment being a record of its own."""
    date = date or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    rows = mark_revisits(pages, id, html, least)
    revisit = F.col("first").isNotNull()
    head = F.lit(_CRLF.join(["HTTP/1.1 200 OK", "Content-Type: text/html; charset=utf-8", "Transfer-Encoding: chunked",
                             "", ""])).cast("binary")
    # The page's id is part of the name; the row's place makes names of repeated ids differ.
    name = F.concat_ws(":", F.lit("urn:page"), F.coalesce(F.col("id").cast("string"), F.lit("")),
                       F.monotonically_increasing_id().cast("string"))
    blocks = rows.select("id", "url", "digest", "first", name.alias("name"), F.when(revisit, head).otherwise(
        F.concat(head, _chunked(F.col("payload"), chunk))).alias("block"))
    size = F.octet_length("block")
    cut = blocks.select("*", size.alias("total"), F.posexplode(F.transform(
        F.sequence(F.lit(0), size - 1, F.lit(segment)), lambda at: F.substring("block", at + 1, F.lit(segment)))))
    number, many = F.col("pos") + 1, F.col("total") > segment
    later = F.col("pos") > 0
    last = F.col("pos") == F.floor((F.col("total") - 1) / segment)
    here = F.when(later, F.concat("name", F.lit(":"), number.cast("string"))).otherwise(F.col("name"))
    bracket = lambda c: F.concat(F.lit("<"), c, F.lit(">"))
    only = lambda condition, value: F.when(condition, value)
    header = F.concat(
        F.lit(_VERSION), _line("WARC-Type", F.when(later, "continuation").when(F.col("first").isNotNull(), "revisit")
                               .otherwise("response")),
        _line("WARC-Record-ID", bracket(here)), _line("WARC-Date", F.lit(date)), _line("WARC-Target-URI", F.col("url")),
        _line("WARC-Payload-Digest", only(~later, F.concat(F.lit("sha1:"), F.col("digest")))),
        _line("WARC-Profile", only(F.col("first").isNotNull(), F.lit(PROFILE))),
        _line("WARC-Refers-To-Target-URI", F.col("first.url")),
        _line("WARC-Refers-To-Date", only(F.col("first").isNotNull(), F.lit(date))),
        _line("WARC-Segment-Number", only(many, number)),
        _line("WARC-Segment-Origin-ID", only(later, bracket(F.col("name")))),
        _line("WARC-Segment-Total-Length", only(many & last, F.col("total"))),
        _line("Content-Type", only(~later, F.lit("application/http;msgtype=response"))),
        _line("Content-Length", F.octet_length("col")), F.lit(_CRLF))
    return cut.select(F.concat(header.cast("binary"), F.col("col"), F.lit(_CRLF).cast("binary")).alias("record"))


def write_archives(records: DataFrame, path: str, compression: str = "gzip", rows_per_file: int = 5_000) -> None:
    """Write records as archives of at most ``rows_per_file`` records each."""
    (records.select(F.col("record").cast("string")).write.option("lineSep", _CRLF).option("compression", compression)
     .option("maxRecordsPerFile", rows_per_file).text(path))


# -- reading ----------------------------------------------------------------

_FIELDS = ("type", "record_id", "uri", "digest", "refers_to_uri", "origin", "number", "total")
_NAMES = {"warc-type": "type", "warc-record-id": "record_id", "warc-target-uri": "uri", "warc-payload-digest": "digest",
          "warc-refers-to-target-uri": "refers_to_uri", "warc-segment-origin-id": "origin",
          "warc-segment-number": "number", "warc-segment-total-length": "total"}
_PARSED = ("type string, record_id string, uri string, digest string, refers_to_uri string, origin string, "
           "number bigint, total bigint, block binary, whole boolean, file string")


def _headers(data: bytes, at: int) -> tuple[dict[str, str], int] | None:
    """Header fields from ``at`` on, and where the block starts; a folded line belongs to the one before."""
    end = data.find(b"\r\n\r\n", at)
    if end < 0:
        return None
    text = re.sub(r"\r\n[ \t]+", " ", data[at:end].decode("utf-8", "replace"))
    fields = (line.partition(":") for line in text.split(_CRLF))
    return {name.strip().lower(): value.strip() for name, sep, value in fields if sep}, end + 4


def _hex_digest(value: str | None) -> str | None:
    """A digest field as lower-case hexadecimal; it may be given so or in base 32."""
    if value is None:
        return None
    _, _, digits = value.rpartition(":")
    if re.fullmatch(r"[0-9a-fA-F]{40}", digits):
        return digits.lower()
    try:
        return base64.b32decode(digits.upper()).hex()
    except ValueError:
        return None


def _record(headers: dict[str, str], block: bytes | None, whole: bool, file: str | None) -> tuple:
    row = {own: headers.get(name) for name, own in _NAMES.items()}
    row["digest"] = _hex_digest(row["digest"])
    for name in ("number", "total"):
        row[name] = int(row[name]) if row[name] and row[name].isdigit() else None
    return (*(row[f] for f in _FIELDS), block, whole, file)


def _of_fragment(data: bytes, file: str) -> tuple:
    """The record of the text after a version line's number; not whole if its length differs from the declared one."""
    found = _headers(data, 0)
    if found:
        headers, at = found
        size = headers.get("content-length", "")
        rest = len(data) - at
        if size.isdigit() and (rest == int(size) or (rest == int(size) + 4 and data.endswith(b"\r\n\r\n"))):
            return _record(headers, data[at:at + int(size)], True, file)
    return _record({}, None, False, file)


def _of_archive(data: bytes, file: str) -> Iterator[tuple]:
    """Records one after the other by declared length; a damaged rest is one record that is not whole."""
    at = 0
    while data.startswith(b"WARC/", at):
        found = _headers(data, at)
        size = found[0].get("content-length", "") if found else ""
        if not size.isdigit() or found[1] + int(size) > len(data):
            break
        headers, start = found
        yield _record(headers, data[start:start + int(size)], True, file)
        at = start + int(size)
        while data[at:at + 2] == b"\r\n":
            at += 2
    if at < len(data):
        yield _record({}, None, False, file)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string()] * 6 + [pa.int64()] * 2 + [pa.binary(), pa.bool_(), pa.string()]
    names = [*_FIELDS, "block", "whole", "file"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


# Bytes of records passed on together.
_TOGETHER = 1 << 22


def _in_batches(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[8] or b"") + 200
        if size > _TOGETHER:
            yield _batch(held)
            held, size = [], 0
    if held:
        yield _batch(held)


def parse_archives(spark: SparkSession, path: str) -> DataFrame:
    """Every record of the archives below ``path``, written once.

    Damaged archives give a row with ``whole`` false and their file.
    """
    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _in_batches(
            _of_fragment(data[1:] if data[:1].isdigit() else data.removeprefix(b"WARC/1.")[1:], file)
            for batch in batches
            for data, file in zip(batch.column("data").to_pylist(), batch.column("file").to_pylist(), strict=True)
            if data.strip())

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _in_batches(row for batch in batches
                           for data, file in zip(batch.column("data").to_pylist(), batch.column("file").to_pylist(), strict=True)
                           for row in _of_archive(_unpacked(data), file))

    text = spark.read.option("lineSep", _BETWEEN).text(path)
    fragments = text.select(F.col("value").cast("binary").alias("data"), F.col("_metadata.file_path").alias("file"))
    records = materialize(fragments.mapInArrow(split, _PARSED), "records")
    torn = [r["file"] for r in records.where("NOT whole").select("file").distinct().collect()]  # names of files
    if not torn:
        return records
    # An archive at a time stands in memory here.
    again = spark.read.format("binaryFile").load(path).where(F.col("_metadata.file_path").isin(torn)) \
        .select(F.col("content").alias("data"), F.col("_metadata.file_path").alias("file"))
    walked = materialize(again.mapInArrow(walk, _PARSED), "walked")
    return records.where(~F.col("file").isin(torn)).unionByName(walked)


def _unpacked(data: bytes) -> bytes:
    """Decompressed bytes of one or several gzip members."""
    return gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data


def dechunk(body: bytes) -> bytes:
    """Payload of chunked transfer framing; raises ValueError if it is damaged."""
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].split(b";")[0], 16)
        at = end + 2
        if not size:
            return b"".join(out)
        if len(body) < at + size + 2 or body[at + size:at + size + 2] != b"\r\n":
            raise ValueError("a chunk's end is missing")
        out.append(body[at:at + size])
        at += size + 2


def payload_of(block: bytes) -> bytes | None:
    """Payload of an HTTP block, out of its transfer framing; null where it is damaged."""
    found = _headers(block, 0)
    if not found:
        return None
    headers, at = found
    try:
        return dechunk(block[at:]) if headers.get("transfer-encoding", "").lower() == "chunked" else block[at:]
    except ValueError:
        return None


def reassembled(records: DataFrame) -> DataFrame:
    """(record_id, type, uri, digest, refers_to_uri, block): segments joined to the records they are part of.

    The block is null where segments are missing, repeated with another
    content, or do not add up to the declared total; without a first segment
    there is no row.
    """
    first = ("type", "uri", "digest", "refers_to_uri")
    single = records.where("whole AND number IS NULL").select("record_id", *first, "block")
    parts = records.where("whole AND number IS NOT NULL").select(
        F.coalesce("origin", "record_id").alias("record_id"), "number", "total", "block",
        F.when(F.col("number") == 1, F.struct(*first)).alias("first"))
    # One group is one record's segments, which end as one value anyway.
    whole = parts.groupBy("record_id").agg(
        F.sort_array(F.array_distinct(F.collect_list(F.struct("number", "block")))).alias("parts"),
        F.max("total").alias("total"), F.max("first").alias("first"))
    size = F.aggregate("parts", F.lit(0).cast("bigint"), lambda s, p: s + F.octet_length(p["block"]))
    counted = F.transform("parts", lambda p: p["number"]) == F.sequence(F.lit(1).cast("bigint"), F.size("parts").cast("bigint"))
    joined = _joined(F.transform("parts", lambda p: p["block"].cast("string")))
    return single.unionByName(whole.where("first IS NOT NULL").select(
        "record_id", "first.*", F.when(counted & (size == F.col("total")), joined).alias("block")))


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """(record_id, type, uri, digest, refers_to_uri, payload) of the responses and revisits below ``path``.

    A revisit's payload is null; ``resolve_revisits`` finds the record that has
    it.  A response whose segments or framing are damaged has a null payload.
    """
    records = reassembled(parse_archives(spark, path)).where(F.col("type").isin("response", "revisit"))
    names = [c for c in records.columns if c != "block"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            payloads = [payload_of(b) if b is not None and kind == "response" else None for b, kind in
                        zip(batch.column("block").to_pylist(), batch.column("type").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(payloads, pa.binary())],
                                             names=[*names, "payload"])

    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in records.schema.fields if f.name != "block")
    return records.mapInArrow(run, kept + ", payload binary")


def page_of(record_id: Column) -> Column:
    """The page id in a record's name; null for a page without one."""
    digits = F.regexp_extract(record_id, "^<urn:page:(-?[0-9]*):", 1)
    return F.when(digits != "", digits.cast("bigint"))


def resolve_revisits(archived: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to): every record with the page whose payload it repeats.

    Digests of responses are taken from the payload read, not from its header.
    """
    rows = materialize(archived.select(
        page_of(F.col("record_id")).alias("page_id"), F.col("type").alias("record_type"),
        F.octet_length("payload").cast("bigint").alias("payload_bytes"),
        F.when(F.col("type") == "revisit", F.col("digest")).otherwise(F.sha1("payload")).alias("payload_digest")), "archived")
    responses = rows.where("record_type = 'response'")
    revisits = rows.where("record_type = 'revisit'").select("page_id", "record_type", "payload_digest")
    # A small row per repeated payload, written, so that the revisits of one payload can be dealt to several tasks.
    held = materialize(responses.groupBy("payload_digest").agg(
        F.max("page_id").alias("refers_to"), F.max("payload_bytes").alias("payload_bytes")), "responses")
    found = revisits.join(held, "payload_digest", "left")
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return responses.withColumn("refers_to", F.lit(None).cast("bigint")).select(columns).unionByName(found.select(columns))


def archive_round_trip(pages: DataFrame) -> DataFrame:
    """Write the pages (page_id, url, html) as archives in the shared folder and read them back; see ``resolve_revisits``."""
    spark = pages.sparkSession
    path = new_location(spark, "warc")
    write_archives(warc_records(pages), path)
    return resolve_revisits(read_archives(spark, path))

