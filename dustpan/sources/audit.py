"""Audit trail: append-only tables, the text form of a line, and its parser.

One table of layouts writes lines and reads them back; reading is the inverse
of writing for every path and error.  A path stands as it is, unless that could
not be read back: paths with line breaks, and, where an error follows, those
that contain what separates the two or a quote, stand in quotes as in JSON.  So
do errors with line breaks.  A path in quotes cannot be mistaken, since paths
begin with a slash.

Lines of others have no quotes.  Where an error follows, it mostly ends with
the path again, in quotation marks; the path then ends there, else at the first
separator.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dustpan.functions.text import STAMP, audit_stamp

AUDIT_COLUMNS = ["session_id", "ts", "kind", "path", "error"]
_TABLE = "ts timestamp_ntz, kind string, path string, error string, session_id string, job string"


class Layout(NamedTuple):
    opening: str
    kind: str
    between: str | None  # what stands between path and error, if an error follows


# Message layouts of the audit text.
LAYOUTS = [
    Layout("Deleted file: ", "deleted_file", None),
    Layout("Deleted directory: ", "deleted_dir", None),
    Layout("Deleted: ", "purged_dir", None),
    Layout("Failed to delete ", "failed", ": "),
    Layout("  Failed: ", "failed_item", " - "),
    Layout("Found empty: ", "empty", None),
    Layout("Added directory: ", "root", None),
    Layout("Error accessing ", "unreadable", ": "),
    Layout("Error checking ", "unchecked", ": "),
    Layout("Error processing ", "unhashed", ": "),
    Layout("Error scanning ", "unscanned", ": "),
]


def write_audit(actions: DataFrame, folder: str, session_id: str, job: str | None = None) -> None:
    """Append (ts, kind, path, error) rows to the session's part of the trail.

    Rows of a named ``job`` are its own part, which writing them again
    replaces, so a job that is finished in a second attempt is told once.
    """
    rows = actions.select("ts", "kind", "path", "error", F.lit(session_id).alias("session_id"), F.lit(job or "").alias("job"))
    writer = rows.write.partitionBy("session_id", "job")
    if job is None:
        writer.mode("append").parquet(folder)
    else:
        writer.mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(folder)


def read_audit(spark: SparkSession, folder: str) -> DataFrame:
    """The trail; sessions are text, also where they look like numbers."""
    return spark.read.schema(_TABLE).parquet(folder).select(*AUDIT_COLUMNS)


def _quoted(text: Column) -> Column:
    """The text in double quotes, escaped as in JSON."""
    cell = F.to_json(F.struct(text.alias("v")))
    return F.substring(cell, F.lit(6), F.length(cell) - 6)


def _unquoted(text: Column) -> Column:
    return F.get_json_object(F.concat(F.lit('{"v":'), text, F.lit("}")), "$.v")


_BREAKS = r"[\n\r\x{85}\x{2028}\x{2029}]"
# A JSON string at the start of a text.
_QUOTE = r'^"(?:[^"\\]|\\.)*"'
# The path again at the end of an error, in quotation marks.
_REPEATED = r"(?s)^(.+?)%s.*(['\"])\1\2$"


def audit_line(ts: Column, kind: Column, path: Column, error: Column) -> Column:
    """The line that tells an event; null for a kind without a layout."""
    messages = []
    for layout in LAYOUTS:
        unclear = path.rlike(_BREAKS) | path.startswith('"')
        told = None
        if layout.between:
            unclear |= path.contains(layout.between) | path.rlike("['\"]") | error.rlike("['\"]$") | path.endswith(layout.between.rstrip())
            open_ = error.rlike(_BREAKS) | error.startswith('"')
            told = F.coalesce(F.concat(F.lit(layout.between), F.when(open_, _quoted(error)).otherwise(error)), F.lit(""))
        shown = F.when(F.coalesce(unclear, F.lit(False)), _quoted(path)).otherwise(path)
        parts = [F.lit(layout.opening), shown, *([told] if told is not None else [])]
        messages.append(F.when(kind == layout.kind, F.concat(*parts)))
    return F.concat(F.lit("["), audit_stamp(ts), F.lit("] "), F.coalesce(*messages))


def _parts(rest: Column, between: str | None) -> Column:
    """(path, error) of what follows an opening; null if it is no path."""
    quote = F.regexp_extract(rest, _QUOTE, 0)
    ended = F.substring(rest, F.length(quote) + 1, F.length(rest))
    both = lambda path, error: F.struct(path.alias("path"), error.alias("error"))
    nothing = F.lit(None).cast("string")
    if not between:
        return F.when((quote != "") & (ended == ""), both(_unquoted(quote), nothing)).when(rest != "", both(rest, nothing))
    size = len(between)
    told = lambda error: F.when(error.rlike(_QUOTE + "$"), _unquoted(error)).otherwise(error)
    behind = lambda path: told(F.substring(rest, F.length(path) + size + 1, F.length(rest)))
    repeated = F.when(rest.rlike("['\"]$"), F.regexp_extract(rest, _REPEATED % between, 1)).otherwise("")
    at = F.instr(rest, between)
    first = F.substring(rest, F.lit(1), at - 1)
    return (F.when((quote != "") & (ended == ""), both(_unquoted(quote), nothing))
            .when((quote != "") & ended.startswith(between), both(_unquoted(quote), told(F.substring(ended, F.lit(size + 1), F.length(ended)))))
            .when(repeated != "", both(repeated, behind(repeated)))
            .when(at > 1, both(first, behind(first)))
            .when(rest.startswith("/"), both(rest, nothing)))


def parse_audit(lines: DataFrame) -> DataFrame:
    """Text lines back to (ts, kind, path, error, raw); anything else is 'other'."""
    line = F.col("line")
    stamp = F.regexp_extract(line, r"^\[(\d{4}-\d\d-\d\d \d\d:\d\d:\d\d)\] ", 1)
    # "[", 19 characters, "] ": the message starts at the 23rd character.
    rows = lines.withColumn("__stamp", stamp).withColumn("__body", F.substring(
        line, F.when(F.col("__stamp") != "", 23).otherwise(F.length(line) + 1), F.length(line)))
    body = F.col("__body")
    found = [F.when(body.startswith(layout.opening), F.struct(
        F.lit(layout.kind).alias("kind"),
        _parts(F.substring(body, F.lit(len(layout.opening) + 1), F.length(body)), layout.between).alias("of")))
        for layout in LAYOUTS]
    parsed = rows.withColumn("__m", F.coalesce(*found))
    known = F.col("__m.of").isNotNull()
    return parsed.select(
        F.when(F.col("__stamp") != "", F.to_timestamp_ntz(F.col("__stamp"), F.lit(STAMP))).alias("ts"),
        F.when(known, F.col("__m.kind")).otherwise("other").alias("kind"),
        F.col("__m.of.path").alias("path"), F.col("__m.of.error").alias("error"), line.alias("raw"))
