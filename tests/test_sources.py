"""Pattern files, audit text and catalogues in their odd forms."""

import random

from pyspark.sql import functions as F

from dustpan.fixtures import PATTERN_COLUMNS
from dustpan.operators import residuals
from dustpan.sources import audit, catalogue, patterns_csv

HEADER = ",".join(PATTERN_COLUMNS)


def load(spark, tmp_path, text):
    path = tmp_path / "patterns.csv"
    path.write_text(text, encoding="utf-8")
    return {r["pid"]: r for r in patterns_csv.load_patterns(spark, str(path)).collect()}


def test_pattern_file(spark, tmp_path):
    rows = load(spark, tmp_path, HEADER + "\n"
                'macOS,._*,/x/._f,"side, ""car""",Yes,Yes\n'
                " Any ,\t*.tmp ,,,No,\n"
                ",*.old,,,No,Yes\n"
                "Any,  ,,,No,Yes\n"
                "Linux,*.short\n"
                'Any,*.two,,"two\nlines",No,No\n')
    assert sorted(rows) == [0, 1, 3, 4, 5]
    assert rows[0]["Description"] == 'side, "car"' and rows[5]["Description"] == "two\nlines"
    assert (rows[1]["OS"], rows[1]["File_Pattern"], rows[1]["Enabled"]) == ("Any", "*.tmp", "")
    assert rows[3]["File_Pattern"] == "" and rows[4]["Enabled"] == ""


def test_pattern_file_without_enabled_column(spark, tmp_path):
    rows = load(spark, tmp_path, "File_Pattern,OS\n*.tmp,Linux\n")
    assert rows[0]["Enabled"] == "Yes" and rows[0]["Description"] == ""


def test_missing_pattern_file_is_empty(spark, tmp_path):
    assert patterns_csv.load_patterns(spark, str(tmp_path / "none.csv")).count() == 0


def test_saved_version_keeps_order_and_backup(spark, tmp_path):
    rows = [(n, f"os{n}", f"*.{n}", ' lead "q"', "two\nlines", "", "Yes") for n in range(50)]
    df = spark.createDataFrame(rows, patterns_csv.PATTERN_SCHEMA)
    first = patterns_csv.save_patterns(df, str(tmp_path), "v1")
    patterns_csv.save_patterns(df.where("pid > 10"), str(tmp_path), "v2")
    assert [tuple(r) for r in patterns_csv.read_pattern_rows(spark, first).orderBy("pid").collect()] == rows


def test_edits(spark):
    rows = [(n, "o", f"*.{n}", "", "", "", "Yes") for n in range(4)]
    df = spark.createDataFrame(rows, patterns_csv.PATTERN_SCHEMA)
    got = residuals.edit_patterns(df, removed=df.where("pid = 1"), toggled=df.where("pid = 2"),
                                  replaced=spark.createDataFrame([(3, "n", "x", "", "", "", "No")], df.schema),
                                  added=df.where("pid = 0")).orderBy("pid").collect()
    assert [(r["pid"], r["OS"], r["File_Pattern"], r["Enabled"]) for r in got] == [
        (0, "o", "*.0", "Yes"), (1, "o", "*.2", "No"), (2, "n", "x", "No"), (3, "o", "*.0", "Yes")]


def test_audit_text(spark):
    lines = ["[2025-01-02 03:04:05] Deleted file: /a: b", "[2025-01-02 03:04:05] Failed to delete /a/b: no: way",
             "[2025-01-02 03:04:05] Session started", "====", "", "[2025-01-02 03:04:05] Error accessing /x"]
    got = [tuple(r)[1:4] for r in audit.parse_audit(spark.createDataFrame([(x,) for x in lines], "line string")).collect()]
    assert got == [("deleted_file", "/a: b", None), ("failed", "/a/b", "no: way"), ("other", None, None),
                   ("other", None, None), ("other", None, None), ("unreadable", "/x", None)]


def test_audit_text_of_others(spark):
    """Error texts mostly repeat the path; layouts without a path are no events."""
    lines = {"Failed to delete /a: b: [Errno 13] Permission denied: '/a: b'": ("failed", "/a: b", "[Errno 13] Permission denied: '/a: b'"),
             "Error scanning /x: boom": ("unscanned", "/x", "boom"), "Error checking /x: y: z": ("unchecked", "/x", "y: z"),
             "Error processing /it's: [Errno 2] gone: \"/it's\"": ("unhashed", "/it's", "[Errno 2] gone: \"/it's\""),
             "Deleted: /d: e": ("purged_dir", "/d: e", None), "  Failed: /p - q - no": ("failed_item", "/p", "q - no"),
             "Failed to delete 3 item(s)": ("other", None, None), "Deleted 2 pattern row(s)": ("other", None, None),
             "Added directory: /r": ("root", "/r", None), "Found empty: ": ("other", None, None)}
    df = spark.createDataFrame([(f"[2025-01-02 03:04:05] {x}",) for x in lines], "line string")
    assert [tuple(r)[1:4] for r in audit.parse_audit(df).collect()] == list(lines.values())


def test_audit_text_is_read_back(spark):
    """Parsing undoes writing, for every layout, on paths and errors of awkward characters."""
    rng = random.Random(6)
    bits = ["a", "b c", ": ", " - ", ":", "\n", "\r", "'", '"', "\\", "\\n", "é", "\u2028", "\u0085", "/", "😀", "{", "}", "\t", "[", "\x01"]
    text = lambda: "".join(rng.choice(bits) for _ in range(rng.randint(0, 7)))
    rows = []
    for layout in audit.LAYOUTS:
        for _ in range(400):
            path = "/" + text()
            error = rng.choice([text() + rng.choice("xyz'"), f"[Errno 1] no: '{path}'", f"no: '{text()}'"]) if layout.between else None
            rows.append((layout.kind, path, error))
    df = spark.createDataFrame(rows, "kind string, path string, error string").withColumn(
        "ts", F.expr("timestamp_ntz'2025-01-02 03:04:05'"))
    lines = df.select("kind", "path", "error", audit.audit_line(F.col("ts"), F.col("kind"), F.col("path"), F.col("error")).alias("line"))
    told = {r["line"]: (r["kind"], r["path"], r["error"]) for r in lines.collect()}
    assert not any(c in line for line in told for c in "\n\r")
    got = {r["raw"]: (r["kind"], r["path"], r["error"]) for r in audit.parse_audit(
        spark.createDataFrame([(x,) for x in told], "line string")).collect()}
    assert got == told


def test_audit_of_a_job_is_told_once(spark, tmp_path):
    rows = spark.sql("SELECT timestamp_ntz'2025-01-01 00:00:00' ts, 'failed' kind, '/a' path, 'e' error")
    for session, job in (("007", "purge"), ("007", "purge"), ("007", "other"), ("008", "purge"), ("007", None)):
        audit.write_audit(rows, str(tmp_path / "audit"), session, job)
    found = [r["session_id"] for r in audit.read_audit(spark, str(tmp_path / "audit")).collect()]
    assert sorted(found) == ["007", "007", "007", "008"]


def test_audit_appends(spark, tmp_path):
    rows = spark.sql("SELECT timestamp_ntz'2025-01-01 00:00:00' ts, 'failed' kind, '/a' path, 'e' error")
    for session in ("s1", "s2", "s2"):
        audit.write_audit(rows, str(tmp_path / "audit"), session)
    assert audit.read_audit(spark, str(tmp_path / "audit")).where("session_id = 's2'").count() == 2


def test_catalogue_reads_only_its_folder(spark, tmp_path):
    rows = spark.createDataFrame([("d1", "/a"), ("d2", "/b")], "device string, path string")
    for session in ("s1", "s2"):
        catalogue.write_catalogue(rows, str(tmp_path / "c"), session)
    one = catalogue.read_catalogue(spark, str(tmp_path / "c"), "s1", "d2")
    assert one.select("path").collect() == [("/b",)] and len(one.inputFiles()) >= 1
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(session_id" in plan
