"""Views of the given tables in the shape the operators expect.

Operators never see these tables; a user maps their own store the same way.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dustpan.functions.hashing import content_hash
from dustpan.functions.paths import basename, depth_of, parent_of, self_and_ancestors
from dustpan.functions.text import audit_stamp

# One row per residual pattern, in file order.
PATTERN_COLUMNS = ["OS", "File_Pattern", "Path_Example", "Description", "Safe_To_Delete", "Enabled"]
PATTERN_ROWS = [
    ("macOS", "._*", "/x/._f", "sidecar", "Yes", "Yes"),
    ("Windows", "Thumbs.db", "", "thumbnails", "Yes", "Yes"),
    ("Linux", "*.tmp", "", "temp", "Yes", "true"),
    ("Linux", "*.bak", "", "backup", "No", "No"),
    ("Office", ".~lock.*#", "", "lock", "Yes", "1"),
    (" Any ", "*.t?p", "", "", "No", "YES"),
    ("Any", "f[0-4]*.txt", "", "", "No", "Yes"),
    ("", "*.old", "", "", "No", "Yes"),
    ("Any", "  ", "", "", "No", "Yes"),
    ("Any", "*.log", "", "", "No", ""),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def file_inventory(spark: SparkSession, sf_dir: str, content: bool = False) -> DataFrame:
    """One file per document, with size and digest of its text."""
    doc = F.col("doc_id")
    name = (F.when(doc % 8 == 0, F.concat(F.lit("f"), doc, F.lit(".tmp")))
             .when(doc % 8 == 1, F.concat(F.lit(".~lock.f"), doc, F.lit("#")))
             .when(doc % 8 == 2, F.concat(F.lit("f"), doc, F.lit(".bak")))
             .when(doc % 8 == 3, F.lit("Thumbs.db"))
             .when(doc % 8 == 4, F.concat(F.lit("._f"), doc))
             .when(doc % 8 == 5, F.concat(F.lit("F"), doc, F.lit(".TMP")))
             .otherwise(F.concat(F.lit("f"), doc, F.lit(".txt"))))
    parent = F.concat(F.lit("/"), "source", F.lit("/"), "lang", F.lit("/d"),
                      F.expr("doc_id div 8").cast("string"))
    rows = table(spark, sf_dir, "documents").select(
        doc.alias("ord"), F.lit(0).alias("root_idx"), F.col("source").alias("device"),
        parent.alias("parent"), name.alias("name"), F.lit("file").alias("entry_type"),
        F.octet_length("text").cast("bigint").alias("size"), content_hash("text").alias("hash"),
        (F.to_timestamp_ntz(F.lit("2024-01-01 00:00:00"))
         + F.make_dt_interval(mins=doc.cast("int"))).alias("mtime"), "text")
    rows = rows.withColumn("path", F.concat("parent", F.lit("/"), "name"))
    return rows if content else rows.drop("text")


def url_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.regexp_replace(F.regexp_replace("url", "^https?:/", ""), "[?#].*$", "")
    return table(spark, sf_dir, "pages").select(url.alias("path"))


def directory_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files and directories named by the page addresses; hosts are top directories."""
    paths = url_paths(spark, sf_dir).distinct()
    dirs = (paths.select(parent_of("path").alias("path")).distinct()
            .select(F.explode(self_and_ancestors("path")).alias("path")).distinct()
            .withColumn("entry_type", F.lit("dir")))
    files = (paths.where(~F.col("path").endswith("/")).join(dirs, "path", "left_anti")
             .withColumn("entry_type", F.lit("file")))
    return dirs.unionByName(files).select(
        "path", parent_of("path").alias("parent"), basename("path").alias("name"),
        depth_of("path").alias("depth"), "entry_type", F.lit(0).alias("root_idx"))


def pattern_table(spark: SparkSession) -> DataFrame:
    """The pattern list as it stands in its file, before trimming and filtering."""
    columns = {"pid": range(len(PATTERN_ROWS)), **dict(zip(PATTERN_COLUMNS, zip(*PATTERN_ROWS)))}
    return spark.createDataFrame(pa.table({name: list(cells) for name, cells in columns.items()}))


def proposed_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A raw pattern table with one proposal per event, untidy cells included."""
    eid, user = F.col("event_id"), F.col("user_id").cast("string")
    os_name = (F.when(eid % 5 == 0, "").when(eid % 5 == 1, "  ")
                .when(eid % 5 == 2, F.concat(F.lit("\t"), "event_type", F.lit(" ")))
                .otherwise(F.col("event_type")))
    glob = (F.when(eid % 7 == 0, "").when(eid % 7 == 1, " ")
             .when(eid % 7 == 2, F.concat(F.lit(" *.u"), user, F.lit("\t")))
             .when(eid % 7 == 3, F.concat(F.lit("e"), user, F.lit("*")))
             .when(eid % 7 == 4, F.concat(F.lit("._u"), user))
             .otherwise(F.concat(F.lit("*.u"), user, F.lit("?"))))
    enabled = (F.when(eid % 6 == 0, "Yes").when(eid % 6 == 1, "true").when(eid % 6 == 2, "1")
                .when(eid % 6 == 3, "No").when(eid % 6 == 4, "").otherwise(" YES "))
    return table(spark, sf_dir, "events").select(
        eid.alias("pid"), os_name.alias("OS"), glob.alias("File_Pattern"),
        F.col("props").alias("Path_Example"),
        F.concat("event_type", F.when(eid % 11 == 0, ",\n").otherwise(", "), F.lit("by "), user)
         .alias("Description"),
        F.when(eid % 2 == 0, "Yes").otherwise("No").alias("Safe_To_Delete"),
        enabled.alias("Enabled"))


def audit_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat(F.lit("/u"), "user_id", F.lit("/e"), "event_id")
    kind = F.col("event_type")
    message = (F.when(kind == "click", F.concat(F.lit("Deleted file: "), path))
                .when(kind == "purchase", F.concat(F.lit("Deleted directory: "), path))
                .when(kind == "error", F.concat(F.lit("Failed to delete "), path, F.lit(": denied")))
                .when(kind == "view", F.concat(F.lit("Found empty: "), path))
                .otherwise(F.concat(F.lit("Error accessing "), path, F.lit(": denied"))))
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("["), audit_stamp("ts"), F.lit("] "), message).alias("line"))


def listed_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scan roots in page order: hosts, folders below them, repeats, missing ones."""
    page = F.col("page_id")
    path = F.regexp_replace(F.regexp_replace("url", "^https?:/", ""), "[?#].*$", "")
    host = F.concat(F.lit("/"), F.split_part(path, F.lit("/"), F.lit(2)))
    root = (F.when(page % 4 == 0, F.concat(host, F.lit("/")))
             .when(page % 4 == 1, F.concat(host, F.lit("//"), F.split_part(path, F.lit("/"), F.lit(3))))
             .when(page % 4 == 2, F.concat(F.lit("/missing"), host))
             .otherwise(parent_of(F.regexp_replace(path, "/$", ""))))
    return table(spark, sf_dir, "pages").select(page.alias("root_idx"), root.alias("root"))


def mounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One mount per source and per language folder of every third source, plus '/'."""
    found = table(spark, sf_dir, "documents").select("source", "lang").distinct()
    number = F.regexp_extract("source", r"(\d+)$", 1).cast("int")
    per_source = found.select(F.concat(F.lit("/"), "source").alias("mount"),
                              F.concat(F.lit("dev-"), "source").alias("device")).distinct()
    per_lang = found.where(number % 3 == 0).select(
        F.concat(F.lit("/"), "source", F.lit("/"), "lang").alias("mount"),
        F.concat(F.lit("dev-"), "source", F.lit("-"), "lang").alias("device"))
    top = spark.createDataFrame([("/", "dev-system")], "mount string, device string")
    return per_source.unionByName(per_lang).unionByName(top).select(
        "mount", "device",
        F.when(F.length("device") % 2 == 0, "SSD").otherwise("HDD").alias("device_type"))


def selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's choice: all larger files, and one language folder of every source."""
    rows = file_inventory(spark, sf_dir)
    files = rows.where(F.col("size") >= 1500).select("path", "entry_type")
    folders = table(spark, sf_dir, "documents").where(F.col("lang") == "fr").select(
        F.concat(F.lit("/"), "source", F.lit("/"), "lang").alias("path"),
        F.lit("dir").alias("entry_type")).distinct()
    return files.unionByName(folders)


def feature_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The given vectors, each with a re-encoded (two-decimal) near copy."""
    given = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    coarse = F.transform("vector", lambda x: F.round(x, 2))
    return given.unionByName(given.select((F.col("id") + 100_000_000).alias("id"), coarse.alias("vector")))
