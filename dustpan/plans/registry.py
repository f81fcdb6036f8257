"""The registered queries: every operator over the given tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dustpan import fixtures as fx
from dustpan.functions import text as tx
from dustpan.functions.hashing import content_hash, dealt_for_reading, hash_files
from dustpan.functions.paths import basename, depth_of, extension_of, parent_of, self_and_ancestors
from dustpan.operators import actions, dedup, emptydirs, profile, residuals, retention, roots, similarity
from dustpan.plans import pipelines
from dustpan.sources import audit, catalogue, lister, patterns_csv, tree_source
from dustpan.storage import materialize, new_location, new_mounted_dir
from dustpan.streaming import incremental

SESSION = "s1"
Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    _QUERIES[fn.__name__] = fn
    return fn


def all_queries() -> dict[str, Query]:
    return dict(_QUERIES)


# -- inputs ------------------------------------------------------------------

def files(spark, sf) -> DataFrame:
    return fx.file_inventory(spark, sf)


def hashed(spark, sf, *columns: str) -> DataFrame:
    """The hashed inventory, written once: whole texts are read a single time."""
    rows = files(spark, sf)
    return materialize(rows.select(*columns) if columns else rows, "hashed")


def tree(spark, sf) -> DataFrame:
    return fx.directory_tree(spark, sf)


def written_tree(spark, sf) -> DataFrame:
    return materialize(tree(spark, sf), "tree")


def patterns(spark) -> DataFrame:
    return patterns_csv.accept_patterns(fx.pattern_table(spark))


def proposals(spark, sf) -> DataFrame:
    return patterns_csv.accept_patterns(fx.proposed_patterns(spark, sf))


def kept(spark, sf, dirs: DataFrame) -> DataFrame:
    return roots.kept_roots(roots.normalize_roots(fx.listed_roots(spark, sf), dirs))


def document_tree(spark, sf) -> tuple[str, DataFrame]:
    """The documents as real files below a fresh folder, and the scan root."""
    target = new_mounted_dir(spark, "docs")
    rows = fx.file_inventory(spark, sf, content=True).select("path", "entry_type", F.col("text").alias("content"))
    materialize(lister.write_tree(rows, target), "written")
    return target, lister.roots_of(spark, [target])


def audit_log(spark, sf) -> DataFrame:
    """The audit text as files, one line per action."""
    path = new_location(spark, "audit-text")
    fx.audit_lines(spark, sf).write.text(path)
    return spark.read.text(path).withColumnRenamed("value", "line")


def audit_table(spark, sf) -> DataFrame:
    """The parsed trail as a table: lines are taken apart once, then queried."""
    return materialize(audit.parse_audit(audit_log(spark, sf)), "audit")


def inside(target: str, path: Column | str = "path") -> Column:
    """Path relative to the folder a tree was written to, with a leading slash."""
    c = F.col(path) if isinstance(path, str) else path
    return F.substring(c, F.lit(len(target) + 1), F.length(c))


# -- sources and sinks -------------------------------------------------------

@query
def list_files(spark, sf):
    target, top = document_tree(spark, sf)
    return lister.list_files(top).select(inside(target).alias("path"), "name", "size")


@query
def list_files_source(spark, sf):
    """The same through the data source, which tests the type itself."""
    target, _ = document_tree(spark, sf)
    found = tree_source.read_tree(spark, [target]).where("entry_type = 'file' AND error IS NULL")
    return found.select(inside(target).alias("path"), "name", "size")


@query
def list_entries(spark, sf):
    target = new_mounted_dir(spark, "tree")
    rows = tree(spark, sf).withColumn("content", F.lit(""))
    materialize(lister.write_tree(rows, target), "written")
    found = lister.list_entries(lister.roots_of(spark, [target]))
    return found.select(inside(target).alias("path"), inside(target, "parent").alias("parent"),
                        "name", "entry_type", F.coalesce("size", F.lit(0)).alias("size"))


@query
def hash_tree(spark, sf):
    target, top = document_tree(spark, sf)
    done = hash_files(dealt_for_reading(materialize(lister.list_files(top).select("path", "size"), "files")))
    return done.select(inside(target).alias("path"), "size", "hash", "hash_error")


@query
def error_ledger(spark, sf):
    """Every listed root is scanned in the written tree; absent ones are reported."""
    target = new_mounted_dir(spark, "tree")
    rows = tree(spark, sf).withColumn("content", F.lit(""))
    materialize(lister.write_tree(rows, target), "written")
    normal = roots.normalize_roots(fx.listed_roots(spark, sf))
    given = roots.kept_roots(normal).select(F.col("root_idx").cast("int").alias("root_idx"),
                                            F.concat(F.lit(target), "root").alias("root"))
    return lister.error_ledger(lister.list_entries(given)).select(
        inside(target).alias("path"), "entry_type", "error")


@query
def normalize_roots(spark, sf):
    dirs = tree(spark, sf).where(F.col("entry_type") == "dir")
    return roots.normalize_roots(fx.listed_roots(spark, sf), dirs)


@query
def load_patterns(spark, sf):
    path = patterns_csv.save_patterns(fx.proposed_patterns(spark, sf), new_location(spark, "patterns"), "v1")
    return patterns_csv.load_patterns(spark, path)


@query
def save_patterns_roundtrip(spark, sf):
    """Two versions saved; the earlier one is still there as the backup."""
    folder = new_location(spark, "patterns")
    first = patterns_csv.save_patterns(fx.proposed_patterns(spark, sf), folder, "v1")
    edited = residuals.valid_patterns(patterns_csv.read_pattern_rows(spark, first))
    second = patterns_csv.save_patterns(edited, folder, "v2")
    return (patterns_csv.read_pattern_rows(spark, first).withColumn("version", F.lit("v1"))
            .unionByName(patterns_csv.read_pattern_rows(spark, second).withColumn("version", F.lit("v2"))))


@query
def write_audit_roundtrip(spark, sf):
    folder = new_location(spark, "audit")
    audit.write_audit(audit.parse_audit(audit_log(spark, sf)), folder, SESSION)
    return audit.read_audit(spark, folder).select(
        "session_id", audit.audit_line(F.col("ts"), F.col("kind"), F.col("path"), F.col("error")).alias("line"))


@query
def parse_audit(spark, sf):
    return audit.parse_audit(audit_log(spark, sf)).select(
        tx.audit_stamp("ts").alias("ts"), "kind", "path", "error", "raw")


@query
def catalogue_roundtrip(spark, sf):
    folder = new_location(spark, "catalogue")
    catalogue.write_catalogue(files(spark, sf), folder, SESSION)
    return catalogue.read_catalogue(spark, folder, SESSION).select(
        "session_id", "device", "path", "size", "hash", tx.audit_stamp("mtime").alias("mtime"))


@query
def device_catalogue_roundtrip(spark, sf):
    folder = new_location(spark, "devices")
    catalogue.write_devices(fx.mounts(spark, sf), folder, SESSION)
    catalogue.write_devices(fx.mounts(spark, sf), folder, "s2")
    return catalogue.read_devices(spark, folder, SESSION).select("session_id", "mount", "device", "device_type")


@query
def apply_deletes(spark, sf):
    """Redundant copies are deleted as real files; paths never written are absent."""
    target, _ = document_tree(spark, sf)
    plan = dedup.dup_plan(hashed(spark, sf, "hash", "ord", "path", "device", "size"))
    doomed = dedup.select_deletable(plan).select("path")
    never = fx.url_paths(spark, sf).distinct()
    items = doomed.unionByName(never).select(F.concat(F.lit(target), "path").alias("path"),
                                             F.lit("file").alias("entry_type"))
    return actions.apply_deletes(items, dry_run=False).select(
        inside(target).alias("path"), "outcome", "error")


# -- whole jobs over real trees --------------------------------------------------

def _job(spark, **folders) -> pipelines.Session:
    return pipelines.Session(SESSION, audit=new_location(spark, "audit"), journal=new_mounted_dir(spark, "journal"), **folders)


def written_folders(spark, sf) -> tuple[str, DataFrame]:
    """The tree of addresses as real folders and files, and the scan root."""
    target = new_mounted_dir(spark, "tree")
    materialize(lister.write_tree(tree(spark, sf).withColumn("content", F.lit("")), target), "written")
    return target, lister.roots_of(spark, [target])


def _left_and_told(spark, target: str, top: DataFrame, job: pipelines.Session) -> DataFrame:
    """(path, state): what is left in a tree, and what the audit trail tells of the rest."""
    told = audit.read_audit(spark, job.audit).select(F.col("path"), F.col("kind").alias("state"))
    left = lister.list_entries(top).select("path", F.lit("left").alias("state"))
    return left.unionByName(told).select(inside(target).alias("path"), "state")


@query
def purge_tree(spark, sf):
    """Empty folders of a real tree go round by round."""
    target, top = written_folders(spark, sf)
    job = _job(spark)
    pipelines.purge_empty_dirs(top, dry_run=False, session=job)
    return _left_and_told(spark, target, top, job)


@query
def quarantine_tree(spark, sf):
    """Leaf-empty folders of a real tree are renamed, then removed."""
    target, top = written_folders(spark, sf)
    job = _job(spark)
    pipelines.quarantine_and_purge(top, SESSION, dry_run=False, session=job)
    rows = _left_and_told(spark, target, top, job)
    return rows.withColumn("path", F.regexp_replace("path", r"\.purge\.[0-9a-f]{8}$", ""))


@query
def delete_tree(spark, sf):
    """Whole folders of a real tree are deleted with all they hold: those of the '.org' hosts."""
    target, top = written_folders(spark, sf)
    job = _job(spark)
    hosts = lister.list_entries(top).where(F.col("path").endswith(".org") & (F.col("parent") == target))
    pipelines.delete_chosen(hosts, hosts, dry_run=False, session=job)
    return _left_and_told(spark, target, top, job)


@query
def find_duplicates_tree(spark, sf):
    """Keep/delete plan of a real tree, in a second session that only reads what has changed."""
    target, top = document_tree(spark, sf)
    folder = new_location(spark, "catalogue")
    pipelines.find_duplicates(top, patterns(spark), session=_job(spark, catalogue=folder))
    second = _job(spark, catalogue=folder)._replace(session_id="s2")
    plan = pipelines.find_duplicates(top, patterns(spark), session=second, since=SESSION)
    return plan.select(inside(target).alias("path"), "hash", "size", "action")


@query
def catalogue_changes(spark, sf):
    """A later session has lost the French files, gained copies of the Spanish ones, and found larger files changed."""
    folder = new_location(spark, "catalogue")
    rows = files(spark, sf).select("device", "path", "parent", "name", "size", "hash", "mtime")
    catalogue.write_catalogue(rows, folder, SESSION)
    lang = F.split_part("path", F.lit("/"), F.lit(3))
    later = rows.where(lang != "fr")
    new = rows.where(lang == "es").withColumn("path", F.concat("path", F.lit(".copy")))
    touched = F.when(F.col("size") >= 1500, F.col("mtime") + F.make_dt_interval(hours=F.lit(1))).otherwise(F.col("mtime"))
    grown = F.when(F.col("size") >= 4000, F.col("size") + 1).otherwise(F.col("size"))
    catalogue.write_catalogue(later.withColumns({"mtime": touched, "size": grown}).unionByName(new), folder, "s2")
    return catalogue.catalogue_changes(catalogue.read_catalogue(spark, folder, SESSION),
                                       catalogue.read_catalogue(spark, folder, "s2"))


# -- projections and filters ---------------------------------------------------

@query
def path_parts(spark, sf):
    return files(spark, sf).select(
        "path", basename("path").alias("name"), parent_of("path").alias("parent"),
        extension_of(basename("path")).alias("extension"), depth_of("path").cast("bigint").alias("depth"),
        F.element_at(self_and_ancestors("path"), 1).alias("top"))


@query
def enabled_patterns(spark, sf):
    return residuals.enabled_patterns(proposals(spark, sf)).select("pid", "File_Pattern", "Enabled")


@query
def valid_patterns(spark, sf):
    return residuals.valid_patterns(fx.proposed_patterns(spark, sf))


@query
def invalid_pattern_rows(spark, sf):
    return residuals.invalid_pattern_rows(fx.proposed_patterns(spark, sf))


@query
def edit_patterns(spark, sf):
    """Unsafe proposals for one event type go, mail-like ones flip, some change, some come."""
    rows = proposals(spark, sf)
    kind = F.col("OS")
    changed = rows.where(kind == "error").withColumn("File_Pattern", F.concat("File_Pattern", F.lit("~")))
    added = rows.where(kind == "signup").withColumn("Description", F.lit("copied"))
    return residuals.edit_patterns(rows, removed=rows.where((kind == "view") & (F.col("Safe_To_Delete") == "No")),
                                   toggled=rows.where(kind == "click"), replaced=changed, added=added)


@query
def exclude_protected(spark, sf):
    dirs = tree(spark, sf).where(F.col("entry_type") == "dir")
    return roots.exclude_protected(dirs, fx.listed_roots(spark, sf), "blog.ththan.example.net").select("path")


@query
def select_deletable(spark, sf):
    return dedup.select_deletable(dup_plan(spark, sf))


# -- joins ---------------------------------------------------------------------

@query
def residual_matches(spark, sf):
    return residuals.residual_matches(files(spark, sf), patterns(spark))


@query
def residual_matches_tree(spark, sf):
    """Files and directories alike; a matched directory does not hide what lies below it."""
    globs = ["blog.*", "*.html", "[0-4]?", "[!0-9]?"]
    table = pa.table({"pid": range(len(globs)), "OS": ["Any"] * len(globs), "File_Pattern": globs,
                      "Safe_To_Delete": ["No"] * len(globs), "Enabled": ["Yes"] * len(globs)})
    return residuals.residual_matches(tree(spark, sf), spark.createDataFrame(table)) \
                    .select("path", "entry_type", "pid", "File_Pattern")


@query
def residual_matches_many(spark, sf):
    """First match among all proposals from the events: too many for one expression."""
    names = fx.table(spark, sf, "events").select(
        F.concat(F.lit("/"), "event_type", F.lit("/"), F.lit("e"), "user_id", F.lit(".u"), "event_id").alias("path"),
        F.concat(F.lit("e"), "user_id", F.lit(".u"), "event_id").alias("name"))
    return residuals.with_first_pattern(names, proposals(spark, sf)).where("pid IS NOT NULL") \
                    .select("path", "pid")


@query
def residual_matches_floating(spark, sf):
    """First match among thousands of globs that have their literal text anywhere in the name."""
    events = fx.table(spark, sf, "events")
    code = F.md5(F.concat_ws(":", "user_id", F.hour("ts")).cast("binary"))
    glob = F.when(F.col("user_id") % 2 == 0, F.concat(F.lit("*"), F.substring(code, 1, 4), F.lit("*"))).otherwise(
        F.concat(F.lit("*"), F.substring(code, 1, 3), F.lit("?"), F.substring(code, 4, 1), F.lit("*")))
    table = events.select(F.col("event_id").alias("pid"), glob.alias("File_Pattern"), F.lit("Yes").alias("Enabled"))
    name = F.concat(F.md5(F.col("event_id").cast("string").cast("binary")), F.lit(".log"))
    names = events.select(F.concat(F.lit("/"), "event_type", F.lit("/"), name).alias("path"), name.alias("name"))
    return residuals.with_first_pattern(names, table).where("pid IS NOT NULL").select("path", "pid")


@query
def non_residual(spark, sf):
    return residuals.non_residual(files(spark, sf), patterns(spark)).select("path", "size")


@query
def size_candidates(spark, sf):
    return dedup.size_candidates(hashed(spark, sf, "path", "size"))


@query
def leaf_empty_dirs(spark, sf):
    return emptydirs.leaf_empty_dirs(written_tree(spark, sf)).select("path", "parent", "name")


@query
def cascade_empty_dirs(spark, sf):
    return emptydirs.cascade_empty_dirs(written_tree(spark, sf)).select("path", "round")


def _cascade_of_selection(spark, sf, scope):
    """The user picks the leaf-empty directories of the '.org' hosts; hosts are roots."""
    rows = written_tree(spark, sf)
    hosts = rows.where("depth = 1").select(F.col("path").alias("root"), F.xxhash64("path").alias("root_idx"))
    chosen = emptydirs.leaf_empty_dirs(rows).where(F.col("path").contains(".org/"))
    return emptydirs.cascade_empty_dirs(rows, hosts, chosen, scope).select("path", "round")


@query
def cascade_below_roots(spark, sf):
    return _cascade_of_selection(spark, sf, "roots")


@query
def cascade_selected(spark, sf):
    return _cascade_of_selection(spark, sf, "selected")


@query
def quarantine_plan(spark, sf):
    return emptydirs.quarantine_plan(written_tree(spark, sf), fx.listed_roots(spark, sf), SESSION) \
                    .select("path", "quarantine_path")


@query
def apply_selection(spark, sf):
    return actions.apply_selection(dup_plan(spark, sf), fx.selection(spark, sf)).select("path", "action")


@query
def attribute_to_root(spark, sf):
    rows = written_tree(spark, sf)
    return roots.attribute_to_root(rows, fx.listed_roots(spark, sf)).select(
        "path", F.coalesce("root_idx", F.lit(-1)).alias("root_idx"))


@query
def revalidate_plan(spark, sf):
    """Between plan and action, '.org' directories gain a file and deep '.net' ones vanish."""
    rows = written_tree(spark, sf)
    plan = materialize(emptydirs.cascade_empty_dirs(rows), "plan")
    grown = plan.where(F.col("path").contains(".org/")).select(
        F.concat("path", F.lit("/late.txt")).alias("path"), F.lit("file").alias("entry_type"))
    vanished = plan.where(F.col("path").contains(".net/") & (F.col("depth") == 3)).select("path")
    fresh = (rows.select("path", "entry_type").join(vanished, "path", "left_anti").unionByName(grown))
    return actions.revalidate_plan(plan, fresh).select("path", "round")


@query
def deletion_closure(spark, sf):
    rows = materialize(files(spark, sf).select("path", "parent", "entry_type"), "files")
    return actions.deletion_closure(rows, fx.selection(spark, sf))


@query
def effective_delete_roots(spark, sf):
    return actions.effective_delete_roots(materialize(fx.selection(spark, sf), "selection"))


@query
def with_device(spark, sf):
    rows = materialize(files(spark, sf).select("path", "parent", "size"), "files")
    return profile.with_device(rows, fx.mounts(spark, sf)).select("path", "device", "device_type")


@query
def verify_checksums(spark, sf):
    """The manifest is upper case for one language, wrong for another, silent on a third."""
    rows = materialize(files(spark, sf).select("path", "hash", F.split_part("path", F.lit("/"), F.lit(3))
                                               .alias("lang")), "hashed")
    wanted = (F.when(F.col("lang") == "en", F.upper("hash"))
               .when(F.col("lang") == "fr", F.reverse("hash")).otherwise(F.col("hash")))
    manifest = rows.where("lang <> 'es'").select("path", wanted.alias("hash")).unionByName(
        fx.url_paths(spark, sf).distinct().select("path", F.sha2("path", 256).alias("hash")))
    return retention.verify_checksums(rows, manifest)


# -- aggregations --------------------------------------------------------------

@query
def duplicate_groups(spark, sf):
    return dedup.duplicate_groups(files(spark, sf))


@query
def duplicate_groups_non_empty(spark, sf):
    return dedup.duplicate_groups(files(spark, sf), include_empty=False)


@query
def duplicate_members(spark, sf):
    return dedup.duplicate_members(hashed(spark, sf, "hash", "ord", "path", "size"))


@query
def same_name_duplicates(spark, sf):
    return dedup.same_name_duplicates(files(spark, sf))


@query
def duplicate_summary(spark, sf):
    return dedup.duplicate_summary(files(spark, sf))


@query
def scan_summary(spark, sf):
    rows = hashed(spark, sf, "hash", "ord", "path", "name", "size", "entry_type")
    return profile.scan_summary(
        scanned=rows, residual=residuals.with_first_pattern(rows, patterns(spark)).where("pid IS NOT NULL"),
        duplicate_groups=dedup.duplicate_groups(rows),
        empty_dirs=emptydirs.leaf_empty_dirs(written_tree(spark, sf)))


@query
def pattern_summary(spark, sf):
    return residuals.pattern_summary(proposals(spark, sf))


def _results(spark, sf):
    return actions.results_of_audit(audit_table(spark, sf))


@query
def deletion_summary(spark, sf):
    return actions.deletion_summary(_results(spark, sf))


@query
def deletion_failures(spark, sf):
    return actions.deletion_failures(_results(spark, sf))


@query
def purge_rounds(spark, sf):
    return emptydirs.purge_rounds(emptydirs.cascade_empty_dirs(written_tree(spark, sf)))


@query
def device_profile(spark, sf):
    return profile.device_profile(files(spark, sf).withColumn(
        "root", F.element_at(self_and_ancestors("parent"), 2)))


@query
def size_class_profile(spark, sf):
    return profile.size_class_profile(files(spark, sf))


def _work(spark, sf):
    return fx.table(spark, sf, "events").select("ts", F.floor(F.col("value") * 1000).alias("bytes"))


@query
def throughput(spark, sf):
    return profile.throughput(_work(spark, sf)).withColumn("window_start", tx.audit_stamp("window_start"))


@query
def completion_estimate(spark, sf):
    """Work logged as events, against a job of twice the store's files and bytes."""
    job = files(spark, sf).agg(F.count("*"), F.sum("size")).first()
    return profile.completion_estimate(profile.throughput(_work(spark, sf)), 200 * job[0], 20000 * job[1])


@query
def job_gate(spark, sf):
    return profile.job_gate(files(spark, sf), max_files=25_000_000, max_bytes=1_000_000)


@query
def pattern_audit(spark, sf):
    return residuals.pattern_audit(files(spark, sf), patterns(spark))


# -- keep/delete plans and other ranked results ----------------------------------

def _plan(spark, sf, policy, **options):
    rows = hashed(spark, sf, "hash", "ord", "path", "device", "size")
    return dedup.dup_plan(rows, policy, **options)


@query
def dup_plan(spark, sf):
    return _plan(spark, sf, "keep_first")


def manual_actions(rows: DataFrame) -> DataFrame:
    """Small files all go, medium ones stay on one device: some groups would lose all copies."""
    return rows.where("size < 3000").select(
        "path", F.when((F.col("size") >= 1000) & (F.col("device") == "src3"), "KEEP")
                 .otherwise("DELETE").alias("action"))


@query
def dup_plan_manual(spark, sf):
    rows = hashed(spark, sf, "hash", "ord", "path", "device", "size")
    return dedup.dup_plan(rows, "manual", manual=manual_actions(rows))


for _policy in ("keep_all", "keep_first", "keep_same_device", "keep_one_per_device"):
    _QUERIES[f"dup_plan_{_policy}"] = partial(_plan, policy=_policy)
_QUERIES["dup_plan_keep_device"] = partial(_plan, policy="keep_device", device="src3")


@query
def retain_newest(spark, sf):
    rows = materialize(files(spark, sf).select("device", "path", "mtime"), "files")
    return retention.retain_newest(rows, "device")


@query
def size_batches(spark, sf):
    return profile.size_batches(files(spark, sf), max_files=20, max_bytes=40_000)


@query
def deletion_order(spark, sf):
    rows = tree(spark, sf).withColumn("device", F.element_at(self_and_ancestors("path"), 1))
    return emptydirs.deletion_order(rows).select("device", "path", "seq")


# -- set operations and reports ----------------------------------------------------

@query
def union_roots(spark, sf):
    rows = written_tree(spark, sf)
    listed = fx.listed_roots(spark, sf)
    found = roots.found_under_roots(rows.select("path", "parent", "entry_type"), listed)
    again = roots.found_under_roots(rows.select("path", "parent", "entry_type"),
                                    listed.withColumn("root_idx", F.col("root_idx") + 100_000_000))
    return roots.union_roots(found, again).select("path", "root_idx", "entry_type")


@query
def tree_report(spark, sf):
    """All leaf-empty directories quarantined, the '.org' ones removed as well."""
    plan = materialize(emptydirs.quarantine_plan(written_tree(spark, sf), fx.listed_roots(spark, sf), SESSION), "plan")
    moved = plan.select(F.col("quarantine_path").alias("path"))
    status = emptydirs.purge_status(moved, moved.where(F.col("path").contains(".org/")))
    return emptydirs.tree_report(status).select("path", "status", "line")


@query
def affected_parents(spark, sf):
    return emptydirs.affected_parents(emptydirs.leaf_empty_dirs(written_tree(spark, sf)))


@query
def unfinished(spark, sf):
    parsed = audit_table(spark, sf)
    return actions.unfinished(parsed.where("path IS NOT NULL"), actions.results_of_audit(parsed))


@query
def scalar_functions(spark, sf):
    docs = fx.table(spark, sf, "documents")
    size = F.octet_length("text").cast("bigint")
    return docs.select(
        "doc_id", content_hash("text").alias("hash"), tx.human_size(size).alias("human"),
        F.md5(tx.strip(F.concat(F.lit("\t \n"), "text", F.lit(" \r\n")))).alias("stripped"),
        tx.is_blank(F.regexp_replace("lang", "[a-z]+", " ")).alias("blank"),
        tx.audit_stamp(F.to_timestamp_ntz(F.lit("2024-01-01 00:00:00"))
                       + F.make_dt_interval(secs=F.col("n_chars"))).alias("stamp"))


# -- similarity and arrival --------------------------------------------------------

@query
def near_duplicates(spark, sf):
    return similarity.near_duplicates(fx.file_inventory(spark, sf, content=True))


@query
def near_duplicate_vectors(spark, sf):
    return similarity.near_duplicate_vectors(fx.feature_vectors(spark, sf))


def _arrivals(spark, sf, batches: int) -> DataFrame:
    """The hashed inventory arrives in batches, larger files announced twice; the index ends equal to the batch result."""
    inbox, base = new_location(spark, "inbox"), new_location(spark, "watch")
    rows = materialize(files(spark, sf).select("hash", "ord", "path", "size"), "hashed")
    # A stated number of files, which follows the rows, so that there are as many batches at every size.
    parts = batches * max(1, rows.count() // (batches * 1_000_000))
    again = rows.where("size >= 1500").withColumn("turn", F.lit(1))
    announced = rows.withColumn("turn", F.lit(0)).unionByName(again)
    announced.repartition(parts, "path", "turn").drop("turn").write.parquet(inbox)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", parts // batches).parquet(inbox)
    incremental.watch_duplicates(stream, f"{base}/index", f"{base}/checkpoint").awaitTermination()
    return incremental.incremental_summary(incremental.indexed_files(spark, f"{base}/index"))


@query
def incremental_duplicates(spark, sf):
    return _arrivals(spark, sf, 10)


@query
def incremental_duplicates_long(spark, sf):
    """Fifty batches: what a batch costs does not follow what came before it."""
    return _arrivals(spark, sf, 50)
