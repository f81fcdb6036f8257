"""The same queries in plain SQL over the same tables, for checking results."""

from __future__ import annotations

FA = """
fa AS (SELECT *, parent || '/' || name AS path FROM (
  SELECT doc_id AS ord, source AS device, lang, 'file' AS entry_type,
    '/' || source || '/' || lang || '/d' || CAST(doc_id // 8 AS VARCHAR) AS parent,
    CASE doc_id % 8 WHEN 0 THEN 'f' || doc_id || '.tmp' WHEN 1 THEN '.~lock.f' || doc_id || '#'
      WHEN 2 THEN 'f' || doc_id || '.bak' WHEN 3 THEN 'Thumbs.db' WHEN 4 THEN '._f' || doc_id
      WHEN 5 THEN 'F' || doc_id || '.TMP' ELSE 'f' || doc_id || '.txt' END AS name,
    CAST(strlen(text) AS BIGINT) AS size, sha256(text) AS hash,
    TIMESTAMP '2024-01-01 00:00:00' + to_minutes(doc_id) AS mtime FROM documents))"""

URLS = """
urls AS (SELECT page_id, regexp_replace(regexp_replace(url, '^https?:/', ''), '[?#].*$', '') AS path FROM pages)"""

FB = URLS + """,
dirs AS (SELECT DISTINCT unnest(list_transform(range(2, len(s)), lambda i: array_to_string(s[1:i], '/'))) AS path
         FROM (SELECT DISTINCT string_split(path, '/') AS s FROM urls)),
leaves AS (SELECT DISTINCT path FROM urls WHERE path NOT LIKE '%/' AND path NOT IN (SELECT path FROM dirs)),
fb AS (SELECT path, regexp_replace(path, '/[^/]*$', '') AS parent, regexp_extract(path, '[^/]*$') AS name,
         CAST(len(path) - len(replace(path, '/', '')) AS BIGINT) AS depth, entry_type
       FROM (SELECT path, 'dir' AS entry_type FROM dirs UNION ALL SELECT path, 'file' FROM leaves))"""

EMPTY = FB + """,
empty AS (SELECT * FROM fb WHERE entry_type = 'dir' AND path NOT IN (SELECT parent FROM fb))"""

CASCADE = FB + """,
gone AS (SELECT path, depth FROM fb d WHERE entry_type = 'dir' AND NOT EXISTS (
           SELECT 1 FROM leaves f WHERE starts_with(f.path, d.path || '/'))),
cascade AS (SELECT d.path, d.depth, CAST(max(s.depth) - d.depth + 1 AS BIGINT) AS round
            FROM gone d JOIN gone s ON s.path = d.path OR starts_with(s.path, d.path || '/')
            GROUP BY d.path, d.depth)"""

PATTERNS = """
pattern_rows(pid, OS, File_Pattern, Safe_To_Delete, Enabled) AS (VALUES
  (0, 'macOS', '._*', 'Yes', 'Yes'), (1, 'Windows', 'Thumbs.db', 'Yes', 'Yes'), (2, 'Linux', '*.tmp', 'Yes', 'true'),
  (3, 'Linux', '*.bak', 'No', 'No'), (4, 'Office', '.~lock.*#', 'Yes', '1'), (5, 'Any', '*.t?p', 'No', 'YES'),
  (6, 'Any', 'f[0-4]*.txt', 'No', 'Yes'), (8, 'Any', '', 'No', 'Yes'), (9, 'Any', '*.log', 'No', '')),
first_match AS (SELECT path, min(CAST(pid AS BIGINT)) AS pid FROM fa JOIN pattern_rows p ON name GLOB File_Pattern
                WHERE lower(Enabled) IN ('yes', 'true', '1') GROUP BY path)"""

_TRIM = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
PROPOSED = """
proposed AS (SELECT event_id AS pid,
  CASE event_id % 5 WHEN 0 THEN '' WHEN 1 THEN '  ' WHEN 2 THEN chr(9) || event_type || ' ' ELSE event_type END AS OS,
  CASE event_id % 7 WHEN 0 THEN '' WHEN 1 THEN ' ' WHEN 2 THEN ' *.u' || user_id || chr(9)
    WHEN 3 THEN 'e' || user_id || '*' WHEN 4 THEN '._u' || user_id ELSE '*.u' || user_id || '?' END AS File_Pattern,
  props AS Path_Example,
  event_type || CASE WHEN event_id % 11 = 0 THEN ',' || chr(10) ELSE ', ' END || 'by ' || user_id AS Description,
  CASE WHEN event_id % 2 = 0 THEN 'Yes' ELSE 'No' END AS Safe_To_Delete,
  CASE event_id % 6 WHEN 0 THEN 'Yes' WHEN 1 THEN 'true' WHEN 2 THEN '1' WHEN 3 THEN 'No' WHEN 4 THEN ''
    ELSE ' YES ' END AS Enabled FROM events)"""
_COLUMNS = ("OS", "File_Pattern", "Path_Example", "Description", "Safe_To_Delete", "Enabled")
LOADED = PROPOSED + ",\nloaded AS (SELECT pid, " + ", ".join(
    f"{_TRIM.format(c)} AS {c}" for c in _COLUMNS) + " FROM proposed WHERE OS <> '' AND File_Pattern <> '')"
_ON = "lower(Enabled) IN ('yes', 'true', '1')"
_COMPLETE = f"{_TRIM.format('OS')} <> '' AND {_TRIM.format('File_Pattern')} <> ''"
VALID = PROPOSED + f""",
valid AS (SELECT pid, {_TRIM.format('OS')} AS OS, {_TRIM.format('File_Pattern')} AS File_Pattern, Path_Example,
  Description, Safe_To_Delete, CASE WHEN {_ON} THEN 'Yes' ELSE 'No' END AS Enabled FROM proposed WHERE {_COMPLETE})"""

AUDIT = """
audit AS (SELECT strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts,
  CASE event_type WHEN 'click' THEN 'deleted_file' WHEN 'purchase' THEN 'deleted_dir' WHEN 'error' THEN 'failed'
    WHEN 'view' THEN 'empty' ELSE 'unreadable' END AS kind, '/u' || user_id || '/e' || event_id AS path,
  CASE WHEN event_type IN ('click', 'purchase', 'view') THEN NULL ELSE 'denied' END AS error,
  CASE event_type WHEN 'click' THEN 'Deleted file: ' WHEN 'purchase' THEN 'Deleted directory: '
    WHEN 'error' THEN 'Failed to delete ' WHEN 'view' THEN 'Found empty: ' ELSE 'Error accessing ' END AS opening
  FROM events),
audit_lines AS (SELECT *, '[' || ts || '] ' || opening || path || coalesce(': ' || error, '') AS line FROM audit)"""

ROOTS = """
listed AS (SELECT page_id AS root_idx, regexp_replace(regexp_replace(CASE page_id % 4
    WHEN 0 THEN '/' || split_part(path, '/', 2) || '/'
    WHEN 1 THEN '/' || split_part(path, '/', 2) || '//' || split_part(path, '/', 3)
    WHEN 2 THEN '/missing/' || split_part(path, '/', 2)
    ELSE regexp_replace(regexp_replace(path, '/$', ''), '/[^/]*$', '') END, '/+', '/', 'g'), '(.)/$', '\\1') AS root
  FROM urls)"""

MOUNTS = """
mounts AS (SELECT '/' AS mount, 'dev-system' AS device
  UNION SELECT '/' || source, 'dev-' || source FROM documents
  UNION SELECT '/' || source || '/' || lang, 'dev-' || source || '-' || lang FROM documents
    WHERE CAST(regexp_extract(source, '\\d+$') AS INT) % 3 = 0)"""

SELECTION = """
selection AS (SELECT path, entry_type FROM fa WHERE size >= 1500
  UNION SELECT '/' || source || '/' || lang, 'dir' FROM documents WHERE lang = 'fr'),
folders AS (SELECT path FROM selection WHERE entry_type = 'dir')"""

GROUPS = """
grp AS (SELECT hash, count(*) AS copies, max(size) AS size, min(ord) AS first_ord, arg_min(path, ord) AS first_path,
          arg_min(device, ord) AS first_device FROM fa GROUP BY hash HAVING count(*) > 1)"""

QUARANTINE = EMPTY + "," + ROOTS + """,
plan AS (SELECT path, path || '.purge.' || substr(sha256('s1' || path), 1, 8) AS quarantine_path, depth
         FROM empty WHERE path NOT IN (SELECT root FROM listed) AND name <> '.purge.lock')"""

_PLAN = ("SELECT fa.hash, substr(fa.hash, 1, 16) AS hash_prefix, ord, path, device, fa.size, "
         "CASE WHEN {keep} THEN 'KEEP' ELSE 'DELETE' END AS action FROM fa JOIN grp USING (hash)")


def _with(*parts: str, recursive: bool = False) -> str:
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",".join(parts) + "\n"


def _dup_plan(keep: str, extra: str = "") -> str:
    return _with(FA, GROUPS, *([extra] if extra else [])) + _PLAN.format(keep=keep)



_COMPONENTS = """
links AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges),
reach(id, other) AS (SELECT a, b FROM links UNION SELECT r.id, l.b FROM reach r JOIN links l ON r.other = l.a)"""

SIMILAR = r"""
words AS (SELECT doc_id, sha256(text) AS hash,
            list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents),
contents AS (SELECT min(doc_id) AS id, hash, any_value(w) AS w FROM words GROUP BY hash),
grams AS (SELECT DISTINCT id, unnest(list_transform(range(1, len(w) - 1),
            lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS g FROM contents WHERE len(w) > 2),
sizes AS (SELECT id, count(*) AS n FROM grams GROUP BY id),
common AS (SELECT x.id AS a, y.id AS b, count(*) AS c FROM grams x JOIN grams y ON x.g = y.g AND x.id < y.id GROUP BY 1, 2),
edges AS (SELECT a, b FROM common JOIN sizes s ON s.id = a JOIN sizes t ON t.id = b WHERE c / (s.n + t.n - c) >= 0.4)"""

VECTORS = """
vectors AS (SELECT vec_id AS id, embedding AS v FROM embeddings
  UNION ALL SELECT vec_id + 100000000, list_transform(embedding, lambda x: CAST(round(x, 2) AS FLOAT)) FROM embeddings),
edges AS (SELECT x.id AS a, y.id AS b FROM vectors x JOIN vectors y
          ON x.id < y.id AND list_cosine_similarity(x.v, y.v) >= 0.95)"""



def all_oracles() -> dict[str, str]:
    sql = {
        # sources and sinks
        "list_files": _with(FA) + "SELECT path, name, size FROM fa",
        "list_entries": _with(FB) + """SELECT path, parent, name, entry_type,
            CAST(0 AS BIGINT) AS size FROM fb""",
        "hash_tree": _with(FA) + "SELECT path, size, hash, CAST(NULL AS VARCHAR) AS hash_error FROM fa",
        "error_ledger": _with(FB, ROOTS) + """SELECT DISTINCT root AS path, 'root' AS entry_type,
            CASE WHEN root IN (SELECT path FROM leaves) THEN 'NotADirectoryError: Not a directory'
                 ELSE 'FileNotFoundError: No such file or directory' END AS error
            FROM listed WHERE root NOT IN (SELECT path FROM dirs)
            AND NOT EXISTS (SELECT 1 FROM listed o WHERE starts_with(listed.root, o.root || '/'))""",
        "normalize_roots": _with(FB, ROOTS) + """,
            first AS (SELECT root, min(root_idx) AS idx FROM listed GROUP BY root),
            here AS (SELECT root FROM first WHERE root IN (SELECT path FROM dirs))
            SELECT root_idx, root, CASE WHEN root_idx <> idx THEN 'repeat'
              WHEN root NOT IN (SELECT root FROM here) THEN 'missing'
              WHEN EXISTS (SELECT 1 FROM here o WHERE starts_with(listed.root, o.root || '/')) THEN 'nested'
              ELSE 'kept' END AS status FROM listed JOIN first USING (root)""",
        "load_patterns": _with(LOADED) + "SELECT * FROM loaded",
        "save_patterns_roundtrip": _with(VALID) + """SELECT *, 'v1' AS version FROM proposed UNION ALL
            SELECT row_number() OVER (ORDER BY pid) - 1, OS, File_Pattern, Path_Example, Description, Safe_To_Delete,
              Enabled, 'v2' FROM valid""",
        "write_audit_roundtrip": _with(AUDIT) + "SELECT 's1' AS session_id, line FROM audit_lines",
        "parse_audit": _with(AUDIT) + "SELECT ts, kind, path, error, line AS raw FROM audit_lines",
        "catalogue_roundtrip": _with(FA) + """SELECT 's1' AS session_id, device, path, size, hash,
            strftime(mtime, '%Y-%m-%d %H:%M:%S') AS mtime FROM fa""",
        "device_catalogue_roundtrip": _with(MOUNTS) + """SELECT 's1' AS session_id, mount, device,
            CASE WHEN len(device) % 2 = 0 THEN 'SSD' ELSE 'HDD' END AS device_type FROM mounts""",
        "apply_deletes": _with(FA, GROUPS, URLS) + """SELECT path, 'deleted' AS outcome, CAST(NULL AS VARCHAR) AS error
            FROM fa JOIN grp USING (hash) WHERE ord <> first_ord
            UNION ALL SELECT DISTINCT path, 'absent', NULL FROM urls""",
        # whole jobs
        "purge_tree": _with(CASCADE) + """SELECT path, CASE WHEN path IN (SELECT path FROM cascade) THEN 'purged_dir' ELSE 'left' END
            AS state FROM fb""",
        "quarantine_tree": _with(EMPTY) + """SELECT path, 'left' AS state FROM fb WHERE path NOT IN (SELECT path FROM empty)
            UNION ALL SELECT path, unnest(['renamed', 'purged_dir']) FROM empty""",
        "delete_tree": _with(FB) + """SELECT path, CASE WHEN path NOT LIKE '%.org' OR depth > 1 THEN 'left'
              WHEN entry_type = 'dir' THEN 'deleted_dir' ELSE 'deleted_file' END AS state
            FROM fb WHERE depth = 1 OR split_part(path, '/', 2) NOT LIKE '%.org'""",
        "find_duplicates_tree": _with(FA, PATTERNS) + """,
            clean AS (SELECT * FROM fa WHERE path NOT IN (SELECT path FROM first_match)),
            twins AS (SELECT hash, min(path) AS kept FROM clean GROUP BY hash HAVING count(*) > 1)
            SELECT path, hash, size, CASE WHEN path = kept THEN 'KEEP' ELSE 'DELETE' END AS action FROM clean JOIN twins USING (hash)""",
        "catalogue_changes": _with(FA) + """SELECT path, CASE WHEN lang = 'fr' THEN 'gone' WHEN size >= 1500 THEN 'changed' ELSE 'same' END
              AS status, size AS size_before, CASE WHEN lang = 'fr' THEN NULL WHEN size >= 4000 THEN size + 1 ELSE size END AS size_after FROM fa
            UNION ALL SELECT path || '.copy', 'added', NULL, size FROM fa WHERE lang = 'es'""",
        # projections and filters
        "path_parts": _with(FA) + """SELECT path, name, parent, regexp_extract(name, '^.+\\.([^.]+)$', 1) AS extension,
            CAST(len(path) - len(replace(path, '/', '')) AS BIGINT) AS depth, '/' || device AS top FROM fa""",
        "enabled_patterns": _with(LOADED) + f"SELECT pid, File_Pattern, Enabled FROM loaded WHERE {_ON}",
        "valid_patterns": _with(VALID) + "SELECT * FROM valid",
        "invalid_pattern_rows": _with(PROPOSED) + f"SELECT pid + 1 AS row_number FROM proposed WHERE NOT ({_COMPLETE})",
        "edit_patterns": _with(LOADED) + f""",
            edited AS (SELECT 0 AS late, pid, OS, File_Pattern || CASE WHEN OS = 'error' THEN '~' ELSE '' END AS File_Pattern,
                Path_Example, Description, Safe_To_Delete,
                CASE WHEN OS <> 'click' THEN Enabled WHEN {_ON} THEN 'No' ELSE 'Yes' END AS Enabled
              FROM loaded WHERE NOT (OS = 'view' AND Safe_To_Delete = 'No')
              UNION ALL SELECT 1, pid, OS, File_Pattern, Path_Example, 'copied', Safe_To_Delete, Enabled
              FROM loaded WHERE OS = 'signup')
            SELECT row_number() OVER (ORDER BY late, pid) - 1 AS pid, OS, File_Pattern, Path_Example, Description,
              Safe_To_Delete, Enabled FROM edited""",
        "exclude_protected": _with(FB, ROOTS) + """SELECT path FROM fb WHERE entry_type = 'dir'
            AND name <> 'blog.ththan.example.net' AND path NOT IN (SELECT root FROM listed)""",
        "select_deletable": _with(FA, GROUPS) + """SELECT path, fa.size FROM fa JOIN grp USING (hash)
            WHERE ord <> first_ord""",
        # joins
        "residual_matches": _with(FA, PATTERNS) + """SELECT path, entry_type, first_match.pid, OS, File_Pattern,
            Safe_To_Delete FROM first_match JOIN fa USING (path) JOIN pattern_rows p ON p.pid = first_match.pid""",
        "residual_matches_tree": _with(FB) + """,
            globs(pid, File_Pattern) AS (VALUES (0, 'blog.*'), (1, '*.html'), (2, '[0-4]?'), (3, '[!0-9]?'))
            SELECT path, entry_type, CAST(min(pid) AS BIGINT) AS pid, arg_min(File_Pattern, pid) AS File_Pattern
            FROM fb JOIN globs ON name GLOB File_Pattern GROUP BY path, entry_type""",
        "residual_matches_many": _with(LOADED) + f""",
            names AS (SELECT '/' || event_type || '/e' || user_id || '.u' || event_id AS path,
                        'e' || user_id || '.u' || event_id AS name FROM events)
            SELECT path, min(pid) AS pid FROM names JOIN loaded ON name GLOB File_Pattern WHERE {_ON} GROUP BY path""",
        "residual_matches_floating": """WITH coded AS (SELECT event_id, user_id, md5(user_id || ':' || hour(ts)) AS code FROM events),
            globs AS (SELECT min(event_id) AS pid, CASE WHEN user_id % 2 = 0 THEN '*' || code[1:4] || '*'
              ELSE '*' || code[1:3] || '?' || code[4] || '*' END AS pattern FROM coded GROUP BY 2),
            names AS (SELECT '/' || event_type || '/' || md5(event_id::VARCHAR) || '.log' AS path, md5(event_id::VARCHAR) || '.log' AS name FROM events)
            SELECT path, min(pid) AS pid FROM names JOIN globs ON name GLOB pattern GROUP BY path""",
        "non_residual": _with(FA, PATTERNS) + "SELECT path, size FROM fa WHERE path NOT IN (SELECT path FROM first_match)",
        "size_candidates": _with(FA) + """SELECT path, size FROM fa WHERE size IN
            (SELECT size FROM fa GROUP BY size HAVING count(*) > 1)""",
        "leaf_empty_dirs": _with(EMPTY) + "SELECT path, parent, name FROM empty",
        "cascade_empty_dirs": _with(CASCADE) + "SELECT path, round FROM cascade",
        "cascade_below_roots": _with(CASCADE) + """, picked AS (SELECT DISTINCT split_part(path, '/', 2) AS host FROM fb
              WHERE entry_type = 'dir' AND path NOT IN (SELECT parent FROM fb) AND path LIKE '%.org/%')
            SELECT path, round FROM cascade WHERE depth > 1 AND split_part(path, '/', 2) IN (SELECT host FROM picked)""",
        "cascade_selected": _with(EMPTY) + "SELECT path, CAST(1 AS BIGINT) AS round FROM empty WHERE path LIKE '%.org/%'",
        "quarantine_plan": _with(QUARANTINE) + "SELECT path, quarantine_path FROM plan",
        "apply_selection": _with(FA, GROUPS, SELECTION) + """SELECT path,
            CASE WHEN ord = first_ord THEN 'KEEP' ELSE 'DELETE' END AS action FROM fa JOIN grp USING (hash)
            WHERE path IN (SELECT path FROM selection)""",
        "attribute_to_root": _with(FB, ROOTS) + """SELECT path, coalesce(min(root_idx), -1) AS root_idx FROM fb LEFT JOIN listed
            ON path = root OR starts_with(path, root || '/') GROUP BY path""",
        "revalidate_plan": _with(CASCADE) + """,
            fresh AS (SELECT path, entry_type FROM fb WHERE path NOT IN
                (SELECT path FROM cascade WHERE path LIKE '%.net/%' AND depth = 3)
              UNION ALL SELECT path || '/late.txt', 'file' FROM cascade WHERE path LIKE '%.org/%')
            SELECT path, round FROM cascade p WHERE path IN (SELECT path FROM fresh WHERE entry_type = 'dir')
              AND NOT EXISTS (SELECT 1 FROM fresh f WHERE starts_with(f.path, p.path || '/')
                              AND f.path NOT IN (SELECT path FROM cascade))""",
        "deletion_closure": _with(FA, SELECTION) + """SELECT DISTINCT fa.path, fa.entry_type FROM fa
            WHERE path IN (SELECT path FROM selection) OR EXISTS
              (SELECT 1 FROM folders d WHERE starts_with(fa.path, d.path || '/'))""",
        "effective_delete_roots": _with(FA, SELECTION) + """SELECT path, entry_type FROM selection s WHERE NOT EXISTS
              (SELECT 1 FROM folders d WHERE starts_with(s.path, d.path || '/'))""",
        "with_device": _with(FA, MOUNTS) + """SELECT path, device, CASE WHEN len(device) % 2 = 0 THEN 'SSD' ELSE 'HDD' END
              AS device_type FROM (SELECT fa.path, arg_max(m.device, len(mount)) AS device FROM fa JOIN mounts m
              ON mount = '/' OR starts_with(fa.path, mount || '/') GROUP BY fa.path)""",
        "verify_checksums": _with(FA, URLS) + """,
            manifest AS (SELECT path, lang = 'fr' AND hash <> reverse(hash) AS wrong FROM fa WHERE lang <> 'es')
            SELECT path, CASE WHEN wrong IS NULL THEN 'unexpected' WHEN wrong THEN 'mismatch' ELSE 'ok' END AS status
            FROM fa LEFT JOIN manifest USING (path)
            UNION ALL SELECT DISTINCT path, 'missing' FROM urls""",
        # aggregations
        "duplicate_groups": _with(FA, GROUPS) + """SELECT hash, copies, size, first_ord, first_path,
            (copies - 1) * size AS redundant_bytes FROM grp""",
        "duplicate_groups_non_empty": _with(FA, GROUPS) + """SELECT hash, copies, size, first_ord, first_path,
            (copies - 1) * size AS redundant_bytes FROM grp WHERE size > 0""",
        "duplicate_members": _with(FA, GROUPS) + "SELECT fa.hash, ord, path, copies FROM fa JOIN grp USING (hash)",
        "same_name_duplicates": _with(FA) + """SELECT hash, name, count(*) AS copies, arg_min(path, ord) AS first_path
            FROM fa GROUP BY hash, name HAVING count(*) > 1""",
        "duplicate_summary": _with(FA, GROUPS) + """SELECT count(*) AS groups,
            CAST(coalesce(sum(copies - 1), 0) AS BIGINT) AS redundant_files,
            CAST(coalesce(sum((copies - 1) * size), 0) AS BIGINT) AS redundant_bytes FROM grp""",
        "scan_summary": _with(FA, PATTERNS, GROUPS, EMPTY) + """SELECT (SELECT count(*) FROM fa) AS scanned,
            (SELECT count(*) FROM first_match) AS residual, (SELECT count(*) FROM grp) AS duplicate_groups,
            (SELECT count(*) FROM empty) AS empty_dirs""",
        "pattern_summary": _with(LOADED) + f"""SELECT count(*) AS patterns,
            count(*) FILTER (WHERE {_ON}) AS enabled FROM loaded""",
        "deletion_summary": _with(AUDIT) + """SELECT count(*) FILTER (WHERE kind IN ('deleted_file', 'deleted_dir'))
            AS deleted, count(*) FILTER (WHERE kind = 'failed') AS failed FROM audit""",
        "deletion_failures": _with(AUDIT) + "SELECT path, error FROM audit WHERE kind = 'failed'",
        "purge_rounds": _with(CASCADE) + """SELECT round, count(*) AS dirs,
            (SELECT count(*) FROM cascade) AS total_dirs,
            (SELECT CAST(max(round) + 1 AS BIGINT) FROM cascade) AS rounds_run FROM cascade GROUP BY round""",
        "device_profile": _with(FA) + """SELECT device, root, grouping_id(device, root) AS level, count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes
            FROM (SELECT device, '/' || device || '/' || lang AS root, size FROM fa) GROUP BY ROLLUP (device, root)""",
        "size_class_profile": _with(FA) + """SELECT CASE WHEN size < 256 THEN 'tiny' WHEN size < 1024 THEN 'small'
            WHEN size < 4096 THEN 'medium' WHEN size < 16384 THEN 'large' ELSE 'xxx-large' END AS size_class,
            count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes FROM fa GROUP BY 1""",
        "throughput": """SELECT strftime(date_trunc('minute', ts), '%Y-%m-%d %H:%M:%S') AS window_start,
            count(*) AS files, CAST(sum(CAST(floor(value * 1000) AS BIGINT)) AS BIGINT) AS bytes,
            count(*) / 60 AS files_per_sec,
            CAST(sum(CAST(floor(value * 1000) AS BIGINT)) AS BIGINT) / 60 AS bytes_per_sec FROM events GROUP BY 1""",
        "completion_estimate": _with(FA) + """,
            done AS (SELECT count(*) AS files, CAST(sum(CAST(floor(value * 1000) AS BIGINT)) AS BIGINT) AS bytes,
                count(DISTINCT date_trunc('minute', ts)) * 60 AS spent FROM events),
            job AS (SELECT 200 * count(*) AS files, CAST(20000 * sum(size) AS BIGINT) AS bytes FROM fa)
            SELECT done.files AS files_done, done.bytes AS bytes_done,
              greatest(greatest(job.files - done.files, 0) * spent / done.files,
                       greatest(job.bytes - done.bytes, 0) * spent / done.bytes) AS eta_seconds FROM done, job""",
        "job_gate": _with(FA) + """SELECT count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes,
            CASE WHEN count(*) > 25000000 THEN 'warn' ELSE 'ok' END AS files_flag,
            CASE WHEN sum(size) > 1000000 THEN 'warn' ELSE 'ok' END AS bytes_flag FROM fa""",
        "pattern_audit": _with(FA, PATTERNS) + """SELECT CAST(p.pid AS BIGINT) AS pid, File_Pattern, count(path) AS hits,
            count(path) / (SELECT count(*) FROM fa) AS share, count(path) = (SELECT count(*) FROM fa) AS matches_all,
            Safe_To_Delete = 'Yes' AS strict_preset FROM pattern_rows p LEFT JOIN fa ON name GLOB File_Pattern
            GROUP BY p.pid, File_Pattern, Safe_To_Delete""",
        # keep/delete plans and other ranked results
        "dup_plan": _dup_plan("ord = first_ord"),
        "dup_plan_keep_first": _dup_plan("ord = first_ord"),
        "dup_plan_keep_all": _dup_plan("true"),
        "dup_plan_keep_device": _dup_plan(
            "CASE WHEN hash IN (SELECT hash FROM fa WHERE device = 'src3') THEN device = 'src3' ELSE ord = first_ord END"),
        "dup_plan_keep_same_device": _dup_plan("device = first_device"),
        "dup_plan_keep_one_per_device": _dup_plan(
            "ord = (SELECT min(o.ord) FROM fa o WHERE o.hash = fa.hash AND o.device = fa.device)"),
        "dup_plan_manual": _with(FA, GROUPS) + """,
            chosen AS (SELECT fa.*, first_ord, CASE WHEN fa.size >= 3000 THEN ord = first_ord
                WHEN fa.size >= 1000 AND device = 'src3' THEN true ELSE false END AS keep FROM fa JOIN grp USING (hash))
            SELECT hash, substr(hash, 1, 16) AS hash_prefix, ord, path, device, size,
              CASE WHEN keep OR (ord = first_ord AND NOT bool_or(keep) OVER (PARTITION BY hash)) THEN 'KEEP'
                   ELSE 'DELETE' END AS action FROM chosen""",
        "retain_newest": _with(FA) + """SELECT device, path, CASE WHEN row_number() OVER
            (PARTITION BY device ORDER BY mtime DESC, path) <= 3 THEN 'KEEP' ELSE 'DELETE' END AS action FROM fa""",
        "size_batches": _with(FA) + """SELECT device, path, size, CAST((so_far - size) // 40000 + (nth - 1) // 20 AS BIGINT)
            AS batch FROM (SELECT *, sum(size) OVER w AS so_far, row_number() OVER w AS nth FROM fa
            WINDOW w AS (PARTITION BY device ORDER BY ord ROWS UNBOUNDED PRECEDING))""",
        "deletion_order": _with(FB) + """SELECT '/' || split_part(path, '/', 2) AS device, path, row_number() OVER
            (PARTITION BY split_part(path, '/', 2) ORDER BY depth DESC, path) AS seq FROM fb""",
        # set operations and reports
        "union_roots": _with(FB, ROOTS) + """SELECT path, min(root_idx) AS root_idx, entry_type FROM fb JOIN listed
            ON parent = root OR starts_with(parent, root || '/') GROUP BY path, entry_type""",
        "tree_report": _with(QUARANTINE) + """,
            state AS (SELECT quarantine_path AS path, depth,
              CASE WHEN path LIKE '%.org/%' THEN 'removed' ELSE 'quarantined' END AS status FROM plan)
            SELECT path, status, repeat('  ', depth - 1) || status || ': ' || substr(path, 2) AS line FROM state""",
        "affected_parents": _with(EMPTY) + "SELECT DISTINCT parent FROM empty",
        "unfinished": _with(AUDIT) + "SELECT path FROM audit WHERE kind NOT IN ('deleted_file', 'deleted_dir')",
        "scalar_functions": """SELECT doc_id, sha256(text) AS hash,
            CASE WHEN strlen(text) >= 1024 THEN printf('= %.1f KB', strlen(text) / 1024)
                 ELSE printf('= %d bytes', strlen(text)) END AS human,
            md5(regexp_replace(chr(9) || ' ' || chr(10) || text || ' ' || chr(13) || chr(10), '^\\s+|\\s+$', '', 'g')) AS stripped,
            regexp_replace(lang, '[a-z]+', '') = '' AS blank,
            strftime(TIMESTAMP '2024-01-01 00:00:00' + to_seconds(n_chars), '%Y-%m-%d %H:%M:%S') AS stamp FROM documents""",
        # similarity and arrival
        "near_duplicates": _with(FA, SIMILAR, _COMPONENTS, recursive=True) + """,
            family AS (SELECT id, min(least(id, other)) AS family FROM reach GROUP BY id),
            member AS (SELECT path, fa.hash, f.family FROM fa JOIN contents c USING (hash) JOIN family f USING (id))
            SELECT path, hash, family, (SELECT count(DISTINCT o.hash) FROM member o WHERE o.family = m.family) AS contents,
              (SELECT count(*) FROM member o WHERE o.family = m.family) AS files FROM member m""",
        "near_duplicate_vectors": _with(VECTORS, _COMPONENTS, recursive=True) + """,
            family AS (SELECT id, min(least(id, other)) AS family FROM reach GROUP BY id)
            SELECT id, family, count(*) OVER (PARTITION BY family) AS members FROM family""",
        "incremental_duplicates": _with(FA) + """SELECT hash, count(*) AS copies, count(*) - 1 AS redundant_files
            FROM fa GROUP BY hash HAVING count(*) > 1""",
    }
    sql["list_files_source"] = sql["list_files"]
    sql["incremental_duplicates_long"] = sql["incremental_duplicates"]
    return sql
