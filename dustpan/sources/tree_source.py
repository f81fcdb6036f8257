"""Directory trees as a Spark data source: ``spark.read.format("tree")``.

    register(spark)
    spark.read.format("tree").option("roots", json.dumps(["/data/a", "/data/b"])).load()

gives the rows of ``list_entries``.  Planning looks only as far into the trees
as it needs to find enough folders to hand out: from the roots down, level by
level, until a level has ``splits`` folders (option, 256 unless given) or
``ahead`` folders were looked into (10,000).  A tree that hangs on one long
branch is therefore cut where it widens.  Each partition lists some whole
subtrees; folders passed on the way are listed flat.

Filters on entry_type, name, size, depth, path, parent and root_idx are tested
before a row leaves its task; a filter on root_idx also leaves out whole roots.
``list_entries`` deals out again what turns out too large for a task, and is
the better way where a few unevenly deep trees hold nearly everything.
"""

from __future__ import annotations

import json
import operator
import os
from collections import deque
from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as ds

from dustpan.sources import lister

SCHEMA = ("root_idx int, path string, parent string, name string, depth int, entry_type string, link_target string, "
          "size bigint, mtime timestamp_ntz, created timestamp_ntz, error string")
_COLUMNS = [part.split()[0] for part in SCHEMA.split(", ")]
SPLITS, AHEAD = 256, 10_000
_PUSHED = ("entry_type", "name", "size", "depth", "path", "parent", "root_idx")

_COMPARE: dict[type, Callable] = {
    ds.EqualTo: operator.eq, ds.GreaterThan: operator.gt, ds.GreaterThanOrEqual: operator.ge, ds.LessThan: operator.lt,
    ds.LessThanOrEqual: operator.le, ds.StringStartsWith: str.startswith, ds.StringEndsWith: str.endswith,
    ds.StringContains: operator.contains, ds.In: lambda value, among: value in among}


def _test(wanted: ds.Filter) -> tuple[str, Callable] | None:
    """(column, test of a value) of a filter this source can apply, else None; a null passes no test."""
    column = getattr(wanted, "attribute", (None,))
    if len(column) != 1 or column[0] not in _PUSHED:
        return None
    if isinstance(wanted, ds.IsNotNull):
        return column[0], lambda value: value is not None
    compare = _COMPARE.get(type(wanted))
    return compare and (column[0], lambda value: value is not None and compare(value, wanted.value))


class Subtrees(ds.InputPartition):
    """Folders (root_idx, path, whether it is a root) to list, with all that is below them or flat."""

    def __init__(self, folders: list[tuple[int, str, bool]], deep: bool):
        super().__init__((folders, deep))
        self.folders, self.deep = folders, deep


class TreeReader(ds.DataSourceReader):
    def __init__(self, options: dict):
        self.roots = [(n, root) for n, root in enumerate(json.loads(options["roots"]))]
        self.splits, self.ahead = int(options.get("splits", SPLITS)), int(options.get("ahead", AHEAD))
        self.tests: list[tuple[str, Callable]] = []

    def pushFilters(self, filters: list[ds.Filter]) -> Iterable[ds.Filter]:  # noqa: N802
        for wanted in filters:
            test = _test(wanted)
            if test:
                self.tests.append(test)
            else:
                yield wanted

    def partitions(self) -> list[Subtrees]:
        tests = [test for column, test in self.tests if column == "root_idx"]
        level = [(n, root, True) for n, root in self.roots if all(test(n) for test in tests)]
        passed: list[tuple[int, str, bool]] = []
        while level and len(level) < self.splits and len(passed) + len(level) <= self.ahead:
            below = [(n, entry, False) for n, path, _ in level for entry in _folders(path)]
            passed += level
            level = below
        cut = lambda folders: [folders[k::self.splits] for k in range(min(self.splits, len(folders)))]
        return [Subtrees(part, False) for part in cut(passed)] + [Subtrees(part, True) for part in cut(level)]

    def read(self, partition: Subtrees) -> Iterator[tuple]:
        todo = deque(partition.folders)
        while todo:
            root_idx, path, is_root = todo.pop()
            try:
                path.encode("utf-8")
            except UnicodeEncodeError:
                yield from self._kept(lister._row(root_idx, path, "dir"))
                continue
            for row, below in lister._visit(root_idx, path, is_root):
                if row is not None:
                    yield from self._kept(row)
                elif partition.deep:
                    todo.append((root_idx, below, False))

    def _kept(self, row: tuple) -> Iterator[tuple]:
        row = lister._readable(row)
        path = row[1]
        parent, _, name = path.rpartition("/")
        whole = (row[0], path, parent, name, path.count("/"), *row[2:])
        cells = dict(zip(_COLUMNS, whole, strict=True))
        if all(test(cells[column]) for column, test in self.tests):
            yield whole


def _folders(path: str) -> list[str]:
    """Folders in a folder; one that cannot be read is reported when it is listed."""
    try:
        with os.scandir(path) as entries:
            return sorted(entry.path for entry in entries if entry.is_dir(follow_symlinks=False))
    except (OSError, UnicodeEncodeError):
        return []


class TreeSource(ds.DataSource):
    @classmethod
    def name(cls) -> str:
        return "tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TreeReader:
        return TreeReader(self.options)


def register(spark: SparkSession) -> None:
    """Make the format known to a session and let it hand over filters."""
    spark.dataSource.register(TreeSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def read_tree(spark: SparkSession, paths: list[str], **options) -> DataFrame:
    """Everything below the paths, which are left out themselves; ``root_idx`` is a path's place in the list.

    Unless ``splits`` is given, there are four subtrees for each of the session's cores.
    """
    register(spark)
    given = {"splits": 4 * spark.sparkContext.defaultParallelism, **options}
    return spark.read.format("tree").options(roots=json.dumps(paths), **given).load()
