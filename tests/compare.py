"""Run registered queries next to their SQL and compare the rows.

    python -m tests.compare [sf_dir] [name ...]
"""

from __future__ import annotations

import math
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        if Path(f"{sf_dir}/{name}.parquet").exists():
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _cell(value):
    if isinstance(value, float):
        return None if math.isnan(value) else value
    return value


def bag(columns, rows) -> tuple[list[str], Counter]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], Counter(tuple(_cell(r[i]) for i in order) for r in rows)


def spark_bag(df):
    return bag(df.columns, [tuple(r) for r in df.collect()])


def sql_bag(con, sql):
    cursor = con.execute(sql)
    return bag([d[0] for d in cursor.description], cursor.fetchall())


def main() -> int:
    import __spark_entry__ as entry
    from dustpan.session import local_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:] or list(entry.queries())
    spark, con, bad = local_session(), connect(sf_dir), 0
    for name in wanted:
        start, took = time.time(), 0.0
        try:
            columns, rows = spark_bag(entry.queries()[name](spark, sf_dir))
            took, start = time.time() - start, time.time()
            sql_columns, sql_rows = sql_bag(con, entry.oracle_sql()[name])
            same = columns == sql_columns and rows == sql_rows
            note = f"rows {sum(rows.values())} vs {sum(sql_rows.values())}"
            if not same:
                note += f" {columns} {sql_columns} spark-only {list((rows - sql_rows))[:3]} sql-only {list((sql_rows - rows))[:3]}"
        except Exception as err:  # report and go on with the next query
            same, note = False, f"{type(err).__name__}: {str(err)[:600]}"
        bad += not same
        print(f"{'ok ' if same else 'BAD'} {name} {took:.2f}s/{time.time() - start:.2f}s {note}", flush=True)
    print(f"{len(wanted) - bad} of {len(wanted)} equal")
    return bad


if __name__ == "__main__":
    sys.exit(main())
