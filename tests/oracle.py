"""Run queries and their SQL side by side: python -m tests.oracle [sf_dir] [name ...]."""

from __future__ import annotations

import glob
import math
import os
import sys
import tempfile
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def _cell(value, digits=None):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "null"
    if isinstance(value, float) and digits:
        return f"{value + 0.0:.{digits}g}"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, float):
        return repr(value + 0.0)
    return str(value)


def _rows(names, rows, digits=None):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(_cell(r[i], digits) for i in order) for r in rows)


def compare(spark, con, fn, sql, sf_dir) -> str:
    """Empty when both sides agree in columns, type kinds, row count and every value."""
    df = fn(spark, sf_dir)
    mine = [tuple(r) for r in df.collect()]
    if sql is None:     # the operator has tests of its own; here a second run must give the same rows
        again = fn(spark, sf_dir)
        if not mine or again.columns != df.columns:
            return f"{len(mine)} rows, columns {df.columns}, then {again.columns}"
        a, b = (_rows(df.columns, rows, 9) for rows in (mine, [tuple(r) for r in again.collect()]))
        return "" if a == b else f"a second run differs: {[(x, y) for x, y in zip(a, b) if x != y][:3]}"
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    theirs = cur.fetchall()
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    a, b = _rows(df.columns, mine), _rows(names, theirs)
    if len(a) != len(b):
        return f"rows {len(a)} != {len(b)}; only spark {[x for x in a if x not in set(b)][:3]}; only sql {[x for x in b if x not in set(a)][:3]}"
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    return f"{len(bad)} of {len(a)} rows differ: {bad[:3]}" if bad else ""


def main() -> None:
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as entry
    from tarnwatch import build_session
    from tarnwatch.plans.freeze import discard_frozen

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    spark = build_session(master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "16g",
                                                 "spark.checkpoint.dir": os.path.join(tempfile.gettempdir(), "tarnwatch-oracle")})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    sqls, failed = entry.oracle_sql(), 0
    for name, fn in entry.queries().items():
        if wanted and not any(w in name for w in wanted):
            continue
        start = time.time()
        try:
            problem = compare(spark, con, fn, sqls.get(name), sf_dir)
        except Exception as error:  # report and go on
            problem = f"{type(error).__name__}: {str(error)[:1500]}"
        failed += bool(problem)
        kind = "sql " if name in sqls else "rows"
        print(f"{'FAIL' if problem else 'ok  '} {kind} {time.time() - start:6.2f}s {name} {problem}", flush=True)
    print(f"failed: {failed}")
    discard_frozen(spark)


if __name__ == "__main__":
    main()
