"""Run a registered query and its SQL side by side and compare every row.

    python -m tests.oracle /root/testdata/sf0.01 [name ...]
"""

from __future__ import annotations

import glob
import math
import os
import sys
import time
import traceback
from collections import Counter
from datetime import datetime

import duckdb

KINDS = {
    "tinyint": "TINYINT", "smallint": "SMALLINT", "int": "INTEGER", "bigint": "BIGINT", "float": "FLOAT",
    "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "date": "DATE",
    "timestamp": "TIMESTAMP", "timestamp_ntz": "TIMESTAMP", "binary": "BLOB",
}


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in sorted(glob.glob(f"{sf_dir}/*.parquet")):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def _cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value + 0.0
    if isinstance(value, datetime):
        return value.replace(tzinfo=None)
    if isinstance(value, list):
        return tuple(_cell(v) for v in value)
    return value


def compare(df, con, sql: str) -> list[str]:
    """Differences between a Spark result and a SQL result; empty when they agree."""
    res = con.execute(sql)
    theirs_cols = [d[0] for d in res.description]
    theirs_types = dict(zip(theirs_cols, [str(d[1]) for d in res.description]))
    theirs_rows = res.fetchall()
    ours_cols = df.columns
    if sorted(ours_cols) != sorted(theirs_cols):
        return [f"columns {sorted(ours_cols)} != {sorted(theirs_cols)}"]
    problems = []
    for name, kind in df.dtypes:
        if KINDS.get(kind, kind.upper()) != theirs_types[name]:
            problems.append(f"type of {name}: {kind} != {theirs_types[name]}")
    order = sorted(ours_cols)
    pick = [theirs_cols.index(c) for c in order]
    ours = Counter(tuple(_cell(row[c]) for c in order) for row in df.collect())
    theirs = Counter(tuple(_cell(row[i]) for i in pick) for row in theirs_rows)
    if ours != theirs:
        extra, missing = ours - theirs, theirs - ours
        problems.append(
            f"rows {sum(ours.values())} vs {sum(theirs.values())}; only ours {list(extra.items())[:3]}; "
            f"only SQL {list(missing.items())[:3]} of {order}"
        )
    elif not ours:
        problems.append("no rows")
    return problems


def main() -> int:
    from __spark_entry__ import oracle_sql, queries
    from fathomry.session import build_session

    spark = build_session(
        master="local[8]",
        **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    sf_dir = sys.argv[1]
    con, sqls, bad = connect(sf_dir), oracle_sql(), 0
    for name, run in queries().items():
        if len(sys.argv) > 2 and not any(name.startswith(p) for p in sys.argv[2:]):
            continue
        begin = time.time()
        try:
            df = run(spark, sf_dir)
            problems = compare(df, con, sqls[name]) if name in sqls else ([] if df.count() else ["no rows"])
        except Exception as error:  # report and go on with the next query
            if os.environ.get("TRACE"):
                traceback.print_exc()
            problems = [f"{type(error).__name__}: {str(error)[:600]}"]
        bad += bool(problems)
        print(f"{'BAD' if problems else 'ok '} {name:42s} {time.time() - begin:6.2f}s {'' if name in sqls else '(rows only)'}", flush=True)
        for p in problems:
            print("     ", p[:1500], flush=True)
    print("failed:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(main())
