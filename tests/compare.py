"""Run registered queries beside their check SQL: ``python tests/compare.py SF_DIR [name …]``."""

from __future__ import annotations

import datetime
import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import duckdb  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def _cell(v):
    if isinstance(v, float):
        return "NaN" if math.isnan(v) else repr(v)
    if isinstance(v, (datetime.date, datetime.datetime)):
        return v.isoformat()
    return "NULL" if v is None else f"{type(v).__name__}:{v}"


def normal(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def compare(spark, con, name, run, sql, sf_dir):
    t0 = time.time()
    df = run(spark, sf_dir)
    ours = normal(df.columns, [tuple(r) for r in df.collect()])
    t1 = time.time()
    if sql is None:
        # only operators of the optional subpackage may be beyond SQL; their own tests hold them to other measures
        return not name.startswith("q_"), f"{len(ours[1])} rows, no check SQL", t1 - t0, 0.0
    cur = con.execute(sql)
    theirs = normal([d[0] for d in cur.description], cur.fetchall())
    t2 = time.time()
    if ours[0] != theirs[0]:
        return False, f"columns {ours[0]} / {theirs[0]}", t1 - t0, t2 - t1
    if ours[1] != theirs[1]:
        mine, other = set(ours[1]), set(theirs[1])
        return False, (
            f"rows {len(ours[1])} / {len(theirs[1])}; only ours {sorted(mine - other)[:3]}; only theirs {sorted(other - mine)[:3]}"
        ), t1 - t0, t2 - t1
    return True, f"{len(ours[1])} rows", t1 - t0, t2 - t1


def main(sf_dir, names):
    from gleaner.session import build_session
    import __spark_entry__ as entry

    spark = build_session(
        master="local[8]", **{"spark.sql.shuffle.partitions": 8, "spark.driver.memory": "8g", "spark.ui.enabled": "false",
                              "spark.ui.showConsoleProgress": "false", "spark.checkpoint.dir": "/tmp/checkpoints"}
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, sql = connect(sf_dir), entry.oracle_sql()
    failed = []
    for name, run in entry.queries().items():
        if names and name not in names:
            continue
        try:
            ok, note, spark_s, sql_s = compare(spark, con, name, run, sql.get(name), sf_dir)
        except Exception as e:
            ok, note, spark_s, sql_s = False, f"{type(e).__name__}: {str(e)[:600]}", 0, 0
        if not ok:
            failed.append(name)
        print(f"{'ok  ' if ok else 'FAIL'} {name:28s} spark {spark_s:6.2f}s sql {sql_s:5.2f}s  {note}", flush=True)
    print("failed:", failed)
    return not failed


if __name__ == "__main__":
    sys.exit(0 if main(sys.argv[1], sys.argv[2:]) else 1)
