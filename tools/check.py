"""Run registered queries against DuckDB on one scale: ``python tools/check.py [sf] [name ...]``."""

from __future__ import annotations

import math
import sys
import time
import traceback
from pathlib import Path

import duckdb

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))

from discloscope.session import build_session  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def local_session():
    return build_session("check", "local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "12g",
        "spark.ui.showConsoleProgress": "false"})


def duck(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


SPARK_RUN: list[float] = []


def normal(v):
    if isinstance(v, float):
        return "NaN" if math.isnan(v) else repr(v)
    if isinstance(v, bool) or v is None:
        return str(v)
    return f"{type(v).__name__}:{v}"


def compare(df, con, sql):
    cols = df.columns
    t0 = time.time()
    mine = df.collect()
    SPARK_RUN.append(time.time() - t0)
    res = con.execute(sql)
    names = [d[0] for d in res.description]
    other = res.fetchall()
    if sorted(names) != sorted(cols):
        return f"columns differ: spark-only {set(cols) - set(names)} sql-only {set(names) - set(cols)}"
    order = sorted(cols)
    a = sorted(tuple(normal(r[c]) for c in order) for r in mine)
    pos = [names.index(c) for c in order]
    b = sorted(tuple(normal(r[i]) for i in pos) for r in other)
    if len(a) != len(b):
        return f"rows {len(a)} vs {len(b)}"
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        x, y = bad[0]
        return f"{len(bad)}/{len(a)} rows differ: " + str([(c, p, q) for c, p, q in zip(order, x, y) if p != q][:4]) + f" key={x[:3]}"
    return f"ok {len(a)} rows"


def main() -> int:
    from discloscope.plans.catalog import QUERIES
    args = sys.argv[1:]
    sf = args[0] if args else "0.01"
    wanted = args[1:]
    sf_dir = f"/root/testdata/sf{sf}"
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    failed = 0
    for name, q in QUERIES.items():
        if wanted and name not in wanted:
            continue
        start = time.time()
        try:
            df = q.run(spark, sf_dir)
            built = time.time() - start
            SPARK_RUN.clear()
            note = compare(df, con, q.sql) if q.sql else f"ok (no SQL) {len(df.collect())} rows"
        except Exception as e:  # report and go on with the next query
            note = f"ERROR {type(e).__name__}: {str(e)[:600]}"
            if wanted:
                traceback.print_exc(limit=4)
        if not note.startswith("ok"):
            failed += 1
        spark_s = built + sum(SPARK_RUN) if SPARK_RUN else 0.0
        print(f"{name:28s} spark {spark_s:6.2f}s total {time.time() - start:6.2f}s {note}", flush=True)
    print("failed", failed)
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
