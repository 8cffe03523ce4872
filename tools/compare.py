"""Run registered queries in Spark and their SQL in DuckDB and compare whole results.

usage: python tools/compare.py SF [name-prefix ...]
"""

from __future__ import annotations

import datetime
import decimal
import math
import os
import sys
import time

sys.path.insert(0, os.path.join(os.path.dirname(os.path.abspath(__file__)), ".."))

import duckdb

from sourcegrain.plans.registry import all_queries
from sourcegrain.session import build_session

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(round(value, 9) + 0.0)
    if isinstance(value, decimal.Decimal):
        return repr(round(float(value), 9))
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, (list, tuple)):
        return [cell(v) for v in value]
    if isinstance(value, bool) or value is None:
        return str(value)
    return str(value) if not isinstance(value, int) else repr(float(value)) if False else str(value)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), sorted((tuple(repr(cell(r[i])) for i in order) for r in rows))


def main() -> int:
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    wanted = sys.argv[2:]
    sf_dir = f"/root/testdata/sf{sf}"
    spark = build_session(master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
                                               "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    bad = []
    for name, q in all_queries().items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        started = time.time()
        try:
            df = q.run(spark, sf_dir)
            got_names, got = rows_of(df.columns, df.collect())
        except Exception as exc:  # noqa: BLE001
            bad.append(name)
            print(f"ERROR   {name}: {str(exc)[:1500]}", flush=True)
            continue
        took = time.time() - started
        if q.sql is None:
            print(f"rows    {name}: {len(got)} rows {took:.2f}s (no sql)", flush=True)
            continue
        started = time.time()
        try:
            cur = con.execute(q.sql)
            want_names, want = rows_of([d[0] for d in cur.description], cur.fetchall())
        except Exception as exc:  # noqa: BLE001
            bad.append(name)
            print(f"SQLERR  {name}: {str(exc)[:1500]}", flush=True)
            continue
        duck = time.time() - started
        if got_names != want_names or got != want:
            bad.append(name)
            print(f"DIFF    {name}: spark {len(got)} duck {len(want)} cols {got_names} vs {want_names}", flush=True)
            a, b = set(got) - set(want), set(want) - set(got)
            for r in sorted(a)[:3]:
                print("   spark", str(r)[:700])
            for r in sorted(b)[:3]:
                print("   duck ", str(r)[:700])
        else:
            note = "" if got else "  (EMPTY)"
            print(f"ok      {name}: {len(got)} rows spark {took:.2f}s duck {duck:.2f}s{note}", flush=True)
    print("FAILED:", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
