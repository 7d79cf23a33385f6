"""Compare registered queries with their SQL oracle: ``python check.py [sf_dir] [name prefix ...]``."""
from __future__ import annotations

import sys
import time

import duckdb
import pandas as pd
from pyspark.sql import SparkSession

from gapscope.catalog import load_registry

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def spark_session() -> SparkSession:
    spark = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
             .config("spark.driver.memory", "12g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
             .config("spark.sql.session.timeZone", "UTC")
             .config("spark.log.structuredLogging.enabled", "false").getOrCreate())
    spark.sparkContext.setLogLevel("OFF")
    return spark


def normal(rows: list[tuple], names: list[str]) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])

    def cell(v):
        if isinstance(v, float):
            return None if v != v else (0.0 if v == 0 else v)
        if isinstance(v, (list, tuple)):
            return tuple(cell(x) for x in v)
        return v
    return sorted((tuple(cell(r[i]) for i in order) for r in rows), key=repr)


def main(argv: list[str]) -> int:
    sf_dir = argv[0] if argv and argv[0].startswith("/") else "/root/testdata/sf0.01"
    wanted = [a for a in argv if not a.startswith("/")]
    spark = spark_session()
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    bad = 0
    for name, item in load_registry().items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        started = time.time()
        try:
            df = item.run(spark, sf_dir)
            got = [tuple(r) for r in df.collect()]
        except Exception as error:  # report and go on with the next query
            bad += 1
            print(f"FAIL {name}: spark {str(error)[:700]}", flush=True)
            continue
        spent = time.time() - started
        sql = item.oracle()
        if sql is None:
            print(f"rows {name}: {len(got)} rows, {spent:.1f}s, no oracle", flush=True)
            continue
        try:
            started = time.time()
            cur = con.execute(sql)
            names = [c[0] for c in cur.description]
            want = cur.fetchall()
            duck = time.time() - started
        except Exception as error:
            bad += 1
            print(f"FAIL {name}: duckdb {str(error)[:500]}", flush=True)
            continue
        if sorted(names) != sorted(df.columns):
            bad += 1
            print(f"FAIL {name}: columns {sorted(df.columns)} vs {sorted(names)}", flush=True)
            continue
        a, b = normal(got, df.columns), normal(want, names)
        if a == b:
            print(f"ok   {name}: {len(a)} rows, {spent:.1f}s (oracle {duck:.1f}s)" + ("  EMPTY" if not a else ""), flush=True)
        else:
            bad += 1
            diff = [(x, y) for x, y in zip(a, b) if x != y][:2]
            print(f"FAIL {name}: {len(a)} vs {len(b)} rows, {sum(x != y for x, y in zip(a, b))} differ, "
                  f"columns {sorted(names)}\n     {str(diff)[:900]}", flush=True)
    print("failures:", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
