"""Run registered queries next to their SQL and compare sorted rows.

Usage: python tests/compare.py SF_DIR [name ...]
"""
import math
import os
import sys
import time

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def _plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def sql_rows(sf_dir, sql):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    return sorted(names), rows_of(names, cur.fetchall())


def spark_rows(spark, sf_dir, fn):
    df = fn(spark, sf_dir)
    return sorted(df.columns), rows_of(df.columns, [tuple(r) for r in df.collect()])


def session():
    from pyspark.sql import SparkSession
    spark = (SparkSession.builder.master("local[8]").appName("secframe-tests")
             .config("spark.driver.memory", "8g").config("spark.sql.shuffle.partitions", "8")
             .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
             .config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main(argv):
    from secframe.catalog import QUERIES, SQL
    sf_dir, names = argv[0], argv[1:]
    spark = session()
    bad = 0
    for name in names or QUERIES:
        t = time.time()
        try:
            cols, got = spark_rows(spark, sf_dir, QUERIES[name])
            took = time.time() - t
            if name not in SQL:
                print(f"rows-only {name:32s} {len(got):6d} rows {took:6.2f}s", flush=True)
                continue
            want_cols, want = sql_rows(sf_dir, SQL[name])
            ok = cols == want_cols and got == want
            bad += not ok
            print(f"{'ok  ' if ok else 'DIFF'}      {name:32s} {len(got):6d} rows {took:6.2f}s", flush=True)
            if not ok:
                print("   columns", cols, want_cols)
                print("   only spark:", [r for r in got if r not in set(want)][:3])
                print("   only sql:  ", [r for r in want if r not in set(got)][:3], len(want), flush=True)
        except Exception as exc:
            bad += 1
            print(f"FAIL      {name}: {type(exc).__name__} {str(exc)[:600]}", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
