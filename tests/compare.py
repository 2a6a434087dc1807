"""Run registered queries and their SQL side by side and report differences.

Usage: python tests/compare.py [sf_dir] [query ...]
"""

import os
import sys
import time

import duckdb
import pandas as pd

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def tidy(frame):
    frame = frame[sorted(frame.columns)]
    for c in frame.columns:
        if frame[c].dtype == object or str(frame[c].dtype).startswith("str"):
            frame[c] = frame[c].astype(object).where(frame[c].notna(), None)
    keys = frame.apply(lambda s: s.map(lambda v: "" if v is None or v != v else repr(v)) if s.dtype == object else s)
    return frame.loc[keys.sort_values(list(keys.columns)).index].reset_index(drop=True)


def difference(spark_df, con, sql):
    """None when both results hold the same rows, else a description."""
    ours = spark_df.toPandas()
    theirs = con.execute(sql).df()
    if sorted(ours.columns) != sorted(theirs.columns):
        return f"columns {sorted(ours.columns)} and {sorted(theirs.columns)}"
    if len(ours) != len(theirs):
        return f"{len(ours)} and {len(theirs)} rows"
    if not len(ours):
        return "no rows"
    ours, theirs = tidy(ours), tidy(theirs)
    types = {c: (str(ours[c].dtype), str(theirs[c].dtype)) for c in ours if str(ours[c].dtype) != str(theirs[c].dtype)}
    for c in ours:
        a, b = ours[c], theirs[c]
        same = (a == b) | (a.isna() & b.isna())
        if not same.all():
            i = same.idxmin()
            return f"{(~same).sum()} of {len(a)} differ in {c}; row {i}:\n{ours.loc[i].to_dict()}\n{theirs.loc[i].to_dict()}"
    return f"types {types}" if types else None


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    import __spark_entry__ as e

    pd.set_option("mode.copy_on_write", True)
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    con, oracle, bad = connect(sf), e.oracle_sql(), 0
    for name, query in e.queries().items():
        if sys.argv[2:] and name not in sys.argv[2:]:
            continue
        start = time.time()
        try:
            df = query(session, sf)
            found = difference(df, con, oracle[name]) if name in oracle else f"no SQL, {df.count()} rows"
        except Exception as error:
            found = f"{type(error).__name__}: {str(error)[:600]}"
        bad += found is not None and name in oracle
        print(f"{name:34s} {time.time() - start:6.2f}s {found or 'same'}", flush=True)
    print("different:", bad)
