"""Runs registered queries and their SQL side by side: python tests/compare.py SF_DIR [NAME ...]"""

from __future__ import annotations

import os
import sys
import time

import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir: str):
    import duckdb

    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p}{'/*.parquet' if os.path.isdir(p) else ''}'")
    return c


def canonical(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        df[c] = df[c].map(lambda x: None if x is None or x != x else round(float(x), 6) if isinstance(x, float) else str(x) if not isinstance(x, (bool, int, str)) and not hasattr(x, "item") else x.item() if hasattr(x, "item") else x)
        df[c] = df[c].map(lambda x: None if x is None or (isinstance(x, float) and x != x) else f"{x:.6f}" if isinstance(x, float) else str(x))
    return df.sort_values(list(df.columns), na_position="first").reset_index(drop=True)


def differences(spark_df: pd.DataFrame, sql_df: pd.DataFrame) -> str:
    if sorted(spark_df.columns) != sorted(sql_df.columns):
        return f"columns {sorted(spark_df.columns)} and {sorted(sql_df.columns)}"
    if len(spark_df) != len(sql_df):
        return f"rows {len(spark_df)} and {len(sql_df)}"
    a, b = canonical(spark_df), canonical(sql_df)
    for c in a.columns:
        other = ~((a[c] == b[c]) | (a[c].isna() & b[c].isna()))
        if other.any():
            return f"{c}: {int(other.sum())} differ, first {a[other].iloc[0].to_dict()} and {b[other].iloc[0].to_dict()}"
    return ""


def main() -> None:
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.driver.memory", "6g").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    queries, oracles, c = entry.queries(), entry.oracle_sql(), duck(sys.argv[1])
    for name, f in queries.items():
        if len(sys.argv) > 2 and name not in sys.argv[2:]:
            continue
        t = time.time()
        try:
            got = f(spark, sys.argv[1]).toPandas()
            took = time.time() - t
            said = differences(got, c.execute(oracles[name]).df()) if name in oracles else "no SQL"
            print(f"{name}: {len(got)} rows, {took:.1f} s, {said or 'equal'}", flush=True)
        except Exception as e:  # a report of all queries
            print(f"{name}: FAILED {type(e).__name__} {str(e)[:700]}", flush=True)


if __name__ == "__main__":
    main()
