"""Run queries and their SQL side by side: ``python tests/compare.py [--heavy ROWS] [query ...]``."""

from __future__ import annotations

import argparse
import os
import sys
import time

import duckdb
import pandas as pd
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
    "labels conversations"
).split()


def session(cores: int = 8, partitions: int = 8) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", partitions)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def database(folder: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    for name in TABLES:
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return db


def sorted_rows(df: pd.DataFrame) -> list[tuple]:
    columns = sorted(df.columns)
    rows = df[columns].astype(object).where(df[columns].notna(), None).itertuples(index=False, name=None)
    return sorted(rows, key=lambda row: [(value is None, str(value)) for value in row])


def difference(got: pd.DataFrame, want: pd.DataFrame) -> str | None:
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} != {sorted(want.columns)}"
    if len(got) != len(want):
        return f"{len(got)} rows != {len(want)}"
    for one, other in zip(sorted_rows(got), sorted_rows(want)):
        if one != other:
            return f"{sorted(got.columns)}\n  {one}\n  {other}"
    return None


def main() -> None:
    from nextrail.check_sql import CHECK_SQL
    from nextrail.operators import skew
    from nextrail.queries import QUERIES

    parser = argparse.ArgumentParser()
    parser.add_argument("--folder", default="/root/testdata/sf0.01")
    parser.add_argument("--heavy", type=int, help="rows from which a key counts as heavy")
    parser.add_argument("--partitions", type=int, default=8)
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    if args.heavy is not None:
        skew.MIN_HEAVY_ROWS = args.heavy
    folder, names = args.folder, args.names or list(QUERIES)
    spark, db = session(partitions=args.partitions), database(folder)
    bad = 0
    for name in names:
        start = time.time()
        try:
            got = QUERIES[name](spark, folder).toPandas()
            took = time.time() - start
            if name not in CHECK_SQL:
                print(f"rows {name}: {len(got)} {took:.1f}s", flush=True)
                continue
            start = time.time()
            want = db.execute(CHECK_SQL[name]).df()
            problem = difference(got, want)
        except Exception as error:  # noqa: BLE001
            took, problem = time.time() - start, str(error)[:1500]
        bad += problem is not None
        print(f"{'BAD ' if problem else 'ok  '} {name} {took:.1f}s sql {time.time() - start:.1f}s {problem or len(got)}", flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main()
