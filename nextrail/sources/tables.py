"""Tables: write once, read back, stage, check keys."""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: the session's ``spark.checkpoint.dir``.

    A folder of our own is made only in local mode, where driver and executors are one machine.
    """
    context = spark.sparkContext
    folder = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="nextrail-")
        context.setCheckpointDir(folder)
    return folder


def own_folder(spark: SparkSession, kind: str) -> str:
    """A new folder in the shared folder, which is removed with all in it when the application ends."""
    path = f"{shared_folder(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    store.mkdirs(folder)
    store.deleteOnExit(folder)
    return path


def stage(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared folder and read from there, until the application ends.

    What follows survives lost executors without the work before it, reads only the columns it needs, and
    sees the same rows however often it reads them.
    """
    spark = df.sparkSession
    path = own_folder(spark, "stage") + "/rows"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def read_split(spark: SparkSession, path: str, flag: str) -> DataFrame:
    """Rows of one split; the flag is pushed into the scan, NULL flags are dropped."""
    return spark.read.parquet(path).where(F.col(flag))


def preview(df: DataFrame, rows: int = 5) -> DataFrame:
    return df.limit(rows)


def content_id(df: DataFrame) -> str:
    """The number of rows and the sum of their hashes, whatever their order: one pass, two numbers."""
    hashes = F.sum(F.xxhash64(*[F.col(f"`{c}`") for c in sorted(df.columns)]).cast("decimal(38,0)"))
    rows, total = df.agg(F.count(F.lit(1)), hashes).first()
    return f"{rows}:{total}"


def _stamp_of(spark: SparkSession, path: str) -> str | None:
    try:
        found = spark.read.json(path, schema="params STRING").first()
    except AnalysisException:
        return None
    return found["params"] if found else None


def materialize(
    spark: SparkSession,
    path: str,
    build: Callable[[], DataFrame],
    *,
    params: dict | None = None,
    overwrite: bool = False,
) -> DataFrame:
    """The table at ``path``; built and written only if it is absent or was built otherwise (A4, A5).

    The parameters are written beside the table after it is complete, so a table that a lost job left
    half-written, or one made with other parameters, is built again.
    """
    stamp_path = path.rstrip("/") + ".params"
    stamp = json.dumps(params or {}, sort_keys=True)
    if overwrite or _stamp_of(spark, stamp_path) != stamp:
        # The old stamp goes first: a job lost while writing must not leave a valid one behind.
        _write_stamp(spark, stamp_path, None)
        build().write.mode("overwrite").parquet(path)
        _write_stamp(spark, stamp_path, stamp)
    return spark.read.parquet(path)


def _write_stamp(spark: SparkSession, path: str, stamp: str | None) -> None:
    row = spark.range(1).select(F.lit(stamp or "").alias("params"))
    row.coalesce(1).write.mode("overwrite").json(path)


def assert_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``df`` itself; a job of its own, which raises if a key occurs twice. NULL keys never match in a join and are skipped."""
    known = df.select(*keys).dropna()
    repeated = known.groupBy(*keys).count().where("count > 1").limit(1).count()
    if repeated:
        raise ValueError(f"join key {list(keys)} is not unique")
    return df


def unique_in_plan(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``df`` itself; the job that reads it ends with an error if a key occurs twice (C8). NULL keys may.

    No job of its own: the rows of a key are counted by a window over the partitioning that a join on the key needs anyhow.
    """
    known = reduce(lambda a, b: a & b, (F.col(k).isNotNull() for k in keys))
    told = F.concat(F.lit(f"join key {list(keys)} is not unique: "), F.concat_ws(", ", *[F.col(k).cast("string") for k in keys]))
    counted = df.withColumn("_of_key", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    once = F.when(known & (F.col("_of_key") > 1), F.raise_error(told).cast("boolean")).otherwise(F.lit(True))
    return counted.where(once).drop("_of_key")


def require_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``df`` itself; raises if a column is missing."""
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df


def table_counts(df: DataFrame) -> DataFrame:
    """One row: number of rows and of columns."""
    return df.agg(F.count(F.lit(1)).alias("n_rows")).withColumn(
        "n_columns", F.lit(len(df.columns)).cast("bigint")
    )
