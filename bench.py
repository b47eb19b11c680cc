"""Time the headline jobs on one machine and print one JSON line."""

from __future__ import annotations

import json
import os
import tempfile
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nextrail import queries as q
from nextrail.operators import encode, search
from nextrail.plans.prepare import prepare
from nextrail.sources import warehouse as wh
from nextrail.sources.tables import stage


def prepare_tables(spark: SparkSession, d: str) -> DataFrame:
    """Split, join and write events, items and users of the order log."""
    prepared = prepare(
        wh.order_log(spark, d),
        wh.part_items(spark, d),
        wh.customer_users(spark, d),
        tempfile.mkdtemp(prefix="nextrail-bench-"),
    )
    return prepared.users


def exact_top20(spark: SparkSession, d: str) -> DataFrame:
    """Top 20 of all item vectors for every customer."""
    log = q.Log(spark, d, "orders")
    items = stage(log.vectors)
    encoded = encode.encode_histories(log.histories(), items)
    return search.search(stage(encoded), items, metric="dot")


JOBS = {
    "prepare_tables": prepare_tables,
    "exact_top20": exact_top20,
    "knn_exact_cosine": q.QUERIES["knn_exact_cosine"],
    "knn_probe8": q.QUERIES["knn_probe8"],
    "recommend_history": q.QUERIES["recommend_history_orders"],
    "user_metrics": q.QUERIES["user_metrics_orders"],
    "sample_negatives": q.QUERIES["sample_negatives_orders"],
    "padded_batches": q.QUERIES["padded_batches"],
    "scored_losses": q.QUERIES["scored_losses"],
    "prefix_mean": q.QUERIES["prefix_mean"],
}


def recall_at_20(spark: SparkSession, d: str) -> float:
    """Share of the exact neighbours that the probing query finds."""
    keys = ["query_id", "item_id"]
    exact = q.QUERIES["knn_exact_cosine"](spark, d).select(*keys)
    near = q.QUERIES["knn_probe8"](spark, d).select(*keys).withColumn("hit", F.lit(1))
    found = exact.join(near, keys, "left")
    return found.agg(F.avg(F.coalesce("hit", F.lit(0)))).first()[0]


def main() -> None:
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        # The tables are small here: let shuffles and scans keep all cores busy.
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
        .config("spark.sql.files.openCostInBytes", "64k")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()

    seconds = {}
    for name, job in JOBS.items():
        start = time.perf_counter()
        job(spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "headline_jobs_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "recall_at_20_probing": round(recall_at_20(spark, folder), 4),
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
