"""Recommend for the held-out users and measure against what they did next (M8)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nextrail.config import TOP_K, EncoderConfig
from nextrail.operators.activity import place_activities
from nextrail.operators.encode import encode_runs
from nextrail.operators.metrics import mean_metrics, retrieval_metrics
from nextrail.operators.pruned import ClusterIndex, nearest
from nextrail.operators.recommend import nearest_to_histories
from nextrail.sources.tables import stage


def histories_of(placed: DataFrame) -> DataFrame:
    return placed.where("part = 'history'").select(
        F.col("user_id").alias("query_id"), "pos", "item_id"
    )


def held_out_users(events: DataFrame, heavy: Sequence | None = None) -> DataFrame:
    """Ids and places of all events of the users with held-out ones, written once; everything below reads this."""
    placed = place_activities(events.drop("item_text", "user_text"), keep=["is_val"], heavy=heavy)
    return stage(
        placed.where("n_target > 0").select("user_id", "part", "pos", "item_id", "label", "is_val")
    )


def evaluate_users(mine: DataFrame, items: DataFrame, *, top_k: int = TOP_K, **options) -> DataFrame:
    """Stage and metrics per user of ``held_out_users``; options go to ``nearest_to_histories``."""
    held_out = mine.where("part = 'target'").withColumnRenamed("user_id", "query_id")
    found = nearest_to_histories(histories_of(mine), items, top_k=top_k, **options)
    scores = retrieval_metrics(found, held_out.where("label"), top_k)
    stages = held_out.groupBy("query_id").agg(
        F.when(F.bool_or("is_val"), "val").otherwise("test").alias("stage")
    )
    return scores.join(stages, "query_id")


def evaluate_runs(
    mine: DataFrame,
    items: DataFrame,
    runs: dict[str, EncoderConfig],
    *,
    top_k: int = TOP_K,
    metric: str = "cosine",
    index: ClusterIndex | None = None,
) -> DataFrame:
    """The rows of ``evaluate_users`` with ``run_id``, for all runs by one search: the items are met once.

    A query's id in that search is its run's number and its own id.
    """
    number = {run: str(i) for i, run in enumerate(runs)}
    named = F.create_map(*[F.lit(x) for run, i in number.items() for x in (i, run)])
    histories = histories_of(mine)
    encoded = encode_runs(histories, items, runs)
    of_run = F.create_map(*[F.lit(x) for run, i in number.items() for x in (run, i)])
    asked = encoded.select(F.concat_ws(":", of_run[F.col("run_id")], "query_id").alias("query_id"), "embedding")

    def for_all(rows: DataFrame, id_col: str, *columns: str) -> DataFrame:
        every = F.explode(F.array(*[F.lit(i) for i in number.values()]))
        numbered = rows.select(every.alias("_run"), F.col(id_col).alias("_id"), *columns)
        return numbered.select(F.concat_ws(":", "_run", "_id").alias("query_id"), *columns)

    seen = for_all(histories, "query_id", "item_id")
    found = nearest(stage(asked), items, exclude=seen, top_k=top_k, metric=metric, index=index)
    held_out = mine.where("part = 'target'")
    scores = retrieval_metrics(found, for_all(held_out.where("label"), "user_id", "item_id"), top_k)
    stages = held_out.groupBy(F.col("user_id").alias("query_id")).agg(
        F.when(F.bool_or("is_val"), "val").otherwise("test").alias("stage")
    )
    run, own = F.substring_index("query_id", ":", 1), F.expr("substring(query_id, instr(query_id, ':') + 1)")
    scores = scores.withColumn("run_id", named[run]).withColumn("query_id", own)
    return scores.join(stages, "query_id")


def evaluate(
    events: DataFrame, items: DataFrame, *, heavy: Sequence | None = None, **options
) -> DataFrame:
    """Per user with held-out events its stage (val or test) and all metrics (M8).

    ``events``: the split log; ``items``: item_id, embedding; ``heavy``: heavy users of the log, if known. The
    whole history is excluded; targets are the distinct held-out items with a positive label.
    """
    return evaluate_users(held_out_users(events, heavy), items, **options)


def evaluate_mean(events: DataFrame, items: DataFrame, **options) -> DataFrame:
    """One row per stage: number of users and the mean of each metric."""
    return mean_metrics(evaluate(events, items, **options), "stage")
