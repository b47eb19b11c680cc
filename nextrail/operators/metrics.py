"""Retrieval metrics of ranked lists."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nextrail.config import TOP_K

def _discounted(ranks: Column) -> Column:
    return F.aggregate(ranks, F.lit(0.0), lambda total, rank: total + 1 / F.log2(rank + 1.0))


def _sum_over_hits(ranks: Column, term) -> Column:
    """Sum of ``term(rank, number of the hit from 1)``."""
    terms = F.transform(ranks, lambda rank, i: term(rank, i + 1))
    return F.aggregate(terms, F.lit(0.0), lambda total, value: total + value)


@dataclass(frozen=True)
class Hits:
    """Per query the sorted ranks of its hits among the ``top_k``, and the number of its targets."""

    ranks: Column
    relevant: Column
    top_k: int

    @property
    def count(self) -> Column:
        return F.size(self.ranks)

    @property
    def misses(self) -> Column:
        return F.lit(self.top_k) - self.count

    @property
    def ideal(self) -> Column:
        return _discounted(F.sequence(F.lit(1), F.least(F.lit(self.top_k), self.relevant).cast("int")))

    @property
    def misses_below(self) -> Column:
        """The pairs of a hit and a miss that are in order."""
        return _sum_over_hits(self.ranks, lambda rank, nth: (self.top_k - rank) - (self.count - nth))

    @property
    def precisions(self) -> Column:
        return _sum_over_hits(self.ranks, lambda rank, nth: nth / rank)


# The names that results must have. NULL counts as 0.
METRICS: dict[str, Callable[[Hits], Column]] = {
    "retrieval_normalized_dcg": lambda q: _discounted(q.ranks) / q.ideal,
    "retrieval_average_precision": lambda q: F.when(q.count > 0, q.precisions / q.count),
    "retrieval_auroc": lambda q: F.when((q.count > 0) & (q.misses > 0), q.misses_below / (q.count * q.misses)),
    "retrieval_precision": lambda q: q.count / F.lit(q.top_k),
    "retrieval_recall": lambda q: q.count / q.relevant,
    "retrieval_hit_rate": lambda q: (q.count > 0).cast("double"),
    "retrieval_reciprocal_rank": lambda q: F.when(q.count > 0, 1 / q.ranks[0]),
}


def register_metric(name: str, value: Callable[[Hits], Column]) -> None:
    """Adds a metric to all results that follow."""
    METRICS[name] = value


def retrieval_metrics(recs: DataFrame, targets: DataFrame, top_k: int = TOP_K) -> DataFrame:
    """All metrics per query that has a target (M1-M7).

    ``recs``: query_id, item_id, rank; ``targets``: query_id, item_id. A list shorter than ``top_k`` counts
    as filled up with misses, and a query without a list scores zero. Targets meet the lists on
    (query, item); what is gathered per query are the ranks of its hits, at most ``top_k``.
    """
    wanted = targets.select("query_id", "item_id").dropna().distinct()
    ranked = recs.select("query_id", "item_id", "rank")
    matched = wanted.join(ranked, ["query_id", "item_id"], "left")
    rank = F.when(F.col("rank") <= top_k, F.col("rank").cast("int"))
    per_query = matched.groupBy("query_id").agg(
        F.sort_array(F.collect_list(rank)).alias("ranks"),
        F.count(F.lit(1)).alias("relevant"),
    )

    hits = Hits(F.col("ranks"), F.col("relevant"), top_k)
    return per_query.select(
        "query_id", *[F.coalesce(value(hits), F.lit(0.0)).alias(name) for name, value in METRICS.items()]
    )


def mean_metrics(per_query: DataFrame, *by: str) -> DataFrame:
    """The mean of each metric and the number of queries evaluated."""
    return per_query.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_queries"), *[F.avg(name).alias(name) for name in METRICS]
    )


def best_run(results: DataFrame, metric: str = "retrieval_normalized_dcg") -> DataFrame:
    """One row: the run with the highest value of the monitored metric, ties by name."""
    key = F.struct(F.col(metric), F.col("run_id"))
    return results.where(F.col(metric).isNotNull()).agg(
        F.max_by("run_id", key).alias("run_id"), F.max(metric).alias(metric)
    )
