"""Ranking losses of a table of scored candidates, as plain aggregates.

Input ``scored``: one row per query and candidate with ``batch_id``, ``query_id`` (unique over all batches),
``cand_id``, ``is_target`` and one column of logits per kind used. Losses are summed per batch. A query's
candidates are never gathered: its target logit comes back by a join, all else is a partial aggregate.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nextrail.config import LossConfig
from nextrail.functions.text import safe_ratio
from nextrail.operators.skew import join_lookup


@dataclass(frozen=True)
class Terms:
    """What a loss is made of: columns of a candidate row, and the mean over the valid negatives of its query."""

    logit: Column
    target: Column
    negative: Column
    shift: Column
    config: LossConfig

    def over_negatives(self, value: Column) -> Column:
        total = F.coalesce(F.sum(F.when(self.negative, value)), F.lit(0.0))
        return safe_ratio(total, F.count_if(self.negative))

    @property
    def log_sum_exp(self) -> Column:
        """Of target and valid negatives, scaled."""
        return F.log(F.sum(F.exp(self.exponent - self.shift))) + F.max(self.shift)

    @property
    def exponent(self) -> Column:
        counted = self.negative | F.col("is_target")
        return F.when(counted, self.config.scale * self.logit)

    @property
    def beyond(self) -> Column:
        return self.logit - self.target * (1 - self.config.margin)


@dataclass(frozen=True)
class Loss:
    """``kind`` of logit it is computed on, and its value per query, an aggregate of the candidate rows."""

    kind: str
    value: Callable[[Terms], Column]


def alignment(q: Terms) -> Column:
    return F.max(1 - q.target)


def contrastive(q: Terms) -> Column:
    return q.over_negatives(relu(q.logit - 1 + q.config.margin))


# The names that results must have.
LOSSES: dict[str, Loss] = {
    "AlignmentLoss": Loss("cosine", alignment),
    "AlignmentContrastiveLoss": Loss("cosine", lambda q: alignment(q) + contrastive(q)),
    "ContrastiveLoss": Loss("cosine", contrastive),
    "InfoNCELoss": Loss("dot", lambda q: q.log_sum_exp - q.config.scale * F.max(q.target)),
    "NCELoss": Loss("dot", lambda q: F.max(softplus(-q.target)) + q.over_negatives(softplus(q.logit))),
    "PairwiseHingeLoss": Loss("dot", lambda q: q.over_negatives(relu(q.beyond))),
    "PairwiseLogisticLoss": Loss("dot", lambda q: q.over_negatives(softplus(q.beyond))),
}


def register_loss(name: str, kind: str, value: Callable[[Terms], Column]) -> None:
    """Adds a loss to all results that follow."""
    LOSSES[name] = Loss(kind, value)


def mark_target(candidates: DataFrame, config: LossConfig = LossConfig(), target_col: str | None = None) -> DataFrame:
    """``is_target`` from the candidate's ``slot`` (L1).

    ``first``: slot 0; ``diagonal``: the slot equal to the query's ``row`` in its batch; otherwise the slot
    that ``target_col`` names.
    """
    if (target_col is None) == (config.target_position is None):
        raise ValueError("give either target_col or config.target_position")
    if target_col is not None:
        target = F.col(target_col)
    elif config.target_position == "first":
        target = F.lit(0)
    else:
        target = F.col("row")
    return candidates.withColumn("is_target", F.col("slot") == target)


def softplus(x: Column) -> Column:
    """log(1 + exp(x)) without overflow."""
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def relu(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0))


def valid_negatives(
    scored: DataFrame,
    config: LossConfig = LossConfig(),
    logit: str = "dot",
) -> DataFrame:
    """The rows with ``logit``, their query's ``target_logit``, and ``is_negative`` (L2, L3).

    With masking on, a candidate that scores at least as high as the target is no negative. Hard negatives
    are the highest of the valid ones, ties by ``cand_id``.
    """
    rows = scored.withColumn("logit", F.col(logit).cast("double"))
    targets = rows.groupBy("query_id").agg(
        F.max(F.when(F.col("is_target"), F.col("logit"))).alias("target_logit")
    )
    rows = join_lookup(rows, targets, "query_id", "inner")
    if config.mask_false_negatives:
        negative = F.col("logit") < F.col("target_logit")
    else:
        negative = ~F.col("is_target")
    rows = rows.withColumn("is_negative", negative)
    if config.num_hard_negatives > 0:
        rows = _hardest(rows, config.num_hard_negatives)
    return rows


def _hardest(rows: DataFrame, count: int) -> DataFrame:
    """Keeps ``is_negative`` on the ``count`` highest negatives of each query, whose ``cand_id`` differ.

    The group limit finds each query's last one before the shuffle; its place then decides for all rows.
    """
    order = Window.partitionBy("query_id").orderBy(F.desc("logit"), "cand_id")
    negatives = rows.where("is_negative").select("query_id", "logit", "cand_id")
    hard = negatives.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= count)
    last = hard.groupBy("query_id").agg(
        F.max_by(F.struct("logit", "cand_id"), "nth").alias("last")
    )
    placed = join_lookup(rows, last, "query_id", "left")
    above = F.col("logit") > F.col("last.logit")
    level = (F.col("logit") == F.col("last.logit")) & (F.col("cand_id") <= F.col("last.cand_id"))
    kept = F.col("is_negative") & F.coalesce(above | level, F.lit(False))
    return placed.withColumn("is_negative", kept).drop("last")


def query_losses(
    scored: DataFrame,
    config: LossConfig = LossConfig(),
    logit: str = "dot",
) -> DataFrame:
    """All losses per query on one kind of logit."""
    rows = valid_negatives(scored, config, logit)
    x, t, negative = F.col("logit"), F.col("target_logit"), F.col("is_negative")
    # The shift is the largest exponent that is summed; with masking on that is the target's.
    shift = config.scale * t
    if not config.mask_false_negatives or config.scale < 0:
        exponent = Terms(x, t, negative, shift, config).exponent
        largest = rows.groupBy("query_id").agg(F.max(exponent).alias("shift"))
        rows = join_lookup(rows, largest, "query_id", "inner")
        shift = F.col("shift")
    terms = Terms(x, t, negative, shift, config)
    return rows.groupBy("batch_id", "query_id").agg(*[loss.value(terms).alias(name) for name, loss in LOSSES.items()])


def batch_losses(
    scored: DataFrame,
    config: LossConfig = LossConfig(),
    *,
    logits: dict[str, str] | None = None,
) -> DataFrame:
    """One row per batch: each loss summed over its queries, and ``<loss>Mean`` per query.

    ``logits`` names the column of each kind of logit, ``dot`` and ``cosine`` by default.
    """
    logits = logits or {"dot": "dot", "cosine": "cosine"}
    result = None
    for column in sorted(set(logits.values())):
        names = [name for name, loss in LOSSES.items() if logits[loss.kind] == column]
        sums = query_losses(scored, config, column).groupBy("batch_id").agg(
            F.count(F.lit(1)).alias("n_queries"), *[F.sum(name).alias(name) for name in names]
        )
        result = sums if result is None else result.join(sums.drop("n_queries"), "batch_id")
    means = {f"{name}Mean": safe_ratio(F.col(name), F.col("n_queries")) for name in LOSSES}
    return result.select("batch_id", "n_queries", *LOSSES).withColumns(means)


def logit_stats(
    scored: DataFrame, config: LossConfig = LossConfig(), logit: str = "dot"
) -> DataFrame:
    """Per batch the share of valid negatives, and mean, std, min and max of both kinds of logit.

    Statistics of no value are NULL, as is the standard deviation of one.
    """
    rows = valid_negatives(scored, config, logit)
    others = F.count(F.lit(1)) - 1
    if config.num_hard_negatives > 0:
        others = F.least(others, F.lit(config.num_hard_negatives))
    density = (
        rows.groupBy("batch_id", "query_id")
        .agg(safe_ratio(F.count_if("is_negative"), others).alias("share"))
        .groupBy("batch_id")
        .agg(F.avg("share").alias("neg_density"))
    )
    stats = []
    for name, chosen in (("pos", F.col("is_target")), ("neg", F.col("is_negative"))):
        value = F.when(chosen, F.col("logit"))
        stats += [
            F.avg(value).alias(f"{name}_mean"),
            F.stddev_samp(value).alias(f"{name}_std"),
            F.min(value).alias(f"{name}_min"),
            F.max(value).alias(f"{name}_max"),
        ]
    return density.join(rows.groupBy("batch_id").agg(*stats), "batch_id")
