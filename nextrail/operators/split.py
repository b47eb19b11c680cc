"""Chronological train / validation / test flags."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nextrail.config import SplitConfig
from nextrail.operators.skew import among, heavy_keys, join_lookup, running_totals
from nextrail.sources.tables import stage


def train_cuts(
    events: DataFrame,
    group_col: str = "user_id",
    order_col: str = "datetime",
    train_prop: float = 0.8,
    *,
    heavy: Sequence | None = None,
) -> DataFrame:
    """Per user the time of the last train row (``cut``) and the number of rows after it (``held_out``).

    A row is in train while fewer than ``train_prop`` of the user's rows are strictly earlier. That holds
    up to one point of time, so the split of a user is one value, and the log itself is never sorted.
    """
    heavy = heavy_keys(events, group_col) if heavy is None else heavy
    hot = among(group_col, heavy)
    log = events.select(group_col, order_col).where(F.col(order_col).isNotNull())

    by_user = Window.partitionBy(group_col)
    earlier = F.rank().over(by_user.orderBy(order_col)) - 1
    share = earlier / F.count(order_col).over(by_user)
    cold = log.where(~hot) if heavy else log
    marked = cold.select(
        group_col,
        order_col,
        (share < F.lit(train_prop)).alias("in_train"),
        F.lit(1).cast("bigint").alias("rows"),
    )
    if heavy:
        # Rows of one time first become one row, then each large user's times are ranked in ranges.
        times = log.where(hot).groupBy(group_col, order_col).agg(F.count(F.lit(1)).alias("rows"))
        ranked = running_totals(
            times, group_col, [order_col], {"row": F.col("rows")}, heavy=heavy
        )
        marked = marked.unionByName(
            ranked.select(
                group_col,
                order_col,
                (F.col("row_before") / F.col("row_total") < F.lit(train_prop)).alias("in_train"),
                "rows",
            )
        )
    return marked.groupBy(group_col).agg(
        F.max(F.when(F.col("in_train"), F.col(order_col))).alias("cut"),
        F.coalesce(F.sum(F.when(~F.col("in_train"), F.col("rows"))), F.lit(0)).alias("held_out"),
    )


def most_active(cuts: DataFrame, val_prop: float = 0.2) -> DataFrame:
    """Adds ``is_active``: the user's held-out count is among the largest ``val_prop`` of all users.

    Users are counted per distinct held-out count, and only that histogram is ranked. Its counts are
    distinct and sum to at most the log's size n, so it has at most sqrt(2n) rows: small enough for one
    task and for a broadcast, whatever the number of users.
    """
    sizes = (
        cuts.where(F.col("held_out") > 0)
        .groupBy("held_out")
        .agg(F.count(F.lit(1)).alias("users"))
    )
    up_to = Window.orderBy("held_out").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    everyone = Window.partitionBy(F.lit(0))
    share = (F.sum("users").over(up_to) - F.col("users")) / F.sum("users").over(everyone)
    active = sizes.select("held_out", (share >= F.lit(1 - val_prop)).alias("is_active"))
    return cuts.join(F.broadcast(active), "held_out", "left")


def train_test_split(
    events: DataFrame,
    group_col: str = "user_id",
    order_col: str = "datetime",
    config: SplitConfig = SplitConfig(),
    *,
    profiles: DataFrame | None = None,
    heavy: Sequence | None = None,
) -> DataFrame:
    """The events with ``is_train``, ``is_val``, ``is_test`` and ``is_predict``.

    A user's rows of equal time fall on one side. A NULL time gives NULL flags. ``profiles``, one row per
    user, adds its columns by the same join, so the log is not shuffled once more for them.
    """
    heavy = heavy_keys(events, group_col) if heavy is None else heavy
    # One row per user, read for the histogram and for the join.
    cuts = stage(train_cuts(events, group_col, order_col, config.train_prop, heavy=heavy))
    cuts = most_active(cuts, config.val_prop).select(group_col, "cut", "is_active")
    added = []
    if profiles is not None:
        added = [c for c in profiles.columns if c != group_col]
        cuts = cuts.join(profiles, group_col, "left")
    flagged = join_lookup(events, cuts, group_col, heavy=heavy, null_safe=True)

    is_train = F.when(
        F.col(order_col).isNotNull(), F.coalesce(F.col(order_col) <= F.col("cut"), F.lit(False))
    )
    # As in a join on the key, rows without a user match no user's activity.
    active = F.when(F.col(group_col).isNotNull(), F.col("is_active"))
    return flagged.withColumn("is_train", is_train).select(
        *events.columns,
        "is_train",
        (~F.col("is_train") & active).alias("is_val"),
        (~F.col("is_train") & ~active).alias("is_test"),
        F.lit(True).alias("is_predict"),
        *added,
    )


def split_summary(events: DataFrame) -> DataFrame:
    """One row per split flag with its number of events and users."""
    parts = F.explode(
        F.array(
            *[
                F.struct(F.lit(name).alias("split"), F.col(flag).alias("member"))
                for name, flag in (("train", "is_train"), ("val", "is_val"), ("test", "is_test"))
            ]
        )
    )
    rows = events.select("user_id", parts.alias("part")).where("part.member")
    per_user = rows.groupBy("part.split", "user_id").agg(F.count(F.lit(1)).alias("n"))
    return per_user.groupBy("split").agg(
        F.sum("n").alias("n_events"), F.count(F.lit(1)).alias("n_users")
    )
