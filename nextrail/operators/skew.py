"""Joins and running totals that stay balanced when a few keys hold much of the data.

A key counts as heavy if it is among the ``most`` largest keys and has more than ``min_rows`` rows. Every
other key holds less than one ``most``-th of the rows, or few enough for one task, so the ordinary shuffle on the key
is balanced for it. ``most`` bounds the list the driver holds and every table of one row per heavy key that
is broadcast; it is never below the number of shuffle partitions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nextrail.sources.tables import stage

MIN_HEAVY_ROWS = 2_000_000
MOST_HEAVY = 10_000
_EXPAND = 4096


def default_parts(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def heavy_keys(
    df: DataFrame, key: str, *, most: int | None = None, min_rows: int | None = None
) -> list:
    """The heavy values of ``key``, NULL included; one map-side combined count, at most ``most`` rows back."""
    most = most or max(MOST_HEAVY, default_parts(df))
    min_rows = MIN_HEAVY_ROWS if min_rows is None else min_rows
    sizes = df.groupBy(F.col(key).alias("key")).agg(F.count(F.lit(1)).alias("rows"))
    largest = sizes.where(F.col("rows") > min_rows).orderBy(F.desc("rows"), "key").limit(most)
    return [row["key"] for row in largest.collect()]


def among(key: str, keys: Sequence) -> Column:
    """Is the key one of ``keys``? Never NULL."""
    known = [value for value in keys if value is not None]
    found = F.coalesce(F.col(key).isin(known), F.lit(False)) if known else F.lit(False)
    return found | F.col(key).isNull() if len(known) < len(keys) else found


def join_lookup(
    left: DataFrame,
    right: DataFrame,
    key: str,
    how: str = "left",
    *,
    heavy: Sequence | None = None,
    null_safe: bool = False,
) -> DataFrame:
    """Join with a table that has one row per key.

    Large partitions of a hot key are split by adaptive execution. Where heavy keys are known already, their
    rows are not shuffled at all: they meet a broadcast of those keys' rows, at most one per heavy key.
    """

    def join(one: DataFrame, other: DataFrame) -> DataFrame:
        if not null_safe:
            return one.join(other, key, how)
        other = other.withColumnRenamed(key, "_right_key")
        return one.join(other, F.col(key).eqNullSafe(F.col("_right_key")), how).drop("_right_key")

    if not heavy:
        return join(left, right)
    hot = among(key, heavy)
    cold_side = join(left.where(~hot), right.where(~hot))
    hot_side = join(left.where(hot), F.broadcast(right.where(hot)))
    return cold_side.unionByName(hot_side)


def running_totals(
    df: DataFrame,
    group: str,
    order: Sequence[str],
    weights: dict[str, Column],
    *,
    heavy: Sequence | None = None,
    spread: bool = False,
) -> DataFrame:
    """Per row ``<name>_before`` (sum over earlier rows of its group) and ``<name>_total``.

    Ascending, NULL first. Rows that tie on ``order`` must be equal or interchangeable. With ``spread`` the groups
    are dealt to as many tasks as there are shuffle partitions, however few bytes they are, for costly work that follows in the same tasks.
    """
    heavy = heavy_keys(df, group) if heavy is None else heavy
    light = df.where(~among(group, heavy)) if heavy else df
    if spread:
        light = light.repartition(default_parts(df), group)
    if not heavy:
        return _windowed(light, group, order, weights)
    hot = among(group, heavy)
    return _windowed(light, group, order, weights).unionByName(
        _chunked(df.where(hot), group, order, weights)
    )


def _windowed(
    df: DataFrame, group: str, order: Sequence[str], weights: dict[str, Column]
) -> DataFrame:
    whole = Window.partitionBy(group)
    so_far = whole.orderBy(*[F.col(c).asc_nulls_first() for c in order]).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    sums = []
    for name, weight in weights.items():
        weight = weight.cast("bigint")
        sums.append((F.sum(weight).over(so_far) - weight).alias(f"{name}_before"))
        sums.append(F.sum(weight).over(whole).alias(f"{name}_total"))
    return df.select("*", *sums)


def _chunked(
    df: DataFrame, group: str, order: Sequence[str], weights: dict[str, Column]
) -> DataFrame:
    """The same for groups too large for a task: each is cut into ranges of its order.

    Equal rows are counted first, so that they cannot fill one range. The ranges are staged, because the
    sums per range and the rows must see the same cut.
    """
    columns = df.columns
    parts = default_parts(df)
    rest = [c for c in columns if c != group and c not in order]
    sequence = [group, *order, *rest]
    equal_rows = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("_copies"))
    ranges = stage(
        equal_rows.repartitionByRange(parts, *sequence).withColumn("_chunk", F.spark_partition_id())
    )
    ranges = ranges.withColumns({f"_w_{n}": w.cast("bigint") for n, w in weights.items()})

    # One row per group and range: ranges are contiguous, so at most (heavy groups + parts) rows.
    per_chunk = ranges.groupBy(F.col(group).alias("_group"), "_chunk").agg(
        *[F.sum(F.col(f"_w_{n}") * F.col("_copies")).alias(f"_s_{n}") for n in weights]
    )
    of_group = Window.partitionBy("_group")
    up_to = of_group.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    offsets = per_chunk.select(
        "_group",
        F.col("_chunk").alias("_of_chunk"),
        *[(F.sum(f"_s_{n}").over(up_to) - F.col(f"_s_{n}")).alias(f"_b_{n}") for n in weights],
        *[F.sum(f"_s_{n}").over(of_group).alias(f"{n}_total") for n in weights],
    )

    inside = (
        Window.partitionBy(group, "_chunk")
        .orderBy(*[F.col(c).asc_nulls_first() for c in [*order, *rest]])
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    local = ranges.select(
        "*",
        *[
            (
                F.sum(F.col(f"_w_{n}") * F.col("_copies")).over(inside)
                - F.col(f"_w_{n}") * F.col("_copies")
            ).alias(f"_l_{n}")
            for n in weights
        ],
    )
    placed = local.join(
        F.broadcast(offsets),
        F.col(group).eqNullSafe(F.col("_group")) & (F.col("_chunk") == F.col("_of_chunk")),
    )
    # Equal rows come back one by one, in steps small enough for one array.
    blocks = placed.withColumn(
        "_block", F.explode(F.sequence(F.lit(0), F.expr(f"(_copies - 1) div {_EXPAND}")))
    )
    copies = blocks.withColumn(
        "_copy",
        F.explode(
            F.expr(
                f"sequence(_block * {_EXPAND}, least(_copies, (_block + 1) * {_EXPAND}) - 1)"
            )
        ),
    )
    out = []
    for n in weights:
        before = F.col(f"_b_{n}") + F.col(f"_l_{n}") + F.col("_copy") * F.col(f"_w_{n}")
        out += [before.cast("bigint").alias(f"{n}_before"), F.col(f"{n}_total")]
    return copies.select(*columns, *out)


def in_key_order(
    df: DataFrame, key: Column, name: str, *, ties: Sequence[str], buckets: int | None = None
) -> DataFrame:
    """Ordinals 0.. over the whole table in the order of ``key``, an evenly spread 60-bit hash.

    Equal-width ranges of an even hash are balanced, so each range numbers its own rows and adds the
    number of rows in lower ranges. Only the ``buckets`` range sizes meet in one task; by default there are so
    many ranges that each holds about a million rows.
    """
    buckets = buckets or max(64, df.count() // 1_000_000)
    marked = df.withColumn("_key", key).withColumn(
        "_bucket", F.expr(f"_key div {(1 << 60) // buckets}")
    )
    sizes = marked.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_rows"))
    up_to = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    offsets = sizes.select(
        "_bucket", (F.sum("_rows").over(up_to) - F.col("_rows")).alias("_offset")
    )
    inside = Window.partitionBy("_bucket").orderBy("_key", *ties)
    return (
        marked.join(offsets, "_bucket")
        .withColumn(name, F.col("_offset") + F.row_number().over(inside) - 1)
        .drop("_key", "_bucket", "_offset")
    )
