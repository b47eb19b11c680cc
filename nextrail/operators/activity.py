"""Events with their texts, items with their flags, and users with their histories."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nextrail.operators.skew import heavy_keys, join_lookup, running_totals
from nextrail.schemas import ACTIVITY, FLAGS
from nextrail.sources.tables import unique_in_plan

PARTS = ("history", "target")


def any_true(flag: str) -> Column:
    """True if the flag is true anywhere in the group; NULL counts as false (D3)."""
    return F.coalesce(F.bool_or(flag), F.lit(False))


def enrich_events(
    events: DataFrame,
    items: DataFrame,
    users: DataFrame | None = None,
    *,
    validate: bool = True,
    heavy: Sequence | None = None,
    heavy_items: Sequence | None = None,
) -> DataFrame:
    """The events with ``item_text`` and ``user_text``; every event stays.

    ``users`` may be left out if the split has brought their text already. ``heavy`` and ``heavy_items`` are the heavy users and items of the log, if they are known.
    """
    items = items.select("item_id", "item_text")
    if validate:
        items = unique_in_plan(items, ["item_id"])
    with_items = join_lookup(events, items, "item_id", heavy=heavy_items)
    if users is None:
        return with_items
    users = users.select("user_id", "user_text")
    if validate:
        users = unique_in_plan(users, ["user_id"])
    return join_lookup(with_items, users, "user_id", heavy=heavy)


def flag_items(items: DataFrame, events: DataFrame, *, validate: bool = True) -> DataFrame:
    """The items with ``is_train``: NULL if never seen; all items are open to the other stages (C4)."""
    if validate:
        items = unique_in_plan(items, ["item_id"])
    seen = events.groupBy("item_id").agg(any_true("is_train").alias("is_train"))
    return items.join(seen, "item_id", "left").withColumns(
        {flag: F.lit(True) for flag in FLAGS[1:]}
    )


def place_activities(
    events: DataFrame, *, keep: Sequence[str] = (), heavy: Sequence | None = None
) -> DataFrame:
    """One row per event: ``part`` ('history' for train rows, else 'target'), its place ``pos`` there, and the
    lengths ``n_history`` and ``n_target`` of both parts.

    Histories are kept as rows, so their length has no bound. Events are sorted field by field, NULL
    first, ids as text; events without a split are in neither part. ``item_text`` may be missing; it
    follows from the id and so does not order anything. ``keep`` names further columns to carry along.
    """
    fields = [c for c in ACTIVITY if c in events.columns]
    chosen = events.where(F.col("is_train").isNotNull())
    placed = running_totals(
        chosen.select("user_id", *fields, "is_train", *keep),
        "user_id",
        [c for c in fields if c != "item_text"],
        {"history": F.col("is_train").cast("int"), "target": (~F.col("is_train")).cast("int")},
        heavy=heavy,
    )
    in_train = F.col("is_train")
    return placed.select(
        "user_id",
        F.when(in_train, F.lit("history")).otherwise(F.lit("target")).alias("part"),
        F.when(in_train, F.col("history_before")).otherwise(F.col("target_before")).alias("pos"),
        F.col("history_total").alias("n_history"),
        F.col("target_total").alias("n_target"),
        *fields,
        *keep,
    )


def lay_out_users(
    users: DataFrame,
    events: DataFrame,
    *,
    validate: bool = True,
    heavy: Sequence | None = None,
) -> DataFrame:
    """The users with their activities, one row per event with its ``part`` and place ``pos``, and the user's flags.

    A history of any length stays rows. Users without a placed event have one row with NULL part and place;
    without any event their flags are NULL too.
    """
    if validate:
        users = unique_in_plan(users, ["user_id"])
    heavy = heavy_keys(events, "user_id") if heavy is None else heavy
    placed = place_activities(events, heavy=heavy).select("user_id", "part", "pos", *ACTIVITY)
    flags = events.groupBy("user_id").agg(
        F.count("is_train").alias("n_placed"), *[any_true(flag).alias(flag) for flag in FLAGS]
    )
    flagged = users.join(flags, "user_id", "left")
    columns = [*users.columns, "part", "pos", *ACTIVITY, *FLAGS]
    active = join_lookup(placed, flagged.where("n_placed > 0"), "user_id", "inner", heavy=heavy)
    idle = flagged.where("n_placed IS NULL OR n_placed = 0")
    return active.select(*columns).unionByName(idle.select(*users.columns, *FLAGS), allowMissingColumns=True)


#: Activities in a list at most, where whole parts are asked for.
LIST_ROWS = 10_000


def latest_lists(laid_out: DataFrame, count: int | None, list_rows: int = LIST_ROWS) -> DataFrame:
    """Per user and part the last ``count`` activities, or with None all of them, as a struct of aligned lists, in order.

    ``first_pos`` is the place of the first one in the whole part. A group limit cuts each part before the shuffle. A whole
    part with more than ``list_rows`` activities comes as several rows with so many each, since a user may hold a third of
    all; they follow each other by ``first_pos``.
    """
    rows = laid_out.where(F.col("part").isNotNull())
    entries = F.sort_array(F.collect_list(F.struct("pos", *ACTIVITY)))
    keys = ["user_id", "part"]
    if count is None:
        rows = rows.withColumn("_chunk", F.floor(F.col("pos") / list_rows))
        keys.append("_chunk")
    else:
        latest = Window.partitionBy("user_id", "part").orderBy(F.desc("pos"))
        rows = rows.withColumn("_back", F.row_number().over(latest)).where(F.col("_back") <= count)
    lists = rows.groupBy(*keys).agg(entries.alias("entries"))
    return lists.select(
        "user_id",
        "part",
        F.col("entries")[0]["pos"].alias("first_pos"),
        F.struct(*[F.col("entries").getField(field).alias(field) for field in ACTIVITY]).alias("lists"),
    )


def list_rows(lists: DataFrame, *fields: str) -> DataFrame:
    """The rows of such lists, with their places in the whole part."""
    zipped = F.arrays_zip(*[F.col(f"lists.{f}").alias(f) for f in fields])
    entries = lists.select("user_id", "part", "first_pos", F.posexplode(zipped).alias("i", "entry"))
    return entries.select(
        "user_id",
        "part",
        (F.col("first_pos") + F.col("i")).alias("pos"),
        *[F.col(f"entry.{f}").alias(f) for f in fields],
    )
