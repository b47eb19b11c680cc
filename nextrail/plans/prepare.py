"""From the raw log to the three prepared tables and their stage views."""

from __future__ import annotations

from dataclasses import asdict, dataclass
from functools import cache

from pyspark.sql import DataFrame, SparkSession

from nextrail.config import SplitConfig
from nextrail.operators.activity import enrich_events, flag_items, lay_out_users
from nextrail.operators.encode import ModelFn, embed_text
from nextrail.operators.skew import heavy_keys
from nextrail.operators.split import train_test_split
from nextrail.sources.raw import load_events, load_items, load_users
from nextrail.sources.tables import content_id, materialize, read_split, stage, unique_in_plan


@dataclass(frozen=True)
class Prepared:
    events: DataFrame
    items: DataFrame
    users: DataFrame


def prepare(
    events: DataFrame,
    items: DataFrame,
    users: DataFrame,
    folder: str,
    *,
    split: SplitConfig = SplitConfig(),
    overwrite: bool = False,
    version: str | None = None,
) -> Prepared:
    """Split the log, join the texts, and write ``events``, ``items`` and ``users`` under ``folder``.

    ``users`` has a row per activity of a user, see ``lay_out_users``.

    Tables found there are read, not built again, unless they were built with other parameters or from other
    rows. ``version`` names the inputs; without it the log is staged, and all rows are counted and hashed, one pass each.
    """
    spark = events.sparkSession

    @cache
    def raw() -> DataFrame:
        # The log is read several times, and often comes from text files or a join.
        return stage(events)

    inputs = version or ",".join(content_id(table) for table in (raw(), items, users))

    @cache
    def heavy_users() -> list:
        return heavy_keys(raw(), "user_id")

    def build_events() -> DataFrame:
        profiles = unique_in_plan(users.select("user_id", "user_text"), ["user_id"])
        flagged = train_test_split(
            raw(), config=split, profiles=profiles, heavy=heavy_users()
        )
        return enrich_events(flagged, items)

    params = {**asdict(split), "inputs": inputs}
    log = materialize(
        spark, f"{folder}/events.parquet", build_events, params=params, overwrite=overwrite
    )
    item_table = materialize(
        spark,
        f"{folder}/items.parquet",
        lambda: flag_items(items, log, validate=False),
        params=params,
        overwrite=overwrite,
    )
    user_table = materialize(
        spark,
        f"{folder}/users.parquet",
        lambda: lay_out_users(users, log, validate=False, heavy=heavy_users()),
        params=params,
        overwrite=overwrite,
    )
    return Prepared(log, item_table, user_table)


def prepare_files(
    spark: SparkSession,
    src: str,
    folder: str,
    *,
    split: SplitConfig = SplitConfig(),
    overwrite: bool = False,
) -> Prepared:
    """The same from the raw files ``movies.dat``, ``users.dat`` and ``ratings.dat`` under ``src``."""
    return prepare(
        load_events(spark, f"{src}/ratings.dat"),
        load_items(spark, f"{src}/movies.dat"),
        load_users(spark, f"{src}/users.dat"),
        folder,
        split=split,
        overwrite=overwrite,
    )


def stage_views(
    spark: SparkSession, folder: str, *, model_fn: ModelFn | None = None
) -> dict[str, DataFrame]:
    """The lazy tables of every stage: items with vectors, users, and one view per split."""
    users = f"{folder}/users.parquet"
    items = spark.read.parquet(f"{folder}/items.parquet")
    return {
        "items": embed_text(items, "item_text", model_fn=model_fn),
        "users": spark.read.parquet(users),
        "train": read_split(spark, users, "is_train"),
        "val": read_split(spark, users, "is_val"),
        "test": read_split(spark, users, "is_test"),
        "predict": read_split(spark, users, "is_predict"),
    }
