"""Readers of the raw '::'-separated files (A1-A3)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nextrail import schemas
from nextrail.functions.text import epoch_to_datetime, json_text, split_literal


def _read(spark: SparkSession, path: str, schema: str, encoding: str) -> DataFrame:
    # No quoting: a quote mark is part of the text. Text such as NA stays text.
    return spark.read.csv(path, schema=schema, sep="::", quote="", encoding=encoding)


def load_items(spark: SparkSession, path: str) -> DataFrame:
    raw = _read(spark, path, schemas.RAW_ITEMS, "ISO-8859-1")
    # An empty field is NULL, and stays so in the JSON text.
    genres = split_literal(F.col("genres"), "|").alias("genres")
    return raw.select(
        F.col("movie_id").alias("item_id"),
        json_text(F.col("title"), genres).alias("item_text"),
    )


def load_users(spark: SparkSession, path: str) -> DataFrame:
    raw = _read(spark, path, schemas.RAW_USERS, "UTF-8")
    profile = [F.col(c) for c in ("gender", "age", "occupation", "zipcode")]
    return raw.select("user_id", json_text(*profile).alias("user_text"))


def load_events(spark: SparkSession, path: str, label: Column | None = None) -> DataFrame:
    """The rating log; every rating is a positive unless ``label`` says otherwise."""
    raw = _read(spark, path, schemas.RAW_EVENTS, "UTF-8")
    return raw.select(
        "user_id",
        F.col("movie_id").alias("item_id"),
        F.col("rating").alias("event_value"),
        "timestamp",
        epoch_to_datetime(F.col("timestamp")).alias("datetime"),
        F.lit("rating").alias("event_name"),
        (F.lit(True) if label is None else label).alias("label"),
    )
