"""Column expressions on ids, text and time."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def split_literal(text: Column, mark: str) -> Column:
    """Split on a literal mark; Spark's ``split`` takes a pattern, so the mark is quoted (B2)."""
    return F.split(text, r"\Q" + mark + r"\E")


def json_text(*fields: Column) -> Column:
    """Compact JSON object with the fields in the order given; NULL fields are kept."""
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})


def epoch_to_datetime(seconds: Column) -> Column:
    """Epoch seconds to a timestamp without zone, whatever the session's time zone."""
    epoch = F.to_timestamp_ntz(F.lit("1970-01-01 00:00:00"))
    return epoch + F.make_dt_interval(secs=seconds)


def last_elements(items: Column, count: int) -> Column:
    """The last ``count`` elements of an array."""
    start = F.greatest(F.size(items) - count + 1, F.lit(1))
    return F.slice(items, start, count)


def joined_lists(first: Column, second: Column) -> Column:
    """One list after the other, a NULL list counts as empty."""
    empty = F.array().cast("array<string>")
    return F.concat(F.coalesce(first, empty), F.coalesce(second, empty))


def safe_ratio(part: Column, whole: Column) -> Column:
    return part / (whole + F.lit(1e-9))
