"""Seeded draws that depend on the row's key only, never on partitions or retries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from nextrail.functions.vectors import let


def draw(*parts: Column) -> Column:
    """An even 60-bit number from the text of the parts."""
    text = F.concat_ws("|", *[part.cast("string") for part in parts])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


def choose(count: Column, size: Column, *key: Column) -> Column:
    """A uniform ``size``-subset of ``0..count-1`` without replacement, ``size <= count`` (Floyd's method).

    The cost depends on ``size`` alone, however large ``count`` is.
    """
    nothing = F.array().cast("array<bigint>")

    def add(chosen: Column, top: Column) -> Column:
        drawn = F.pmod(draw(*key, top), top + 1)
        return let(
            drawn,
            lambda pick: F.array_append(
                chosen, F.when(F.array_contains(chosen, pick), top).otherwise(pick)
            ),
        )

    tops = F.sequence((count - size).cast("bigint"), (count - 1).cast("bigint"))
    return F.when(size > 0, F.aggregate(tops, nothing, add)).otherwise(nothing)


def shuffled(values: Column, *key: Column) -> Column:
    """The values in a drawn order."""
    keyed = F.transform(values, lambda v: F.struct(draw(*key, v).alias("key"), v.alias("value")))
    return F.transform(F.array_sort(keyed), lambda entry: entry["value"])


def choose_repeating(count: Column, size: Column, *key: Column) -> Column:
    """``size`` independent draws from ``0..count-1``."""
    nothing = F.array().cast("array<bigint>")
    slots = F.sequence(F.lit(0), (size - 1).cast("int"))
    return F.when(
        size > 0, F.transform(slots, lambda slot: F.pmod(draw(*key, slot), count))
    ).otherwise(nothing)
