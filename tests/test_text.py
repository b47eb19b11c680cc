"""Expressions on text, time and lists."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from nextrail.config import EncoderConfig, IndexConfig, LossConfig, SequenceConfig, SplitConfig
from nextrail.functions import text


def test_expressions(spark):
    df = spark.createDataFrame(
        [("a|b.c", ["x", "y", "z"], None, 86_400, None)],
        "s string, l array<string>, n array<string>, t int, e int",
    )
    row = df.select(
        text.split_literal(F.col("s"), "|"),
        text.json_text(F.col("s"), F.col("e")),
        text.epoch_to_datetime(F.col("t")),
        text.last_elements(F.col("l"), 2),
        text.last_elements(F.col("l"), 9),
        text.joined_lists(F.col("n"), F.col("l")),
        text.joined_lists(F.col("n"), F.col("n")),
        text.safe_ratio(F.lit(1), F.lit(0)),
    ).first()
    assert list(row)[:-1] == [
        ["a", "b.c"],
        '{"s":"a|b.c","e":null}',
        dt.datetime(1970, 1, 2),
        ["y", "z"],
        ["x", "y", "z"],
        ["x", "y", "z"],
        [],
    ]
    assert row[-1] == pytest.approx(1e9)


@pytest.mark.parametrize(
    "make",
    [
        lambda: SplitConfig(train_prop=1.0),
        lambda: SplitConfig(val_prop=1.5),
        lambda: SequenceConfig(max_seq_length=0),
        lambda: SequenceConfig(pos_lookahead=-1),
        lambda: EncoderConfig(pooling="sum"),
        lambda: IndexConfig(metric="hamming"),
        lambda: LossConfig(target_position="last"),
    ],
)
def test_settings_are_checked(make):
    with pytest.raises(ValueError):
        make()
