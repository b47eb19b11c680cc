"""The skew-safe plans against plain Python, on groups of which one holds a third or more of the rows."""

import random

import pytest
from pyspark.sql import functions as F

from nextrail.functions.sampling import draw
from nextrail.operators import skew


def rows_with_hot_key(n=600, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        group = "hot" if i % 3 == 0 else rng.choice([f"u{k}" for k in range(40)] + [None])
        # Few distinct values, so that equal rows abound.
        rows.append((group, rng.choice([None, 1, 2, 3, 50]), rng.choice([0, 1])))
    return rows


def test_heavy_keys_are_the_largest(spark):
    df = spark.createDataFrame(rows_with_hot_key(), "g string, t int, w int")
    assert skew.heavy_keys(df, "g", min_rows=100) == ["hot"]
    assert skew.heavy_keys(df, "g", most=1, min_rows=1) == ["hot"]
    assert skew.heavy_keys(df, "g", min_rows=10_000) == []


def test_null_key_can_be_heavy(spark):
    df = spark.createDataFrame([(None,)] * 9 + [("a",)], "g string")
    heavy = skew.heavy_keys(df, "g", min_rows=5)
    assert heavy == [None]
    assert df.where(skew.among("g", heavy)).count() == 9
    assert df.where(~skew.among("g", heavy)).count() == 1


@pytest.mark.parametrize("min_rows", [100, 5, 0])
def test_running_totals(spark, min_rows):
    rows = rows_with_hot_key()
    df = spark.createDataFrame(rows, "g string, t int, w int").repartition(5)
    heavy = skew.heavy_keys(df, "g", min_rows=min_rows)
    got = skew.running_totals(
        df, "g", ["t", "w"], {"n": F.lit(1), "w": F.col("w")}, heavy=heavy
    ).collect()

    key = lambda r: (r[1] is not None, r[1] or 0, r[2])
    want = []
    for group in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == group), key=key)
        done = 0
        for i, r in enumerate(mine):
            want.append((*r, i, len(mine), done, sum(x[2] for x in mine)))
            done += r[2]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


@pytest.mark.parametrize("null_safe", [False, True])
@pytest.mark.parametrize("how", ["left", "inner"])
def test_join_lookup(spark, how, null_safe):
    left = spark.createDataFrame(rows_with_hot_key(), "g string, t int, w int")
    right = spark.createDataFrame([("hot", 1), ("u1", 2), ("u99", 3), (None, 4)], "g string, v int")
    plain = skew.join_lookup(left, right, "g", how, heavy=[], null_safe=null_safe)
    for heavy in (["hot"], ["hot", None], ["u1", "u2", None]):
        split = skew.join_lookup(left, right, "g", how, heavy=heavy, null_safe=null_safe)
        assert split.columns == plain.columns
        assert sorted(map(str, split.collect())) == sorted(map(str, plain.collect()))
    nulls = plain.where("g IS NULL AND v = 4").count()
    assert (nulls > 0) == null_safe


def test_ordinals_do_not_depend_on_partitions(spark, partitions):
    ids = [(f"i{k}",) for k in range(500)]
    results = []
    for count in (1, 4, 17):
        partitions(count)
        df = spark.createDataFrame(ids, "id string").repartition(count)
        rows = skew.in_key_order(df, draw(F.col("id")), "n", ties=["id"], buckets=16).collect()
        results.append(sorted((r["id"], r["n"]) for r in rows))
    assert results[0] == results[1] == results[2]
    assert sorted(n for _, n in results[0]) == list(range(500))
