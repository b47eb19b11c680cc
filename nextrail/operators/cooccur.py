"""Item vectors from sequences: co-occurrence counts, their mutual information, and its main directions.

Nothing is trained on the driver: counts and weights are rows, and so are the vectors, which a block power iteration turns
towards the largest eigenvalues. Only matrices of the vectors' length by itself come to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nextrail.operators.skew import join_lookup
from nextrail.operators.vector_sums import lists, matrix, small_total, vector_sums
from nextrail.sources.tables import stage

#: Directions whose share of the block's largest squared length is below this are dropped from the block.
NOTHING = 1e-12
#: Places of a query that one span holds.
SPAN = 4096


def cooccurrence(histories: DataFrame, window: int = 5) -> DataFrame:
    """``item_id, other_id, n``: how often two different items stand at most ``window`` places apart in a query, both ways.

    ``histories``: query_id, pos (0, 1, ... without gaps), item_id. A query is cut into spans of places, each with the first places
    of the next, so one of any length is spread over all tasks. A pair is counted once, before the shuffle too, and then
    given back both ways.
    """
    rows = histories.select("query_id", "pos", "item_id").dropna()
    span = max(SPAN, window)
    own = F.floor(F.col("pos") / span)
    spans = F.when(F.pmod("pos", F.lit(span)) < window, F.array(own, own - 1)).otherwise(F.array(own))
    cut = rows.select("*", own.alias("_own"), F.explode(spans).alias("_span"))
    ahead = Window.partitionBy("query_id", "_span").orderBy("pos").rangeBetween(1, window)
    met = cut.withColumn("_others", F.collect_list("item_id").over(ahead)).where("_own = _span")
    pairs = met.select("item_id", F.explode("_others").alias("other_id")).where("item_id <> other_id")
    pairs = pairs.select(F.least("item_id", "other_id").alias("one"), F.greatest("item_id", "other_id").alias("other"))
    counts = pairs.groupBy("one", "other").agg(F.count(F.lit(1)).alias("n"))
    both = F.explode(F.array(F.struct("one", "other"), F.struct(F.col("other").alias("one"), F.col("one").alias("other"))))
    return counts.select(both.alias("p"), "n").select(F.col("p.one").alias("item_id"), F.col("p.other").alias("other_id"), "n")


def mutual_information(counts: DataFrame) -> DataFrame:
    """``item_id, other_id, weight``: ``ln(n * total / (n of the item * n of the other))`` where that is above 0."""
    counts = stage(counts)
    sums = stage(counts.groupBy("item_id").agg(F.sum("n").cast("double").alias("of_item")))
    total = float(sums.agg(F.sum("of_item")).first()[0] or 0.0)
    others = sums.select(F.col("item_id").alias("other_id"), F.col("of_item").alias("of_other"))
    known = join_lookup(join_lookup(counts, sums, "item_id", "inner"), others, "other_id", "inner")
    weight = F.log(F.col("n") * F.lit(total) / (F.col("of_item") * F.col("of_other")))
    return known.select("item_id", "other_id", weight.alias("weight")).where("weight > 0")


def _turned(rows: DataFrame, turn: np.ndarray) -> DataFrame:
    """``item_id, point`` times a small matrix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column("item_id"), lists(matrix(batch.column("point")) @ turn)], ["item_id", "point"])

    return rows.select("item_id", "point").mapInArrow(run, "item_id string, point array<double>")


def _times(weights: DataFrame, vectors: DataFrame) -> DataFrame:
    """``item_id, point``: the weighted sum of the other items' vectors."""
    other = vectors.select(F.col("item_id").alias("other_id"), F.col("point"))
    met = join_lookup(weights, other, "other_id", "inner")
    scaled = met.select("item_id", F.transform("point", lambda x: x * F.col("weight")).alias("point"))
    return vector_sums(scaled, "item_id").select("item_id", F.col("total").alias("point"))


def _orthogonal(vectors: DataFrame, dim: int) -> DataFrame:
    """The block with orthogonal columns of length 1; directions that are next to nothing become zero."""
    gram = small_total(vectors, lambda b: (m := matrix(b.column("point"))).T @ m, (dim, dim))
    squares, turn = np.linalg.eigh(gram)
    scale = np.where(squares > NOTHING * max(squares[-1], 0), 1 / np.sqrt(np.maximum(squares, 1e-300)), 0)
    return stage(_turned(vectors, turn * scale))


def item_vectors(weights: DataFrame, dim: int = 16, *, rounds: int = 12, seed: int = 0) -> tuple[DataFrame, np.ndarray]:
    """``item_id, embedding`` of length ``dim``, and the eigenvalues that its directions stand for, falling.

    ``weights``: item_id, other_id, weight, symmetric, staged. The inner product of two vectors comes near the weight of the two items: the
    directions of the largest positive eigenvalues, each scaled by the root of its own; others are zero. ``rounds`` block power
    steps, each one join and one sum by item. The start is drawn by hashes of the ids. Items without a weight have no row.
    """
    items = weights.select("item_id").distinct()
    draw = [(F.pmod(F.xxhash64(F.lit(seed), "item_id", F.lit(i)), F.lit(1 << 20)) / F.lit(float(1 << 19)) - 1) for i in range(dim)]
    vectors = _orthogonal(stage(items.select("item_id", F.array(*draw).alias("point"))), dim)
    for _ in range(rounds):
        vectors = _orthogonal(stage(_times(weights, vectors)), dim)
    product = _times(weights, vectors).withColumnRenamed("point", "image")
    both = vectors.join(product, "item_id").select("point", "image")
    small = small_total(both, lambda b: matrix(b.column("point")).T @ matrix(b.column("image")), (dim, dim))
    values, turn = np.linalg.eigh((small + small.T) / 2)
    values, turn = values[::-1], turn[:, ::-1]
    found = _turned(vectors, turn * np.sqrt(np.maximum(values, 0)))
    return found.withColumnRenamed("point", "embedding"), values
