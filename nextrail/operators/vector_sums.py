"""Sums and means of vectors by key, and products with small matrices, with partial sums in the tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def lists(matrix: np.ndarray) -> pa.Array:
    """The rows of a matrix as a list column."""
    offsets = np.arange(len(matrix) + 1, dtype=np.int32) * matrix.shape[1]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(matrix.reshape(-1)))


def matrix(column: pa.Array) -> np.ndarray:
    """A list column whose lists have one length as a matrix."""
    return column.flatten().to_numpy().reshape(len(column), -1) if len(column) else np.empty((0, 0))


def vector_sums(rows: DataFrame, *keys: str, column: str = "point") -> DataFrame:
    """``keys``, ``n`` and ``total``, the sum of the arrays ``column`` of each key.

    All arrays have one length. Each batch adds up what it holds of a key before the shuffle, so a key with a third of all
    rows sends a row per batch.
    """
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema if f.name in keys}
    schema = ", ".join(f"{name} {kind}" for name, kind in kinds.items()) + ", n long, total array<double>"

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            codes = np.zeros(batch.num_rows, np.int64)
            for name in kinds:
                found = batch.column(name).dictionary_encode(null_encoding="encode")
                codes = codes * (len(found.dictionary) + 1) + found.indices.to_numpy()
            _, first, group, n = np.unique(codes, return_index=True, return_inverse=True, return_counts=True)
            values = matrix(batch.column(column))[np.argsort(group, kind="stable")]
            totals = np.add.reduceat(values, np.cumsum(n) - n, axis=0)
            out = [*(batch.column(name).take(pa.array(first)) for name in kinds), pa.array(n), lists(totals)]
            yield pa.RecordBatch.from_arrays(out, [*kinds, "n", "total"])

    parts = rows.select(*kinds, column).mapInArrow(add, schema)
    cells = parts.select(*kinds, "n", F.posexplode("total").alias("dim", "value"))
    sums = cells.groupBy(*kinds, "dim").agg(F.sum("n").alias("n"), F.sum("value").alias("value"))
    whole = sums.groupBy(*kinds).agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("dim", "value"))).alias("cells"))
    return whole.select(*kinds, "n", F.col("cells")["value"].alias("total"))


def vector_means(rows: DataFrame, *keys: str, column: str = "point") -> DataFrame:
    """``keys`` and ``mean``, the mean of the arrays ``column`` of each key."""
    sums = vector_sums(rows, *keys, column=column)
    return sums.select(*keys, F.transform("total", lambda x: x / F.col("n")).alias("mean"))


def small_total(rows: DataFrame, part: Callable[[pa.RecordBatch], np.ndarray], shape: tuple[int, int]) -> np.ndarray:
    """The sum over all batches of a small matrix that ``part`` makes of each; its cells are added up by Spark."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for batch in batches:
            if batch.num_rows:
                total += part(batch)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size, dtype=np.int32)), pa.array(total.reshape(-1))], ["cell", "value"])

    table = rows.mapInArrow(add, "cell int, value double").groupBy("cell").agg(F.sum("value").alias("value")).toArrow()
    out = np.zeros(shape[0] * shape[1])
    out[table["cell"].to_numpy()] = table["value"].to_numpy()
    return out.reshape(shape)
