"""Exact top-k search through a clustered index, pruned by bounds.

For each metric there is a space in which similar means near: unit vectors for cosine, for the inner product the vectors
with one more dimension that brings all of them to the largest norm, the vectors themselves for l2. There a cluster's centre
and its farthest and nearest member bound how near any member can be to a query. A query visits the clusters from the
best bound on, in rounds; it is done once its k-th score beats every bound that is left. What is left out so can't be among
the best: the result is that of the search without an index. A catalogue of checked size goes to every task, which goes
through the rounds itself; with a larger one a round is a search of the probed clusters' blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import Accumulator
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nextrail.config import METRICS, TOP_K
from nextrail.functions.vectors import COSINE_EPS, as_double, squared_distance, unit
from nextrail.functions.vectors import dot as vectors_dot
from nextrail.operators import search as flat
from nextrail.operators.vector_sums import vector_means
from nextrail.sources.tables import stage

#: Clusters that a query visits in the first round, and how many times as many in each further one.
FIRST, GROWTH = 2, 16
#: Clusters that a round may send a query to, on the average, for each block of all items; beyond that blocks move less.
PROBES_PER_BLOCK = 2
#: Share of the scores' size by which bounds are widened, for rounding and for ties.
SLACK = 1e-8


@dataclass(frozen=True)
class ClusterIndex:
    """Items by cluster, and per cluster its centre in the metric's space, the least and the largest distance from it.

    ``clusters``: cluster_id, centre, inner, outer, n_items; one row each, about the square root of the number of items.
    ``most``: the largest squared norm, which the space of the inner product needs.
    """

    items: DataFrame
    clusters: DataFrame
    metric: str
    most: float


def point(vector: Column, metric: str, most: float) -> Column:
    """An item's place in the metric's space."""
    vector = as_double(vector)
    if metric == "cosine":
        return unit(vector)
    if metric == "dot":
        return F.concat(vector, F.array(F.sqrt(F.greatest(F.lit(most) - vectors_dot(vector, vector), F.lit(0.0)))))
    return vector


def index_clusters(items: DataFrame, metric: str = "cosine") -> ClusterIndex:
    """The index over ``items`` (item_id, embedding, cluster_id), however they were clustered.

    Items without a vector, an id or a cluster take no part in searches. ``items`` is read three times; pass a staged or
    written table.
    """
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {METRICS}")
    known = flat.usable(items, "item_id", "cluster_id").where(F.col("cluster_id").isNotNull())
    most = 0.0
    if metric == "dot":
        vector = as_double(F.col("embedding"))
        most = known.agg(F.max(vectors_dot(vector, vector))).first()[0] or 0.0
    points = known.select("cluster_id", point(F.col("embedding"), metric, most).alias("point"))
    centres = vector_means(points, "cluster_id").withColumnRenamed("mean", "centre")
    far = F.sqrt(squared_distance(F.col("point"), F.col("centre")))
    bounds = points.join(centres, "cluster_id").groupBy("cluster_id").agg(
        F.min(far).alias("inner"), F.max(far).alias("outer"), F.count(F.lit(1)).alias("n_items")
    )
    return ClusterIndex(items, stage(centres.join(bounds, "cluster_id")), metric, most)


def _best_possible(vectors: np.ndarray, centres: np.ndarray, inner: np.ndarray, outer: np.ndarray, metric: str, most: float) -> np.ndarray:
    """For each query and cluster a score that no member exceeds."""
    squares = np.einsum("ij,ij->i", vectors, vectors)[:, None]
    if metric == "cosine":
        vectors = vectors / np.maximum(np.sqrt(squares), COSINE_EPS)
        squares = np.einsum("ij,ij->i", vectors, vectors)[:, None]
    product = vectors @ centres[:, : vectors.shape[1]].T  # a query's further dimension is 0
    away = np.sqrt(np.maximum(squares + np.einsum("ij,ij->i", centres, centres) - 2 * product, 0))
    least = np.maximum(np.maximum(away - outer, inner - away), 0)
    if metric == "l2":
        return 1 - least**2
    if metric == "dot":
        return (squares + most - least**2) / 2
    return np.maximum(1 - least**2 / 2, 0)  # vectors shorter than the norms' floor score near 0


def _slack(vectors: np.ndarray, kth: np.ndarray, metric: str, most: float) -> np.ndarray:
    """By how much a bound may fall below the k-th score (a column) and still count."""
    scale = 1 + np.abs(np.where(np.isfinite(kth), kth, 0))
    if metric != "cosine":
        scale = scale + np.einsum("ij,ij->i", vectors, vectors)[:, None] + most
    return SLACK * scale


def _pruned_whole(
    clusters: tuple[np.ndarray, ...], metric: str, most: float, top_k: int, first: int, scored: Accumulator | None,
    vectors: np.ndarray, items: np.ndarray, row: np.ndarray, column: np.ndarray,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query, item and score of the best pairs, cluster by cluster; ``clusters``: order of the items by cluster, starts, bounds."""
    order, starts, inner, outer, centres = clusters
    found = []
    stripe = max(1, flat._MATRIX_CELLS // max(1, len(items)))
    for start in range(0, len(vectors), stripe):
        asked = vectors[start : start + stripe]
        bound = _best_possible(asked, centres, inner, outer, metric, most)
        nearest = np.argsort(-bound, axis=1, kind="stable")
        scores, kth = np.full((len(asked), len(items)), -np.inf), np.full((len(asked), 1), -np.inf)
        low, high = np.searchsorted(row, [start, start + stripe])
        done, width = 0, first
        while done < len(centres):
            wanted = np.zeros(bound.shape, bool)
            np.put_along_axis(wanted, nearest[:, done : done + width], True, axis=1)
            wanted &= bound >= kth - _slack(asked, kth, metric, most)
            if not wanted.any():
                break
            for c in np.flatnonzero(wanted.any(axis=0)):
                rows, columns = np.flatnonzero(wanted[:, c]), order[starts[c] : starts[c + 1]]
                scores[np.ix_(rows, columns)] = flat.similarity(asked[rows], items[columns], metric)
                if scored is not None:
                    scored.add(len(rows) * len(columns))
            scores[row[low:high] - start, column[low:high]] = -np.inf
            if len(items) > top_k:
                kth = np.partition(scores, len(items) - top_k, axis=1)[:, len(items) - top_k, None]
            done, width = done + width, width * GROWTH
        rows, columns = flat.best_of_block(scores, top_k)
        found.append((rows + start, columns, scores[rows, columns]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def search_pruned(
    queries: DataFrame,
    index: ClusterIndex,
    *,
    exclude: DataFrame | None = None,
    top_k: int = TOP_K,
    first: int = FIRST,
    item_block: int = flat.ITEM_BLOCK,
    query_block: int = flat.QUERY_BLOCK,
    shared_bytes: int = flat.SHARED_BYTES,
    report: dict | None = None,
) -> DataFrame:
    """``query_id, item_id, score, rank``: the rows of ``search`` over the index's items, by its metric.

    Items of up to ``shared_bytes`` go to every task. Beyond that, each round's probes and the best so far are written once;
    the clusters alone go to every task then, up to ``search.SHARED_BYTES``, and with more the items are searched in blocks
    without the index. So are, for the queries that are left, all items, where the bounds leave a round more than
    ``PROBES_PER_BLOCK`` clusters a query for each block of items. ``report`` gets the number of all ``pairs`` and of the ``scored`` ones, the latter an accumulator, to be read
    (``.value``) once the result has been.
    """
    metric, most = index.metric, index.most
    items = flat.usable(index.items, "item_id", "cluster_id").where(F.col("cluster_id").isNotNull())
    asked = flat.usable(queries, "query_id")
    asked = asked.select("query_id", flat._sent(asked).alias("embedding"))
    sizes = index.clusters.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("centre")).alias("dim"), F.sum("n_items").alias("items")).first()
    if sizes["n"] * (sizes["dim"] or 0) * 8 > flat.SHARED_BYTES:
        return flat.search(asked, items, exclude=exclude, top_k=top_k, metric=metric, item_block=item_block, query_block=query_block)
    table = index.clusters.orderBy("cluster_id").toArrow()
    centres = flat._matrix(table["centre"], sizes["dim"] or 0)
    ids, inner, outer = (table[c].to_numpy() for c in ("cluster_id", "inner", "outer"))
    context = queries.sparkSession.sparkContext
    scored = context.accumulator(0)
    if report is not None:
        report.update(scored=scored, pairs=(sizes["items"] or 0) * asked.count())
    dim = max(0, (sizes["dim"] or 0) - (metric == "dot"))
    if (sizes["items"] or 0) * (dim * 8 + flat.ID_BYTES) <= shared_bytes:

        def whole(catalogue: pa.Table):
            of = np.searchsorted(ids, catalogue["cluster_id"].to_numpy())
            starts = np.r_[0, np.cumsum(np.bincount(of, minlength=len(ids)))]
            clusters = context.broadcast((np.argsort(of, kind="stable"), starts, inner, outer, centres))
            return lambda: partial(_pruned_whole, clusters.value, metric, most, top_k, first, scored if report is not None else None)

        return flat._shared_search(asked, items, exclude, dim, whole)
    shared = context.broadcast((ids, inner, outer, centres))
    schema = f"query_id string, embedding {asked.schema['embedding'].dataType.simpleString()}, cluster_id " + index.clusters.schema["cluster_id"].dataType.simpleString()

    def visits(done: int, width: int):
        def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, inner, outer, centres = shared.value
            for batch in batches:
                step = max(1, flat._MATRIX_CELLS // max(1, len(ids)))
                for start in range(0, batch.num_rows if len(ids) else 0, step):
                    part = batch.slice(start, step)
                    vectors = flat._matrix(pa.chunked_array([part.column("embedding")]), len(part.column("embedding")[0]))
                    bound = _best_possible(vectors, centres, inner, outer, metric, most)
                    nearest = np.argsort(-bound, axis=1, kind="stable")[:, done : done + width]
                    best = np.take_along_axis(bound, nearest, axis=1)
                    kth = part.column("kth").fill_null(-np.inf).to_numpy()[:, None]
                    rows, places = np.nonzero(best >= kth - _slack(vectors, kth, metric, most))
                    chosen = part.select(["query_id", "embedding"]).take(pa.array(rows))
                    yield pa.RecordBatch.from_arrays([*chosen.columns, pa.array(ids[nearest[rows, places]])], ["query_id", "embedding", "cluster_id"])

        return probe

    n_items = index.clusters.select("cluster_id", "n_items")
    best, done, width = None, 0, first
    waiting = asked.withColumn("kth", F.lit(None).cast("double"))
    blocks = -(-(sizes["items"] or 0) // item_block)
    while done < sizes["n"]:
        visited = waiting.mapInArrow(visits(done, width), schema)
        if width > PROBES_PER_BLOCK * blocks:
            asks = visited.select("query_id").groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
            asks = stage(asks)
            left = asks.agg(F.count(F.lit(1)).alias("queries"), F.sum("n").alias("probes")).first()
            if (left["probes"] or 0) > PROBES_PER_BLOCK * blocks * left["queries"]:
                if report is not None:
                    scored.add(left["queries"] * sizes["items"])
                open_ = asked.join(asks.hint("merge"), "query_id", "left_semi")
                rest = flat.search(
                    open_, items, exclude=exclude, top_k=top_k, metric=metric, item_block=item_block, query_block=query_block,
                    shared_bytes=shared_bytes,
                )
                if best is None:
                    return rest
                settled = best.join(asks.hint("merge"), "query_id", "left_anti").select("query_id", "item_id", "score", "rank")
                return settled.unionByName(rest.select("query_id", "item_id", "score", "rank"))
        probes = stage(visited)
        if report is not None:
            scored.add(probes.join(n_items, "cluster_id").agg(F.sum("n_items")).first()[0] or 0)
        if best is not None and probes.isEmpty():
            break
        found = flat.search_probed(
            probes, items, exclude, flat._exact_scorer(metric, top_k), n_items=n_items, item_block=item_block, query_block=query_block
        )
        if best is not None:
            found = found.unionByName(best.drop("rank"))
        best = stage(flat.ranked_top_k(found, top_k))
        kth = best.where(F.col("rank") == top_k).select("query_id", F.col("score").alias("kth"))
        waiting = asked.join(kth.hint("merge"), "query_id", "left")
        done, width = done + width, width * GROWTH
    if best is None:
        return queries.sparkSession.createDataFrame([], f"{flat.RESULT}, rank int")
    return best


def nearest(
    queries: DataFrame,
    items: DataFrame,
    *,
    index: ClusterIndex | None = None,
    centroids: DataFrame | None = None,
    nprobe: int | None = None,
    metric: str = "cosine",
    **options,
) -> DataFrame:
    """The way of all recommendation jobs: exactly through ``index`` if one is given, else without one.

    With ``nprobe`` only the nearest clusters are searched: those of ``centroids``, ``items`` having ``cluster_id``.
    Centroids without ``nprobe`` are an index whose bounds are worked out first. An index brings its own items and metric.
    """
    if nprobe is not None:
        if centroids is None:
            raise ValueError("nprobe needs centroids")
        return flat.search_clusters(queries, items, centroids, nprobe=nprobe, metric=metric, **options)
    if index is None and centroids is not None:
        index = index_clusters(items, metric)
    if index is None:
        return flat.search(queries, items, metric=metric, **options)
    if index.metric != metric:
        raise ValueError(f"the index is for {index.metric}, asked for {metric}")
    return search_pruned(queries, index, **options)
