"""Two-level clustering of vectors, without a list of all centres on the driver (K4).

A coarse level of about the fourth root of the number of rows is trained first; then each coarse cluster is split in its own
group. A group is trained by one task on a number of its rows that is bounded by the number of its centres, the first by a
hash; every row is then assigned, rows meeting the centres of their group in blocks. This is the same at all sizes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nextrail.functions.vectors import as_double, dot
from nextrail.operators.pruned import point
from nextrail.operators.search import n_lists
from nextrail.operators.skew import default_parts
from nextrail.operators.vector_sums import lists, matrix
from nextrail.sources.tables import stage

#: Rows per centre that are trained on, at most.
TRAINED_ROWS = 512
#: Candidates among which each further centre of a start is chosen.
_TRIES = 8
#: Rows of a group that meet a copy of its centres in one block.
BLOCK_ROWS = 65_536
_CELLS = 4_000_000


def _nearest(vectors: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The place of the nearest centre, of equally near ones the first."""
    out = np.empty(len(vectors), np.int64)
    squares = np.einsum("ij,ij->i", centres, centres)
    step = max(1, _CELLS // len(centres))
    for start in range(0, len(vectors), step):
        part = vectors[start : start + step]
        away = np.einsum("ij,ij->i", part, part)[:, None] + squares - 2 * part @ centres.T
        out[start : start + step] = np.round(away, 12).argmin(axis=1)
    return out


def assign(points: DataFrame, centres: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``points`` (item_id, group, point) with the ``place`` of the nearest of the group's centres (group, place, centre).

    A group is cut into blocks, each with a copy of the group's centres; a task holds these and a batch of rows. Rows of a
    group without centres are left out.
    """
    counts = points.groupBy("group").agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias("blocks"))
    sizes = stage(counts)
    rows = points.join(sizes, "group").select(
        "group", F.pmod(F.xxhash64("item_id"), "blocks").cast("int").alias("block"), F.lit(1).alias("role"), F.lit(0).alias("place"), "item_id", "point"
    )
    heads = centres.join(sizes, "group").select(
        "group", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(0).alias("role"), "place",
        F.lit(None).cast("string").alias("item_id"), F.col("centre").alias("point"),
    )

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, known = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.stack([batch.column(c).to_numpy() for c in ("group", "block", "role")])
            vectors = matrix(batch.column("point"))
            borders = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1
            for start, end in zip([0, *borders], [*borders, batch.num_rows], strict=True):
                if (group := tuple(key[:2, start])) != now:
                    now, held, known = group, [], None
                if not key[2, start]:
                    held.append((batch.column("place").to_numpy()[start:end], vectors[start:end]))
                    continue
                if known is None and held:
                    known = tuple(np.concatenate(x) for x in zip(*held, strict=True))
                if known is not None:
                    part = batch.slice(start, end - start)
                    places = known[0][_nearest(vectors[start:end], known[1])]
                    yield pa.RecordBatch.from_arrays(
                        [part.column("item_id"), part.column("group"), pa.array(places.astype(np.int32)), part.column("point")],
                        ["item_id", "group", "place", "point"],
                    )

    met = rows.unionByName(heads).repartition(default_parts(points), "group", "block")
    met = met.sortWithinPartitions("group", "block", "role", "place")
    return met.mapInArrow(find, "item_id string, group int, place int, point array<double>")


def _fit(vectors: np.ndarray, k: int, rounds: int, random: np.random.Generator | None) -> np.ndarray:
    """``k`` centres, fewer if there are fewer different rows, after so many rounds.

    Without ``random`` the first ``k`` rows are the start. With it each next one is drawn with weights of the squared
    distance from those already there, the best of some tries. A centre moves to the mean of the rows nearest to it, or stays
    if it has none.
    """
    if random is None:
        centres = vectors[:k].copy()
    else:
        chosen, away = [0], ((vectors - vectors[0]) ** 2).sum(axis=1)
        while len(chosen) < k and away.sum() > 0:
            tries = random.choice(len(vectors), size=_TRIES, p=away / away.sum())
            left = [np.minimum(away, ((vectors - vectors[i]) ** 2).sum(axis=1)) for i in tries]
            best = int(np.argmin([x.sum() for x in left]))
            chosen.append(int(tries[best]))
            away = left[best]
        centres = vectors[chosen]
    for _ in range(rounds):
        place = _nearest(vectors, centres)
        count = np.bincount(place, minlength=len(centres))
        totals = np.zeros(centres.shape)
        np.add.at(totals, place, vectors)
        centres = np.where(count[:, None] > 0, totals / np.maximum(count, 1)[:, None], centres)
    return centres


def train(points: DataFrame, counts: DataFrame, *, rounds: int, seed: int = 0, spread: bool = True) -> DataFrame:
    """Centres ``group, place, centre`` of ``points`` (item_id, group, point); ``counts``: group and its number ``k`` of centres.

    Each group is trained on its ``TRAINED_ROWS * k`` rows with the least md5 of seed and id, cut before the shuffle.
    ``spread``: whether the start is spread out or the first ``k`` of these rows.
    """
    draw = F.md5(F.concat(F.lit(f"{seed}|"), "item_id"))
    first = Window.partitionBy("group").orderBy("draw", "item_id")
    drawn = points.withColumn("draw", draw).join(counts, "group").withColumn("nth", F.row_number().over(first))
    drawn = drawn.where(F.col("nth") <= TRAINED_ROWS * F.col("k"))

    def fit(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("nth")
        group, k = key[0].as_py(), rows["k"][0].as_py()
        random = np.random.default_rng([seed, group]) if spread else None
        centres = _fit(matrix(pa.concat_arrays(rows["point"].chunks)), k, rounds, random)
        groups, places = (pa.array(x, pa.int32()) for x in ([group] * len(centres), range(len(centres))))
        return pa.table({"group": groups, "place": places, "centre": lists(centres)})

    taught = drawn.select("group", "k", "nth", "point").groupBy("group")
    return stage(taught.applyInArrow(fit, "group int, place int, centre array<double>"))


def two_levels(
    points: DataFrame, n_clusters: int, *, rounds: int = 10, seed: int = 0, spread: bool = True
) -> tuple[DataFrame, DataFrame]:
    """``item_id, cluster_id`` for staged ``points`` (item_id, point), and the centres ``cluster_id, centroid``.

    The coarse level has the root of ``n_clusters``, to a power of two; each coarse cluster is then given its share of the
    clusters by its rows, one at least. Only the sizes of the coarse clusters come to the driver. ``spread``: see ``train``.
    """
    whole = points.select("item_id", F.lit(0).alias("group"), "point")
    coarse = min(n_clusters, 2 ** (max(1, n_clusters).bit_length() // 2))
    count = points.sparkSession.createDataFrame([(0, coarse)], "group int, k int")
    first = train(whole, count, rounds=rounds, seed=seed, spread=spread)

    grouped = stage(assign(whole, first).select("item_id", F.col("place").alias("group"), "point"))
    sizes = {r["group"]: r["n"] for r in grouped.groupBy("group").agg(F.count(F.lit(1)).alias("n")).collect()}
    shares = _shares(sizes, max(n_clusters, len(sizes)))
    counts = points.sparkSession.createDataFrame(list(shares.items()), "group int, k int")
    centres = train(grouped, counts, rounds=rounds, seed=seed, spread=spread)
    offsets = [(group, sum(k for other, k in shares.items() if other < group)) for group in shares]
    offsets = points.sparkSession.createDataFrame(offsets, "group int, before int")

    def numbered(rows: DataFrame, *columns: Column | str) -> DataFrame:
        return rows.join(offsets, "group").select((F.col("before") + F.col("place")).cast("int").alias("cluster_id"), *columns)

    found = numbered(assign(grouped, centres), "item_id").select("item_id", "cluster_id")
    return found, numbered(centres, F.col("centre").alias("centroid"))


def cluster_items(
    items: DataFrame, *, n_clusters: int | None = None, seed: int = 0, rounds: int = 10, metric: str = "cosine"
) -> tuple[DataFrame, DataFrame]:
    """The items that have a vector and an id with ``cluster_id``, and the centroids, trained for ``metric`` (K4).

    Ids become text; rows under one id are clustered by their own vectors.
    """
    kept = items.where("embedding IS NOT NULL AND item_id IS NOT NULL").withColumn("item_id", F.col("item_id").cast("string"))
    kept = stage(kept.withColumn("_uid", F.monotonically_increasing_id()))
    most = 0.0
    if metric == "dot":
        vector = as_double(F.col("embedding"))
        most = kept.agg(F.max(dot(vector, vector))).first()[0] or 0.0
    numbered = kept.select(F.concat_ws("/", "item_id", "_uid").alias("item_id"), point(F.col("embedding"), metric, most).alias("point"))
    found, centroids = two_levels(stage(numbered), n_clusters or n_lists(kept.count()), rounds=rounds, seed=seed)
    found = found.select(F.substring_index("item_id", "/", -1).cast("long").alias("_uid"), "cluster_id")
    # One row each on both sides: by the size of its file alone a table that compresses well would be sent to all tasks.
    return kept.join(found.hint("merge"), "_uid").drop("_uid"), centroids


def _shares(sizes: dict[int, int], total: int) -> dict[int, int]:
    """``total`` dealt to the groups by their sizes, one at least, the rest to the largest remainders."""
    rows = sum(sizes.values())
    spare = total - len(sizes)
    exact = {g: spare * n / rows for g, n in sorted(sizes.items())}
    shares = {g: 1 + int(x) for g, x in exact.items()}
    left = total - sum(shares.values())
    for g in sorted(exact, key=lambda g: (int(exact[g]) - exact[g], g))[:left]:
        shares[g] += 1
    return shares
