"""Hard-negative mining by Strassen's multiplication of anchor and candidate tiles (operator 13).

The candidates are dealt to tasks once; every anchor passes each task once. A task multiplies tiles of anchors with tiles
of its candidates by Strassen's recursion on int64, whose additions and products are exact, and keeps the best of each
anchor in heaps of bounded size. Heaps of two tiles or of two tasks merge into one. Two passes are needed: the first finds
each anchor's positives, whose scores set the window that the second one's negatives must be in.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nextrail.sources.tables import stage

#: Candidates of one tile, and of one task at most.
TILE_ROWS, TASK_ROWS = 4096, 65_536
#: Anchors of one tile.
ANCHOR_ROWS = 256
#: Up to this many rows or columns numpy multiplies.
LEAF = 32
#: Scores times 100 must fit a long.
MOST_SCORE = 2**63 // 128


def strassen(a: np.ndarray, b: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """``a @ b`` for int64 matrices by seven products of halves; odd sides are padded with a zero row or column."""
    rows, inner, columns = a.shape[0], a.shape[1], b.shape[1]
    if min(rows, inner, columns) <= leaf:
        return a @ b
    if rows % 2 or inner % 2 or columns % 2:
        a = np.pad(a, ((0, rows % 2), (0, inner % 2)))
        b = np.pad(b, ((0, inner % 2), (0, columns % 2)))
    m, k, n = a.shape[0] // 2, a.shape[1] // 2, b.shape[1] // 2
    a11, a12, a21, a22 = a[:m, :k], a[:m, k:], a[m:, :k], a[m:, k:]
    b11, b12, b21, b22 = b[:k, :n], b[:k, n:], b[k:, :n], b[k:, n:]
    p1 = strassen(a11 + a22, b11 + b22, leaf)
    p2 = strassen(a21 + a22, b11, leaf)
    p3 = strassen(a11, b12 - b22, leaf)
    p4 = strassen(a22, b21 - b11, leaf)
    p5 = strassen(a11 + a12, b22, leaf)
    p6 = strassen(a21 - a11, b11 + b12, leaf)
    p7 = strassen(a12 - a22, b21 + b22, leaf)
    out = np.empty((2 * m, 2 * n), np.int64)
    out[:m, :n] = p1 + p4 - p5 + p7
    out[:m, n:] = p3 + p5
    out[m:, :n] = p2 + p4
    out[m:, n:] = p1 - p2 + p3 + p6
    return out[:rows, :columns]


class Heap:
    """The best ``size`` of (score, id): higher scores first, of equal ones the smaller id; two heaps merge into one."""

    def __init__(self, size: int) -> None:
        self.size = size
        self.scores, self.ids = np.empty(0, np.int64), np.empty(0, np.int64)

    def merge(self, scores: np.ndarray, ids: np.ndarray) -> None:
        if len(self.scores) == self.size and len(scores):
            near = scores >= self.scores[-1]
            scores, ids = scores[near], ids[near]
        if len(scores) > 4 * self.size:
            near = scores >= np.partition(scores, len(scores) - self.size)[len(scores) - self.size]
            scores, ids = scores[near], ids[near]
        if not len(scores):
            return
        scores, ids = np.concatenate([self.scores, scores]), np.concatenate([self.ids, ids])
        best = np.lexsort((ids, -scores))[: self.size]
        self.scores, self.ids = scores[best], ids[best]


def _check(rows: DataFrame) -> tuple[int, int]:
    """Number and length of the vectors; raises where they differ in length or a score may not fit."""
    most = F.array_max(F.transform("vector", lambda x: F.abs(x.cast("double"))))
    found = rows.agg(F.count(F.lit(1)).alias("n"), F.min(F.size("vector")).alias("low"), F.max(F.size("vector")).alias("high"), F.max(most).alias("most")).first()
    if found["n"] and found["low"] != found["high"]:
        raise ValueError("vectors differ in length")
    if (found["most"] or 0) ** 2 * (found["high"] or 0) >= MOST_SCORE:
        raise ValueError("components are too large for scores of 64 bits")
    return found["n"], found["high"] or 0


def _met(candidates: DataFrame, anchors: DataFrame, tasks: int) -> DataFrame:
    """Candidates by task, and behind them every anchor once per task."""
    here = candidates.select(
        F.pmod(F.xxhash64("uid"), F.lit(tasks)).cast("int").alias("task"), F.lit(0).cast("byte").alias("asks"),
        "uid", "vec_id", "label", "vector", F.lit(None).cast("array<long>").alias("given"),
    )
    asking = anchors.select(
        F.explode(F.sequence(F.lit(0), F.lit(tasks - 1))).alias("task"), F.lit(1).cast("byte").alias("asks"),
        "uid", "vec_id", "label", "vector", "given",
    )
    met = here.unionByName(asking).repartitionById(tasks, "task")
    return met.sortWithinPartitions("task", "asks", "uid")


def _mined(met: DataFrame, dims: int, size: int, window: tuple[int, int, int] | None) -> DataFrame:
    """``uid, given, vec_id, score``: heaps of each task, for each anchor or, in a window, each of its ``given`` scores.

    ``given`` is the number of the given score, 0 without a window.
    """

    def answers(anchors: list[tuple], tiles: list[tuple]) -> Iterator[tuple]:
        ids, labels = np.array([a[1] for a in anchors]), [a[2] for a in anchors]
        left = np.stack([a[3] for a in anchors])
        heaps = [[Heap(size) for _ in (a[4] if window else (0,))] for a in anchors]
        for tile_ids, tile_labels, right in tiles:
            scores = strassen(left, right)
            for row, (uid_heaps, anchor) in enumerate(zip(heaps, anchors, strict=True)):
                score = scores[row]
                if window is None:
                    usable = (tile_labels == labels[row]) & (tile_ids != ids[row])
                    uid_heaps[0].merge(score[usable], tile_ids[usable])
                    continue
                low, whole, high = window
                other = (tile_labels != labels[row]) & (tile_ids != ids[row])
                other_scores, other_ids = score[other], tile_ids[other]
                for heap, given in zip(uid_heaps, anchor[4], strict=True):
                    inside = (low * given <= whole * other_scores) & (whole * other_scores <= high * given)
                    heap.merge(other_scores[inside], other_ids[inside])
        for anchor, uid_heaps in zip(anchors, heaps, strict=True):
            for number, heap in enumerate(uid_heaps):
                yield anchor[0], number, heap

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, held, tiles, anchors = None, [], [], []

        def closed() -> None:
            """The candidates held so far become one tile, its vectors as columns."""
            if held:
                ids, labels, vectors = (np.concatenate(x) for x in zip(*held, strict=True))
                for at in range(0, len(ids), TILE_ROWS):
                    part = slice(at, at + TILE_ROWS)
                    tiles.append((ids[part], labels[part], np.ascontiguousarray(vectors[part].T)))
                held.clear()

        def answered() -> Iterator[pa.RecordBatch]:
            closed()
            rows = [(uid, number, heap) for uid, number, heap in answers(anchors, tiles) if len(heap.ids)] if anchors and tiles else []
            anchors.clear()
            if rows:
                counts = [len(heap.ids) for _, _, heap in rows]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.repeat(np.array([uid for uid, _, _ in rows], np.int64), counts)),
                        pa.array(np.repeat(np.array([number for _, number, _ in rows], np.int32), counts)),
                        pa.array(np.concatenate([heap.ids for _, _, heap in rows])),
                        pa.array(np.concatenate([heap.scores for _, _, heap in rows])),
                    ],
                    ["uid", "given", "vec_id", "score"],
                )

        for batch in batches:
            if not batch.num_rows:
                continue
            tasks, asks = batch.column("task").to_numpy(), batch.column("asks").to_numpy()
            matrix = batch.column("vector").flatten().to_numpy().reshape(batch.num_rows, dims)
            uids, ids, labels = (batch.column(c).to_numpy() for c in ("uid", "vec_id", "label"))
            given = batch.column("given")
            borders = np.flatnonzero((tasks[1:] != tasks[:-1]) | (asks[1:] != asks[:-1])) + 1
            for start, end in zip([0, *borders], [*borders, len(tasks)], strict=True):
                if tasks[start] != task:
                    yield from answered()
                    task, tiles = tasks[start], []
                if not asks[start]:
                    held.append((ids[start:end], labels[start:end], matrix[start:end]))
                    continue
                for row in range(start, end):
                    anchors.append((uids[row], ids[row], labels[row], matrix[row], given[row].as_py()))
                    if len(anchors) == ANCHOR_ROWS:
                        yield from answered()
        yield from answered()

    return met.mapInArrow(run, "uid long, given int, vec_id long, score long")


def _ranked(found: DataFrame, size: int) -> DataFrame:
    """The heaps of all tasks merged: the best ``size`` rows of each anchor and given score, with their ``rank``."""
    order = Window.partitionBy("uid", "given").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= size)


def mine(vectors: DataFrame, anchors_every: int, positives: int, negatives: int, window: tuple[int, int, int]) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    ``vectors`` has ``vec_id`` (long), ``label`` (integer) and ``vector`` (array<long>); rows with a null among these take no
    part. Anchors are the rows whose id is divisible by ``anchors_every``, each for itself. Its positives are the best
    ``positives`` rows with its label but not its id, by integer inner product, ties to the smaller id. For each of them the
    best ``negatives`` rows of other labels are given whose score is in the window: with ``(low, whole, high)``,
    ``low * positive_score <= whole * score <= high * positive_score``. Fewer rows are all given; an anchor without
    positives, or a positive whose window is empty, gives none. Repeated rows count as often as they are there. An empty
    table gives an empty one. Vectors that differ in length, or whose scores may not fit 64 bits, are an error.
    """
    known = vectors.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), "vector").dropna()
    known = stage(known.withColumn("uid", F.monotonically_increasing_id()))
    n, dims = _check(known)
    spread = min(known.sparkSession.sparkContext.defaultParallelism, -(-n // TILE_ROWS))
    tasks = max(1, -(-n // TASK_ROWS), spread)
    anchors = known.where(F.col("vec_id") % anchors_every == 0)
    nothing = F.lit(None).cast("array<long>")

    near = _ranked(_mined(_met(known, anchors.withColumn("given", nothing), tasks), dims, positives, None), positives)
    near = stage(near.select("uid", "rank", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")))
    # At most ``positives`` scores in the order of their rank.
    lists = near.groupBy("uid").agg(F.array_sort(F.collect_list(F.struct("rank", "positive_score"))).alias("near"))
    asking = anchors.join(lists, "uid").withColumn("given", F.transform("near", lambda x: x["positive_score"]))
    far = _ranked(_mined(_met(known, asking, tasks), dims, negatives, window), negatives)
    named = near.join(anchors.select("uid", F.col("vec_id").alias("anchor_id")), "uid").withColumn("given", F.col("rank") - 1).drop("rank")
    return far.join(named, ["uid", "given"]).select(
        "anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )


ORACLE = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    CAST(list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS DOUBLE[]) AS vector
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, CAST(list_dot_product(a.vector, c.vector) AS BIGINT) AS score
  FROM v a JOIN v c ON a.vec_id <> c.vec_id WHERE a.vec_id % 100 = 0
), positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT anchor_id, positive_id,
  CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
  vec_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scored USING (anchor_id)
WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY rank <= 10
"""
