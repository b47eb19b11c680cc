"""Exact top-k search by inner product without random access (operator 1).

The candidates are dealt to tasks, and within a task to blocks of bounded size. A block keeps one list per dimension, sorted
by component; a query reads each from the end where its own component makes the largest products. The lists are read in
slices, next always those of the group of lists whose frontier products fall most per row. What is read gives each candidate a
lower bound and an upper bound: the part not read is at most the lists' frontiers, and at most the product of the norms that
are left of the query and of the candidate. Candidates whose upper bound is below the k-th best lower bound, or the k-th
score of the blocks before, are left out for good; once few remain, their final scores are resolved. Every query passes each
task once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nextrail.sources.tables import stage

#: Candidates in a block, and in a task at most.
BLOCK_ROWS, TASK_ROWS = 4096, 65_536
#: Share of a list that its first slice holds, the second having the rest, and the number of groups in which lists are read.
FIRST_SLICE, GROUPS = 1 / 2, 8
#: Share by which bounds are widened, for sums of rounded products.
MARGIN = 1e-9


class SortedLists:
    """The integer vectors of a block, one sorted list per dimension."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        order = np.argsort(ids, kind="stable")  # so that of equal scores the smaller id comes first
        self.ids, self.vectors = ids[order], vectors[order]
        self._columns = np.ascontiguousarray(self.vectors.T.astype(np.float64))
        self._order = np.argsort(self._columns, axis=1, kind="stable")
        self._values = np.take_along_axis(self._columns, self._order, axis=1)
        self._squares = (self._columns**2).sum(axis=0)

    def top(self, query: np.ndarray, k: int, skip: object = None, known_kth: float = -np.inf) -> tuple[np.ndarray, np.ndarray, float]:
        """Ids and scores of the k best that reach ``known_kth``, ties to the smaller id, and the share of the lists read.

        ``skip`` is the id that takes no part; ``known_kth`` a score that the k-th best of all has at least.
        """
        n, dims = self.vectors.shape
        weight = query.astype(np.float64)
        up, heavy = weight >= 0, weight * weight
        part = here = np.arange(n) if skip is None else np.flatnonzero(self.ids != skip)
        read = 0
        if len(part) > 4 * k:
            half = min(n, max(k, int(n * FIRST_SLICE)))
            # The products at the top of each list, where its first slice ends, and at its end.
            top, mid, end = (np.where(up, self._values[:, n - i], self._values[:, i - 1]) * weight for i in (1, half, n))
            groups = np.array_split(np.argsort(-heavy, kind="stable"), min(GROUPS, dims))
            falls = [[(mid[g] - end[g]).sum() / max(1, n - half), (top[g] - mid[g]).sum() / half] for g in groups]
            upper, lower, half_read = np.full(n, top.sum()), np.full(n, end.sum()), {}
            exact, left, left_of_query = np.zeros(n), self._squares.copy(), heavy.sum()
            margin = MARGIN * (1 + np.sqrt(left_of_query * self._squares.max()))
            norms = np.sqrt(left_of_query * left)
        while len(here) > 4 * k and any(falls):
            at = max((i for i, f in enumerate(falls) if f), key=lambda i: falls[i][-1])
            falls[at].pop()
            group = groups[at]
            if at not in half_read:  # the first slice of each list
                high, low = np.repeat(mid[group][:, None], n, axis=1), np.repeat(end[group][:, None], n, axis=1)
                for row, d in enumerate(group):
                    taken = slice(n - half, n) if up[d] else slice(0, half)
                    places, products = self._order[d, taken], weight[d] * self._values[d, taken]
                    high[row, places] = products
                    low[row, places] = products
                half_read[at] = high.sum(axis=0), low.sum(axis=0)
                upper += half_read[at][0] - top[group].sum()
                lower += half_read[at][1] - end[group].sum()
                read += half * len(group)
            else:  # the lists to their ends: every product is known
                products = weight[group] @ self._columns[group]
                upper += products - half_read[at][0]
                lower += products - half_read[at][1]
                exact += products
                left -= np.einsum("ij,ij->j", self._columns[group], self._columns[group])
                left_of_query -= heavy[group].sum()
                norms = np.sqrt(max(left_of_query, 0) * np.maximum(left, 0))
                read += (n - half) * len(group)
            least = np.maximum(lower, exact - norms)[part]
            kth = np.partition(least, len(least) - k)[len(least) - k]
            # Bounds are sums of rounded numbers; the margin keeps every candidate that could qualify.
            here = here[np.minimum(upper, exact + norms)[here] >= max(kth, known_kth) - 2 * margin]
        scores = self.vectors[here] @ query
        best = np.lexsort((self.ids[here], -scores))[:k]
        best = best[scores[best] >= known_kth]
        return self.ids[here][best], scores[best], read / max(1, n * dims)


class Blocks:
    """All candidates of a task, in blocks that are gone through one after the other."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, block_rows: int = BLOCK_ROWS) -> None:
        parts = [slice(at, at + block_rows) for at in range(0, len(ids), block_rows)]
        self._lists = [SortedLists(ids[part], vectors[part]) for part in parts]

    def top(self, query: np.ndarray, k: int, skip: object = None) -> tuple[np.ndarray, np.ndarray, float]:
        """The k best of all blocks; the k-th score of those gone through bounds the next. Also the mean share read."""
        ids, scores, shares = np.empty(0, np.int64), np.empty(0, np.int64), []
        for lists in self._lists:
            kth = scores[-1] if len(scores) == k else -np.inf
            found, more, share = lists.top(query, k, skip, kth)
            shares.append(share)
            ids, scores = np.concatenate([ids, found]), np.concatenate([scores, more])
            best = np.lexsort((ids, -scores))[:k]
            ids, scores = ids[best], scores[best]
        return ids, scores, float(np.mean(shares)) if shares else 0.0


def quantised(vector: Column, scale: int) -> Column:
    """floor(scale * x) of each component as double; null if the vector or a component is null or not finite."""
    numbers = F.transform(vector.cast("array<double>"), lambda x: F.floor(x * F.lit(float(scale))).cast("long"))
    odd = F.exists(vector.cast("array<double>"), lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(vector.isNotNull() & ~F.coalesce(odd, F.lit(True)), numbers)


def top_k(
    vectors: DataFrame, queries: DataFrame, k: int, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each query the ``k`` candidates with the highest integer inner product.

    ``vectors`` and ``queries`` have ``vec_id`` (long) and ``vector`` (array<long>, not null). Ties go to the smaller
    ``vec_id``; candidates with the query's own id take no part; fewer than ``k`` give fewer rows. Rows with a null id
    take no part. A repeated candidate row is listed as often as it is there; equal query rows give one result,
    and one query id with several vectors is an error. All vectors must have one length. No candidates give no rows.
    """
    kept = vectors.where(F.col("vec_id").isNotNull()).select(
        "vec_id", "vector", F.monotonically_increasing_id().alias("_uid")
    )
    kept = stage(kept)
    sizes = kept.agg(F.count(F.lit(1)).alias("n"), F.min(F.size("vector")).alias("least"), F.max(F.size("vector")).alias("most")).first()
    asked = stage(queries.where(F.col("vec_id").isNotNull()).select("vec_id", "vector").distinct())
    wrong = asked.agg(F.count(F.lit(1)) - F.countDistinct("vec_id"), F.min(F.size("vector")), F.max(F.size("vector"))).first()
    if wrong[0]:
        raise ValueError("a query id has several vectors")
    if len({sizes["least"], sizes["most"], wrong[1], wrong[2]} - {None}) > 1:
        raise ValueError("vectors differ in length")
    dims = sizes["most"] or wrong[2] or 0
    spread = min(vectors.sparkSession.sparkContext.defaultParallelism, -(-sizes["n"] // block_rows))
    tasks = max(1, -(-sizes["n"] // max(TASK_ROWS, block_rows)), spread)
    none = F.lit(None).cast("long")
    items = kept.select(
        F.pmod(F.xxhash64("_uid"), F.lit(tasks)).cast("int").alias("task"), none.alias("query_id"), "vec_id", "vector"
    )
    asking = asked.select(
        F.explode(F.sequence(F.lit(0), F.lit(tasks - 1))).alias("task"),
        F.col("vec_id").alias("query_id"), none.alias("vec_id"), "vector",
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, ids, parts, blocks = None, [], [], None
        for batch in batches:
            of = batch.column("task").to_numpy()
            asks = batch.column("query_id").is_valid().to_numpy(zero_copy_only=False)
            matrix = batch.column("vector").flatten().to_numpy().reshape(batch.num_rows, dims)
            query_ids = batch.column("query_id").fill_null(0).to_numpy()
            vec_ids = batch.column("vec_id").fill_null(0).to_numpy()
            out: list[tuple] = []
            borders = np.flatnonzero((of[1:] != of[:-1]) | (asks[1:] != asks[:-1])) + 1
            for start, end in zip([0, *borders], [*borders, len(of)], strict=True):
                if start == end:
                    continue
                if of[start] != task:
                    task, ids, parts, blocks = of[start], [], [], None
                if not asks[start]:
                    ids.append(vec_ids[start:end])
                    parts.append(matrix[start:end])
                    continue
                if blocks is None and ids:
                    blocks = Blocks(np.concatenate(ids), np.concatenate(parts), block_rows)
                    ids, parts = [], []
                for row in range(start, end) if blocks else ():
                    found, scores, _ = blocks.top(matrix[row], k, query_ids[row])
                    out += zip([query_ids[row]] * len(found), found, scores, strict=True)
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.array(x, np.int64)) for x in zip(*out, strict=True)], ["query_id", "vec_id", "score"]
                )

    met = items.unionByName(asking).repartitionById(tasks, "task")
    met = met.sortWithinPartitions("task", F.col("query_id").isNotNull(), "vec_id")
    found = met.mapInArrow(run, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS vector
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id,
    CAST(list_dot_product(CAST(q.vector AS DOUBLE[]), CAST(c.vector AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0
), ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
  FROM scored
)
SELECT * FROM ranked WHERE rank <= 10
"""
