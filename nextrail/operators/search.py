"""Exact and partitioned top-k search by vector similarity.

A catalogue of checked size goes to every task once, and the queries stream past it. A larger one meets the
queries in blocks: a block pair is one group of an Arrow co-group, scored by one matrix product, which gives back the
best ``top_k`` per query only. No pair of a query and an item ever becomes a row. Block counts follow from the sizes
of both sides per cluster, so a large cluster, or one that many queries probe, is cut into as many blocks as it
needs.

Rows without a vector or without an id take no part, on either side. Ids are text. A query id stands for one query.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from nextrail.config import METRICS, NPROBE, RECALL, TOP_K
from nextrail.functions.vectors import COSINE_EPS, as_double
from nextrail.operators.skew import default_parts, join_lookup
from nextrail.sources.tables import stage

#: Queries, at most, by which the number of probes is measured.
RECALL_QUERIES = 1024
#: Bytes of vectors and ids up to which a catalogue is sent to all tasks, and what an id is reckoned at.
SHARED_BYTES, ID_BYTES = 64 << 20, 64
#: Rows of a block: each item goes to every query block and each query, with its best, to every item block.
ITEM_BLOCK = 262_144
QUERY_BLOCK = 65_536
# Least number of queries and of items in a block that is cut for the tasks' sake, and scores held at a time.
_MIN_QUERIES = 256
_MIN_ITEMS = 4096
# What a query with its best of a block weighs, in items.
_QUERY_WEIGHT = 3
_MATRIX_CELLS = 4_000_000
# Columns of a group whose maximum is looked at first.
_GROUP = 64
# Queries and items of a tile that is scored in single precision, and the share of a row's cells beyond which its candidates are too many.
_TILE_QUERIES, _TILE_ITEMS, _DENSE = 512, 2048, 8
# Queries that go through the clusters of a bundle together.
_PROBING_QUERIES = 2048
# Pairs of blocks, at most, that are dealt one by one.
_DEALT_PAIRS = 4096
# Scores that agree to this many digits are ties, ordered by item id.
TIE_DIGITS = 9


def n_lists(n_items: int) -> int:
    """Number of clusters for an index: 2 to the whole part of log2(n) / 2 (K3)."""
    return 2 ** int(math.log2(n_items) / 2) if n_items > 0 else 1


def _matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    flat = column.combine_chunks()
    if isinstance(flat, pa.ChunkedArray):
        flat = pa.concat_arrays(flat.chunks)
    values = flat.flatten().to_numpy(zero_copy_only=False)
    if len(values) != len(column) * dim:
        raise ValueError("vectors of different lengths")
    return values.astype(np.float64, copy=False).reshape(len(column), dim)


def _runs(ids: pa.ChunkedArray) -> tuple[pa.Array, np.ndarray]:
    """The distinct ids of a sorted column, and where each begins, the end last."""
    flat = pa.concat_arrays(ids.chunks) if ids.num_chunks else pa.array([], pa.string())
    if not len(flat):
        return flat, np.zeros(1, np.int64)
    new = pc.not_equal(flat.slice(1), flat.slice(0, len(flat) - 1)).to_numpy(zero_copy_only=False)
    starts = np.r_[0, np.flatnonzero(new) + 1]
    return flat.take(pa.array(starts)), np.r_[starts, len(flat)]


def _barred_places(
    row: np.ndarray, asked: pa.Array | pa.ChunkedArray, ids: pa.Array, starts: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Row (ascending) and column of every place whose id is excluded; an id that is there twice is barred twice."""
    found = pc.index_in(asked, value_set=ids)
    found = found.combine_chunks() if isinstance(found, pa.ChunkedArray) else found
    known = found.is_valid().to_numpy(zero_copy_only=False)
    run, row = found.fill_null(0).to_numpy(zero_copy_only=False)[known].astype(np.int64), row[known]
    times = starts[run + 1] - starts[run]
    first = np.repeat(np.cumsum(times) - times, times)
    column = np.repeat(starts[run], times) + np.arange(len(first)) - first
    row = np.repeat(row, times)
    order = np.argsort(row, kind="stable")
    return row[order], column[order]


def similarity(queries: np.ndarray, items: np.ndarray, metric: str, squares: np.ndarray | None = None) -> np.ndarray:
    """``1 - distance`` of every query with every item of a block (B15); ``squares``: the items' squared norms, if known."""
    product = queries @ items.T
    if metric == "dot":
        return product
    left = np.einsum("ij,ij->i", queries, queries)[:, None]
    right = (np.einsum("ij,ij->i", items, items) if squares is None else squares)[None, :]
    if metric == "cosine":
        return product / np.maximum(np.sqrt(left) * np.sqrt(right), COSINE_EPS)
    return 1.0 - np.maximum(left + right - 2.0 * product, 0.0)


def _contenders(scores: np.ndarray, top_k: int) -> tuple[np.ndarray, np.ndarray] | None:
    """Row and column numbers of finite scores with each row's best ``top_k`` and all ties among them; None if they are too many.

    The k-th largest of the maxima of some groups of columns is no more than the k-th largest score.
    """
    groups = scores.shape[1] // _GROUP
    if groups < 2 * top_k:
        return None
    tops = scores[:, : groups * _GROUP].reshape(len(scores), _GROUP, groups).max(axis=1)
    kth = np.partition(tops, groups - top_k, axis=1)[:, groups - top_k, None]
    if not np.isfinite(kth).all():
        return None
    rows, columns = np.nonzero(scores >= kth - (2 * 10.0**-TIE_DIGITS + 1e-12 * np.abs(kth)))
    return (rows, columns) if len(rows) * 8 <= scores.size else None


def best_of_block(scores: np.ndarray, top_k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column numbers of each row's best ``top_k`` finite scores, in order; ties by lower column."""
    if (few := _contenders(scores, top_k)) is not None:
        rows, columns = few
        ranked = np.round(scores[rows, columns], TIE_DIGITS)
        order = np.lexsort((columns, -ranked, rows))
        rows, columns = rows[order], columns[order]
        chosen = np.arange(len(rows)) - np.searchsorted(rows, rows) < top_k
        return rows[chosen], columns[chosen]
    ranked = np.round(scores, TIE_DIGITS)
    width = ranked.shape[1]
    if width > top_k:
        floor = np.partition(ranked, width - top_k, axis=1)[:, width - top_k, None]
        level = ranked == floor
        missing = top_k - (ranked > floor).sum(axis=1, keepdims=True)
        chosen = (ranked > floor) | level & (level.cumsum(axis=1) <= missing)
    else:
        chosen = np.ones(ranked.shape, bool)
    rows, columns = np.nonzero(chosen & (ranked > -np.inf))
    order = np.lexsort((columns, -ranked[rows, columns], rows))
    return rows[order], columns[order]


def _true_places(mask: np.ndarray) -> np.ndarray:
    """The flat places of what is true in a contiguous array; eight bytes are looked at together, as few are."""
    flat = mask.reshape(-1)
    if flat.size % 8:
        return np.flatnonzero(flat)
    words = np.flatnonzero(flat.view(np.uint64))
    which, byte = np.nonzero(flat.reshape(-1, 8)[words])
    return words[which] * 8 + byte


def _kth_of_tile(product: np.ndarray, top_k: int) -> np.ndarray:
    """What ``top_k`` cells of each row reach: their k-th largest, or that of the maxima of groups of columns, which is no more."""
    groups = product.shape[1] // 32
    if groups >= 2 * top_k:
        product = product[:, : groups * 32].reshape(len(product), 32, groups).max(axis=1)
    return np.partition(product, product.shape[1] - top_k, axis=1)[:, product.shape[1] - top_k].astype(np.float64)


def _pair_scores(queries: np.ndarray, items: np.ndarray, metric: str, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The ``similarity`` of each query with the item beside it; ``left`` and ``right``: their squared norms."""
    product = np.einsum("ij,ij->i", queries, items)
    if metric == "dot":
        return product
    if metric == "cosine":
        return product / np.maximum(np.sqrt(left) * np.sqrt(right), COSINE_EPS)
    return 1.0 - np.maximum(left + right - 2.0 * product, 0.0)


def _single(queries: np.ndarray, items: np.ndarray, metric: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Both sides in single precision, by whose product each query ranks the items, how far that is off at most, and which queries to leave out.

    Scores follow from the products by ``_lifted``. Left out are queries for whose numbers the bound doesn't hold.
    """
    left, right = (np.sqrt(np.einsum("ij,ij->i", x, x)) for x in (queries, items))
    odd = ~np.isfinite(left)
    if metric == "cosine":
        # Below the norms' floor a score isn't that of the directions.
        least = right[right > 0].min(initial=np.inf)
        odd |= (left > 0) & (left * least < 2 * COSINE_EPS)
        queries, items = queries / np.maximum(left, 1e-300)[:, None], items / np.maximum(right, 1e-300)[:, None]
        left, right = np.minimum(left, 1), np.minimum(right, 1)
    elif metric == "l2":
        queries, items = np.c_[queries, np.ones(len(queries))], np.c_[items, -(right**2) / 2]
        left, right = (np.sqrt(np.einsum("ij,ij->i", x, x)) for x in (queries, items))
    most = right.max(initial=0.0)
    off = (queries.shape[1] + 8) * 2.0**-23 * left * most + 1e-30
    odd |= ~(left * most < 1e30) | ~np.isfinite(left) | (left > 1e30) | (not most < 1e30)
    with np.errstate(over="ignore", invalid="ignore"):
        return np.where(odd[:, None], 0, queries).astype(np.float32), items.astype(np.float32), off, odd


def _tiled(
    vectors: np.ndarray, items: np.ndarray, metric: str, top_k: int, row: np.ndarray, column: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The rows of ``_striped`` for many items: tiles are scored in single precision, what may be among the best again in double.

    A tile's products are compared with a limit, the query's k-th score so far less what single precision may be off. A query that leaves too
    many candidates (ties, or nearly all items excluded) is scored in double precision as a whole.
    """
    single, other, off, odd = _single(vectors, items, metric)
    norms, sizes = (np.einsum("ij,ij->i", x, x) for x in (vectors, items))
    width = len(items)
    buffer, marks = np.empty(_TILE_QUERIES * _TILE_ITEMS, np.float32), np.empty(_TILE_QUERIES * _TILE_ITEMS, bool)
    found = []
    for start in range(0, len(vectors), _TILE_QUERIES):
        asked, exact = single[start : start + _TILE_QUERIES], vectors[start : start + _TILE_QUERIES]
        low, high = np.searchsorted(row, [start, start + len(asked)])
        by_item = np.argsort(column[low:high], kind="stable")
        barred, of = column[low:high][by_item], row[low:high][by_item] - start
        margin, square = off[start : start + len(asked)], norms[start : start + len(asked)]
        dense = odd[start : start + len(asked)].copy()
        limit = np.full(len(asked), -np.inf)
        kth, last = np.full(len(asked), -np.inf), np.full(len(asked), width)
        best = tuple(np.empty(0, t) for t in (np.int64, np.int64, np.float64))
        waiting, count = [], 0
        for begin in range(0, width, _TILE_ITEMS):
            tile = other[begin : begin + _TILE_ITEMS]
            cells = len(asked) * len(tile)
            product, mark = (x[:cells].reshape(len(asked), len(tile)) for x in (buffer, marks))
            np.matmul(asked, tile.T, out=product)
            one, two = np.searchsorted(barred, [begin, begin + len(tile)])
            product[of[one:two], barred[one:two] - begin] = -np.inf
            if begin == 0:
                limit = _kth_of_tile(product, top_k) - 2 * margin - 4 * 10.0**-TIE_DIGITS
                dense |= limit == -np.inf
                limit[dense] = np.inf
            np.greater_equal(product, limit.astype(np.float32)[:, None], out=mark)
            places = _true_places(mark)
            if len(places) * 2 * _DENSE > cells:
                many = mark.sum(axis=1) * _DENSE > len(tile)
                dense |= many
                limit[many] = np.inf
                places = places[~many[places // len(tile)]]
            for first in range(0, len(places), 1 << 15):
                query, item = np.divmod(places[first : first + (1 << 15)], len(tile))
                item += begin
                score = _pair_scores(exact[query], items[item], metric, square[query], sizes[item])
                ranked = np.round(score, TIE_DIGITS)
                better = (ranked > kth[query]) | (ranked == kth[query]) & (item < last[query])
                waiting.append((query[better], item[better], score[better]))
                count += len(waiting[-1][0])
            if not count or begin and count < len(asked) * top_k and begin + _TILE_ITEMS < width:
                continue
            query, item, score = (np.concatenate(x) for x in zip(best, *waiting, strict=True))
            waiting, count = [], 0
            ranked = np.round(score, TIE_DIGITS)
            order = np.lexsort((item, -ranked, query))
            query, item, score, ranked = (x[order] for x in (query, item, score, ranked))
            nth = np.arange(len(query)) - np.searchsorted(query, query)
            full = query[nth == top_k - 1]
            kth[full], last[full] = ranked[nth == top_k - 1], item[nth == top_k - 1]
            best = tuple(x[nth < top_k] for x in (query, item, score))
            reached = (kth[full] - 1 + square[full]) / 2 if metric == "l2" else kth[full]
            reached = reached - margin[full] - 2 * 10.0**-TIE_DIGITS - 1e-12 * (np.abs(reached) + square[full])
            limit[full] = np.where(dense[full], np.inf, np.maximum(limit[full], reached))
        query, item, score = best
        whole = ~dense[query]
        query, item, score = query[whole], item[whole], score[whole]
        if dense.any():
            left = np.flatnonzero(dense)
            kept = dense[row[low:high] - start]
            again = np.searchsorted(left, row[low:high][kept] - start)
            rows, items_of, scores = _striped_double(exact[left], items, metric, top_k, again, column[low:high][kept])
            query, item, score = (np.concatenate(x) for x in ((query, left[rows]), (item, items_of), (score, scores)))
            order = np.argsort(query, kind="stable")
            query, item, score = query[order], item[order], score[order]
        found.append((query + start, item, score))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _striped(
    vectors: np.ndarray, items: np.ndarray, metric: str, top_k: int, row: np.ndarray, column: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query, item and score of the best pairs; ``row`` (ascending) and ``column`` are the excluded ones."""
    if len(vectors) and len(items) >= 2 * _TILE_ITEMS and 2 * _DENSE * top_k <= _TILE_ITEMS:
        return _tiled(vectors, items, metric, top_k, row, column)
    return _striped_double(vectors, items, metric, top_k, row, column)


def _striped_double(
    vectors: np.ndarray, items: np.ndarray, metric: str, top_k: int, row: np.ndarray, column: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All scores of some queries at a time, in double precision."""
    found = []
    stripe = max(1, _MATRIX_CELLS // max(1, len(items)))
    squares = np.einsum("ij,ij->i", items, items)
    for start in range(0, len(vectors), stripe):
        scores = similarity(vectors[start : start + stripe], items, metric, squares)
        low, high = np.searchsorted(row, [start, start + stripe])
        scores[row[low:high] - start, column[low:high]] = -np.inf
        rows, columns = best_of_block(scores, top_k)
        found.append((rows + start, columns, scores[rows, columns]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _scored_whole(metric: str, top_k: int, asked: np.ndarray, items: np.ndarray, row: np.ndarray, column: np.ndarray):
    return _striped(asked, items, metric, top_k, row, column)


def usable(rows: DataFrame, id_col: str, *more: str) -> DataFrame:
    """The rows that can be searched: id as text, vector as floats or doubles; no NULL among them."""
    return rows.select(F.col(id_col).cast("string").alias(id_col), "embedding", *more).dropna(subset=[id_col, "embedding"])


def _sent(rows: DataFrame) -> Column:
    """The vectors as they are shuffled: floats stay floats, which become doubles where they are scored, anything else doubles."""
    is_float = rows.schema["embedding"].dataType.simpleString() == "array<float>"
    return F.col("embedding") if is_float else as_double(F.col("embedding"))


def _checked_sizes(items: DataFrame) -> tuple[int, int]:
    """Number and dimension of the items; raises if their vectors differ in length (H5)."""
    length = F.size("embedding")
    found = items.agg(F.count(F.lit(1)).alias("n"), F.min(length).alias("low"), F.max(length).alias("high")).first()
    if found["low"] != found["high"]:
        raise ValueError(f"vectors of different lengths: {found['low']}..{found['high']}")
    return found["n"], found["high"] or 0


RESULT = "query_id string, item_id string, score double"
#: Further columns of probes that scorers get: the probed clusters where several are searched as one.
_MORE = ("probed",)
#: Scores a block: vectors of the queries, the block's items by id, and the excluded places, to columns without the query.
Scorer = Callable[[np.ndarray, pa.Table, np.ndarray, np.ndarray], tuple[np.ndarray, dict[str, np.ndarray]]]


def _exact_scorer(metric: str, top_k: int) -> Scorer:
    def scored(vectors: np.ndarray, right: pa.Table, row: np.ndarray, column: np.ndarray):
        items = _matrix(right["embedding"], vectors.shape[1])
        query, item, score = _striped(vectors, items, metric, top_k, row, column)
        return query, {"item_id": right["item_id"].to_numpy()[item], "score": score}

    return scored


def _scored_block(scorer: Scorer, schema: pa.Schema):
    """What a block pair is turned into: the rows of ``scorer`` for its queries, which gets their further columns too."""

    def scored(left: pa.Table, right: pa.Table) -> pa.Table:
        is_query = np.asarray(left["item_id"].is_null())
        queries = left.filter(pa.array(is_query)).sort_by("query_id")
        if queries.num_rows == 0 or right.num_rows == 0:
            return schema.empty_table()
        right = right.sort_by("item_id")
        query_ids, starts = _runs(queries["query_id"])
        if len(query_ids) < queries.num_rows:
            raise ValueError("query_id is not unique")
        barred = left.filter(pa.array(~is_query))
        row = pc.index_in(barred["query_id"], value_set=query_ids)
        barred, row = barred.filter(row.is_valid()), row.drop_null().to_numpy()
        row, column = _barred_places(row, barred["item_id"], *_runs(right["item_id"]))
        vectors = _matrix(queries["embedding"], len(queries["embedding"][0]))
        more = [queries[c] for c in queries.column_names if c in _MORE]
        query, columns = scorer(vectors, right, row, column, *more)
        columns = {"query_id": query_ids.take(pa.array(query)), **columns}
        return pa.table([pa.array(columns[f.name], f.type) for f in schema], schema=schema)

    return scored


def _block(id_col: str, blocks: str) -> Column:
    return F.pmod(F.xxhash64(id_col), F.col(blocks)).cast("int")


def _balanced(n_items: float | Column, n_queries: float | Column, blocks: float | Column, weight: float) -> float | Column:
    """The number of item blocks, squared, by which least is shuffled if there are so many ``blocks``.

    Each item goes to all query blocks, each query to all item blocks, and its best come back from there.
    """
    return blocks * n_items / (weight * n_queries)


def _item_blocks(n_items: Column, n_queries: Column, block: int, parts: int, share: Column, weight: float) -> Column:
    spread = F.least(F.ceil(n_items / _MIN_ITEMS), F.ceil(F.sqrt(_balanced(n_items, n_queries, 2 * parts * share, weight))))
    return F.greatest(F.ceil(n_items / block), spread).cast("int")


def _query_blocks(n_queries: Column, item_blocks: Column, block: int, parts: int, share: Column) -> Column:
    """Blocks are as large as allowed, since every item goes to every query block and the other way round.

    A small search is still cut into some blocks per task, so that all tasks have work: two of all clusters together, of which
    each cluster has its share of the pairs.
    """
    spread = F.least(F.ceil(n_queries / _MIN_QUERIES), F.ceil(2 * parts * share / item_blocks))
    return F.greatest(F.ceil(n_queries / block), spread).cast("int")


def ranked_top_k(scored: DataFrame, top_k: int) -> DataFrame:
    """The best ``top_k`` rows per query with their ``rank``."""
    order = Window.partitionBy("query_id").orderBy(
        F.round("score", TIE_DIGITS).desc(), F.col("item_id")
    )
    ranked = scored.withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= top_k)


def _block_search(
    probes: DataFrame,
    items: DataFrame,
    exclude: DataFrame | None,
    sized: Callable[[DataFrame], DataFrame],
    scorer: Scorer,
    schema: str = RESULT,
    payload: dict[str, Column] | None = None,
    blocks: tuple[int, int] | None = None,
) -> DataFrame:
    """``probes``: query_id, embedding, cluster_id; ``items``: item_id, cluster_id and what ``payload`` is made of.

    ``sized`` adds the ``item_blocks`` and ``query_blocks`` of the cluster and drops clusters without either. ``payload``
    is what the items' side sends, the vectors unless told otherwise; ``scorer`` gives rows of ``schema``. ``blocks``: the numbers of item
    and query blocks of the only cluster; its pairs of blocks, a few per task, are then dealt evenly to the tasks.
    """
    payload = payload or {"embedding": _sent(items)}
    kind = probes.select(_sent(probes).alias("embedding")).schema["embedding"].dataType

    def every(count: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(count) - 1))

    left = sized(probes).select(
        "cluster_id",
        _block("query_id", "query_blocks").alias("query_block"),
        every("item_blocks").alias("item_block"),
        "query_id",
        F.lit(None).cast("string").alias("item_id"),
        _sent(probes).alias("embedding"),
        *[c for c in _MORE if c in probes.columns],
    )
    if exclude is not None:
        barred = sized(exclude).select(
            "cluster_id",
            _block("query_id", "query_blocks").alias("query_block"),
            _block("item_id", "item_blocks").alias("item_block"),
            "query_id",
            "item_id",
            F.lit(None).cast(kind).alias("embedding"),
            *[F.lit(None).cast(probes.schema[c].dataType).alias(c) for c in _MORE if c in probes.columns],
        )
        left = left.unionByName(barred)
    right = sized(items).select(
        "cluster_id",
        every("query_blocks").alias("query_block"),
        _block("item_id", "item_blocks").alias("item_block"),
        "item_id",
        *[value.alias(name) for name, value in payload.items()],
    )
    # The work per byte is high: a stated number of partitions keeps the engine from merging small ones.
    key = ["cluster_id", "query_block", "item_block"]
    parts = default_parts(items)
    if blocks is not None and blocks[0] * blocks[1] <= _DEALT_PAIRS:
        dealt = F.lit(_dealt(blocks[0] * blocks[1], parts)).cast("array<int>")
        pair = F.element_at(dealt, F.col("query_block") * blocks[0] + F.col("item_block") + 1).alias("pair")
        left, right, key = left.select(pair, "query_id", "item_id", "embedding"), right.select(pair, "item_id", *payload), ["pair"]
    score = _scored_block(scorer, to_arrow_schema(StructType.fromDDL(schema)))
    return (
        left.repartition(parts, *key)
        .groupBy(*key)
        .cogroup(right.repartition(parts, *key).groupBy(*key))
        .applyInArrow(score, schema)
    )


def _spark_hash(value: int) -> int:
    """Spark's ``hash`` of an int column, by which rows are dealt to partitions."""
    k = value * 0xCC9E2D51 & 0xFFFFFFFF
    k = ((k << 15 | k >> 17) & 0xFFFFFFFF) * 0x1B873593 & 0xFFFFFFFF
    h = 42 ^ k
    h = (h << 13 | h >> 19) & 0xFFFFFFFF
    h = (h * 5 + 0xE6546B64 & 0xFFFFFFFF) ^ 4
    for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
        h = (h ^ h >> shift) * factor & 0xFFFFFFFF
    h ^= h >> 16
    return h - (h >> 31 << 32)


def _dealt(count: int, parts: int) -> list[int]:
    """Different ints, of which the n-th is hashed to partition n modulo ``parts``."""
    out, waiting, value = [0] * count, [range(p, count, parts) for p in range(min(parts, count))], 0
    at, left = [0] * len(waiting), count
    while left:
        p = _spark_hash(value) % parts
        if p < len(waiting) and at[p] < len(waiting[p]):
            out[waiting[p][at[p]]] = value
            at[p], left = at[p] + 1, left - 1
        value += 1
    return out


def _distinct_exclusions(exclude: DataFrame) -> DataFrame:
    return exclude.select("query_id", "item_id").dropna().distinct()


def search(
    queries: DataFrame,
    items: DataFrame,
    *,
    exclude: DataFrame | None = None,
    top_k: int = TOP_K,
    metric: str = "cosine",
    item_block: int = ITEM_BLOCK,
    query_block: int = QUERY_BLOCK,
    shared_bytes: int = SHARED_BYTES,
) -> DataFrame:
    """Exact top-k: ``query_id, item_id, score, rank`` (K1; K2 is ``metric='dot'``).

    The items are counted and checked first; pass a staged or written table if they are costly. Repeated query ids are
    an error, found while scoring.

    ``exclude`` holds pairs ``query_id, item_id`` that are taken out before ranking, so a query gets
    ``top_k`` rows whenever that many items are left. Filtering the nearest ``2 * (top_k + excluded)``
    afterwards (F3) gives the same rows, since at least ``top_k`` of them are not excluded.
    """
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {METRICS}")
    queries, items = usable(queries, "query_id"), usable(items, "item_id")
    n_items, dim = _checked_sizes(items)
    if n_items * (dim * 8 + ID_BYTES) <= shared_bytes:
        return _shared_search(queries, items, exclude, dim, lambda _: lambda: partial(_scored_whole, metric, top_k))
    n_queries = queries.count()
    balanced = math.sqrt(_balanced(n_items, max(1, n_queries), 2 * default_parts(items), _QUERY_WEIGHT))
    item_blocks = max(1, math.ceil(n_items / item_block), min(math.ceil(n_items / _MIN_ITEMS), math.ceil(balanced)))
    spread = min(math.ceil(n_queries / _MIN_QUERIES), math.ceil(2 * default_parts(items) / item_blocks))
    blocks = {"item_blocks": item_blocks, "query_blocks": max(1, math.ceil(n_queries / query_block), spread)}

    def sized(rows: DataFrame) -> DataFrame:
        names = ("item_blocks", "query_blocks")
        return rows.withColumns({name: F.lit(blocks[name]) for name in names})

    one = F.lit(0).alias("cluster_id")
    barred = None
    if exclude is not None:
        barred = _distinct_exclusions(exclude).select("query_id", "item_id", one)
    found = _block_search(
        queries.select("query_id", "embedding", one),
        items.select("item_id", "embedding", one),
        barred,
        sized,
        _exact_scorer(metric, top_k),
        blocks=(blocks["item_blocks"], blocks["query_blocks"]),
    )
    return ranked_top_k(found, top_k)


#: Scores vectors with all items of a catalogue (in order of their ids), but for excluded places: query, item, score.
Whole = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]


def _shared_search(
    queries: DataFrame,
    items: DataFrame,
    exclude: DataFrame | None,
    dim: int,
    whole: Callable[[pa.Table], Callable[[], Whole]],
) -> DataFrame:
    """Every task gets the whole catalogue once; queries aren't shuffled but for their exclusions.

    ``whole``, given the sorted catalogue on the driver, gives what a task makes its scorer with. A query's exclusions are a
    list of known items, at most as long as the catalogue.
    """
    table = items.toArrow().sort_by("item_id")
    scorer = whole(table)
    runs = _runs(table["item_id"])
    shared = queries.sparkSession.sparkContext.broadcast((table["item_id"].to_numpy(), *runs, _matrix(table["embedding"], dim)))
    rows = queries.select("query_id", as_double(F.col("embedding")).alias("embedding"))
    # Queries hold little and cost much: every task gets its share of them, dealt as the exclusions are.
    rows = rows.repartition(default_parts(queries), "query_id")
    if exclude is not None:
        pairs = _distinct_exclusions(exclude).join(F.broadcast(items.select("item_id").distinct()), "item_id", "left_semi")
        lists = pairs.groupBy("query_id").agg(F.collect_list("item_id").alias("barred"))
        rows = rows.join(lists, "query_id", "left")
    else:
        rows = rows.withColumn("barred", F.lit(None).cast("array<string>"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, names, starts, vectors = shared.value
        score_all, before = scorer(), None
        for batch in batches:
            if not batch.num_rows:
                continue
            here = batch.column("query_id")
            if here[0].as_py() == before or pc.any(pc.equal(here.slice(1), here.slice(0, len(here) - 1))).as_py():
                raise ValueError("query_id is not unique")
            before = here[-1].as_py()
            if not len(ids):
                continue
            barred = batch.column("barred")
            times = pc.fill_null(pc.list_value_length(barred), 0).to_numpy()
            row, column = _barred_places(np.repeat(np.arange(batch.num_rows), times), barred.flatten(), names, starts)
            asked = _matrix(pa.chunked_array([batch.column("embedding")]), dim)
            query, item, scores = score_all(asked, vectors, row, column)
            first = np.searchsorted(query, query)
            rank = np.arange(len(query)) - first + 1
            names = ["query_id", "item_id", "score", "rank"]
            found = [batch.column("query_id").take(pa.array(query)), pa.array(ids[item], pa.string())]
            yield pa.RecordBatch.from_arrays([*found, pa.array(scores), pa.array(rank.astype(np.int32))], names)

    rows = rows.sortWithinPartitions("query_id")  # equal ids meet
    return rows.mapInArrow(score, f"{RESULT}, rank int")


def probe_clusters(
    queries: DataFrame, centroids: DataFrame, nprobe: int = NPROBE, metric: str = "cosine"
) -> DataFrame:
    """The ``nprobe`` clusters nearest to each query, one row each; see ``probe_lists``."""
    return probe_lists(queries, centroids, nprobe, metric).select("query_id", "embedding", F.explode("probed").alias("cluster_id"))


def probe_lists(queries: DataFrame, centroids: DataFrame, nprobe: int = NPROBE, metric: str = "cosine") -> DataFrame:
    """The ``nprobe`` clusters nearest to each query, as a list (``probed``); ties by lower id.

    For cosine that is by the distance of the unit query, as the clusters are of unit vectors; else by ``metric``.

    The centroids, about sqrt(n) rows, go to every task as one array. Where they have one dimension more than the
    queries (see ``pruned.point``), it is left out.
    """
    table = centroids.orderBy("cluster_id").toArrow()
    points = _matrix(table["centroid"], len(table["centroid"][0])) if table.num_rows else np.empty((0, 0))
    shared = queries.sparkSession.sparkContext.broadcast((table["cluster_id"].to_numpy(), points))
    plain = usable(queries, "query_id")
    plain = plain.select("query_id", _sent(plain).alias("embedding"))
    schema = f"query_id string, embedding {plain.schema['embedding'].dataType.simpleString()}, probed array<int>"

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, points = shared.value
        for batch in batches:
            if batch.num_rows == 0 or len(ids) == 0:
                continue
            vectors = _matrix(pa.chunked_array([batch.column("embedding")]), len(batch.column("embedding")[0]))
            rows, near = _nearness(vectors, points, metric, nprobe)
            ends = np.searchsorted(rows, np.arange(batch.num_rows + 1)).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(ids[near], pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.select(["query_id", "embedding"]).columns, lists], ["query_id", "embedding", "probed"])

    return plain.mapInArrow(probe, schema)


def _nearness(vectors: np.ndarray, points: np.ndarray, metric: str, nprobe: int) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and places of the ``nprobe`` points nearest to each vector, in order."""
    nothing = np.array([], np.int64)
    if metric == "cosine":
        vectors = vectors / np.maximum(np.sqrt((vectors**2).sum(axis=1, keepdims=True)), COSINE_EPS)
    rows, near, _ = _striped(vectors, points[:, : vectors.shape[1]], "dot" if metric == "dot" else "l2", nprobe, nothing, nothing)
    return rows, near


def probes_for(
    queries: DataFrame,
    items: DataFrame,
    centroids: DataFrame,
    *,
    recall: float = RECALL,
    top_k: int = TOP_K,
    least: int = NPROBE,
    metric: str = "cosine",
) -> int:
    """The fewest probes, ``least`` or more, by which ``search_clusters`` finds the share ``recall`` of the exact ``top_k``.

    Measured against the exact search on up to ``RECALL_QUERIES`` of the queries, drawn by a hash: the mean share less two
    standard errors reaches ``recall``, or all clusters are probed. As items of a probed cluster are scored exactly, an
    exact neighbour is found if its cluster's place in the query's order is among the probes.
    """
    drawn = usable(queries, "query_id").orderBy(F.xxhash64(F.lit("recall"), "query_id"), "query_id").limit(RECALL_QUERIES)
    drawn = stage(drawn.select("query_id", as_double(F.col("embedding")).alias("embedding")))
    known = usable(items, "item_id", "cluster_id").where(F.col("cluster_id").isNotNull())
    exact = search(drawn, known, top_k=top_k, metric=metric).select("query_id", "item_id")
    exact = join_lookup(exact, known.select("item_id", "cluster_id"), "item_id", "inner").select("query_id", "cluster_id")
    # RECALL_QUERIES rows, top_k times as many, and one row per cluster.
    asked, hits, clusters = drawn.toArrow(), exact.toArrow(), centroids.orderBy("cluster_id").toArrow()
    if not hits.num_rows:
        return least
    ids = clusters["cluster_id"].to_numpy()
    points = _matrix(clusters["centroid"], len(clusters["centroid"][0]))
    vectors = _matrix(asked["embedding"], len(asked["embedding"][0]))
    rows, near = _nearness(vectors, points, metric, len(ids))
    place = np.full((len(vectors), len(ids)), len(ids), np.int64)
    place[rows, near] = np.arange(len(rows)) - np.searchsorted(rows, rows)
    query = pc.index_in(hits["query_id"], value_set=asked["query_id"]).to_numpy()
    needed = place[query, np.searchsorted(ids, hits["cluster_id"].to_numpy())]
    asked_of = np.bincount(query, minlength=len(vectors))
    answered = asked_of > 0
    for nprobe in range(min(least, len(ids)), len(ids)):
        shares = np.bincount(query[needed < nprobe], minlength=len(vectors))[answered] / asked_of[answered]
        if shares.mean() - 2 * shares.std() / math.sqrt(len(shares)) >= recall:
            return nprobe
    return len(ids)


def search_clusters(
    queries: DataFrame,
    items: DataFrame,
    centroids: DataFrame,
    *,
    exclude: DataFrame | None = None,
    top_k: int = TOP_K,
    nprobe: int = NPROBE,
    metric: str = "cosine",
    item_block: int = ITEM_BLOCK,
    query_block: int = QUERY_BLOCK,
) -> DataFrame:
    """Top-k among the items of the ``nprobe`` nearest clusters, scored exactly (K5).

    With ``nprobe`` equal to the number of clusters it is the exact search: what all queries probe is one cluster, cut into blocks
    by its size, and no query is sent to each of the clusters.
    """
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {METRICS}")
    items = usable(items, "item_id", "cluster_id").where(F.col("cluster_id").isNotNull())
    if centroids.count() <= nprobe:
        probed = items.join(F.broadcast(centroids.select("cluster_id")), "cluster_id", "left_semi")
        return search(queries, probed, exclude=exclude, top_k=top_k, metric=metric, item_block=item_block, query_block=query_block)
    # One row per cluster, about the square root of the number of items.
    sizes = {r["cluster_id"]: r["n"] for r in items.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n")).collect()}
    bundle = _bundles(sizes, usable(queries, "query_id").count(), nprobe, default_parts(items), item_block)
    if not bundle:
        return ranked_top_k(queries.sparkSession.createDataFrame([], RESULT), top_k)
    probes = stage(_probed_bundles(probe_lists(queries, centroids, nprobe, metric), bundle))
    number = items.sparkSession.createDataFrame(list(bundle.items()), f"_of {items.schema['cluster_id'].dataType.simpleString()}, _bundle int")
    together = items.join(F.broadcast(number), F.col("cluster_id") == F.col("_of"))
    together = together.select("item_id", "embedding", F.col("_bundle").alias("cluster_id"), F.col("_of").cast("int").alias("_of"))
    found = search_probed(
        probes, together, exclude, _probing_scorer(metric, top_k), item_block=item_block, query_block=query_block,
        payload={"embedding": _sent(together), "_of": F.col("_of")},
    )
    return ranked_top_k(found, top_k)


def _bundles(sizes: dict[int, int], n_queries: int, nprobe: int, parts: int, item_block: int) -> dict[int, int]:
    """The bundle of each cluster: clusters are searched together up to a block of items, so a query goes to each bundle once.

    A bundle's items go to all of its query blocks: where probes are so few that clusters by themselves shuffle less, each is a bundle.
    """
    total = sum(sizes.values())
    balanced = math.sqrt(_balanced(total, max(1, n_queries), 2 * parts, _QUERY_WEIGHT))
    count = max(1, math.ceil(total / item_block), min(math.ceil(total / _MIN_ITEMS), math.ceil(balanced)))
    copies = max(1, min(math.ceil(n_queries / _MIN_QUERIES), math.ceil(2 * parts / count)))
    if _QUERY_WEIGHT * n_queries * nprobe + total <= _QUERY_WEIGHT * n_queries * min(nprobe, count) + total * copies:
        return {cluster: place for place, cluster in enumerate(sorted(sizes))}
    out, held, now = {}, 0, 0
    for cluster, n in sorted(sizes.items()):
        if held and held + n > max(1, total / count):
            now, held = now + 1, 0
        out[cluster], held = now, held + n
    return out


def _probed_bundles(probes: DataFrame, bundle: dict[int, int]) -> DataFrame:
    """``probes`` (query_id, embedding, probed) as a row per bundle (cluster_id) with the clusters probed there."""
    clusters = np.array(sorted(bundle))
    of = np.array([bundle[c] for c in sorted(bundle)])
    shared = probes.sparkSession.sparkContext.broadcast((clusters, of))
    schema = f"query_id string, embedding {probes.schema['embedding'].dataType.simpleString()}, cluster_id int, probed array<int>"

    def bundled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        clusters, of = shared.value
        for batch in batches:
            lists = batch.column("probed")
            row = np.repeat(np.arange(batch.num_rows), pc.list_value_length(lists).to_numpy())
            probed = lists.flatten().to_numpy()
            place = np.minimum(np.searchsorted(clusters, probed), len(clusters) - 1)
            known = clusters[place] == probed
            row, probed, where = row[known], probed[known], of[place[known]]
            order = np.lexsort((probed, where, row))
            row, probed, where = row[order], probed[order], where[order]
            new = np.flatnonzero(np.r_[len(row) > 0, (row[1:] != row[:-1]) | (where[1:] != where[:-1])][: len(row)])
            found = pa.ListArray.from_arrays(pa.array(np.r_[new, len(row)].astype(np.int32)), pa.array(probed.astype(np.int32)))
            asked = batch.select(["query_id", "embedding"]).take(pa.array(row[new]))
            yield pa.RecordBatch.from_arrays([*asked.columns, pa.array(where[new].astype(np.int32)), found], ["query_id", "embedding", "cluster_id", "probed"])

    return probes.mapInArrow(bundled, schema)


def _probing_scorer(metric: str, top_k: int) -> Scorer:
    """The best of each query among the items (``_of`` a cluster) of the clusters that it probes (``probed``)."""

    def scored(vectors: np.ndarray, right: pa.Table, row: np.ndarray, column: np.ndarray, probed: pa.ChunkedArray):
        items = _matrix(right["embedding"], vectors.shape[1])
        clusters, of = np.unique(right["_of"].to_numpy(), return_inverse=True)
        order = np.argsort(of, kind="stable")
        starts = np.r_[0, np.cumsum(np.bincount(of, minlength=len(clusters)))]
        within = np.empty(len(of), np.int64)
        within[order] = np.arange(len(of)) - starts[of[order]]
        lists = probed.combine_chunks()
        lists = pa.concat_arrays(lists.chunks) if isinstance(lists, pa.ChunkedArray) else lists
        asks = np.repeat(np.arange(len(vectors)), pc.list_value_length(lists).to_numpy())
        wanted = lists.flatten().to_numpy()
        place = np.minimum(np.searchsorted(clusters, wanted), len(clusters) - 1)
        here = clusters[place] == wanted
        asks, place = asks[here], place[here]
        out = []
        for start in range(0, len(vectors), _PROBING_QUERIES):
            low, high = np.searchsorted(asks, [start, start + _PROBING_QUERIES])
            first, last = np.searchsorted(row, [start, start + _PROBING_QUERIES])
            barred = np.argsort(of[column[first:last]], kind="stable") + first
            borders = np.searchsorted(of[column[barred]], np.arange(len(clusters) + 1))
            best, waiting, count = tuple(np.empty(0, t) for t in (np.int64, np.int64, np.float64)), [], 0
            by_cluster = np.argsort(place[low:high], kind="stable") + low
            ends = np.searchsorted(place[by_cluster], np.arange(len(clusters) + 1))
            visited = np.flatnonzero(np.diff(ends))
            for c in visited:
                rows, members = asks[by_cluster[ends[c] : ends[c + 1]]], order[starts[c] : starts[c + 1]]
                out_of = barred[borders[c] : borders[c + 1]]
                at = np.minimum(np.searchsorted(rows, row[out_of]), len(rows) - 1)
                mine = rows[at] == row[out_of]
                query, item, score = _striped(vectors[rows], items[members], metric, top_k, at[mine], within[column[out_of[mine]]])
                waiting.append((rows[query], members[item], score))
                count += len(query)
                if count > 8 * top_k * _PROBING_QUERIES or c == visited[-1]:
                    best = _best_pairs(*(np.concatenate(x) for x in zip(best, *waiting, strict=True)), top_k)
                    waiting, count = [], 0
            out.append(best)
        query, item, score = (np.concatenate(x) for x in zip(*out, strict=True))
        return query, {"item_id": right["item_id"].to_numpy()[item], "score": score}

    return scored


def _best_pairs(query: np.ndarray, item: np.ndarray, score: np.ndarray, top_k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The best ``top_k`` pairs of each query, in order; ties by lower item."""
    order = np.lexsort((item, -np.round(score, TIE_DIGITS), query))
    query, item, score = query[order], item[order], score[order]
    few = np.arange(len(query)) - np.searchsorted(query, query) < top_k
    return query[few], item[few], score[few]


def search_probed(
    probes: DataFrame,
    items: DataFrame,
    exclude: DataFrame | None,
    scorer: Scorer,
    *,
    n_items: DataFrame | None = None,
    schema: str = RESULT,
    payload: dict[str, Column] | None = None,
    item_block: int = ITEM_BLOCK,
    query_block: int = QUERY_BLOCK,
    weight: float = _QUERY_WEIGHT,
) -> DataFrame:
    """The rows of ``scorer`` for the staged ``probes`` (query_id, embedding, cluster_id), block by block.

    ``weight``: what a query with its rows of a block weighs, in items. ``n_items``: cluster_id, n_items, where it is known; else the items are counted. Items that are a table written by
    ``cluster_id`` are read in the probed clusters alone: the sizes' filter prunes its folders.
    """
    size = F.count(F.lit(1))
    if n_items is None:
        n_items = items.groupBy("cluster_id").agg(size.alias("n_items"))
    n_queries = probes.groupBy("cluster_id").agg(size.alias("n_queries"))
    item_blocks = _item_blocks(F.col("n_items"), F.col("n_queries"), item_block, default_parts(items), F.col("share"), weight)
    # One row per cluster, about the square root of the number of items.
    pairs = F.col("n_items").cast("double") * F.col("n_queries")
    sizes = stage(
        n_items.select("cluster_id", "n_items")
        .join(n_queries, "cluster_id")
        .withColumn("share", F.coalesce(F.try_divide(pairs, F.sum(pairs).over(Window.partitionBy())), F.lit(0.0)))
        .withColumn("item_blocks", item_blocks)
        .select(
            "cluster_id",
            "item_blocks",
            _query_blocks(
                F.col("n_queries"), F.col("item_blocks"), query_block, default_parts(items), F.col("share")
            ).alias("query_blocks"),
        )
    ).where("item_blocks > 0")

    def sized(rows: DataFrame) -> DataFrame:
        return rows.join(sizes, "cluster_id")

    barred = None
    if exclude is not None:
        where = items.select("item_id", "cluster_id").distinct()
        barred = join_lookup(_distinct_exclusions(exclude), where, "item_id", "inner")
    return _block_search(probes, items, barred, sized, scorer, schema, payload)


def with_item_text(candidates: DataFrame, items: DataFrame) -> DataFrame:
    """Candidates in the result form ``query_id, item_id, item_text, score, rank``.

    One item may be recommended to most queries; adaptive execution splits its rows.
    """
    texts = items.select("item_id", "item_text")
    return join_lookup(candidates, texts, "item_id").select(
        "query_id", "item_id", "item_text", "score", "rank"
    )
