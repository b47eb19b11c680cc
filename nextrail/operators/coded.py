"""Search over 8-bit codes: a first pass with bounds on the error, then exact scores of what the bounds leave.

An item's vector is written as whole numbers of 8 bits times one scale, an eighth of the bytes of doubles, together with the
length of what the code leaves out. A query's score with the code and that length bound its score with the vector from
both sides: only items whose upper bound reaches the k-th lower bound can be among the best, and those are scored exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nextrail.config import METRICS, TOP_K
from nextrail.functions import vectors as vec
from nextrail.operators import search as flat
from nextrail.operators.skew import join_lookup
from nextrail.sources.tables import stage

#: Largest whole number of a code, and the norm below which a vector's direction is not trusted.
TOP_CODE, SHORT = 127, 1e-4
#: Share of the scores' size by which bounds are widened, for rounding and for ties.
SLACK = 1e-8
CODE = ("code", "scale", "error")
#: Rows of a block: what the bounds leave of a pair of blocks is held at once.
ITEM_BLOCK, QUERY_BLOCK = 65_536, 8_192
# Bounds held at a time, and what a query with the items that its bounds leave weighs, in codes.
_CELLS, _QUERY_WEIGHT = 1_000_000, 32


def code_items(items: DataFrame, metric: str = "cosine") -> DataFrame:
    """``item_id, code, scale, error`` for the items that can be searched, with ``cluster_id`` if ``items`` has it.

    ``code`` has a byte per dimension; ``error`` is the length of the vector (for cosine, of the unit vector) less its code.
    """
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {METRICS}")
    more = [c for c in ("cluster_id",) if c in items.columns]
    known = flat.usable(items, "item_id", *more).withColumn("embedding", vec.as_double(F.col("embedding")))
    kinds = "".join(f", {f.name} {f.dataType.simpleString()}" for f in known.schema if f.name in more)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors = flat._matrix(pa.chunked_array([batch.column("embedding")]), len(batch.column("embedding")[0]))
            norms = np.sqrt(np.einsum("ij,ij->i", vectors, vectors))
            if metric == "cosine":
                vectors = vectors / np.maximum(norms, vec.COSINE_EPS)[:, None]
            scale = np.abs(vectors).max(axis=1, initial=0) / TOP_CODE
            scale[scale == 0] = 1
            codes = np.rint(vectors / scale[:, None]).astype(np.int8)
            error = np.sqrt(((vectors - scale[:, None] * codes) ** 2).sum(axis=1)) * (1 + SLACK)
            if metric == "cosine":
                error[norms < SHORT] = np.inf
            yield pa.RecordBatch.from_arrays(
                [batch.column("item_id"), *(batch.column(c) for c in more), pa.array([c.tobytes() for c in codes]), pa.array(scale), pa.array(error)],
                ["item_id", *more, *CODE],
            )

    return known.select("item_id", *more, "embedding").mapInArrow(code, f"item_id string{kinds}, code binary, scale double, error double")


def bounds(vectors: np.ndarray, codes: np.ndarray, scale: np.ndarray, error: np.ndarray, metric: str) -> tuple[np.ndarray, np.ndarray]:
    """The least and the largest score that each query can have with each coded item."""
    norms = np.sqrt(np.einsum("ij,ij->i", vectors, vectors))
    if metric == "cosine":
        vectors = vectors / np.maximum(norms, vec.COSINE_EPS)[:, None]
    product = vectors @ codes.T * scale
    if metric == "l2":
        squares = np.einsum("ij,ij->i", codes, codes) * scale**2
        size = norms[:, None] ** 2 + squares
        away = np.sqrt(np.maximum(size - 2 * product, 0))
        low, high = 1 - (away + error) ** 2, 1 - np.maximum(away - error, 0) ** 2
    else:
        spread = norms[:, None] * error
        if metric == "cosine":  # a short vector's direction isn't trusted: nothing is known of its scores
            spread = np.where(norms[:, None] < SHORT, np.inf, error)
        low, high, size = product - spread, product + spread, np.abs(product)
    slack = SLACK * (1 + size)
    return low - slack, high + slack


def _reached(low: np.ndarray, top_k: int) -> np.ndarray:
    """What ``top_k`` of each row reach: their k-th largest, or that of the maxima of groups of columns, which is no more."""
    groups = low.shape[1] // flat._GROUP
    if groups >= 2 * top_k:
        low = low[:, : groups * flat._GROUP].reshape(len(low), flat._GROUP, groups).max(axis=1)
    return np.partition(low, low.shape[1] - top_k, axis=1)[:, low.shape[1] - top_k, None]


def _bound_scorer(metric: str, top_k: int) -> flat.Scorer:
    """The items of a block whose upper bound reaches the block's k-th lower bound."""

    def scored(vectors: np.ndarray, right: pa.Table, row: np.ndarray, column: np.ndarray):
        dim = vectors.shape[1]
        codes = np.frombuffer(b"".join(right["code"].to_pylist()), np.int8).reshape(-1, dim).astype(np.float64)
        scale, error = right["scale"].to_numpy(), right["error"].to_numpy()
        wide = len(codes) >= 2 * flat._TILE_ITEMS and 2 * flat._DENSE * top_k <= flat._TILE_ITEMS and np.isfinite(error).all()
        query, item, low, high = (_tiled if wide else _striped)(vectors, codes, scale, error, metric, top_k, row, column)
        return query, {"item_id": right["item_id"].take(pa.array(item)).combine_chunks(), "low": low, "high": high}

    return scored


def _striped(
    vectors: np.ndarray, codes: np.ndarray, scale: np.ndarray, error: np.ndarray, metric: str, top_k: int, row: np.ndarray, column: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Query, item and bounds of what the bounds leave, but for the excluded places ``row`` (ascending) and ``column``."""
    found = []
    stripe = max(1, _CELLS // max(1, len(codes)))
    for start in range(0, len(vectors), stripe):
        low, high = bounds(vectors[start : start + stripe], codes, scale, error, metric)
        first, last = np.searchsorted(row, [start, start + stripe])
        low[row[first:last] - start, column[first:last]] = -np.inf
        open_ = np.ones(low.shape, bool)
        open_[row[first:last] - start, column[first:last]] = False
        if low.shape[1] > top_k:
            open_ &= high >= _reached(low, top_k)
        rows, columns = (x.astype(np.int32) for x in np.nonzero(open_))
        found.append((rows + np.int32(start), columns, low[rows, columns], high[rows, columns]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _pair_bounds(product: np.ndarray, norms: np.ndarray, squares: np.ndarray, error: np.ndarray, metric: str) -> tuple[np.ndarray, np.ndarray]:
    """``bounds`` of pairs, from their products, the queries' norms and the codes' squared norms and errors."""
    if metric == "l2":
        size = norms**2 + squares
        away = np.sqrt(np.maximum(size - 2 * product, 0))
        low, high = 1 - (away + error) ** 2, 1 - np.maximum(away - error, 0) ** 2
    else:
        spread = error if metric == "cosine" else norms * error
        low, high, size = product - spread, product + spread, np.abs(product)
    slack = SLACK * (1 + size)
    return low - slack, high + slack


def _tiled(
    vectors: np.ndarray, codes: np.ndarray, scale: np.ndarray, error: np.ndarray, metric: str, top_k: int, row: np.ndarray, column: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """What the rows of ``_striped`` hold of each query's best, for many codes with finite errors.

    Tiles are scored in single precision; bounds are worked out for what can reach the query's k-th lower bound so far, given the
    largest error. Queries with too many such codes, or too short ones, are left to ``_striped``.
    """
    norms, squares = np.sqrt(np.einsum("ij,ij->i", vectors, vectors)), np.einsum("ij,ij->i", codes, codes) * scale**2
    asked = vectors / np.maximum(norms, vec.COSINE_EPS)[:, None] if metric == "cosine" else vectors
    kind = "l2" if metric == "l2" else "dot"  # unit vectors' codes are compared by their products
    single, other, off, odd = flat._single(asked, codes * scale[:, None], kind)
    if metric == "cosine":
        odd |= norms < SHORT
    worst, most = error.max(), squares.max()
    slack = 2 * SLACK * (1 + (norms**2 + most if metric == "l2" else norms * np.sqrt(most)))
    spread = worst * (1 if metric == "cosine" else norms)
    width, cells = len(codes), flat._TILE_QUERIES * flat._TILE_ITEMS
    buffer, marks = np.empty(cells, np.float32), np.empty(cells, bool)
    found = []
    for start in range(0, len(vectors), flat._TILE_QUERIES):
        part = slice(start, min(start + flat._TILE_QUERIES, len(vectors)))
        rows = part.stop - start
        first, last = np.searchsorted(row, [start, part.stop])
        by_item = np.argsort(column[first:last], kind="stable")
        barred, of = column[first:last][by_item], row[first:last][by_item] - start
        norm, loose, wide, margin = norms[part], slack[part], spread[part] if metric != "cosine" else np.full(rows, spread), off[part]
        dense, kth = odd[part].copy(), np.full(rows, -np.inf)

        def limit_of(kth: np.ndarray, norm=norm, loose=loose, wide=wide, margin=margin) -> np.ndarray:
            """The least product by which a code's upper bound can reach ``kth``."""
            if metric != "l2":
                return kth - loose - wide - margin
            return (norm**2 - (np.sqrt(np.maximum(1 - kth + loose, 0)) + worst) ** 2) / 2 - margin - loose

        kept, waiting, count = tuple(np.empty(0, t) for t in (np.int64, np.int64, np.float64, np.float64)), [], 0
        for begin in range(0, width, flat._TILE_ITEMS):
            tile = other[begin : begin + flat._TILE_ITEMS]
            size = rows * len(tile)
            product, mark = (x[:size].reshape(rows, len(tile)) for x in (buffer, marks))
            np.matmul(single[part], tile.T, out=product)
            one, two = np.searchsorted(barred, [begin, begin + len(tile)])
            product[of[one:two], barred[one:two] - begin] = -np.inf
            if begin == 0:
                reached = flat._kth_of_tile(product, top_k)
                dense |= reached == -np.inf
                if metric == "l2":
                    kth = 1 - (np.sqrt(np.maximum(norm**2 - 2 * (reached - margin), 0)) + worst) ** 2 - loose
                else:
                    kth = reached - margin - wide - loose
                limit = np.where(dense, np.inf, limit_of(kth)).astype(np.float32)
            np.greater_equal(product, limit[:, None], out=mark)
            places = flat._true_places(mark)
            if len(places) * 2 * flat._DENSE > size:
                many = mark.sum(axis=1) * flat._DENSE > len(tile)
                dense |= many
                limit[many] = np.inf
                places = places[~many[places // len(tile)]]
            for at in range(0, len(places), 1 << 15):
                query, item = np.divmod(places[at : at + (1 << 15)], len(tile))
                item += begin
                exact = np.einsum("ij,ij->i", asked[part][query], codes[item]) * scale[item]
                low, high = _pair_bounds(exact, norm[query], squares[item], error[item], metric)
                can = high >= kth[query]
                waiting.append((query[can], item[can], low[can], high[can]))
                count += len(waiting[-1][0])
            if not count or begin and count < max(rows * top_k, len(kept[0])) and begin + flat._TILE_ITEMS < width:
                continue
            kept = tuple(np.concatenate(x) for x in zip(kept, *waiting, strict=True))
            waiting, count = [], 0
            order = np.lexsort((-kept[2], kept[0]))
            query, low = kept[0][order], kept[2][order]
            at_k = np.arange(len(query)) - np.searchsorted(query, query) == top_k - 1
            kth[query[at_k]] = np.maximum(kth[query[at_k]], low[at_k])
            limit = np.where(dense, np.inf, limit_of(kth)).astype(np.float32)
            can = kept[3] >= kth[kept[0]]
            kept = tuple(x[can] for x in kept)
        whole = ~dense[kept[0]]
        kept = tuple(x[whole] for x in kept)
        if dense.any():
            left = np.flatnonzero(dense)
            also = dense[row[first:last] - start]
            again = np.searchsorted(left, row[first:last][also] - start)
            more = _striped(vectors[part][left], codes, scale, error, metric, top_k, again, column[first:last][also])
            kept = tuple(np.concatenate(x) for x in zip(kept, (left[more[0]], *more[1:]), strict=True))
        found.append((kept[0] + start, *kept[1:]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def search_coded(
    queries: DataFrame,
    codes: DataFrame,
    items: DataFrame,
    *,
    metric: str = "cosine",
    exclude: DataFrame | None = None,
    top_k: int = TOP_K,
    probes: DataFrame | None = None,
    n_items: DataFrame | None = None,
    refine_factor: int | None = None,
    item_block: int = ITEM_BLOCK,
    query_block: int = QUERY_BLOCK,
    report: dict | None = None,
) -> DataFrame:
    """``query_id, item_id, score, rank`` over ``codes`` (of ``code_items`` for the same metric) of ``items``.

    The result is that of the exact search. With ``refine_factor``, only the best ``refine_factor * top_k`` items by the middle of
    their bounds are scored exactly, which may miss some. ``probes`` (query_id, embedding, cluster_id, staged) limits each
    query to clusters, ``codes`` having ``cluster_id``; ``n_items`` per cluster saves a count. ``report`` gets the numbers of
    ``rescored`` and of all ``pairs``. Vectors are fetched for what is scored exactly only.
    """
    asked = flat.usable(queries, "query_id")
    asked = asked.select("query_id", flat._sent(asked).alias("embedding"))
    if probes is None:
        codes = codes.withColumn("cluster_id", F.lit(0))
        probes = stage(asked.withColumn("cluster_id", F.lit(0)))
        n_items = None
    found = flat.search_probed(
        probes, codes, exclude, _bound_scorer(metric, top_k), n_items=n_items,
        schema="query_id string, item_id string, low double, high double",
        payload={c: F.col(c) for c in CODE}, item_block=item_block, query_block=query_block, weight=_QUERY_WEIGHT,
    )
    whole = Window.partitionBy("query_id")
    if refine_factor is None:
        by_low = whole.orderBy(F.desc("low")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        found = found.withColumn("_kth", F.nth_value("low", top_k).over(by_low)).where("_kth IS NULL OR high >= _kth")
    else:
        middle = whole.orderBy(F.desc(F.col("low") + F.col("high")), "item_id")
        found = found.withColumn("_place", F.row_number().over(middle)).where(F.col("_place") <= refine_factor * top_k)
    pairs = found.select("query_id", "item_id").distinct()
    if report is not None:
        pairs = stage(pairs)
        report.update(rescored=pairs.count(), pairs=asked.count() * codes.count())
    vectors = flat.usable(items, "item_id")
    vectors = vectors.select("item_id", flat._sent(vectors).alias("_item"))
    met = join_lookup(join_lookup(pairs, vectors, "item_id", "inner"), asked, "query_id", "inner")
    one, other = F.col("embedding"), F.col("_item")
    score = {"dot": vec.dot, "cosine": vec.cosine, "l2": lambda a, b: 1 - vec.squared_distance(a, b)}[metric](one, other)
    return flat.ranked_top_k(met.select("query_id", "item_id", score.alias("score")), top_k)
