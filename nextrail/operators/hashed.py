"""Approximate search by signs of random planes in bands (K6).

A vector's signs on the planes of a band name a bucket; a query is scored with the items that share one of its buckets. The
buckets are searched in blocks like clusters, so a bucket of any size is split, and only each query's best leave a block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nextrail.config import TOP_K
from nextrail.operators import search as flat
from nextrail.operators.vector_sums import matrix
from nextrail.sources.tables import stage

BANDS, BITS = 24, 4


def planes(count: int, dim: int) -> np.ndarray:
    """Planes of 1 and -1: plane p has -1 at place d if the md5 of ``p|d`` begins with an odd digit."""
    odd = [[int(hashlib.md5(f"{p}|{d}".encode()).hexdigest()[0], 16) % 2 for d in range(dim)] for p in range(count)]
    return 1.0 - 2.0 * np.array(odd, np.float64).reshape(count, dim)


def buckets(rows: DataFrame, id_col: str, bands: int = BANDS, bits: int = BITS) -> DataFrame:
    """``id_col, embedding, cluster_id``: each vector once per band, in the bucket that its signs there name."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = None
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors = matrix(batch.column("embedding")).astype(np.float64, copy=False)
            known = planes(bands * bits, vectors.shape[1]) if known is None else known
            signs = np.round(vectors @ known.T, 9).reshape(-1, bands, bits) >= 0
            named = signs @ (1 << np.arange(bits)) + (np.arange(bands) << bits)
            each = pa.array(np.repeat(np.arange(batch.num_rows), bands))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c).take(each) for c in (id_col, "embedding")), pa.array(named.reshape(-1).astype(np.int32))],
                [id_col, "embedding", "cluster_id"],
            )

    kept = flat.usable(rows, id_col)
    kept = kept.select(id_col, flat._sent(kept).alias("embedding"))
    return kept.mapInArrow(sign, f"{id_col} string, embedding {kept.schema['embedding'].dataType.simpleString()}, cluster_id int")


def search_hashed(
    queries: DataFrame,
    items: DataFrame,
    *,
    bands: int = BANDS,
    bits: int = BITS,
    exclude: DataFrame | None = None,
    top_k: int = TOP_K,
    metric: str = "cosine",
    item_block: int = flat.ITEM_BLOCK,
    query_block: int = flat.QUERY_BLOCK,
) -> DataFrame:
    """``query_id, item_id, score, rank``: the best by exact score among the items that share a bucket with the query.

    More bands and fewer bits find more and score more. Repeated item ids count once, with their best score. What shares no
    bucket is missed: ``search`` and ``search_pruned`` are the exact ways.
    """
    probes = stage(buckets(queries, "query_id", bands, bits))
    stored = stage(buckets(items, "item_id", bands, bits))
    found = flat.search_probed(
        probes, stored, exclude, flat._exact_scorer(metric, top_k), item_block=item_block, query_block=query_block
    )
    # A pair that meets in several bands comes back from each.
    once = found.groupBy("query_id", "item_id").agg(F.max("score").alias("score"))
    return flat.ranked_top_k(once, top_k)
