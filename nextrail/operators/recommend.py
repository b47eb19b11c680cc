"""Recommendation jobs for whole tables of histories, queries, items and users."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nextrail.config import TOP_K, EncoderConfig
from nextrail.functions.vectors import as_double, unit
from nextrail.operators.encode import ModelFn, encode_histories, known_tail, pool
from nextrail.operators.lookup import lookup_one
from nextrail.operators.pruned import ClusterIndex, nearest
from nextrail.operators.search import with_item_text
from nextrail.operators.skew import join_lookup
from nextrail.sources.tables import stage


def nearest_to_histories(
    histories: DataFrame,
    items: DataFrame,
    *,
    top_k: int = TOP_K,
    metric: str = "cosine",
    encoder: EncoderConfig = EncoderConfig(),
    exclude: DataFrame | None = None,
    exclude_scope: str = "all",
    model_fn: ModelFn | None = None,
    dim: int | None = None,
    index: ClusterIndex | None = None,
    centroids: DataFrame | None = None,
    nprobe: int | None = None,
) -> DataFrame:
    """``query_id, item_id, score, rank`` for rows ``query_id, pos, item_id``, without the history's items (O1).

    ``histories`` is read several times; pass a staged or written table. ``exclude_scope``: ``all`` leaves out the whole history, ``tail`` only the items the vector was made
    from, so that older ones may come again. ``items``: item_id, embedding. ``index`` over them prunes
    the search, which stays exact; with ``centroids`` and ``nprobe`` (``items`` then has cluster_id) the nearest clusters are searched.
    """
    if exclude_scope not in ("all", "tail"):
        raise ValueError("exclude_scope must be 'all' or 'tail'")
    encoded = encode_histories(
        histories, items, encoder, model_fn=model_fn, dim=dim
    )
    seen = histories.select("query_id", "pos", "item_id")
    if exclude_scope == "tail":
        seen = known_tail(seen, items, encoder.max_seq_length)
    seen = seen.select("query_id", "item_id")
    if exclude is not None:
        seen = seen.unionByName(exclude.select("query_id", "item_id"))
    # Search reads its queries twice, to size the blocks and to fill them.
    return nearest(
        stage(encoded),
        items,
        exclude=seen,
        top_k=top_k,
        metric=metric,
        index=index,
        centroids=centroids,
        nprobe=nprobe,
    )


def recommend_histories(histories: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The same with ``item_text``; options as in ``nearest_to_histories``."""
    return with_item_text(nearest_to_histories(histories, items, **options), items)


def unpack_requests(requests: DataFrame) -> dict[str, DataFrame]:
    """Requests with list columns as the tables that ``recommend_queries`` takes.

    Columns: ``query_id`` and any of ``embedding``, ``item_ids``, ``input_embeds``, ``exclude_item_ids``,
    ``top_k``.
    """
    kept = [c for c in ("query_id", "embedding", "top_k") if c in requests.columns]
    tables = {"queries": requests.select(*kept)}
    if "item_ids" in requests.columns:
        tables["item_rows"] = requests.select(
            "query_id", F.posexplode("item_ids").alias("pos", "item_id")
        )
    if "input_embeds" in requests.columns:
        tables["input_rows"] = requests.select(
            "query_id", F.posexplode("input_embeds").alias("pos", "embedding")
        )
    if "exclude_item_ids" in requests.columns:
        tables["exclude"] = requests.select(
            "query_id", F.explode("exclude_item_ids").alias("item_id")
        )
    return tables


def recommend_queries(
    queries: DataFrame,
    items: DataFrame,
    *,
    item_rows: DataFrame | None = None,
    input_rows: DataFrame | None = None,
    exclude: DataFrame | None = None,
    top_k: int = TOP_K,
    metric: str = "cosine",
    encoder: EncoderConfig = EncoderConfig(),
    **index,
) -> DataFrame:
    """Items for a table of requests (O2); ``index`` may give ``index``, or ``centroids`` and ``nprobe``.

    ``queries``: query_id and optionally ``embedding`` and ``top_k``; ``item_rows``: query_id, pos, item_id;
    ``input_rows``: query_id, pos, embedding; ``exclude``: query_id, item_id. A given vector goes before
    input vectors, these before item ids. Requests from which no vector follows have no rows. Left out are
    the excluded items and the request's own, cut to the last known ones unless input vectors were given.
    """
    own = F.col("embedding") if "embedding" in queries.columns else F.lit(None)
    vectors = queries.select("query_id", own.cast("array<double>").alias("own"))
    barred = [exclude.select("query_id", "item_id")] if exclude is not None else []
    given = [F.col("own")]

    if input_rows is not None:
        latest = Window.partitionBy("query_id").orderBy(F.desc("pos"))
        last = input_rows.withColumn("_back", F.row_number().over(latest))
        last = last.where(F.col("_back") <= encoder.max_seq_length)
        lists = last.groupBy("query_id").agg(
            F.sort_array(F.collect_list(F.struct("pos", "embedding")))["embedding"].alias("vectors")
        )
        pooled = pool(F.col("vectors"), encoder.pooling)
        pooled = unit(pooled) if encoder.normalize else pooled
        vectors = vectors.join(lists.select("query_id", pooled.alias("of_inputs")), "query_id", "left")
        given.append(F.col("of_inputs"))
    if item_rows is not None:
        resolved = item_rows.select("query_id", "pos", "item_id")
        if input_rows is not None:
            with_inputs = input_rows.select("query_id").distinct().withColumn("has_inputs", F.lit(True))
            marked = stage(join_lookup(resolved, with_inputs, "query_id"))
            resolved = marked.where("has_inputs IS NULL").drop("has_inputs")
            barred.append(marked.where("has_inputs").select("query_id", "item_id"))
        encoded = encode_histories(resolved, items, encoder)
        encoded = encoded.withColumnRenamed("embedding", "of_items")
        vectors = vectors.join(encoded, "query_id", "left")
        given.append(F.col("of_items"))
        tail = known_tail(resolved, items, encoder.max_seq_length)
        barred.append(tail.select("query_id", "item_id"))

    vectors = vectors.select("query_id", F.coalesce(*given).alias("embedding"))
    vectors = stage(vectors.where("embedding IS NOT NULL"))
    hidden = reduce(DataFrame.unionByName, barred) if barred else None
    largest = top_k
    if "top_k" in queries.columns:
        largest = max(top_k, queries.agg(F.max("top_k")).first()[0] or 0)
    found = nearest(vectors, items, exclude=hidden, top_k=largest, metric=metric, **index)
    if "top_k" in queries.columns:
        limits = queries.select("query_id", F.coalesce("top_k", F.lit(top_k)).alias("limit"))
        found = found.join(limits, "query_id").where("rank <= limit").drop("limit")
    return with_item_text(found, items)


def recommend_items(
    requests: DataFrame,
    items: DataFrame,
    *,
    exclude: DataFrame | None = None,
    top_k: int = TOP_K,
    metric: str = "cosine",
    encoder: EncoderConfig = EncoderConfig(),
    **index,
) -> DataFrame:
    """Items like the requested one, itself left out (O3). Requests: ``query_id, item_id``."""
    found = lookup_one(requests, items.select("item_id", "embedding")).where("is_found")
    found = found.where("embedding IS NOT NULL")
    vector = as_double(F.col("embedding"))
    vector = unit(vector) if encoder.normalize else vector
    barred = requests.select("query_id", "item_id")
    if exclude is not None:
        barred = barred.unionByName(exclude.select("query_id", "item_id"))
    near = nearest(
        found.select("query_id", vector.alias("embedding")),
        items,
        exclude=barred,
        top_k=top_k,
        metric=metric,
        **index,
    )
    return with_item_text(near, items)


def recommend_users(
    placed: DataFrame,
    items: DataFrame,
    *,
    users: DataFrame | None = None,
    exclude: DataFrame | None = None,
    top_k: int = TOP_K,
    metric: str = "cosine",
    encoder: EncoderConfig = EncoderConfig(),
    **index,
) -> DataFrame:
    """Items for users from history and target together, only the encoded items left out.

    ``placed``: user_id, part, pos, n_history, item_id; ``users`` limits the job to the ``user_id`` it holds.
    """
    if users is not None:
        placed = join_lookup(placed, users.select("user_id").distinct(), "user_id", "inner")
    after = F.when(F.col("part") == "target", F.col("n_history")).otherwise(0)
    histories = placed.select(
        F.col("user_id").alias("query_id"), (F.col("pos") + after).alias("pos"), "item_id"
    )
    return recommend_histories(
        stage(histories),
        items,
        top_k=top_k,
        metric=metric,
        encoder=encoder,
        exclude=exclude,
        exclude_scope="tail",
        **index,
    )


def search_vectors(
    queries: DataFrame,
    items: DataFrame,
    *,
    exclude: DataFrame | None = None,
    top_k: int = TOP_K,
    metric: str = "cosine",
    **index,
) -> DataFrame:
    """Candidates for given vectors ``query_id, embedding``."""
    found = nearest(queries, items, exclude=exclude, top_k=top_k, metric=metric, **index)
    return with_item_text(found, items)
