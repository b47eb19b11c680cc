"""Texts and histories to vectors."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Sequence
from dataclasses import replace
from functools import reduce

import numpy as np
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nextrail.config import EncoderConfig
from nextrail.functions.vectors import as_double, is_zero, let, unit
from nextrail.operators.skew import join_lookup
from nextrail.sources.tables import stage

_SPACE = re.compile(r"[ \t\n\r\f\v]+")

ModelFn = Callable[[], Callable[[np.ndarray], np.ndarray]]


def embed_text(
    df: DataFrame,
    text_col: str = "item_text",
    *,
    out_col: str = "embedding",
    model_fn: ModelFn | None = None,
    batch_size: int = 256,
    num_features: int = 256,
) -> DataFrame:
    """A vector per text.

    ``model_fn`` loads a model once per Python worker and returns its batch prediction. By default it is
    ``hashed_words``, a stand-in with the same contract, not a language model. A NULL text counts as empty.
    """
    embed = predict_batch_udf(
        model_fn or hashed_words(num_features),
        return_type=T.ArrayType(T.FloatType()),
        batch_size=batch_size,
    )
    return df.withColumn(out_col, embed(F.coalesce(text_col, F.lit(""))))


def hashed_words(num_features: int, remembered: int = 200_000) -> ModelFn:
    """Unit-length word counts, each lower-cased word counted at the place that its md5 gives; zeros without words."""

    def load() -> Callable[[np.ndarray], np.ndarray]:
        places: dict[str, int] = {}

        def place(word: str) -> int:
            if word not in places:
                if len(places) >= remembered:
                    places.clear()
                places[word] = int(hashlib.md5(word.encode()).hexdigest()[:8], 16) % num_features
            return places[word]

        def predict(texts: np.ndarray) -> np.ndarray:
            counts = np.zeros((len(texts), num_features))
            for row, text in enumerate(texts):
                words = _SPACE.split(str(text).lower())
                np.add.at(counts[row], [place(word) for word in words if word], 1)
            norms = np.sqrt((counts * counts).sum(axis=1, keepdims=True))
            return (counts / np.maximum(norms, 1)).astype(np.float32)

        return predict

    return load


def known_tail(
    histories: DataFrame,
    vectors: DataFrame,
    max_seq_length: int,
    *,
    heavy_items: Sequence | None = None,
) -> DataFrame:
    """The last ``max_seq_length`` items of each query that have a vector.

    Ids are matched first and vectors joined to what is left, so a long history moves as ids only. The
    group limit cuts each query to ``max_seq_length`` rows before the shuffle. The ids are staged: against a table whose size
    isn't known, a log in a small file would be sent to all tasks, and the few ids, one task's, would bring out all its rows.
    """
    ids = stage(vectors.select("item_id"))
    known = join_lookup(histories, ids, "item_id", "inner", heavy=heavy_items)
    latest = Window.partitionBy("query_id").orderBy(F.desc("pos"))
    tail = known.withColumn("_back", F.row_number().over(latest))
    return tail.where(F.col("_back") <= max_seq_length).drop("_back")


def pool(vectors: Column, mode: str) -> Column:
    """One vector from an ordered list of vectors, zero vectors masked; zeros if all are.

    ``first`` takes the first vector whether masked or not.
    """
    if mode == "first":
        return as_double(vectors[0])

    def combined(counted: Column) -> Column:
        if mode == "last":
            return as_double(F.element_at(counted, -1))
        if mode == "max":
            return _fold(counted, lambda a, b: F.greatest(a, b))
        total = _fold(counted, lambda a, b: a + b)
        return let(F.size(counted), lambda n: F.transform(total, lambda value: value / n))

    zeros = F.transform(as_double(vectors[0]), lambda _: F.lit(0.0))
    counted = F.filter(vectors, lambda v: ~is_zero(v))
    return let(counted, lambda some: F.when(F.size(some) > 0, combined(some)).otherwise(zeros))


def _fold(vectors: Column, merge: Callable[[Column, Column], Column]) -> Column:
    """The vectors merged place by place, from the first on."""
    rest = F.slice(vectors, 2, F.size(vectors))
    return F.aggregate(
        rest, as_double(vectors[0]), lambda acc, v: F.zip_with(acc, as_double(v), merge)
    )


def encode_histories(
    histories: DataFrame,
    vectors: DataFrame,
    config: EncoderConfig = EncoderConfig(),
    *,
    model_fn: ModelFn | None = None,
    batch_size: int = 256,
    dim: int | None = None,
    heavy_items: Sequence | None = None,
) -> DataFrame:
    """``query_id, embedding`` for rows ``query_id, pos, item_id``.

    Unknown items are dropped, then the last ``max_seq_length`` kept; all-zero vectors do not count.
    Queries without a known item have no row. The pooled vector skips the trained attention layers of a
    sequence model; plug one in as ``model_fn``, called with arrays of (batch, max_seq_length, dim).
    """
    rows = _tail_vectors(histories, vectors, config.max_seq_length, heavy_items)
    # At most max_seq_length vectors per query, in order: the result does not depend on partitions.
    listed = rows.groupBy("query_id").agg(
        F.sort_array(F.collect_list(F.struct("pos", "embedding")))["embedding"].alias("vectors")
    )
    if model_fn is not None:
        if dim is None:
            raise ValueError("a model needs the dimension of its input vectors")
        embedding = _predicted(F.col("vectors"), config.max_seq_length, dim, model_fn, batch_size)
    else:
        embedding = pool(F.col("vectors"), config.pooling)
    embedding = unit(embedding) if config.normalize else embedding
    return listed.select("query_id", embedding.alias("embedding"))


def encode_runs(
    histories: DataFrame,
    vectors: DataFrame,
    runs: dict[str, EncoderConfig],
    *,
    heavy_items: Sequence | None = None,
) -> DataFrame:
    """``run_id, query_id, embedding``: the histories under several settings, their vectors joined once per length.

    Rows as of ``encode_histories``, for each run its own.
    """
    out = []
    for length in sorted({config.max_seq_length for config in runs.values()}):
        listed = _tail_vectors(histories, vectors, length, heavy_items).groupBy("query_id").agg(
            F.sort_array(F.collect_list(F.struct("pos", "embedding")))["embedding"].alias("vectors")
        )
        pooled = []
        for run, config in runs.items():
            if config.max_seq_length == length:
                vector = pool(F.col("vectors"), config.pooling)
                pooled.append(F.struct(F.lit(run).alias("run_id"), (unit(vector) if config.normalize else vector).alias("embedding")))
        rows = listed.select("query_id", F.explode(F.array(*pooled)).alias("run"))
        out.append(rows.select("run.run_id", "query_id", "run.embedding"))
    return reduce(DataFrame.unionByName, out)


def _tail_vectors(
    histories: DataFrame, vectors: DataFrame, length: int, heavy_items: Sequence | None
) -> DataFrame:
    histories = histories.select("query_id", "pos", "item_id")
    tail = known_tail(histories, vectors, length, heavy_items=heavy_items)
    embeddings = vectors.select("item_id", "embedding")
    return join_lookup(tail, embeddings, "item_id", "inner", heavy=heavy_items)


def _predicted(
    vectors: Column, length: int, dim: int, model_fn: ModelFn, batch_size: int
) -> Column:
    predict = predict_batch_udf(
        model_fn,
        return_type=T.ArrayType(T.FloatType()),
        batch_size=batch_size,
        input_tensor_shapes=[[length, dim]],
    )
    flat = F.flatten(vectors).cast("array<float>")
    missing = F.lit(length * dim) - F.size(flat)
    padding = F.array_repeat(F.lit(0.0).cast("float"), missing)
    return as_double(predict(F.concat(flat, padding)))


def embed_or_zero(queries: DataFrame, encoded: DataFrame, dim: int) -> DataFrame:
    """Every query with its vector; zeros where there was nothing to encode."""
    zeros = F.array_repeat(F.lit(0.0), dim)
    found = queries.join(encoded, "query_id", "left")
    return found.withColumn("embedding", F.coalesce("embedding", zeros))


def prefix_states(histories: DataFrame, vectors: DataFrame, config: EncoderConfig = EncoderConfig()) -> DataFrame:
    """``query_id, pos, embedding``: per place of a query's last items the pooled vector of those up to it.

    All-zero vectors have no row and do not count; ``first`` is the first vector that counts. One fold over each query's list of
    at most ``max_seq_length`` vectors: a state follows from the one before and the next vector, whatever their dimension.
    """
    rows = _tail_vectors(histories, vectors, config.max_seq_length, None)
    rows = rows.withColumn("embedding", as_double(F.col("embedding"))).where(~is_zero(F.col("embedding")))
    listed = rows.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("pos", "embedding"))).alias("seen"))
    merge = {
        "mean": lambda state, v: F.zip_with(state, v, lambda a, b: a + b),
        "max": lambda state, v: F.zip_with(state, v, lambda a, b: F.greatest(a, b)),
        "first": lambda state, v: state,
        "last": lambda state, v: v,
    }[config.pooling]

    def step(states: Column, entry: Column) -> Column:
        last = F.element_at(states, -1)
        return F.concat(states, F.array(merge(last, entry["embedding"])))

    first = F.array(F.col("seen")[0]["embedding"])
    states = F.aggregate(F.slice("seen", 2, F.greatest(F.size("seen") - 1, F.lit(0))), first, step)
    out = listed.select("query_id", "seen.pos", F.posexplode(states).alias("nth", "state"))
    state = F.col("state")
    if config.pooling == "mean":
        state = F.transform(state, lambda x: x / (F.col("nth") + 1))
    return out.select("query_id", F.col("pos")[F.col("nth")].alias("pos"), (unit(state) if config.normalize else state).alias("embedding"))


def prefix_means(
    histories: DataFrame, vectors: DataFrame, dim: int, config: EncoderConfig = EncoderConfig()
) -> DataFrame:
    """``prefix_states`` with the mean, for vectors of ``dim`` numbers."""
    found = prefix_states(histories, vectors, replace(config, pooling="mean"))
    return found.where(F.size("embedding") == dim)
