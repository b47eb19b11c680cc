"""The operators run over the whole warehouse tables, one query per operator or job.

``events`` in a name is the event log, ``orders`` the log of order lines; see ``sources.warehouse``.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial, reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nextrail.config import EncoderConfig, IndexConfig, LossConfig, SequenceConfig
from nextrail.functions import vectors as vec
from nextrail.operators import activity, coded, cooccur, encode, hashed, kmeans, lookup, losses, metrics, pruned, recommend, search
from nextrail.operators import sequences as seq
from nextrail.operators.skew import heavy_keys, join_lookup, running_totals
from nextrail.operators.split import split_summary, train_test_split
from nextrail.plans.evaluate import evaluate, evaluate_runs, held_out_users, histories_of
from nextrail.plans.prepare import prepare, prepare_files, stage_views
from nextrail.plans.training import training_examples
from nextrail.sources import warehouse as wh
from nextrail.sources.tables import own_folder, preview, read_split, stage, table_counts
from nextrail.sources.vector_store import copy_store, open_store, search_store, write_store

Query = Callable[[SparkSession, str], DataFrame]
DIM = 64
LOGS = {"events": wh.event_log, "orders": wh.order_log, "priorities": wh.priority_log}
ITEMS = {"events": wh.event_items, "orders": wh.part_items, "priorities": wh.priority_items}
USERS = {"events": wh.event_users, "orders": wh.customer_users, "priorities": wh.customer_users}
VECTORS = {"events": wh.event_item_vectors, "orders": wh.part_item_vectors, "priorities": wh.priority_items}
#: The items that sequences are made of: what the event log's items have a vector for, and every part.
CATALOGUES = {"events": wh.event_item_vectors, "orders": wh.part_items, "priorities": wh.priority_items}


def rounded(column: Column | str, name: str) -> Column:
    """Six digits, and no negative zero."""
    value = F.col(column) if isinstance(column, str) else column
    return (F.round(value.cast("double"), 6) + F.lit(0.0)).alias(name)


class Log:
    """An interaction log, read or joined once, with its heavy users."""

    def __init__(self, spark: SparkSession, d: str, name: str) -> None:
        raw = LOGS[name](spark, d)
        self.raw = stage(raw) if name == "orders" else raw
        self.items, self.users = ITEMS[name](spark, d), USERS[name](spark, d)
        self.vectors = VECTORS[name](spark, d)
        self.heavy = heavy_keys(self.raw, "user_id")

    def split(self, profiles: DataFrame | None = None) -> DataFrame:
        return train_test_split(self.raw, profiles=profiles, heavy=self.heavy)

    def enriched(self) -> DataFrame:
        return activity.enrich_events(self.split(self.users), self.items)

    def placed(self) -> DataFrame:
        return activity.place_activities(self.split(), heavy=self.heavy)

    def laid_out(self) -> DataFrame:
        events = stage(self.enriched())
        return activity.lay_out_users(self.users, events, heavy=self.heavy)

    def histories(self) -> DataFrame:
        return stage(histories_of(self.placed()))


def positive_counts():
    """A stand-in for a sequence model: per dimension the number of positive entries among the vectors."""
    return lambda inputs: (inputs > 0).sum(axis=1).astype("float32")


def by_dimension(df: DataFrame, *keys: str, column: str = "embedding") -> DataFrame:
    return df.select(*keys, F.posexplode(column).alias("dim", "value")).select(
        *keys, "dim", rounded("value", "value")
    )


def candidates(df: DataFrame) -> DataFrame:
    return df.select("query_id", "item_id", rounded("score", "score"), "rank")


# --- preparation ---


def split_flags(spark: SparkSession, d: str, log: str) -> DataFrame:
    return Log(spark, d, log).split().select(
        "user_id", "item_id", "event_value", "event_name",
        "is_train", "is_val", "is_test", "is_predict",
    )


def split_sizes(spark: SparkSession, d: str) -> DataFrame:
    return split_summary(Log(spark, d, "orders").split())


def val_events(spark: SparkSession, d: str) -> DataFrame:
    return Log(spark, d, "orders").split().where("is_val").select("user_id", "item_id", "event_value")


def item_text_json(spark: SparkSession, d: str) -> DataFrame:
    return wh.part_items(spark, d)


def user_text_json(spark: SparkSession, d: str) -> DataFrame:
    return wh.customer_users(spark, d)


def events_enriched(spark: SparkSession, d: str) -> DataFrame:
    return Log(spark, d, "orders").enriched().select(
        "user_id", "item_id", "event_value", "event_name", "label", "item_text", "user_text"
    )


def items_seen_in_train(spark: SparkSession, d: str) -> DataFrame:
    return activity.flag_items(wh.part_items(spark, d), Log(spark, d, "orders").split())


def user_history(spark: SparkSession, d: str, log: str) -> DataFrame:
    """The activities of all users in order."""
    rows = Log(spark, d, log).laid_out().where("part IS NOT NULL")
    return rows.select("user_id", "part", "pos", "item_id", "item_text", "event_name", "event_value", "label")


def user_lists(spark: SparkSession, d: str) -> DataFrame:
    """The whole parts as lists of at most 50 activities, laid out again."""
    lists = activity.latest_lists(Log(spark, d, "orders").laid_out(), None, list_rows=50)
    return activity.list_rows(lists, "item_id", "item_text", "event_value", "label")


def user_lists_latest(spark: SparkSession, d: str) -> DataFrame:
    """The last eight activities of each part, as lists and laid out again."""
    lists = activity.latest_lists(Log(spark, d, "orders").laid_out(), 8)
    return activity.list_rows(lists, "item_id", "item_text", "event_value", "label")


def users_flagged(spark: SparkSession, d: str) -> DataFrame:
    """Every customer with the number of its activities and its flags; NULL without orders."""
    flags = ("is_train", "is_val", "is_test", "is_predict")
    users = Log(spark, d, "orders").laid_out().groupBy("user_id").agg(
        *[F.count_if(F.col("part") == part).alias(part) for part in ("history", "target")],
        *[F.bool_or(flag).alias(flag) for flag in flags],
    )
    sizes = [F.when(F.col("is_train").isNotNull(), F.col(part)).alias(f"n_{part}") for part in ("history", "target")]
    return users.select("user_id", *sizes, *flags)


def table_sizes(spark: SparkSession, d: str) -> DataFrame:
    return table_counts(wh.part_items(spark, d))


def prepared_stages(spark: SparkSession, d: str) -> DataFrame:
    """The events of each stage, from the tables that ``prepare`` writes and ``read_split`` scans."""
    folder = own_folder(spark, "prepared")
    prepare(wh.order_log(spark, d), wh.part_items(spark, d), wh.customer_users(spark, d), folder)
    parts = [
        read_split(spark, f"{folder}/events.parquet", f"is_{name}").select(
            F.lit(name).alias("stage"), "user_id", "item_id", "event_value", "item_text", "user_text"
        )
        for name in ("train", "val", "test", "predict")
    ]
    return reduce(DataFrame.unionByName, parts)


def raw_files(spark: SparkSession, d: str) -> DataFrame:
    """Parts, customers and the order log written as raw files, read again and prepared: the flagged events."""
    folder = own_folder(spark, "raw")

    def write(rows: DataFrame, name: str, *fields: Column) -> None:
        rows.select(F.concat_ws("::", *[F.coalesce(f.cast("string"), F.lit("")) for f in fields])).write.text(f"{folder}/{name}.dat")

    parts = wh.table(spark, d, "part")
    write(parts, "movies", F.col("p_partkey"), F.col("p_name"), F.replace("p_type", F.lit(" "), F.lit("|")))
    write(
        wh.table(spark, d, "customer"), "users",
        F.col("c_custkey"), F.substring("c_mktsegment", 1, 1), F.col("c_nationkey"), F.length("c_name"), F.col("c_custkey"),
    )
    log = wh.order_log(spark, d)
    write(log, "ratings", F.col("user_id"), F.col("item_id"), F.col("event_value").cast("int"), 86_400 * F.unix_date(F.col("datetime").cast("date")))
    made = prepare_files(spark, folder, own_folder(spark, "prepared"))
    return made.events.select(
        "user_id", "item_id", "event_value", F.col("datetime").cast("string").alias("datetime"), "event_name", "label",
        "item_text", "user_text", "is_train", "is_val", "is_test",
    )


def stage_view(spark: SparkSession, d: str) -> DataFrame:
    """The users' activities as the stage views give them, and the items' vectors' entries that aren't zero."""
    folder = own_folder(spark, "prepared")
    prepare(wh.order_log(spark, d), wh.part_items(spark, d), wh.customer_users(spark, d), folder, version="1")
    views = stage_views(spark, folder, model_fn=encode.hashed_words(16))
    users = [
        views[name].select(F.lit(name).alias("view"), F.col("user_id").alias("id"), "part", F.col("pos").cast("long").alias("place"), F.col("event_value").cast("double").alias("value"))
        for name in ("val", "test")
    ]
    items = views["items"].select("item_id", F.posexplode("embedding").alias("dim", "value")).where("value <> 0")
    entries = items.select(
        F.lit("items").alias("view"), F.col("item_id").alias("id"), F.lit(None).cast("string").alias("part"),
        F.col("dim").cast("long").alias("place"), rounded("value", "value"),
    )
    return reduce(DataFrame.unionByName, [*users, entries])


def preview_sizes(spark: SparkSession, d: str) -> DataFrame:
    """How many rows a preview of each table has."""
    tables = {"parts": wh.part_items(spark, d), "customers": wh.customer_users(spark, d), "regions": wh.table(spark, d, "region")}
    counts = [table_counts(preview(rows, 7)).select(F.lit(name).alias("name"), "n_rows") for name, rows in tables.items()]
    return reduce(DataFrame.unionByName, counts)


def targets_without_history(spark: SparkSession, d: str) -> DataFrame:
    """The rows of ``new_targets`` by exclusion of the history's pairs."""
    events = Log(spark, d, "orders").split().select("user_id", "item_id", "is_train")
    return lookup.without_ids(events.where("NOT is_train"), events.where("is_train"), ["user_id", "item_id"]).drop("is_train")


# --- sequences ---


def vocabulary(spark: SparkSession, d: str) -> DataFrame:
    return seq.vocabulary(wh.part_items(spark, d)).select("item_id", "item_idx")


def indexed(spark: SparkSession, d: str, log: str) -> tuple[DataFrame, DataFrame, list]:
    """Histories over the log's catalogue, its vocabulary, and the heavy users."""
    source = Log(spark, d, log)
    vocab = stage(seq.vocabulary(CATALOGUES[log](spark, d).select("item_id", "item_text")))
    past = seq.index_histories(
        source.split(), vocab, heavy=source.heavy
    )
    return stage(past), vocab, source.heavy


def history_trimmed(spark: SparkSession, d: str, log: str) -> DataFrame:
    return indexed(spark, d, log)[0].select("user_id", "pos", "item_id", "item_idx", "label", "hits")


def history_copies(spark: SparkSession, d: str) -> DataFrame:
    return seq.copies_of(indexed(spark, d, "orders")[0], 8)


def history_tail(spark: SparkSession, d: str) -> DataFrame:
    items = wh.part_items(spark, d)
    return encode.known_tail(Log(spark, d, "orders").histories(), items, 8)


SAMPLING = {
    "events": SequenceConfig(seed=3),
    "orders": SequenceConfig(max_seq_length=8, pos_lookahead=3, batch_size=64, seed=5),
    # Few items: many users have seen them all.
    "priorities": SequenceConfig(max_seq_length=4, batch_size=16, seed=7),
}


def sample_sequences(spark: SparkSession, d: str, log: str) -> DataFrame:
    config = SAMPLING[log]
    copies = seq.copies_of(indexed(spark, d, log)[0], config.max_seq_length)
    return seq.sample_positions(copies, config).select(
        "user_id", "copy", F.posexplode("places").alias("slot", "pos")
    )


def sample_positives(spark: SparkSession, d: str, log: str) -> DataFrame:
    config = SAMPLING[log]
    past = indexed(spark, d, log)[0]
    samples = seq.sample_positions(seq.copies_of(past, config.max_seq_length), config)
    return seq.sample_positives(samples, past, config)


def sample_negatives(spark: SparkSession, d: str, log: str) -> DataFrame:
    config = SAMPLING[log]
    past, vocab, heavy = indexed(spark, d, log)
    samples = seq.sample_positions(seq.copies_of(past, config.max_seq_length), config)
    return seq.sample_negatives(samples, past, vocab.count(), config, heavy=heavy)


def batched_examples(spark: SparkSession, d: str, log: str, with_texts: bool = False):
    source = Log(spark, d, log)
    return training_examples(
        source.split(),
        CATALOGUES[log](spark, d).select("item_id", "item_text"),
        SAMPLING[log],
        with_texts=with_texts,
        heavy=source.heavy,
    )


def example_texts(spark: SparkSession, d: str) -> DataFrame:
    """The texts of each slot, aligned with its items."""
    batched, _ = batched_examples(spark, d, "events", with_texts=True)
    roles = ("history", "pos", "neg")
    zipped = F.arrays_zip(*[f"{role}_item_text" for role in roles])
    return batched.select("user_id", "copy", F.posexplode(zipped).alias("slot", "texts")).select(
        "user_id", "copy", "slot", *[F.col(f"texts.{role}_item_text") for role in roles]
    )


def padded_batches(spark: SparkSession, d: str) -> DataFrame:
    batched, _ = batched_examples(spark, d, "orders")
    return seq.pad_batches(batched).select(
        "user_id", "copy", "batch_id",
        F.size("history_item_idx").alias("seq_len"),
        *[
            F.array_join(F.col(f"{role}_item_idx").cast("array<string>"), ",").alias(role)
            for role in ("history", "pos", "neg")
        ],
    )


def batch_stats(spark: SparkSession, d: str) -> DataFrame:
    batched, _ = batched_examples(spark, d, "orders")
    return seq.batch_stats(batched).select(
        "batch_id", "size", "seq_len", "numel", "attention_non_zero", "positive_non_zero",
        rounded("attention_density", "attention_density"),
        rounded("positive_density", "positive_density"),
    )


# --- lookups ---


def order_requests(spark: SparkSession, d: str) -> DataFrame:
    """One request per order for the parts of its lines, one row per line; an order has few of them."""
    lines = wh.table(spark, d, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("request_id"),
        "l_linenumber",
        F.col("l_partkey").cast("string").alias("item_id"),
        F.col("l_suppkey").cast("string").alias("supplier"),
    )
    order = ["l_linenumber", "item_id", "supplier"]
    placed = running_totals(lines, "request_id", order, {"line": F.lit(1)}, heavy=[])
    return placed.select("request_id", F.col("line_before").alias("pos"), "item_id", "supplier")


def lookup_ordered(spark: SparkSession, d: str) -> DataFrame:
    found = lookup.lookup_ordered(order_requests(spark, d), wh.part_items(spark, d))
    return found.select("request_id", "pos", "item_id", "item_text")


def lookup_store(spark: SparkSession, d: str) -> DataFrame:
    found = lookup.lookup_store(order_requests(spark, d), wh.part_items(spark, d))
    return found.select("request_id", "item_id", "item_text")


def lookup_one(spark: SparkSession, d: str) -> DataFrame:
    asked = wh.order_log(spark, d).select(F.col("user_id").alias("request_id"), "item_id")
    found = lookup.lookup_one(asked, wh.part_items(spark, d))
    return found.select("request_id", "item_id", "item_text", "is_found")


def lookup_user(spark: SparkSession, d: str) -> DataFrame:
    """The customer of each order, by id."""
    asked = wh.table(spark, d, "orders").select(
        F.col("o_orderkey").cast("string").alias("request_id"), F.col("o_custkey").cast("string").alias("user_id")
    )
    found = lookup.lookup_one(asked, wh.customer_users(spark, d), id_col="user_id")
    return found.select("request_id", "user_id", "user_text", "is_found")


def new_targets(spark: SparkSession, d: str) -> DataFrame:
    """Held-out (user, item) rows whose item is not in the user's history."""
    events = Log(spark, d, "orders").split().select("user_id", "item_id", "is_train")
    # One pass: the held-out rows of a pair are counted, and given back if none of the pair's rows is in the history.
    pairs = events.dropna(subset=["user_id", "item_id"]).groupBy("user_id", "item_id").agg(
        F.bool_or("is_train").alias("known"), F.count_if(~F.col("is_train")).cast("int").alias("times")
    )
    fresh = pairs.where(~F.col("known"))
    return fresh.select("user_id", "item_id", F.explode(F.array_repeat(F.lit(0), F.col("times"))).alias("_")).drop("_")


# --- vectors ---


def pooled(spark: SparkSession, d: str, mode: str, normalize: bool = False) -> DataFrame:
    config = EncoderConfig(pooling=mode, normalize=normalize)
    items = wh.event_item_vectors(spark, d)
    return by_dimension(
        encode.encode_histories(Log(spark, d, "events").histories(), items, config), "query_id"
    )


def pooled_by_model(spark: SparkSession, d: str) -> DataFrame:
    """Histories through a plugged model."""
    config = EncoderConfig(max_seq_length=6)
    found = encode.encode_histories(
        Log(spark, d, "events").histories(), wh.event_item_vectors(spark, d), config, model_fn=positive_counts, dim=DIM
    )
    return by_dimension(found, "query_id")


def pooled_or_zero(spark: SparkSession, d: str) -> DataFrame:
    config = EncoderConfig(max_seq_length=4)
    items = stage(wh.part_item_vectors(spark, d))
    encoded = encode.encode_histories(Log(spark, d, "orders").histories(), items, config)
    queries = wh.customer_users(spark, d).select(F.col("user_id").alias("query_id"))
    return by_dimension(encode.embed_or_zero(queries, encoded, DIM), "query_id")


def prefix_mean(spark: SparkSession, d: str) -> DataFrame:
    items = wh.event_item_vectors(spark, d)
    means = encode.prefix_means(Log(spark, d, "events").histories(), items, DIM)
    return by_dimension(means, "query_id", "pos")


def prefix_state(spark: SparkSession, d: str, mode: str) -> DataFrame:
    items = wh.event_item_vectors(spark, d)
    states = encode.prefix_states(Log(spark, d, "events").histories(), items, EncoderConfig(pooling=mode))
    return by_dimension(states, "query_id", "pos")


def pair_similarity(spark: SparkSession, d: str) -> DataFrame:
    """Each history item with the next one of its user."""
    items = stage(wh.event_item_vectors(spark, d).select("item_id", "embedding"))
    past = Log(spark, d, "events").histories()
    following = past.select("query_id", (F.col("pos") - 1).alias("pos"), F.col("item_id").alias("other_id"))
    # Ids meet first. A log of few items is a small file of many rows: by its size it would be sent to all tasks.
    pairs = past.select("query_id", "pos", "item_id").join(following.hint("merge"), ["query_id", "pos"])
    pairs = join_lookup(pairs, items, "item_id", "inner")
    pairs = join_lookup(pairs, items.select(F.col("item_id").alias("other_id"), F.col("embedding").alias("other")), "other_id", "inner")
    one, other = F.col("embedding"), F.col("other")
    return pairs.select(
        "query_id", "pos",
        rounded(vec.dot(one, other), "dot"),
        rounded(vec.cosine(one, other), "cosine"),
        rounded(vec.half_squared_distance(one, other), "half_l2"),
        rounded(vec.norm(vec.unit(one)), "unit_norm"),
        rounded(vec.unit(one)[0], "unit_first"),
    )


def all_vectors(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    items = wh.item_vectors(spark, d)
    return items.select(F.col("item_id").alias("query_id"), "embedding"), items


def knn_exact(spark: SparkSession, d: str, metric: str) -> DataFrame:
    queries, items = all_vectors(spark, d)
    return candidates(search.search(queries, items, metric=metric))


def knn_excluding_seen(spark: SparkSession, d: str) -> DataFrame:
    """Parts for each customer's mean vector, none it ever ordered."""
    source = Log(spark, d, "orders")
    items = stage(source.vectors)
    encoded = stage(encode.encode_histories(source.histories(), items))
    seen = source.raw.select(F.col("user_id").alias("query_id"), "item_id")
    return candidates(search.search(encoded, items, exclude=seen, metric="dot"))


def knn_clusters(spark: SparkSession, d: str, nprobe: int | None) -> DataFrame:
    queries, items = all_vectors(spark, d)
    clustered, centroids = kmeans.cluster_items(items)
    if nprobe is None:
        nprobe = search.n_lists(items.count())
    found = search.search_clusters(queries, stage(clustered), centroids, nprobe=nprobe)
    return candidates(found)


def knn_probing(spark: SparkSession, d: str) -> DataFrame:
    """All vectors through the clustered index: 8 probes, or as many as it takes to find 0.9 of the exact neighbours."""
    queries, items = all_vectors(spark, d)
    clustered, centroids = kmeans.cluster_items(items)
    clustered = stage(clustered)
    nprobe = search.probes_for(queries, clustered, centroids)
    return candidates(search.search_clusters(queries, clustered, centroids, nprobe=nprobe))


def knn_probe_labels(spark: SparkSession, d: str, metric: str = "dot") -> DataFrame:
    """The vectors clustered by their label, the three nearest of the labels' mean vectors probed."""
    items = wh.table(spark, d, "embeddings").select(
        F.col("vec_id").cast("string").alias("item_id"),
        vec.as_double(F.col("embedding")).alias("embedding"),
        F.col("label").alias("cluster_id"),
    )
    means = items.groupBy("cluster_id").agg(
        F.array(*[F.avg(F.col("embedding")[i]) for i in range(DIM)]).alias("centroid")
    )
    queries = items.select(F.col("item_id").alias("query_id"), "embedding")
    return candidates(
        search.search_clusters(queries, items, means, top_k=10, nprobe=3, metric=metric)
    )


def knn_inner_product(spark: SparkSession, d: str) -> DataFrame:
    """Raw inner products of each user's mean vector with the items it has not seen."""
    source = Log(spark, d, "events")
    past = source.histories()
    items = stage(source.vectors)
    encoded = stage(encode.encode_histories(past, items))
    return candidates(search.search(encoded, items, exclude=past, metric="dot", top_k=10))


def knn_stored(spark: SparkSession, d: str) -> DataFrame:
    """All vectors through an index that is written, opened again and probed in full."""
    queries, items = all_vectors(spark, d)
    path = own_folder(spark, "store")
    write_store(items, path, IndexConfig(metric="cosine"))
    store = open_store(spark, path)
    found = search.search_clusters(
        queries, store.items, store.centroids, nprobe=store.centroids.count(), metric=store.config.metric
    )
    return candidates(found)


def knn_copied(spark: SparkSession, d: str) -> DataFrame:
    """The written index copied, the copy searched exactly by its bounds."""
    queries, items = all_vectors(spark, d)
    path, to = own_folder(spark, "store"), own_folder(spark, "store")
    write_store(items, path, IndexConfig(metric="l2"))
    return candidates(search_store(queries, copy_store(spark, path, to)))


def recommend_probing(spark: SparkSession, d: str) -> DataFrame:
    """Items for customers through the clustered index, all of its clusters probed."""
    source = Log(spark, d, "orders")
    clustered, centroids = kmeans.cluster_items(stage(source.vectors))
    found = recommend.nearest_to_histories(
        source.histories(), stage(clustered), centroids=centroids, nprobe=centroids.count(), top_k=10
    )
    return candidates(found)


def clustered_index(items: DataFrame, metric: str) -> pruned.ClusterIndex:
    return pruned.index_clusters(stage(kmeans.cluster_items(items, metric=metric)[0]), metric)


def knn_pruned(spark: SparkSession, d: str, metric: str) -> DataFrame:
    """All vectors with all, exactly, through the clusters that the bounds leave."""
    queries, items = all_vectors(spark, d)
    return candidates(pruned.search_pruned(queries, clustered_index(items, metric)))


def recommend_indexed(spark: SparkSession, d: str, log: str) -> DataFrame:
    """The same recommendations as without an index."""
    source = Log(spark, d, log)
    items = stage(source.vectors)
    found = recommend.recommend_histories(source.histories(), items, metric="dot", index=clustered_index(items, "dot"))
    return found.select("query_id", "item_id", "item_text", rounded("score", "score"), "rank")


def user_metrics_indexed(spark: SparkSession, d: str) -> DataFrame:
    """Evaluation through the index of the event log's items."""
    source = Log(spark, d, "events")
    items = stage(source.vectors)
    scores = evaluate(source.split(), items, metric="dot", heavy=source.heavy, index=clustered_index(items, "dot"))
    return scores.select("query_id", "stage", *[rounded(m, m) for m in metrics.METRICS])


def labelled_vectors(spark: SparkSession, d: str) -> DataFrame:
    return wh.table(spark, d, "embeddings").select(
        F.col("vec_id").cast("string").alias("item_id"), "embedding", F.col("label").alias("cluster_id")
    )


def knn_stored_probes(spark: SparkSession, d: str, metric: str) -> DataFrame:
    """A written index whose clusters are the labels, opened again: codes of three probed clusters, then exact scores."""
    path = own_folder(spark, "store")
    write_store(labelled_vectors(spark, d), path, IndexConfig(metric=metric))
    queries, _ = all_vectors(spark, d)
    return candidates(search_store(queries, open_store(spark, path), nprobe=3, top_k=10))


def knn_hashed(spark: SparkSession, d: str) -> DataFrame:
    """The best of what shares a bucket of sign bits."""
    queries, items = all_vectors(spark, d)
    return candidates(hashed.search_hashed(queries, items))


def clusters_two_levels(spark: SparkSession, d: str) -> DataFrame:
    """All vectors in 16 clusters, from a stated start: the rows with the least md5, two rounds on either level."""
    points = stage(wh.item_vectors(spark, d).select("item_id", vec.as_double(F.col("embedding")).alias("point")))
    return kmeans.two_levels(points, 16, rounds=2, spread=False)[0]


WINDOW = 5


def item_cooccurrence(spark: SparkSession, d: str, log: str) -> DataFrame:
    """How often two items stand near each other in a history."""
    return cooccur.cooccurrence(Log(spark, d, log).histories(), WINDOW)


def item_mutual_information(spark: SparkSession, d: str, log: str) -> DataFrame:
    weights = cooccur.mutual_information(cooccur.cooccurrence(Log(spark, d, log).histories(), WINDOW))
    return weights.select("item_id", "other_id", rounded("weight", "weight"))


def item_vectors_learnt(spark: SparkSession, d: str) -> DataFrame:
    """Vectors of the event log's items from what stands near what in its histories."""
    counts = cooccur.cooccurrence(Log(spark, d, "events").histories(), WINDOW)
    found, _ = cooccur.item_vectors(stage(cooccur.mutual_information(counts)))
    return by_dimension(found, "item_id")


def knn_coded(spark: SparkSession, d: str, metric: str) -> DataFrame:
    """All vectors with all, exactly: bounds from 8-bit codes first, exact scores of what they leave."""
    queries, items = all_vectors(spark, d)
    return candidates(coded.search_coded(queries, stage(coded.code_items(items, metric)), items, metric=metric))


def index_sizes(spark: SparkSession, d: str) -> DataFrame:
    """Rows per cluster of the index of all vectors, and the planned number of clusters."""
    _, items = all_vectors(spark, d)
    clustered, _ = kmeans.cluster_items(items)
    sizes = clustered.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(
        F.sum("n").alias("n_items"),
        F.count(F.lit(1)).alias("n_clusters"),
        F.lit(search.n_lists(items.count())).cast("bigint").alias("planned"),
    )


def embed_text_default(spark: SparkSession, d: str) -> DataFrame:
    """The entries of the documents' vectors that aren't zero."""
    documents = wh.table(spark, d, "documents").select("doc_id", "text")
    return by_dimension(encode.embed_text(documents, "text"), "doc_id").where("value <> 0")


# --- recommendation and evaluation ---


def recommend_history(spark: SparkSession, d: str, log: str) -> DataFrame:
    source = Log(spark, d, log)
    items = stage(source.vectors)
    found = recommend.recommend_histories(source.histories(), items, metric="dot")
    return found.select("query_id", "item_id", "item_text", rounded("score", "score"), "rank")


def index_of(items: DataFrame, indexed: bool, metric: str = "cosine") -> dict:
    """What makes a job search through an index of its items, if it shall."""
    return {"index": clustered_index(items, metric)} if indexed else {}


def recommend_user(spark: SparkSession, d: str, log: str, indexed: bool = False) -> DataFrame:
    source = Log(spark, d, log)
    items = stage(source.vectors)
    return candidates(recommend.recommend_users(source.placed(), items, top_k=5, **index_of(items, indexed)))


def recommend_item(spark: SparkSession, d: str, indexed: bool = False) -> DataFrame:
    """Similar items for every part."""
    requests = wh.part_items(spark, d).select(F.col("item_id").alias("query_id"), "item_id")
    items = stage(wh.part_item_vectors(spark, d))
    return candidates(recommend.recommend_items(requests, items, top_k=5, **index_of(items, indexed)))


def recommend_query(spark: SparkSession, d: str, indexed: bool = False) -> DataFrame:
    """One request per order: the parts of its lines; pending orders bring the vectors of their suppliers'
    numbers, urgent ones a vector of their own; the customer's number is excluded."""
    vectors = wh.item_vectors(spark, d)
    orders = wh.table(spark, d, "orders").select(
        F.col("o_orderkey").cast("string").alias("query_id"),
        F.col("o_custkey").cast("string").alias("item_id"),
        "o_orderstatus",
        "o_orderpriority",
    )
    lines = stage(order_requests(spark, d).withColumnRenamed("request_id", "query_id"))
    pending = orders.where("o_orderstatus = 'P'").select("query_id")
    supplied = join_lookup(
        lines.select("query_id", "pos", F.col("supplier").alias("item_id")), vectors, "item_id", "inner"
    )
    supplied = join_lookup(supplied, pending, "query_id", "inner")
    queries = join_lookup(orders, vectors, "item_id").select(
        "query_id",
        F.when(F.col("o_orderpriority") == "1-URGENT", F.col("embedding")).alias("embedding"),
        F.when(F.col("o_orderpriority") == "5-LOW", F.lit(2)).alias("top_k"),
    )
    items = stage(wh.part_item_vectors(spark, d))
    return candidates(
        recommend.recommend_queries(
            queries,
            items,
            item_rows=lines,
            input_rows=stage(supplied),
            exclude=orders,
            top_k=4,
            encoder=EncoderConfig(max_seq_length=3),
            **index_of(items, indexed),
        )
    )


def search_vectors(spark: SparkSession, d: str, indexed: bool = False) -> DataFrame:
    queries, _ = all_vectors(spark, d)
    items = stage(wh.part_item_vectors(spark, d))
    found = recommend.search_vectors(queries, items, top_k=3, metric="l2", **index_of(items, indexed, "l2"))
    return found.select("query_id", "item_id", "item_text", rounded("score", "score"), "rank")


def scored_users(spark: SparkSession, d: str, log: str) -> DataFrame:
    source = Log(spark, d, log)
    return evaluate(
        source.split(),
        stage(source.vectors),
        metric="dot",
        heavy=source.heavy,
    )


def user_metrics(spark: SparkSession, d: str, log: str) -> DataFrame:
    return scored_users(spark, d, log).select(
        "query_id", "stage", *[rounded(m, m) for m in metrics.METRICS]
    )


def own_metric(spark: SparkSession, d: str) -> DataFrame:
    """A registered metric beside the others: the rank of the last hit, 0 without one."""
    metrics.register_metric("last_hit", lambda hits: F.array_max(hits.ranks).cast("double"))
    try:
        return scored_users(spark, d, "events").select("query_id", "stage", rounded("last_hit", "last_hit"))
    finally:
        del metrics.METRICS["last_hit"]


def metrics_mean(spark: SparkSession, d: str) -> DataFrame:
    means = metrics.mean_metrics(scored_users(spark, d, "events"), "stage")
    return means.select("stage", "n_queries", *[rounded(m, m) for m in metrics.METRICS])


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Top 20 unseen items for every validation user, with the user's NDCG."""
    scores = scored_users(spark, d, "events")
    ndcg = "retrieval_normalized_dcg"
    return scores.where("stage = 'val'").select(F.col("query_id").alias("user_id"), rounded(ndcg, ndcg))


def run_results(spark: SparkSession, d: str) -> DataFrame:
    """Validation NDCG by pooling mode, all modes searched for at once."""
    source = Log(spark, d, "events")
    mine, items = held_out_users(source.split(), source.heavy), stage(source.vectors)
    runs = {mode: EncoderConfig(pooling=mode) for mode in ("mean", "max", "first", "last")}
    scores = evaluate_runs(mine, items, runs, metric="dot").where("stage = 'val'")
    return metrics.mean_metrics(scores, "run_id")


def best_run(spark: SparkSession, d: str) -> DataFrame:
    ndcg = "retrieval_normalized_dcg"
    return metrics.best_run(run_results(spark, d), ndcg).select("run_id", rounded(ndcg, ndcg))


# --- losses of a table of scored candidates ---


def scored_lines(spark: SparkSession, d: str) -> DataFrame:
    """An order's lines as candidates, the first one the target, priced and discounted as two scores."""
    lines = wh.table(spark, d, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("query_id"),
        F.concat_ws("-", "l_linenumber", "l_partkey", "l_suppkey").alias("cand_id"),
        (F.sqrt("l_extendedprice") / 100).alias("dot"),
        (1 - 10 * F.col("l_discount")).alias("cosine"),
    )
    slots = running_totals(lines, "query_id", ["cand_id"], {"slot": F.lit(1)}, heavy=[])
    orders = wh.table(spark, d, "orders").select(
        F.col("o_orderkey").cast("string").alias("query_id"), F.col("o_custkey").alias("batch_id")
    )
    slots = slots.withColumnRenamed("slot_before", "slot").drop("slot_total")
    return losses.mark_target(join_lookup(slots, orders, "query_id", "inner"))


def scored_losses(spark: SparkSession, d: str, config: LossConfig = LossConfig()) -> DataFrame:
    sums = losses.batch_losses(stage(scored_lines(spark, d)), config)
    return sums.select(
        "batch_id", "n_queries", *[rounded(c, c) for c in sums.columns if c not in ("batch_id", "n_queries")]
    )


def own_loss(spark: SparkSession, d: str) -> DataFrame:
    """A registered loss: by how much the target misses the mean of its negatives plus one, if at all."""
    losses.register_loss("MeanGap", "dot", lambda q: F.greatest(1 + q.over_negatives(q.logit) - F.max(q.target), F.lit(0.0)))
    try:
        sums = losses.batch_losses(stage(scored_lines(spark, d)), LossConfig())
    finally:
        del losses.LOSSES["MeanGap"]
    return sums.select("batch_id", "n_queries", rounded("MeanGap", "MeanGap"))


def hard_negatives(spark: SparkSession, d: str) -> DataFrame:
    scored = stage(scored_lines(spark, d))
    rows = losses.valid_negatives(scored, LossConfig(num_hard_negatives=2), "cosine")
    return rows.where("is_negative").select("batch_id", "query_id", "cand_id", rounded("logit", "logit"))


def logit_stats(spark: SparkSession, d: str) -> DataFrame:
    stats = losses.logit_stats(stage(scored_lines(spark, d)), LossConfig(num_hard_negatives=2))
    return stats.select("batch_id", *[rounded(c, c) for c in stats.columns if c != "batch_id"])


HARD = LossConfig(num_hard_negatives=5, scale=2.0, margin=0.25)
UNMASKED = LossConfig(mask_false_negatives=False)

QUERIES: dict[str, Query] = {
    "split_flags_events": partial(split_flags, log="events"),
    "split_flags_orders": partial(split_flags, log="orders"),
    "split_summary": split_sizes,
    "val_events": val_events,
    "item_text_json": item_text_json,
    "user_text_json": user_text_json,
    "events_enriched": events_enriched,
    "items_seen_in_train": items_seen_in_train,
    "user_history_events": partial(user_history, log="events"),
    "user_history_orders": partial(user_history, log="orders"),
    "user_lists": user_lists,
    "user_lists_latest": user_lists_latest,
    "users_flagged": users_flagged,
    "prepared_stages": prepared_stages,
    "table_sizes": table_sizes,
    "vocabulary": vocabulary,
    "history_trimmed_events": partial(history_trimmed, log="events"),
    "history_trimmed_orders": partial(history_trimmed, log="orders"),
    "history_copies": history_copies,
    "history_tail": history_tail,
    "sample_sequences_events": partial(sample_sequences, log="events"),
    "sample_sequences_orders": partial(sample_sequences, log="orders"),
    "sample_positives_events": partial(sample_positives, log="events"),
    "sample_positives_orders": partial(sample_positives, log="orders"),
    "sample_negatives_events": partial(sample_negatives, log="events"),
    "sample_negatives_orders": partial(sample_negatives, log="orders"),
    "sample_negatives_priorities": partial(sample_negatives, log="priorities"),
    "example_texts": example_texts,
    "padded_batches": padded_batches,
    "batch_stats": batch_stats,
    "lookup_ordered": lookup_ordered,
    "lookup_store": lookup_store,
    "lookup_one": lookup_one,
    "lookup_user": lookup_user,
    "new_targets": new_targets,
    "targets_without_history": targets_without_history,
    "raw_files": raw_files,
    "stage_view": stage_view,
    "preview_sizes": preview_sizes,
    "pooled_by_model": pooled_by_model,
    "own_metric": own_metric,
    "own_loss": own_loss,
    "knn_copied": knn_copied,
    "pooled_mean": partial(pooled, mode="mean"),
    "pooled_mean_unit": partial(pooled, mode="mean", normalize=True),
    "pooled_max": partial(pooled, mode="max"),
    "pooled_first": partial(pooled, mode="first"),
    "pooled_last": partial(pooled, mode="last"),
    "pooled_or_zero": pooled_or_zero,
    "prefix_mean": prefix_mean,
    "prefix_max": partial(prefix_state, mode="max"),
    "prefix_first": partial(prefix_state, mode="first"),
    "prefix_last": partial(prefix_state, mode="last"),
    "pair_similarity": pair_similarity,
    "knn_exact_dot": partial(knn_exact, metric="dot"),
    "knn_exact_cosine": partial(knn_exact, metric="cosine"),
    "knn_exact_l2": partial(knn_exact, metric="l2"),
    "knn_excluding_seen": knn_excluding_seen,
    "knn_full_probe": partial(knn_clusters, nprobe=None),
    "knn_stored": knn_stored,
    "knn_probe8": knn_probing,
    "knn_probe_labels": knn_probe_labels,
    "knn_probe_labels_cosine": partial(knn_probe_labels, metric="cosine"),
    "knn_probe_labels_l2": partial(knn_probe_labels, metric="l2"),
    "knn_inner_product": knn_inner_product,
    "knn_pruned_dot": partial(knn_pruned, metric="dot"),
    "knn_pruned_cosine": partial(knn_pruned, metric="cosine"),
    "knn_pruned_l2": partial(knn_pruned, metric="l2"),
    "knn_coded_dot": partial(knn_coded, metric="dot"),
    "knn_coded_cosine": partial(knn_coded, metric="cosine"),
    "knn_coded_l2": partial(knn_coded, metric="l2"),
    "knn_stored_probes": partial(knn_stored_probes, metric="dot"),
    "knn_stored_probes_cosine": partial(knn_stored_probes, metric="cosine"),
    "knn_hashed": knn_hashed,
    "clusters_two_levels": clusters_two_levels,
    "item_cooccurrence_events": partial(item_cooccurrence, log="events"),
    "item_cooccurrence_orders": partial(item_cooccurrence, log="orders"),
    "item_mutual_information": partial(item_mutual_information, log="events"),
    "item_vectors_learnt": item_vectors_learnt,
    "recommend_indexed_events": partial(recommend_indexed, log="events"),
    "recommend_indexed_orders": partial(recommend_indexed, log="orders"),
    "recommend_user_indexed": partial(recommend_user, log="orders", indexed=True),
    "recommend_item_indexed": partial(recommend_item, indexed=True),
    "recommend_query_indexed": partial(recommend_query, indexed=True),
    "search_vectors_indexed": partial(search_vectors, indexed=True),
    "user_metrics_indexed": user_metrics_indexed,
    "recommend_probing": recommend_probing,
    "index_sizes": index_sizes,
    "embed_text_default": embed_text_default,
    "recommend_history_events": partial(recommend_history, log="events"),
    "recommend_history_orders": partial(recommend_history, log="orders"),
    "recommend_user_events": partial(recommend_user, log="events"),
    "recommend_user_orders": partial(recommend_user, log="orders"),
    "recommend_item": recommend_item,
    "recommend_query": recommend_query,
    "search_vectors": search_vectors,
    "user_metrics_events": partial(user_metrics, log="events"),
    "user_metrics_orders": partial(user_metrics, log="orders"),
    "metrics_mean": metrics_mean,
    "best_run": best_run,
    "flagship": flagship,
    "scored_losses": scored_losses,
    "scored_losses_hard": partial(scored_losses, config=HARD),
    "scored_losses_unmasked": partial(scored_losses, config=UNMASKED),
    "scored_losses_scaled": partial(scored_losses, config=LossConfig(scale=500.0)),
    "hard_negatives": hard_negatives,
    "logit_stats": logit_stats,
}
