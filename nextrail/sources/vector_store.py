"""A vector table on disk: items and codes by cluster, centroids, bounds and column names."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nextrail.config import TOP_K, IndexConfig
from nextrail.functions.vectors import assert_dimension
from nextrail.operators.coded import ITEM_BLOCK, code_items, search_coded
from nextrail.operators.kmeans import cluster_items
from nextrail.operators.pruned import ClusterIndex, index_clusters, search_pruned
from nextrail.operators.search import probe_clusters
from nextrail.operators.vector_sums import vector_means
from nextrail.sources.tables import require_columns, stage

PARTS = ("items", "centroids", "clusters", "codes", "columns")
#: Parts that are written by cluster.
BY_CLUSTER = ("items", "codes")


@dataclass(frozen=True)
class VectorStore:
    """``items`` and their 8-bit ``codes`` by cluster, the ``centroids`` that are probed, and the clusters' bounds and sizes."""

    config: IndexConfig
    items: DataFrame
    centroids: DataFrame
    clusters: DataFrame
    codes: DataFrame
    most: float

    @property
    def named(self) -> DataFrame:
        """The items with the column names that searches use."""
        config = self.config
        return self.items.withColumnsRenamed({config.id_col: "item_id", config.embedding_col: "embedding"})

    @property
    def index(self) -> ClusterIndex:
        return ClusterIndex(self.named, self.clusters, self.config.metric, self.most)


def write_store(
    items: DataFrame, path: str, config: IndexConfig = IndexConfig(), *, seed: int = 0
) -> VectorStore:
    """Ids as text, vectors as floats of one length, clustered and written by cluster; replaces the table.

    Items that have a column ``cluster_id`` keep their clusters, whose mean vectors are the centroids.
    """
    require_columns(items, [config.id_col, config.embedding_col])
    table = items.withColumns(
        {
            config.id_col: F.col(config.id_col).cast("string"),
            config.embedding_col: F.col(config.embedding_col).cast("array<float>"),
        }
    )
    # Rows without a vector stay readable by id, in a part of their own.
    has_vector = F.col(config.embedding_col).isNotNull() & F.col(config.id_col).isNotNull()
    assert_dimension(table.where(has_vector), config.embedding_col)
    named = table.where(has_vector).withColumnsRenamed({config.embedding_col: "embedding", config.id_col: "item_id"})
    if "cluster_id" in items.columns:
        clustered = stage(named)
        points = clustered.select("cluster_id", F.col("embedding").cast("array<double>").alias("point"))
        centroids = vector_means(points, "cluster_id").withColumnRenamed("mean", "centroid")
    else:
        clustered, centroids = cluster_items(named, seed=seed, metric=config.metric)
        clustered = stage(clustered)
    index = index_clusters(clustered, config.metric)
    rest = table.where(~has_vector).drop("cluster_id").withColumn("cluster_id", F.lit(None).cast("int"))
    whole = clustered.withColumnsRenamed({"embedding": config.embedding_col, "item_id": config.id_col}).unionByName(rest)
    _write_by_cluster(whole, config.id_col, f"{path}/items")
    _write_by_cluster(code_items(clustered, config.metric), "item_id", f"{path}/codes")
    centroids.write.mode("overwrite").parquet(f"{path}/centroids")
    index.clusters.write.mode("overwrite").parquet(f"{path}/clusters")
    spark = items.sparkSession
    columns = spark.range(1).select(
        *[
            F.lit(getattr(config, name)).alias(name)
            for name in ("id_col", "text_col", "embedding_col", "metric")
        ],
        F.lit(index.most).alias("most"),
    )
    columns.write.mode("overwrite").parquet(f"{path}/columns")
    return open_store(spark, path)


def _write_by_cluster(rows: DataFrame, id_col: str, path: str) -> None:
    """Large clusters are written by as many tasks as they fill files."""
    rows = stage(rows)
    files = rows.groupBy("cluster_id").agg(F.ceil(F.count(F.lit(1)) / ITEM_BLOCK).alias("_files"))
    files = F.broadcast(files.withColumnRenamed("cluster_id", "_of"))
    spread = rows.join(files, F.col("cluster_id").eqNullSafe(F.col("_of")))
    spread = spread.withColumn("_file", F.pmod(F.xxhash64(id_col), "_files"))
    spread = spread.repartition("cluster_id", "_file").drop("_of", "_files", "_file")
    spread.write.mode("overwrite").partitionBy("cluster_id").parquet(path)


def open_store(spark: SparkSession, path: str) -> VectorStore:
    """The table with the column names found in its metadata; raises if a needed column is missing."""
    names = spark.read.parquet(f"{path}/columns").first().asDict()
    most = names.pop("most")
    config = replace(IndexConfig(), **names)
    items = spark.read.parquet(f"{path}/items")
    require_columns(items, [config.id_col, config.embedding_col, "cluster_id"])
    rest = {part: spark.read.parquet(f"{path}/{part}") for part in ("centroids", "clusters", "codes")}
    return VectorStore(config, items, **rest, most=most)


def copy_store(spark: SparkSession, path: str, to: str) -> VectorStore:
    """Write the same store elsewhere."""
    for part in PARTS:
        rows = spark.read.parquet(f"{path}/{part}")
        writer = rows.write.mode("overwrite")
        if part in BY_CLUSTER:
            writer = writer.partitionBy("cluster_id")
        writer.parquet(f"{to}/{part}")
    return open_store(spark, to)


def search_store(
    queries: DataFrame,
    store: VectorStore,
    *,
    nprobe: int | None = None,
    exclude: DataFrame | None = None,
    top_k: int = TOP_K,
    refine_factor: int | None = None,
) -> DataFrame:
    """``query_id, item_id, score, rank`` from a stored table: exactly by its bounds, or in the ``nprobe`` nearest clusters (K5).

    With probes only the folders of clusters that some query probes are read, codes first and then the vectors that are
    scored; the number of probes of a cluster, joined to it, prunes the others. ``refine_factor``: see ``search_coded``.
    """
    metric = store.config.metric
    if nprobe is None:
        return search_pruned(queries, store.index, exclude=exclude, top_k=top_k)
    probes = stage(probe_clusters(queries, store.centroids, nprobe, metric))
    touched = stage(probes.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n_probes"))).where("n_probes > 0")
    return search_coded(
        queries,
        store.codes,
        store.named.join(touched, "cluster_id", "left_semi"),
        metric=metric,
        exclude=exclude,
        top_k=top_k,
        probes=probes,
        n_items=store.clusters,
        refine_factor=refine_factor,
    )
