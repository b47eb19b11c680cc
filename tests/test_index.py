"""Clusterings, pruned and coded search, stored tables, hashed buckets and learnt item vectors against NumPy."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from nextrail.config import IndexConfig
from nextrail.operators import coded, cooccur, hashed, kmeans, pruned, recommend, search
from nextrail.operators.vector_sums import vector_means, vector_sums
from nextrail.sources.tables import stage
from nextrail.sources.vector_store import copy_store, open_store, search_store, write_store

RNG = np.random.default_rng(8)
CENTRES = 3 * RNG.normal(size=(20, 8))
MATRIX = CENTRES[RNG.integers(20, size=600)] + 0.4 * RNG.normal(size=(600, 8))
MATRIX[100:300] = MATRIX[100]  # a third are copies of one vector
MATRIX[7] = 0
IDS = [f"i{k:03d}" for k in range(len(MATRIX))]
ASKED = [3, 7, 50, 100, 305, 420, 599]
METRICS = ("dot", "cosine", "l2")


@pytest.fixture(scope="module")
def items(spark):
    rows = [(i, f"text {i}", [float(x) for x in v]) for i, v in zip(IDS, MATRIX)]
    return spark.createDataFrame(rows, "item_id string, item_text string, embedding array<double>").cache()


@pytest.fixture(scope="module")
def queries(spark, items):
    noise = spark.createDataFrame([("far", [9.0] * 8), ("none", None)], "query_id string, embedding array<double>")
    return items.where(F.col("item_id").isin([IDS[k] for k in ASKED])).select(F.col("item_id").alias("query_id"), "embedding").unionByName(noise).cache()


@pytest.fixture(scope="module")
def indices(items):
    return {m: pruned.index_clusters(stage(kmeans.cluster_items(items, metric=m)[0]), m) for m in METRICS}


def ranked(df):
    return sorted((r.query_id, r["rank"], r.item_id, round(r.score, 8)) for r in df.collect())


def barred(spark):
    pairs = [(IDS[k], IDS[j]) for k in ASKED for j in range(k % 5, 600, 3)] + [("far", i) for i in IDS[:595]]
    return spark.createDataFrame(pairs, "query_id string, item_id string")


# ---- clustering


def test_assign_and_train_in_blocks(spark):
    points = spark.createDataFrame(
        [(f"p{i}", i % 2, [float(x) for x in v]) for i, v in enumerate(MATRIX[:90])], "item_id string, group int, point array<double>"
    )
    centres = spark.createDataFrame([(0, 0, [0.0] * 8), (0, 4, [5.0] * 8), (1, 2, [-1.0] * 8), (1, 3, [-1.0] * 8)], "group int, place int, centre array<double>")
    got = {r.item_id: r.place for r in kmeans.assign(points, centres, block_rows=7).collect()}
    for i, v in enumerate(MATRIX[:90]):
        near = {0: [(0, np.zeros(8)), (4, np.full(8, 5.0))], 1: [(2, np.full(8, -1.0))]}[i % 2]  # equal centres: the first
        assert got[f"p{i}"] == min(near, key=lambda c: ((v - c[1]) ** 2).sum())[0]
    counts = spark.createDataFrame([(0, 3), (1, 2)], "group int, k int")
    trained = kmeans.train(points, counts, rounds=0, spread=False).collect()
    assert sorted((r.group, r.place) for r in trained) == [(0, 0), (0, 1), (0, 2), (1, 0), (1, 1)]


def test_a_round_moves_centres_to_the_means():
    vectors = np.array([[0.0], [1.0], [10.0], [11.0], [12.0]])
    assert kmeans._fit(vectors, 2, 1, None).tolist() == [[0.0], [8.5]]
    assert sorted(kmeans._fit(vectors, 2, 5, np.random.default_rng(0)).ravel()) == [0.5, 11.0]
    assert len(kmeans._fit(np.ones((4, 2)), 3, 2, np.random.default_rng(0))) == 1


def test_shares_add_up():
    for sizes, total in (({0: 1, 1: 1, 2: 98}, 16), ({0: 5}, 4), ({3: 10, 5: 10, 9: 10}, 8)):
        shares = kmeans._shares(sizes, total)
        assert sum(shares.values()) == total and min(shares.values()) >= 1
        assert shares[max(sizes, key=sizes.get)] == max(shares.values())


def test_items_are_clustered_as_they_are(spark, items):
    extra = spark.createDataFrame([(None, "no id", [1.0] * 8), ("none", "no vector", None), (IDS[0], "again", [float(x) for x in MATRIX[50]])], items.schema)
    found, centroids = kmeans.cluster_items(items.unionByName(extra), n_clusters=8)
    rows = found.collect()
    assert len(rows) == 601 and found.columns == [*items.columns, "cluster_id"]
    assert {r.cluster_id for r in rows} <= {r.cluster_id for r in centroids.collect()}
    assert len({r.cluster_id for r in rows if r.item_id in IDS[100:300]}) == 1
    again = {r.item_text: r.cluster_id for r in kmeans.cluster_items(items.repartition(7), n_clusters=8)[0].collect()}
    # Copies under one id aside, partitions change nothing.
    same = kmeans.cluster_items(items.coalesce(1), n_clusters=8)[0].collect()
    assert len(again) == len(same)


def test_vector_sums(spark):
    rows = [("a", 1, [1.0, 2.0]), ("a", 1, [3.0, 4.0]), ("b", None, [5.0, 6.0]), (None, 1, [7.0, 8.0]), ("a", 2, [0.5, 0.5])]
    points = spark.createDataFrame(rows * 3, "k string, g int, point array<double>").repartition(3)
    got = {(r.k, r.g): (r.n, r.total) for r in vector_sums(points, "k", "g").collect()}
    assert got == {("a", 1): (6, [12.0, 18.0]), ("b", None): (3, [15.0, 18.0]), (None, 1): (3, [21.0, 24.0]), ("a", 2): (3, [1.5, 1.5])}
    assert {r.k: r["mean"] for r in vector_means(points, "k").collect()}["b"] == [5.0, 6.0]
    assert vector_sums(points.where("false"), "k").count() == 0


# ---- pruned search


@pytest.mark.parametrize("shared", [0, search.SHARED_BYTES])
@pytest.mark.parametrize("metric", METRICS)
def test_pruned_search_is_exact(spark, items, queries, indices, metric, shared):
    for exclude in (None, barred(spark)):
        want = ranked(search.search(queries, items, metric=metric, top_k=9, exclude=exclude))
        report = {}
        got = pruned.search_pruned(queries, indices[metric], top_k=9, exclude=exclude, item_block=40, shared_bytes=shared, report=report)
        assert ranked(got) == want
        assert report["pairs"] == 600 * 8 and 0 < report["scored"].value <= report["pairs"]
    everything = pruned.search_pruned(queries, indices[metric], top_k=700, shared_bytes=shared)
    assert ranked(everything) == ranked(search.search(queries, items, metric=metric, top_k=700))


@pytest.mark.parametrize("shared", [0, search.SHARED_BYTES])
def test_bounds_leave_most_pairs_out(queries, indices, shared):
    report = {}
    pruned.search_pruned(queries, indices["l2"], top_k=5, first=1, shared_bytes=shared, report=report).collect()
    assert report["scored"].value < 0.6 * report["pairs"]


@pytest.mark.parametrize("metric", METRICS)
def test_no_member_exceeds_its_bound(metric):
    random = np.random.default_rng(5)
    members, asked = random.normal(size=(50, 6)) * random.lognormal(0, 1, (50, 1)), random.normal(size=(20, 6))
    members[0] = 0
    asked[1] *= 1e-9
    most = float((members**2).sum(axis=1).max()) if metric == "dot" else 0.0
    points = {
        "l2": members,
        "cosine": members / np.maximum(np.linalg.norm(members, axis=1, keepdims=True), 1e-12),
        "dot": np.c_[members, np.sqrt(np.maximum(most - (members**2).sum(axis=1), 0))],
    }[metric]
    centre = points.mean(axis=0, keepdims=True)
    away = np.linalg.norm(points - centre, axis=1)
    bound = pruned._best_possible(asked, centre, away.min(keepdims=True), away.max(keepdims=True), metric, most)
    assert (search.similarity(asked, members, metric).max(axis=1) <= bound[:, 0] + 1e-9).all()


def test_an_index_is_the_way_where_one_is_given(items, queries, indices):
    with pytest.raises(ValueError, match="index is for"):
        pruned.nearest(queries, items, index=indices["dot"], metric="l2")
    with pytest.raises(ValueError, match="centroids"):
        pruned.nearest(queries, items, nprobe=2)
    requests = items.limit(5).select(F.col("item_id").alias("query_id"), "item_id")
    plain, indexed = (ranked(recommend.recommend_items(requests, items, top_k=4, **more)) for more in ({}, {"index": indices["cosine"]}))
    assert plain == indexed
    clustered, centroids = kmeans.cluster_items(items, n_clusters=8)
    assert ranked(pruned.nearest(queries, stage(clustered), centroids=centroids, top_k=4)) == ranked(search.search(queries, items, top_k=4))


def test_nothing_to_find(spark, items, queries, indices):
    assert pruned.search_pruned(queries.where("false"), indices["dot"]).count() == 0
    empty = items.where("false").withColumn("cluster_id", F.lit(0))
    assert pruned.search_pruned(queries, pruned.index_clusters(empty)).count() == 0


# ---- codes


@pytest.mark.parametrize("metric", METRICS)
def test_coded_search_is_exact(spark, items, queries, metric):
    short = spark.createDataFrame([("tiny", "t", [1e-6] * 8), ("zero", "z", [0.0] * 8)], items.schema)
    more = items.unionByName(short)
    codes = stage(coded.code_items(more, metric))
    for exclude in (None, barred(spark)):
        report = {}
        got = coded.search_coded(queries, codes, more, metric=metric, exclude=exclude, top_k=9, item_block=50, report=report)
        assert ranked(got) == ranked(search.search(queries, more, metric=metric, exclude=exclude, top_k=9))
    near = coded.search_coded(queries, codes, more, metric=metric, top_k=9, refine_factor=4)
    exact = {r[:3:2] for r in ranked(search.search(queries, more, metric=metric, top_k=9))}
    assert len(exact & {r[:3:2] for r in ranked(near)}) > 0.6 * len(exact)  # copies tie


@pytest.mark.parametrize("metric", METRICS)
def test_scores_lie_within_their_bounds(metric):
    random = np.random.default_rng(3)
    vectors, asked = random.normal(size=(80, 16)) * random.lognormal(0, 2, (80, 1)), random.normal(size=(9, 16))
    own = vectors / np.linalg.norm(vectors, axis=1, keepdims=True) if metric == "cosine" else vectors
    scale = np.abs(own).max(axis=1) / 127
    codes = np.rint(own / scale[:, None])
    error = np.linalg.norm(own - codes * scale[:, None], axis=1)
    low, high = coded.bounds(asked, codes, scale, error, metric)
    score = search.similarity(asked, vectors, metric)
    assert (low <= score).all() and (score <= high).all()


def test_codes_are_a_fifth_of_the_vectors(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select(F.col("vec_id").alias("item_id"), "embedding")
    sizes = coded.code_items(vectors).agg(F.avg(F.length("code") + 16)).first()[0]
    assert sizes == 80 < 64 * 8 / 4  # 64 doubles are what the exact search shuffles


# ---- stored tables


def leaves(df, name):
    """The nodes of the executed plan whose name begins so."""
    out, todo = [], [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
            continue
        if kind.endswith("QueryStageExec"):
            todo.append(node.plan())
        if node.nodeName().startswith(name):
            out.append(node)
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return out


def files_read(df, part):
    df.collect()
    scans = [s for s in leaves(df, "Scan parquet") if s.relation().location().rootPaths().mkString().endswith(f"/{part}")]
    assert scans
    return max(s.metrics().apply("numFiles").value() for s in scans), " ".join(s.toString() for s in scans)


def test_a_stored_table_is_read_in_the_probed_clusters_alone(spark, items, queries, tmp_path):
    store = write_store(items, str(tmp_path / "s"), IndexConfig(metric="l2"))
    all_files = len(store.codes.inputFiles())
    one = queries.where(F.col("query_id") == IDS[100])
    got = search_store(one, store, nprobe=2, top_k=5)
    read, plan = files_read(got, "codes")
    assert "dynamicpruning" in plan.lower() and read <= 2 < all_files
    read, plan = files_read(got, "items")
    assert "dynamicpruning" in plan.lower() and read <= 2
    copied = open_store(spark, copy_store(spark, str(tmp_path / "s"), str(tmp_path / "t")) and str(tmp_path / "t"))
    n = copied.centroids.count()
    kept = copied.named  # floats
    want = ranked(search.search(queries, kept, metric="l2", top_k=5))
    assert ranked(search_store(queries, copied, top_k=5)) == want
    assert ranked(search_store(queries, copied, nprobe=n, top_k=5)) == want
    exclude = barred(spark)
    want = ranked(search.search(queries, kept, metric="l2", top_k=5, exclude=exclude))
    assert ranked(search_store(queries, copied, nprobe=n, top_k=5, exclude=exclude)) == want


def test_a_store_keeps_given_clusters(spark, items, queries, tmp_path):
    given = items.withColumn("cluster_id", F.pmod(F.xxhash64("item_id"), F.lit(4)).cast("int")).withColumnRenamed("item_id", "key")
    store = write_store(given, str(tmp_path / "s"), IndexConfig(id_col="key", metric="dot"))
    means = {r.cluster_id: r["mean"] for r in vector_means(given.select("cluster_id", F.col("embedding").cast("array<float>").cast("array<double>").alias("point")), "cluster_id").collect()}
    assert all(np.allclose(r.centroid, means[r.cluster_id]) for r in store.centroids.collect()) and len(means) == 4
    near = ranked(search_store(queries, store, nprobe=1, top_k=3))
    assert {r[2] for r in near} < set(IDS) and len(near) == 3 * 8


# ---- buckets


def test_hashed_search(queries, items):
    got = hashed.search_hashed(queries, items, bands=12, bits=3, top_k=10, item_block=30)
    exact = {r[:3:2]: r[3] for r in ranked(search.search(queries, items, top_k=10))}
    found = {r[:3:2]: r[3] for r in ranked(got)}
    assert all(found[k] == pytest.approx(exact[k]) for k in exact.keys() & found.keys())
    assert len(exact.keys() & found.keys()) >= 0.9 * len(exact)


def test_copies_share_all_buckets(spark, items):
    named = hashed.buckets(items, "item_id", bands=3, bits=5)
    by = {}
    for r in named.collect():
        by.setdefault(r.item_id, set()).add(r.cluster_id)
    assert len({frozenset(by[i]) for i in IDS[100:300]}) == 1 and all(len(b) == 3 for b in by.values())
    signs = MATRIX @ hashed.planes(15, 8).T >= 0
    assert by[IDS[0]] == {32 * band + sum(1 << j for j in range(5) if signs[0, 5 * band + j]) for band in range(3)}


# ---- what large tables need


@pytest.mark.parametrize("metric", METRICS)
def test_pruned_search_goes_on_in_blocks_where_bounds_leave_too_much(spark, items, queries, indices, metric, monkeypatch):
    want = ranked(search.search(queries, items, metric=metric, top_k=9, exclude=barred(spark)))
    monkeypatch.setattr(pruned.flat, "search_probed", lambda *a, **o: pytest.fail("a round was probed"))
    monkeypatch.setattr(pruned, "PROBES_PER_BLOCK", 0)
    got = pruned.search_pruned(queries, indices[metric], top_k=9, exclude=barred(spark), item_block=40, shared_bytes=0)
    assert ranked(got) == want


def test_settled_and_open_queries_of_a_round_come_together(spark, items, queries, indices, monkeypatch):
    for most in (0.01, 0.1, 0.3):
        monkeypatch.setattr(pruned, "PROBES_PER_BLOCK", most)
        for metric in METRICS:
            got = pruned.search_pruned(queries, indices[metric], top_k=5, first=1, shared_bytes=0, item_block=40)
            assert ranked(got) == ranked(search.search(queries, items, metric=metric, top_k=5))


def test_a_full_probe_sends_no_query_to_each_cluster(items, queries, monkeypatch):
    clustered, centroids = kmeans.cluster_items(items, n_clusters=8)
    some = centroids.where("cluster_id < 3")
    known = clustered.where("cluster_id < 3")
    monkeypatch.setattr(search, "probe_clusters", lambda *a: pytest.fail("probed"))
    for table, heads in ((items, centroids), (known, some)):
        got = search.search_clusters(queries, stage(clustered), heads, nprobe=8, metric="dot", top_k=9)
        assert ranked(got) == ranked(search.search(queries, table, metric="dot", top_k=9))


def test_clustered_items_are_not_sent_to_all_tasks(items):
    """Vectors of few words are a small file of many rows."""
    plan = kmeans.cluster_items(items, n_clusters=8)[0]._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin [_uid" not in plan and "SortMergeJoin [_uid" in plan


def test_blocks_per_task_are_of_all_clusters_together(spark):
    rows = spark.range(100).select(F.lit(5_000).alias("n"), F.lit(1).alias("b"), F.lit(0.01).alias("share"))
    blocks = rows.select(search._query_blocks(F.col("n"), F.col("b"), 65_536, 8, F.col("share")).alias("x")).agg(F.sum("x")).first()[0]
    assert blocks == 100


def test_floats_are_shuffled_as_floats(spark, items, queries):
    def small(rows):
        return rows.withColumn("embedding", F.col("embedding").cast("array<float>"))

    got = search.search(stage(small(queries)), stage(small(items)), shared_bytes=0, top_k=5)
    assert "array<double>" not in got._jdf.queryExecution().analyzed().toString()
    assert ranked(got) == ranked(search.search(small(queries), small(items), top_k=5))


@pytest.mark.parametrize("top_k", [1, 5, 20])
def test_the_best_of_wide_blocks(top_k):
    random = np.random.default_rng(top_k)
    used = 0
    for turn in range(12):
        scores = random.normal(size=(3, 4000)) * 10.0 ** random.integers(-3, 6)
        if turn % 3 == 0:
            scores = np.round(scores, 1)
        if turn % 4 == 0:
            scores = scores + random.choice([0, 4e-10, -4e-10], size=scores.shape)
        scores[random.random(scores.shape) < random.choice([0, 0.01, 0.99])] = -np.inf
        rounded = np.round(scores, search.TIE_DIGITS)
        want = [(i, j) for i in range(3) for j in sorted(range(4000), key=lambda j: (-rounded[i, j], j))[:top_k] if rounded[i, j] > -np.inf]
        assert [tuple(map(int, x)) for x in zip(*search.best_of_block(scores, top_k))] == want
        used += search._contenders(scores, top_k) is not None
    assert used


# ---- item vectors


def test_counts_and_weights(spark):
    past = {"a": "xyzxy", "b": "xx", "c": "zq", "d": "q"}
    rows = [(q, pos, i) for q, ids in past.items() for pos, i in enumerate(ids)] + [("e", 0, None), ("e", 1, "x")]
    histories = spark.createDataFrame(rows, "query_id string, pos long, item_id string")
    counts = {}
    for ids in past.values():
        for i, one in enumerate(ids):
            for j, other in enumerate(ids):
                if 0 < abs(i - j) <= 2 and one != other:
                    counts[one, other] = counts.get((one, other), 0) + 1
    got = cooccur.cooccurrence(histories, 2)
    assert {(r.item_id, r.other_id): r.n for r in got.collect()} == counts
    total = sum(counts.values())
    of = {i: sum(n for (a, _), n in counts.items() if a == i) for i in "xyzq"}
    want = {(a, b): np.log(n * total / (of[a] * of[b])) for (a, b), n in counts.items()}
    weights = {(r.item_id, r.other_id): r.weight for r in cooccur.mutual_information(got).collect()}
    assert weights == pytest.approx({k: w for k, w in want.items() if w > 0})


def test_counts_over_spans_and_without_sending_the_log_to_all_tasks(spark, monkeypatch):
    """Spans of three places, longer windows, gaps and places that are there twice; a small file may hold many rows."""
    monkeypatch.setattr(cooccur, "SPAN", 3)
    random = np.random.default_rng(4)
    rows = [(q, int(pos), f"i{random.integers(5)}") for q in "ab" for pos in random.choice(30, size=25)]
    histories = stage(spark.createDataFrame(rows, "query_id string, pos long, item_id string"))
    for window in (2, 5):
        counts = {}
        for q, pos, one in rows:
            for q2, pos2, other in rows:
                if q == q2 and 0 < abs(pos - pos2) <= window and one != other:
                    counts[one, other] = counts.get((one, other), 0) + 1
        got = cooccur.cooccurrence(histories, window)
        assert {(r.item_id, r.other_id): r.n for r in got.collect()} == counts
        assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()


def test_vectors_give_the_weights_back(spark):
    random = np.random.default_rng(1)
    hidden = np.abs(random.normal(size=(30, 3))) @ np.diag([3.0, 2.0, 1.0])
    matrix = hidden @ hidden.T
    rows = [(f"i{a}", f"i{b}", float(matrix[a, b])) for a in range(30) for b in range(30)]
    weights = stage(spark.createDataFrame(rows, "item_id string, other_id string, weight double"))
    found, values = cooccur.item_vectors(weights, 5, rounds=8)
    vectors = {r.item_id: np.array(r.embedding) for r in found.collect()}
    stacked = np.array([vectors[f"i{a}"] for a in range(30)])
    assert np.allclose(stacked @ stacked.T, matrix, atol=1e-6)
    assert np.allclose(values[:3], np.linalg.eigvalsh(matrix)[::-1][:3]) and np.allclose(values[3:], 0, atol=1e-6)


def test_items_are_cut_where_many_query_blocks_would_get_them(spark):
    """What is shuffled by the blocks of 200 partitions, in items."""
    n, parts, share = F.lit(120_000), 200, F.lit(1.0)
    item_blocks = search._item_blocks(n, n, search.ITEM_BLOCK, parts, share, search._QUERY_WEIGHT)
    query_blocks = search._query_blocks(n, F.col("i"), search.QUERY_BLOCK, parts, share)
    (r,) = spark.range(1).select(item_blocks.alias("i")).select("i", query_blocks.alias("q")).collect()
    assert r.i * r.q >= 2 * parts
    assert 120_000 * (r.q + search._QUERY_WEIGHT * r.i) < 120_000 * 2 * parts / 4


@pytest.mark.parametrize("metric", ["dot", "l2"])
def test_bounds_of_wide_blocks_leave_the_best(metric):
    random = np.random.default_rng(2)
    low = np.round(random.normal(size=(7, 3000)), 1)
    low[0, 5:] = -np.inf
    kth = np.sort(low, axis=1)[:, -10, None]
    assert (coded._reached(low, 10) <= kth).all() and (coded._reached(low[:, :40], 10) == np.sort(low[:, :40], axis=1)[:, -10, None]).all()
    vectors, ids = random.normal(size=(4, 3000)), pa.array([f"i{i}" for i in range(3000)])
    codes = np.clip(np.rint(random.normal(size=(3000, 4)) * 30), -127, 127).astype(np.int8)
    right = pa.table({"item_id": ids, "code": [c.tobytes() for c in codes], "scale": np.full(3000, 0.02), "error": np.full(3000, 0.01)})
    none = np.empty(0, np.int64)
    query, found = coded._bound_scorer(metric, 10)(vectors[:, :4], right, none, none)
    exact = search.similarity(vectors[:, :4], codes * 0.02, metric)
    kept = {(int(q), i) for q, i in zip(query, found["item_id"].to_pylist(), strict=True)}
    assert {(q, f"i{i}") for q in range(4) for i in np.argsort(-exact[q])[:10]} <= kept


# ---- wide blocks in tiles


def wide(metric):
    """Items of several kinds, queries between them: copies, zeros, tiny ones, and numbers that single precision can't tell apart."""
    random = np.random.default_rng(12)
    items = random.normal(size=(900, 8))
    items[200:320] = items[200]
    items[400:410] = 0
    items[500:600] = items[500] * (1 + 1e-9 * np.arange(100)[:, None])
    queries = np.concatenate([random.normal(size=(40, 8)), items[[200, 400, 500]], [[1e-9] * 8, [1e200] + [0] * 7, [np.nan] * 8, [0.0] * 8]])
    if metric == "cosine":
        items[700] = 1e-9
    pairs = np.unique(random.integers(0, [len(queries), len(items)], size=(4000, 2)), axis=0)
    pairs = np.concatenate([pairs[pairs[:, 0] != 2], [(2, c) for c in range(895)]])
    row, column = pairs[np.argsort(pairs[:, 0], kind="stable")].T
    return queries, items, row, column


@pytest.mark.parametrize("metric", METRICS)
@pytest.mark.parametrize("top_k", [1, 6])
def test_tiles_leave_the_best(metric, top_k, monkeypatch):
    monkeypatch.setattr(search, "_TILE_ITEMS", 128)
    monkeypatch.setattr(search, "_TILE_QUERIES", 16)
    queries, items, row, column = wide(metric)
    with np.errstate(all="ignore"):
        got = search._striped(queries, items, metric, top_k, row, column)
        want = search._striped_double(queries, items, metric, top_k, row, column)
    assert np.array_equal(got[0], want[0]) and np.array_equal(got[1], want[1])
    assert np.allclose(got[2], want[2], rtol=1e-12, atol=1e-12, equal_nan=True)


@pytest.mark.parametrize("metric", METRICS)
def test_few_pairs_of_a_wide_block_are_scored_in_double_precision(metric, monkeypatch):
    random = np.random.default_rng(13)
    queries, items = random.normal(size=(600, 16)), random.normal(size=(10_000, 16))
    scored, none = [], np.empty(0, np.int64)
    whole = search.similarity
    monkeypatch.setattr(search, "similarity", lambda q, i, *more: scored.append(len(q) * len(i)) or whole(q, i, *more))
    rows, columns, _ = search._striped(queries, items, metric, 5, none, none)
    assert sum(scored) == 0
    assert len(rows) == 3000
    best = np.round(whole(queries[:50], items, metric), 9).argsort(axis=1, kind="stable")[:, -1]
    assert (columns[::5][:50] == best).all()


def test_pairs_of_blocks_are_dealt_evenly(spark):
    for count, parts in ((100, 32), (7, 32), (64, 1)):
        keys = search._dealt(count, parts)
        assert len(set(keys)) == count
        rows = spark.createDataFrame([(k,) for k in keys], "pair int").repartition(parts, "pair")
        sizes = [r.n for r in rows.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()]
        assert max(sizes) - min(sizes) <= 1 and len(sizes) == min(count, parts)


def test_a_round_sends_no_query_to_more_clusters_than_blocks_would(spark, monkeypatch):
    random = np.random.default_rng(14)
    rows = [(f"i{k:03d}", f"text {k}", [float(x) for x in v]) for k, v in enumerate(random.normal(size=(600, 16)))]
    items = spark.createDataFrame(rows, "item_id string, item_text string, embedding array<double>")
    queries = items.select(F.col("item_id").alias("query_id"), "embedding")
    index = pruned.index_clusters(stage(kmeans.cluster_items(items, n_clusters=64)[0]))
    sent, probed = [], search.search_probed
    monkeypatch.setattr(pruned.flat, "search_probed", lambda probes, *a, **o: sent.append(probes.count()) or probed(probes, *a, **o))
    got = ranked(pruned.search_pruned(queries, index, top_k=5, shared_bytes=0, item_block=120))
    assert got == ranked(search.search(queries, items, top_k=5))
    assert max(sent) <= 600 * 5 * 2


@pytest.mark.parametrize("metric", METRICS)
def test_tiles_leave_what_bounds_leave(metric, monkeypatch):
    monkeypatch.setattr(search, "_TILE_ITEMS", 128)
    monkeypatch.setattr(search, "_TILE_QUERIES", 16)
    queries, items, row, column = wide("dot")
    queries = np.delete(queries, [44, 45], axis=0)
    kept = (row < 44) & (row != 2)
    row, column = row[kept], column[kept]
    scale = np.abs(items).max(axis=1) / coded.TOP_CODE
    scale[scale == 0] = 1
    codes = np.rint(items / scale[:, None])
    error = np.sqrt(((items - scale[:, None] * codes) ** 2).sum(axis=1))
    got, want = (
        {(q, i): (low, high) for q, i, low, high in zip(*x(queries, codes, scale, error, metric, 6, row, column))} for x in (coded._tiled, coded._striped)
    )
    for query in range(len(queries)):
        mine = {i: b for (q, i), b in want.items() if q == query}
        kth = sorted((low for low, _ in mine.values()), reverse=True)[5]
        assert {i for i, (_, high) in mine.items() if high >= kth} <= {i for q, i in got if q == query}
    assert all(np.allclose(bounds, want[pair], rtol=1e-9, atol=1e-9, equal_nan=True) for pair, bounds in got.items() if pair in want)


def test_bounds_of_a_wide_block_are_not_worked_out_for_all_pairs(monkeypatch):
    random = np.random.default_rng(15)
    vectors = random.normal(size=(6000, 16))
    scale = np.abs(vectors).max(axis=1) / coded.TOP_CODE
    codes = np.rint(vectors / scale[:, None]).astype(np.int8)
    error = np.sqrt(((vectors - scale[:, None] * codes) ** 2).sum(axis=1))
    right = pa.table({"item_id": [f"{k:05d}" for k in range(6000)], "code": [c.tobytes() for c in codes], "scale": scale, "error": error})
    worked, whole, none = [], coded.bounds, np.empty(0, np.int64)
    monkeypatch.setattr(coded, "bounds", lambda q, c, *more: worked.append(len(q) * len(c)) or whole(q, c, *more))
    query, columns = coded._bound_scorer("dot", 5)(vectors[:300], right, none, none)
    assert sum(worked) == 0
    top = np.argsort(-(vectors[:300] @ vectors.T), axis=1)[:, :5]
    found = {(q, i) for q, i in zip(query.tolist(), columns["item_id"].to_pylist())}
    assert {(q, f"{i:05d}") for q in range(300) for i in top[q]} <= found


@pytest.mark.parametrize("metric", METRICS)
def test_a_query_goes_once_to_the_clusters_that_are_searched_together(spark, items, queries, metric, monkeypatch):
    clustered, centroids = kmeans.cluster_items(items, metric=metric)
    clustered = stage(clustered)
    options = {"exclude": barred(spark), "top_k": 6, "metric": metric}
    probes = stage(search.probe_clusters(queries, centroids, 5, metric))
    each = search.search_probed(probes, search.usable(clustered, "item_id", "cluster_id"), options["exclude"], search._exact_scorer(metric, 6))
    want = ranked(search.ranked_top_k(each, 6))
    sent, probed = [], search.search_probed
    monkeypatch.setattr(search, "search_probed", lambda probes, *a, **o: sent.append(probes.count()) or probed(probes, *a, **o))
    assert ranked(search.search_clusters(queries, clustered, centroids, nprobe=5, **options)) == want
    assert ranked(search.search_clusters(queries, clustered, centroids, nprobe=5, item_block=150, query_block=2, **options)) == want
    assert sent[0] <= len(ASKED) + 1


def test_clusters_are_searched_together_where_that_shuffles_less():
    sizes = {c: 312 for c in range(256)}
    assert len(set(search._bundles(sizes, 80_000, 8, 32, search.ITEM_BLOCK).values())) == 256
    many = search._bundles(sizes, 80_000, 140, 32, search.ITEM_BLOCK)
    assert len(set(many.values())) <= 6 and sorted(many) == sorted(sizes)
