"""Encoding, search, lookups, the vector store and recommendation jobs against NumPy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from nextrail.config import EncoderConfig, IndexConfig
from nextrail.functions import vectors as vec
from nextrail.operators import coded, encode, kmeans, lookup, pruned, recommend, search
from nextrail.plans.evaluate import evaluate_runs, evaluate_users
from nextrail.sources.tables import stage
from nextrail.sources.vector_store import copy_store, open_store, write_store

RNG = np.random.default_rng(4)
N, DIM = 200, 8
MATRIX = RNG.normal(size=(N, DIM))
MATRIX[60:130] = MATRIX[60]  # a third of the items are copies of one vector
IDS = [f"i{k:03d}" for k in range(N)]
QUERIES = {f"q{k}": RNG.normal(size=DIM) for k in range(30)}
QUERIES["same"] = MATRIX[60]


@pytest.fixture(scope="module")
def items(spark):
    rows = [(i, f"text {i}", [float(x) for x in v]) for i, v in zip(IDS, MATRIX)]
    return spark.createDataFrame(rows, "item_id string, item_text string, embedding array<double>").cache()


@pytest.fixture(scope="module")
def queries(spark):
    rows = [(q, [float(x) for x in v]) for q, v in QUERIES.items()]
    return spark.createDataFrame(rows, "query_id string, embedding array<double>").cache()


def scores(query, metric):
    if metric == "dot":
        return MATRIX @ query
    if metric == "cosine":
        return MATRIX @ query / np.maximum(np.linalg.norm(MATRIX, axis=1) * np.linalg.norm(query), 1e-8)
    return 1 - ((MATRIX - query) ** 2).sum(axis=1)


def expected(query, metric, top_k, hidden=()):
    ranked = sorted(
        (-round(s, 9), i) for s, i in zip(scores(query, metric), IDS) if i not in hidden
    )
    return [i for _, i in ranked[:top_k]]


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append(r["item_id"])
    return out


@pytest.mark.parametrize("metric", ["dot", "cosine", "l2"])
@pytest.mark.parametrize("blocks", [(65_536, 8_192), (37, 5)])
def test_exact_search(queries, items, metric, blocks):
    got = found(
        search.search(queries, items, metric=metric, top_k=7, item_block=blocks[0], query_block=blocks[1])
    )
    assert got == {q: expected(v, metric, 7) for q, v in QUERIES.items()}


def test_exclusions_come_before_ranking(spark, queries, items):
    hidden = {q: set(IDS[k * 3 : k * 3 + 80]) | {"unknown"} for k, q in enumerate(QUERIES)}
    hidden["same"] = set(IDS[:197])
    pairs = [(q, i) for q, ids in hidden.items() for i in ids] * 2
    exclude = spark.createDataFrame(pairs, "query_id string, item_id string")
    want = {q: expected(v, "cosine", 5, hidden[q]) for q, v in QUERIES.items()}
    assert found(search.search(queries, items, exclude=exclude, top_k=5, item_block=50)) == want
    assert len(want["same"]) == 3
    clustered, centroids = kmeans.cluster_items(items)
    got = search.search_clusters(
        queries, clustered, centroids, exclude=exclude, top_k=5, nprobe=centroids.count(), item_block=9
    )
    assert found(got) == want


def test_probing(queries, items):
    clustered, centroids = kmeans.cluster_items(items)
    n = centroids.count()
    assert n == search.n_lists(N) == 8
    exact = found(search.search(queries, items, top_k=10))
    # The cluster of copies is cut into blocks like any other.
    full = search.search_clusters(queries, clustered, centroids, top_k=10, nprobe=n, item_block=16)
    assert found(full) == exact
    near = found(search.search_clusters(queries, clustered, centroids, top_k=10, nprobe=n // 2))
    hits = sum(len(set(exact[q]) & set(near.get(q, []))) for q in exact)
    assert hits / (10 * len(exact)) > 0.6


@pytest.mark.parametrize("metric,least", [("cosine", 0.95), ("dot", 0.8), ("l2", 0.95)])
def test_probing_follows_the_metric(spark, metric, least):
    """Clustered vectors of uneven lengths: eight of 32 clusters hold nearly all of the best."""
    random = np.random.default_rng(7)
    centres = random.normal(size=(40, 16))
    matrix = centres[random.integers(40, size=1500)] + 0.25 * random.normal(size=(1500, 16))
    matrix *= random.lognormal(0, 0.7, size=(1500, 1)) if metric != "l2" else 1
    rows = [(f"i{k}", [float(x) for x in v]) for k, v in enumerate(matrix)]
    items = spark.createDataFrame(rows, "item_id string, embedding array<double>")
    asked = items.limit(60).withColumnRenamed("item_id", "query_id")
    clustered, centroids = kmeans.cluster_items(items, metric=metric)
    exact = found(search.search(asked, items, metric=metric))
    near = found(search.search_clusters(asked, clustered, centroids, metric=metric, nprobe=8))
    assert np.mean([len(set(exact[q]) & set(near[q])) / 20 for q in exact]) >= least


@pytest.mark.parametrize("metric", ["cosine", "dot", "l2"])
def test_probes_follow_from_the_recall(spark, metric):
    """Vectors without clusters: eight of 32 probes lose many of the best, the chosen number does not."""
    random = np.random.default_rng(11)
    rows = [(f"i{k}", [float(x) for x in v]) for k, v in enumerate(random.normal(size=(1500, 24)))]
    items = spark.createDataFrame(rows, "item_id string, embedding array<double>")
    asked = items.withColumnRenamed("item_id", "query_id")
    clustered, centroids = kmeans.cluster_items(items, metric=metric)
    exact = found(search.search(asked, items, metric=metric))

    def recall(nprobe):
        near = found(search.search_clusters(asked, clustered, centroids, metric=metric, nprobe=nprobe))
        return np.mean([len(set(exact[q]) & set(near[q])) / 20 for q in exact])

    nprobe = search.probes_for(asked, clustered, centroids, metric=metric)
    assert 8 < nprobe < centroids.count() and recall(8) < 0.9 <= recall(nprobe)
    assert search.probes_for(asked, clustered, centroids, metric=metric, recall=0.0) == 8
    assert search.probes_for(asked, clustered, centroids, metric=metric, recall=1.0) >= nprobe
    assert search.probes_for(asked.where("false"), clustered, centroids, metric=metric) == 8


def test_rows_without_vectors_take_no_part(spark, items, queries):
    few = spark.createDataFrame(
        [(1, None), (2, [1.0] * DIM), (None, [1.0] * DIM)], "item_id long, embedding array<double>"
    )
    asked = spark.createDataFrame([("a", [1.0] * DIM), ("b", None)], "query_id string, embedding array<double>")
    for shared in (search.SHARED_BYTES, 0):
        rows = search.search(asked, few, shared_bytes=shared).collect()
        assert [(r["query_id"], r["item_id"], r["rank"]) for r in rows] == [("a", "2", 1)]
        nothing = search.search(asked, few.where("false"), shared_bytes=shared)
        assert nothing.count() == 0
        want = found(search.search(queries, items, top_k=5))
        assert found(search.search(queries, items, top_k=5, item_block=30, shared_bytes=shared)) == want
    with pytest.raises(ValueError, match="lengths"):
        search.search(asked, few.unionByName(few.select(F.lit(9).alias("item_id"), F.array(F.lit(1.0)).alias("embedding"))))
    for shared in (search.SHARED_BYTES, 0):
        with pytest.raises(Exception, match="unique"):
            search.search(asked.unionByName(asked), few, shared_bytes=shared).collect()
        with pytest.raises(Exception, match="lengths"):
            search.search(asked.select("query_id", F.array(F.lit(1.0)).alias("embedding")), few, shared_bytes=shared).collect()


@pytest.mark.parametrize("shared", [search.SHARED_BYTES, 0])
def test_an_excluded_id_is_barred_in_all_its_rows(spark, shared):
    rows = [("a", [1.0, 0.0]), ("a", [0.9, 0.1]), ("b", [0.5, 0.5]), ("a", [0.1, 0.9]), ("c", [0.4, 0.5]), ("c", [0.6, 0.1])]
    few = spark.createDataFrame(rows, "item_id string, embedding array<double>")
    asked = spark.createDataFrame([("p", [1.0, 0.0]), ("q", [1.0, 0.0]), ("r", [0.0, 1.0])], "query_id string, embedding array<double>")
    exclude = spark.createDataFrame([("p", "a"), ("q", "a"), ("q", "c"), ("q", "x"), ("s", "b")], "query_id string, item_id string")
    got = search.search(asked, few, exclude=exclude, metric="dot", top_k=4, shared_bytes=shared).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.item_id, round(r.score, 9)) for r in got] == [
        ("p", "c", 0.6), ("p", "b", 0.5), ("p", "c", 0.4), ("q", "b", 0.5),
        ("r", "a", 0.9), ("r", "b", 0.5), ("r", "c", 0.5), ("r", "a", 0.1),
    ]


@pytest.mark.parametrize("n,lists", [(1, 1), (3, 1), (4, 2), (500, 16), (2000, 32), (10**8, 8192)])
def test_number_of_clusters(n, lists):
    assert search.n_lists(n) == lists


def test_unknown_metric(queries, items):
    with pytest.raises(ValueError, match="metric"):
        search.search(queries, items, metric="hamming")


def test_vector_functions(spark):
    df = spark.createDataFrame([([3.0, 4.0], [1.0, 0.0]), ([0.0, 0.0], [1.0, 2.0])], "a array<double>, b array<double>")
    a, b = F.col("a"), F.col("b")
    rows = df.select(
        vec.dot(a, b), vec.cosine(a, b), vec.half_squared_distance(a, b), vec.unit(a), vec.is_zero(a)
    ).collect()
    assert tuple(rows[0]) == (3.0, 0.6, 10.0, [0.6, 0.8], False)
    assert tuple(rows[1]) == (0.0, 0.0, 2.5, [0.0, 0.0], True)
    assert vec.assert_dimension(df, "a") == 2
    ragged = spark.createDataFrame([([1.0],), ([1.0, 2.0],)], "a array<double>")
    with pytest.raises(ValueError, match="one length"):
        vec.assert_dimension(ragged, "a")


HISTORIES = {
    "a": [IDS[k] for k in (5, 9, 9, 150, 7)],
    "b": ["unknown", IDS[3]],
    "c": ["unknown"],
    "d": [IDS[k] for k in range(100)],
}


@pytest.fixture(scope="module")
def histories(spark):
    rows = [(q, pos, i) for q, ids in HISTORIES.items() for pos, i in enumerate(ids)]
    return spark.createDataFrame(rows, "query_id string, pos long, item_id string").cache()


def tail(query, length):
    return [IDS.index(i) for i in HISTORIES[query] if i in IDS][-length:]


@pytest.mark.parametrize("mode", ["mean", "max", "first", "last"])
@pytest.mark.parametrize("normalize", [False, True])
def test_pooling(histories, items, heavy_rows, mode, normalize):
    config = EncoderConfig(max_seq_length=3, pooling=mode, normalize=normalize)
    rows = encode.encode_histories(histories, items, config).collect()
    got = {r["query_id"]: r["embedding"] for r in rows}
    assert set(got) == {"a", "b", "d"}
    pools = {
        "mean": lambda m: m.mean(axis=0),
        "max": lambda m: m.max(axis=0),
        "first": lambda m: m[0],
        "last": lambda m: m[-1],
    }
    for query, vector in got.items():
        want = pools[mode](MATRIX[tail(query, 3)])
        want = want / np.linalg.norm(want) if normalize else want
        assert np.allclose(vector, want)


def test_zero_vectors_are_masked(spark):
    items = spark.createDataFrame(
        [("z", [0.0, 0.0]), ("a", [1.0, 2.0]), ("b", [3.0, -2.0])], "item_id string, embedding array<double>"
    )
    rows = [("q", 0, "z"), ("q", 1, "a"), ("q", 2, "b"), ("q", 3, "z"), ("only", 0, "z")]
    past = spark.createDataFrame(rows, "query_id string, pos long, item_id string")
    want = {"mean": [2.0, 0.0], "max": [3.0, 2.0], "first": [0.0, 0.0], "last": [3.0, -2.0]}
    for mode, vector in want.items():
        got = encode.encode_histories(past, items, EncoderConfig(pooling=mode)).collect()
        assert {r["query_id"]: r["embedding"] for r in got} == {"q": vector, "only": [0.0, 0.0]}


def test_plugged_model(histories, items):
    def model_fn():
        def predict(inputs):
            return inputs.sum(axis=1)

        return predict

    config = EncoderConfig(max_seq_length=3)
    rows = encode.encode_histories(histories, items, config, model_fn=model_fn, dim=DIM).collect()
    for r in rows:
        assert np.allclose(r["embedding"], MATRIX[tail(r["query_id"], 3)].sum(axis=0), atol=1e-5)


def test_prefix_means(histories, items, heavy_rows):
    got = encode.prefix_means(histories, items, DIM, EncoderConfig(max_seq_length=4)).collect()
    for query in ("a", "b", "d"):
        rows = sorted((r["pos"], r["embedding"]) for r in got if r["query_id"] == query)
        matrix = MATRIX[tail(query, 4)]
        assert len(rows) == len(matrix)
        for n, (_, vector) in enumerate(rows, 1):
            assert np.allclose(vector, matrix[:n].mean(axis=0))


@pytest.mark.parametrize("mode", ["mean", "max", "first", "last"])
def test_prefix_states(spark, histories, items, mode):
    zeros = spark.createDataFrame([(IDS[9], "zero", [0.0] * DIM)], items.schema)
    known = items.where(F.col("item_id") != IDS[9]).unionByName(zeros)
    for normalize in (False, True):
        got = encode.prefix_states(histories, known, EncoderConfig(max_seq_length=4, pooling=mode, normalize=normalize)).collect()
        for query in ("a", "b", "d"):
            rows = sorted((r["pos"], r["embedding"]) for r in got if r["query_id"] == query)
            matrix = np.array([MATRIX[k] for k in tail(query, 4) if k != 9])
            assert len(rows) == len(matrix)
            for n, (_, vector) in enumerate(rows, 1):
                part = matrix[:n]
                want = {"mean": part.mean(axis=0), "max": part.max(axis=0), "first": part[0], "last": part[-1]}[mode]
                assert np.allclose(vector, want / np.linalg.norm(want) if normalize else want)


def test_runs_share_one_search(spark, items):
    events = [
        (u, part, pos, IDS[(7 * k + 3 * pos + (0 if part == "history" else 40)) % N], True, k % 2 == 0)
        for k, u in enumerate(("u:1", "v", "w"))
        for part, count in (("history", 9), ("target", 5))
        for pos in range(count)
    ]
    mine = spark.createDataFrame(events, "user_id string, part string, pos long, item_id string, label boolean, is_val boolean")
    runs = {m: EncoderConfig(pooling=m, max_seq_length=n) for m, n in (("mean", 4), ("last", 4), ("max", 3))} | {"unit": EncoderConfig(normalize=True)}
    got = evaluate_runs(mine, items, runs, metric="dot", top_k=30)
    for run, config in runs.items():
        want = evaluate_users(mine, items, metric="dot", top_k=30, encoder=config)
        mine_of = got.where(F.col("run_id") == run).select(*want.columns)
        assert sorted(map(str, mine_of.collect())) == sorted(map(str, want.collect()))
    assert got.count() == 12


def test_a_model_runs_once_per_item(spark, tmp_path):
    """Vectors that come from a model are staged before they are searched."""
    told = str(tmp_path / "told")

    def counting():
        def predict(texts):
            with open(told, "a") as file:
                file.write(f"{len(texts)}\n")
            return np.array([[float(len(t)), 1.0] for t in texts], np.float32)

        return predict

    texts = spark.createDataFrame([(f"i{k}", "x" * (k + 1)) for k in range(40)], "item_id string, item_text string")
    vectors = stage(encode.embed_text(texts, model_fn=counting))
    asked = vectors.limit(9).withColumnRenamed("item_id", "query_id")
    assert recommend.search_vectors(asked, vectors, top_k=3).count() == 27
    requests = texts.limit(4).select(F.col("item_id").alias("query_id"), F.lit(0).alias("pos"), "item_id")
    assert recommend.recommend_queries(requests.select("query_id"), vectors, item_rows=requests, top_k=2).count() == 8
    assert sum(map(int, open(told).read().split())) == 40


def test_default_text_vectors(spark):
    texts = [("a", "red ring"), ("b", "red ring"), ("c", "blue bolt and more"), ("d", None)]
    df = spark.createDataFrame(texts, "item_id string, item_text string")
    got = {r["item_id"]: np.array(r["embedding"]) for r in encode.embed_text(df, num_features=512).collect()}
    assert np.allclose(got["a"], got["b"]) and not np.allclose(got["a"], got["c"])
    assert np.isclose(np.linalg.norm(got["c"]), 1, atol=1e-6)

    def lengths():
        return lambda texts: np.array([[float(len(t or ""))] for t in texts], dtype="float32")

    plugged = encode.embed_text(df, model_fn=lengths).collect()
    assert {r["item_id"]: r["embedding"] for r in plugged}["a"] == [8.0]


def test_lookups(spark, items, heavy_rows):
    asked = lookup.requested(
        spark.createDataFrame([("r", ["i002", "x", "i001", "i002"])], "request_id string, ids array<string>"), "ids"
    )
    ordered = lookup.lookup_ordered(asked, items).orderBy("pos").collect()
    assert [r["item_id"] for r in ordered] == ["i002", "i001", "i002"]
    assert sorted(r["item_id"] for r in lookup.lookup_store(asked, items).collect()) == ["i001", "i002"]
    one = spark.createDataFrame([("p", "i001"), ("q", None), ("r", "x")], "request_id string, item_id string")
    got = {r["request_id"]: r["is_found"] for r in lookup.lookup_one(one, items).collect()}
    assert got == {"p": True, "q": False, "r": False}


def test_recommend_histories(histories, items, heavy_rows):
    encoder = EncoderConfig(max_seq_length=3)
    rows = recommend.recommend_histories(histories, items, top_k=4, encoder=encoder)
    assert {r["item_text"] for r in rows.collect() if r["item_id"] == IDS[0]} <= {"text i000"}
    got = found(rows)
    assert set(got) == {"a", "b", "d"}
    for query, ids in got.items():
        vector = MATRIX[tail(query, 3)].mean(axis=0)
        assert ids == expected(vector, "cosine", 4, set(HISTORIES[query]))
    again = found(
        recommend.recommend_histories(histories, items, top_k=4, encoder=encoder, exclude_scope="tail")
    )
    vector = MATRIX[tail("d", 3)].mean(axis=0)
    assert again["d"] == expected(vector, "cosine", 4, {IDS[k] for k in tail("d", 3)})


def test_recommend_queries(spark, items, heavy_rows):
    own, inputs = QUERIES["q1"], [QUERIES["q2"], QUERIES["q3"], QUERIES["q4"]]
    plain = lambda m: [float(x) for x in m]
    rows = [
        ("own", plain(own), [IDS[1], IDS[2]], [plain(v) for v in inputs], [IDS[9]], 2),
        ("inputs", None, [IDS[k] for k in range(10)], [plain(v) for v in inputs], None, None),
        ("items", None, [IDS[1], "x", IDS[150], IDS[4]], None, [IDS[7]], 6),
        ("nothing", None, ["x"], None, None, None),
        ("empty", None, None, None, None, None),
    ]
    schema = (
        "query_id string, embedding array<double>, item_ids array<string>, "
        "input_embeds array<array<double>>, exclude_item_ids array<string>, top_k int"
    )
    tables = recommend.unpack_requests(spark.createDataFrame(rows, schema))
    got = found(
        recommend.recommend_queries(items=items, **tables, top_k=3, encoder=EncoderConfig(max_seq_length=2))
    )
    assert got == {
        "own": expected(own, "cosine", 2, {IDS[1], IDS[2], IDS[9]}),
        "inputs": expected(np.mean(inputs[1:], axis=0), "cosine", 3, set(IDS[:10])),
        "items": expected(MATRIX[[150, 4]].mean(axis=0), "cosine", 6, {IDS[150], IDS[4], IDS[7]}),
    }


def test_recommend_items(spark, items):
    requests = spark.createDataFrame([("p", "i005"), ("q", "x")], "query_id string, item_id string")
    got = found(recommend.recommend_items(requests, items, top_k=5))
    assert got == {"p": expected(MATRIX[5], "cosine", 5, {"i005"})}


def test_recommend_users(spark, items):
    rows = [("u", "history", p, 3, IDS[p]) for p in range(3)] + [("u", "target", p, 3, IDS[10 + p]) for p in range(2)]
    rows += [("v", "history", 0, 1, IDS[20])]
    placed = spark.createDataFrame(rows, "user_id string, part string, pos long, n_history long, item_id string")
    encoder = EncoderConfig(max_seq_length=3)
    users = spark.createDataFrame([("u",)], "user_id string")
    got = found(recommend.recommend_users(placed, items, users=users, top_k=5, encoder=encoder))
    last = [2, 10, 11]
    assert got == {"u": expected(MATRIX[last].mean(axis=0), "cosine", 5, {IDS[k] for k in last})}


def test_vector_store(spark, items, queries, tmp_path):
    extra = spark.createDataFrame([("none", "no vector", None)], items.schema)
    config = IndexConfig(metric="dot")
    store = write_store(items.unionByName(extra), str(tmp_path / "s"), config)
    copied = copy_store(spark, str(tmp_path / "s"), str(tmp_path / "t"))
    assert copied.config == store.config == config
    assert copied.items.count() == N + 1
    assert lookup.lookup_one(
        spark.createDataFrame([("r", "none")], "request_id string, item_id string"), copied.items
    ).first()["is_found"]
    opened = open_store(spark, str(tmp_path / "t"))
    vectors = opened.items.where("embedding IS NOT NULL")
    full = search.search_clusters(
        queries, vectors, opened.centroids, top_k=3, nprobe=opened.centroids.count(), metric="dot"
    )
    exact = search.search(queries, vectors, top_k=3, metric="dot")
    assert found(full) == found(exact)
    with pytest.raises(ValueError, match="missing columns"):
        write_store(items.drop("embedding"), str(tmp_path / "u"))


def test_the_log_is_not_sent_to_all_tasks_for_its_items(spark):
    """Where the size of the items isn't known, a small file of histories must not be the side that is sent."""
    past = stage(spark.range(400).selectExpr("cast(id % 20 as string) query_id", "cast(id div 20 as int) pos", "cast(id % 7 as string) item_id"))
    items = spark.range(700).selectExpr("cast(id % 7 as string) item_id").distinct()
    vectors = items.join(spark.range(700).selectExpr("cast(id as string) item_id", "array(1.0D, id) embedding"), "item_id")
    found = encode.known_tail(past, vectors, 5)
    assert found.count() == 20 * 5
    assert "BuildLeft" not in found._jdf.queryExecution().executedPlan().toString()
