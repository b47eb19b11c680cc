"""Every registered query against its SQL, and the plans that large tables need."""

import os
import subprocess
import sys

import pytest
from compare import database, difference

import __spark_entry__ as contract
from nextrail import queries as q
from nextrail.operators import encode, search
from nextrail.operators.split import train_test_split
from nextrail.sources import warehouse as wh

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def db():
    return database(FOLDER)


@pytest.mark.parametrize("name", sorted(contract.oracle_sql()))
def test_query(spark, db, name):
    got = contract.queries()[name](spark, FOLDER).toPandas()
    want = db.execute(contract.oracle_sql()[name]).df()
    assert len(got) > 0
    assert difference(got, want) is None


@pytest.mark.parametrize("name", sorted(set(contract.queries()) - set(contract.oracle_sql())))
def test_query_without_sql(spark, name):
    assert contract.queries()[name](spark, FOLDER).count() > 0


def test_probing_finds_most_neighbours(spark):
    exact = {tuple(r) for r in q.knn_exact(spark, FOLDER, "cosine").select("query_id", "item_id").collect()}
    near = {tuple(r) for r in q.knn_clusters(spark, FOLDER, 8).select("query_id", "item_id").collect()}
    assert len(exact & near) / len(exact) > 0.8


@pytest.mark.parametrize("folder", [FOLDER, "/root/testdata/sf0.1"])
def test_approximate_queries_find_nine_of_ten_neighbours(spark, folder):
    keys = ["query_id", "item_id"]
    exact = {tuple(r) for r in q.knn_exact(spark, folder, "cosine").select(*keys).collect()}
    for name in ("knn_probe8", "knn_hashed"):
        near = {tuple(r) for r in contract.queries()[name](spark, folder).select(*keys).collect()}
        print(name, folder, len(exact & near) / len(exact))
        assert len(exact & near) / len(exact) >= 0.9


def test_entry(spark):
    rows = contract.entry(spark).collect()
    assert len(rows) == 2
    mean = sum(r["retrieval_normalized_dcg"] for r in rows) / 2
    assert round(mean, 6) == 0.077196


@pytest.mark.parametrize("absent", ["zstandard", "nextrail.llm"])
def test_the_rest_goes_on_without_the_document_operators(absent):
    """The entry, in a process of its own, where a module can't be imported."""
    code = (
        "import sys; sys.modules[%r] = None\n"
        "import __spark_entry__ as entry\n"
        "print(len(entry.queries()), any(n.startswith('op') for n in entry.queries()), 'knn_exact_dot' in entry.oracle_sql())"
    ) % absent
    root = os.path.dirname(os.path.abspath(contract.__file__))
    done = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
    assert done.stdout.split()[1:] == ["False", "True"] and int(done.stdout.split()[0]) > 80
    present = os.path.isdir(os.path.join(root, "nextrail", "llm"))
    assert ("left out" in done.stderr) == (absent == "zstandard" and present)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_top_k_is_limited_before_the_shuffle(spark):
    queries, items = q.all_vectors(spark, FOLDER)
    for shared_bytes, limits in ((0, 2), (search.SHARED_BYTES, 0)):
        plan = plan_of(search.search(queries, items, shared_bytes=shared_bytes))
        assert plan.count("WindowGroupLimit") == limits
        # A catalogue that all tasks have gives ranked lists, one task per query.
        assert ("Window [" in plan) == bool(limits)
        assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_tail_is_limited_before_the_shuffle(spark):
    past = q.Log(spark, FOLDER, "events").histories()
    plan = plan_of(encode.known_tail(past, wh.event_item_vectors(spark, FOLDER), 32, heavy_items=[]))
    assert plan.count("WindowGroupLimit") == 2


def test_split_reads_only_its_columns_and_sorts_no_wide_rows(spark):
    events = wh.event_log(spark, FOLDER)
    split = train_test_split(events, heavy=[]).select("user_id", "is_train")
    plan = plan_of(split)
    assert "props" not in plan
    # Only the histogram of held-out counts meets in one task.
    assert plan.count("SinglePartition") <= 1


def test_model_vectors_are_read_from_a_stage(spark):
    """The text model of ``search_vectors`` and ``recommend_query`` isn't part of the searching plans."""
    for name in ("search_vectors", "recommend_query"):
        assert "predict" not in plan_of(contract.queries()[name](spark, FOLDER)).lower()


def test_places_of_a_log_are_not_sent_to_all_tasks(spark):
    """A log of few items is a small file of many rows; its places meet the next ones by a shuffle."""
    plan = plan_of(q.pair_similarity(spark, FOLDER))
    assert "SortMergeJoin [query_id" in plan
    assert "BroadcastHashJoin [query_id" not in plan


def test_no_join_without_keys(spark):
    for name in ("recommend_history_events", "user_metrics_events", "scored_losses"):
        plan = plan_of(contract.queries()[name](spark, FOLDER))
        assert "NestedLoop" not in plan and "Cartesian" not in plan
