"""Raw files, split flags, texts, histories and the prepared tables."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from nextrail.config import SplitConfig
from nextrail.operators.activity import (
    enrich_events,
    flag_items,
    latest_lists,
    lay_out_users,
    list_rows,
    place_activities,
)
from nextrail.operators.split import split_summary, train_test_split
from nextrail.plans.prepare import prepare, prepare_files, stage_views
from nextrail.sources.raw import load_events, load_items, load_users
from nextrail.sources.tables import assert_unique, materialize, preview, read_split, stage

DAY = dt.datetime(2024, 1, 1)
EVENTS = (
    "user_id string, item_id string, event_value double, datetime timestamp_ntz, "
    "event_name string, label boolean"
)


def log(spark, users, label=True):
    """``users``: user to list of (minute, item)."""
    rows = [
        (user, item, 1.0, None if minute is None else DAY + dt.timedelta(minutes=minute), "view", label)
        for user, events in users.items()
        for minute, item in events
    ]
    return spark.createDataFrame(rows, EVENTS)


def distinct_times(count):
    return [(i, str(i)) for i in range(count)]


def flags(df):
    return {
        (r["user_id"], r["item_id"]): (r["is_train"], r["is_val"], r["is_test"], r["is_predict"])
        for r in df.collect()
    }


def test_four_times_are_all_train(spark, heavy_rows):
    got = flags(train_test_split(log(spark, {"a": distinct_times(4)})))
    assert set(got.values()) == {(True, False, False, True)}


def test_fifth_time_is_held_out(spark, heavy_rows):
    got = flags(train_test_split(log(spark, {"a": distinct_times(5)})))
    assert got["a", "4"] == (False, False, True, True)
    assert sum(f[0] for f in got.values()) == 4


@pytest.mark.parametrize("sizes,val", [((5, 10, 15), set()), ((5, 10, 15, 20, 25), {"25"})])
def test_most_active_users_are_val(spark, heavy_rows, sizes, val):
    got = flags(train_test_split(log(spark, {str(n): distinct_times(n) for n in sizes})))
    assert {user for (user, _), f in got.items() if f[1]} == val
    assert {user for (user, _), f in got.items() if f[2]} == {str(n) for n in sizes} - val


def test_ties_stay_together(spark, heavy_rows):
    events = [(0, "a"), (1, "b"), (1, "c"), (1, "d"), (1, "e"), (1, "f")]
    got = flags(train_test_split(log(spark, {"u": events})))
    # The tied group starts at rank 1 of 6, so all of it is train.
    assert all(f[0] for f in got.values())


def test_null_time_has_null_flags(spark, heavy_rows):
    got = flags(train_test_split(log(spark, {"u": [(None, "x"), *distinct_times(5)]})))
    assert got["u", "x"][:3] == (None, False, None)
    assert got["u", "4"][0] is False


def test_split_is_exact_for_any_proportion(spark, heavy_rows):
    config = SplitConfig(train_prop=0.5, val_prop=0.5)
    got = flags(train_test_split(log(spark, {"a": distinct_times(4), "b": distinct_times(8)}), config=config))
    assert sum(f[0] for (u, _), f in got.items() if u == "b") == 4
    assert {u for (u, _), f in got.items() if f[1]} == {"b"}


def test_summary(spark):
    rows = split_summary(train_test_split(log(spark, {"a": distinct_times(5), "b": distinct_times(4)})))
    assert {r["split"]: (r["n_events"], r["n_users"]) for r in rows.collect()} == {
        "train": (8, 2),
        "test": (1, 1),
    }


def users_of(spark, *ids):
    return spark.createDataFrame([(i, f"text {i}") for i in ids], "user_id string, user_text string")


def items_of(spark, *ids):
    return spark.createDataFrame([(i, f"text {i}") for i in ids], "item_id string, item_text string")


def test_unseen_item_has_null_flag(spark):
    events = train_test_split(log(spark, {"u": distinct_times(5)}))
    rows = flag_items(items_of(spark, "0", "4", "99"), events).collect()
    assert {r["item_id"]: r["is_train"] for r in rows} == {"0": True, "4": False, "99": None}
    assert all(r["is_val"] and r["is_test"] and r["is_predict"] for r in rows)


def test_history_sorts_ids_as_text(spark, heavy_rows):
    events = log(spark, {"u": [(0, "9"), (0, "10"), (1, "1"), (2, "2")]})
    placed = place_activities(train_test_split(events))
    got = [r["item_id"] for r in placed.where("part = 'history'").orderBy("pos").collect()]
    assert got == ["10", "9", "1", "2"]


def test_users_are_laid_out_by_row(spark, heavy_rows):
    events = log(spark, {"a": distinct_times(20), "b": [(None, "7")]})
    users = users_of(spark, "a", "b", "c")
    events = enrich_events(train_test_split(events), items_of(spark, *map(str, range(15))), users)
    rows = lay_out_users(users, events).cache()
    of = {u: rows.where(F.col("user_id") == u).orderBy("part", "pos").collect() for u in "abc"}
    assert [r["item_id"] for r in of["a"]] == [str(i) for i in range(20)]
    assert [(r["part"], r["pos"]) for r in of["a"]] == [("history", i) for i in range(16)] + [("target", i) for i in range(4)]
    assert {r["user_text"] for r in of["a"]} == {"text a"} and of["a"][15]["item_text"] is None
    assert [(r["part"], r["is_train"]) for r in of["b"]] == [(None, False)]
    assert [(r["part"], r["is_train"], r["user_text"]) for r in of["c"]] == [(None, None, "text c")]
    lists = {(r["user_id"], r["part"]): r for r in latest_lists(rows, 5).collect()}
    assert set(lists) == {("a", "history"), ("a", "target")}
    assert lists["a", "history"]["lists"]["item_id"] == ["11", "12", "13", "14", "15"]
    again = list_rows(latest_lists(rows, 5), "item_id").where("part = 'history'").orderBy("pos").collect()
    assert [(r["pos"], r["item_id"]) for r in again] == [(i, str(i)) for i in range(11, 16)]


@pytest.mark.parametrize("list_rows_", [4, 100])
def test_lists_of_whole_parts(spark, list_rows_):
    events = enrich_events(train_test_split(log(spark, {"a": distinct_times(20), "b": distinct_times(3)})), items_of(spark, *map(str, range(20))))
    rows = lay_out_users(users_of(spark, "a", "b"), events)
    lists = latest_lists(rows, None, list_rows=list_rows_).collect()
    assert all(len(r["lists"]["item_id"]) <= list_rows_ for r in lists)
    assert len(lists) == (6 if list_rows_ == 4 else 3)
    again = list_rows(latest_lists(rows, None, list_rows=list_rows_), "item_id", "label").orderBy("user_id", "part", "pos").collect()
    want = rows.where("part IS NOT NULL").select("user_id", "part", "pos", "item_id", "label").orderBy("user_id", "part", "pos").collect()
    assert [tuple(r) for r in again] == [tuple(r) for r in want]


def jobs_of(spark, work):
    """How many Spark jobs ``work`` starts."""
    spark.sparkContext.setJobGroup(group := f"jobs-{id(work)}", "counted")
    try:
        work()
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_keys_are_checked_in_the_joins_own_jobs(spark):
    split = stage(train_test_split(log(spark, {"a": distinct_times(4), "b": distinct_times(6)})))
    nulls = spark.createDataFrame([(None, "x"), (None, "y")], "id string, text string")
    items, users = items_of(spark, "1", "2", "3"), users_of(spark, "a", "b")
    more_items, more_users = (t.unionByName(nulls.toDF(*t.columns)) for t in (items, users))
    twice_items, twice_users = items.unionByName(items_of(spark, "2")), users.unionByName(users_of(spark, "b"))

    def whole(df):
        return df.write.format("noop").mode("overwrite").save()

    enriched = stage(enrich_events(split, more_items, more_users))
    for make, right, wrong in (
        (lambda t, **k: enrich_events(split, t, **k), more_items, twice_items),
        (lambda t, **k: enrich_events(split, items, t, **k), more_users, twice_users),
        (lambda t, **k: flag_items(t, split, **k), more_items, twice_items),
        (lambda t, **k: lay_out_users(t, enriched, heavy=[], **k), more_users, twice_users),
    ):
        checked, plain = make(right), make(right, validate=False)
        assert sorted(map(str, checked.collect())) == sorted(map(str, plain.collect()))
        # Adaptive execution starts a job per shuffle; without it, a job is an action or a broadcast.
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        try:
            assert jobs_of(spark, lambda: whole(make(right))) == jobs_of(spark, lambda: whole(make(right, validate=False)))
        finally:
            spark.conf.unset("spark.sql.adaptive.enabled")
        with pytest.raises(Exception, match="not unique"):
            make(wrong).collect()
        assert make(wrong, validate=False).count() > 0


def test_duplicate_keys_raise(spark):
    with pytest.raises(ValueError, match="not unique"):
        assert_unique(items_of(spark, "1", "1"), ["item_id"])
    assert_unique(spark.createDataFrame([(None,), (None,), ("a",)], "k string"), ["k"])


@pytest.fixture
def raw_folder(tmp_path):
    (tmp_path / "movies.dat").write_bytes(
        "1::Toy Story (1995)::Animation|Children's|Comedy\n"
        "2::Amélie \"x\"::Comedy\n"
        "3::NA::\n".encode("latin-1")
    )
    (tmp_path / "users.dat").write_text("1::F::1::10::48067\n2::M::25::3::00231-4\n")
    (tmp_path / "ratings.dat").write_text(
        "".join(f"1::{1 + i % 3}::{1 + i % 5}::{978300000 + i}\n" for i in range(10))
        + "".join(f"2::1::4::{978300000 + i}\n" for i in range(5))
    )
    return tmp_path


def test_raw_files(spark, raw_folder):
    items = {r["item_id"]: r["item_text"] for r in load_items(spark, str(raw_folder / "movies.dat")).collect()}
    assert items["1"] == '{"title":"Toy Story (1995)","genres":["Animation","Children\'s","Comedy"]}'
    assert items["2"] == '{"title":"Amélie \\"x\\"","genres":["Comedy"]}'
    assert items["3"] == '{"title":"NA","genres":null}'
    users = load_users(spark, str(raw_folder / "users.dat")).where("user_id = '1'").first()
    assert users["user_text"] == '{"gender":"F","age":1,"occupation":10,"zipcode":"48067"}'
    events = load_events(spark, str(raw_folder / "ratings.dat"))
    first = events.orderBy("timestamp").first()
    assert first["datetime"] == dt.datetime(2000, 12, 31, 22, 0)
    assert dict(events.dtypes)["datetime"] == "timestamp_ntz"
    assert events.where("label AND event_name = 'rating'").count() == 15


def test_prepare_files(spark, raw_folder, tmp_path):
    out = str(tmp_path / "out")
    tables = prepare_files(spark, str(raw_folder), out)
    assert tables.events.count() == 15
    assert tables.events.where("is_train").count() == 12
    assert {"item_text", "user_text", "is_predict"} <= set(tables.events.columns)
    assert tables.items.count() == 3 and tables.users.count() == 15
    views = stage_views(spark, out)
    people = {name: views[name].select("user_id").distinct().count() for name in ("train", "val", "test", "predict")}
    assert people["train"] == people["predict"] == people["val"] + people["test"] == 2
    assert views["items"].select(F.size("embedding")).distinct().count() == 1
    assert preview(tables.events).count() == 5

    # Found again without the source; built anew if a parameter differs.
    again = prepare_files(spark, str(raw_folder), out)
    assert again.users.count() == 15
    other = prepare_files(spark, str(raw_folder), out, split=SplitConfig(train_prop=0.5))
    assert other.events.where("is_train").count() == 8


def test_prepare_reads_the_log_once(spark, tmp_path):
    """The log's own work is done once, however often its rows are needed."""
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    events = log(spark, {"a": distinct_times(8), "b": distinct_times(6)})
    prepare(events.mapInArrow(counted, EVENTS), items_of(spark, "1", "2"), users_of(spark, "a", "b"), str(tmp_path / "t"))
    assert seen.value == 14


def test_materialize_builds_once(spark, tmp_path):
    calls = []

    def build():
        calls.append(1)
        return spark.range(3)

    path = str(tmp_path / "t")
    for _ in range(2):
        assert materialize(spark, path, build, params={"a": 1}).count() == 3
    assert len(calls) == 1
    materialize(spark, path, build, params={"a": 2})
    materialize(spark, path, build, params={"a": 2}, overwrite=True)
    assert len(calls) == 3


def test_split_flag_is_pushed_into_the_scan(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame([(1, True), (2, False), (3, None)], "id int, is_val boolean").write.parquet(path)
    df = read_split(spark, path, "is_val")
    assert [r["id"] for r in df.collect()] == [1]
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(is_val,true)" in plan
