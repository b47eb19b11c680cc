"""Vocabulary, indexed histories and sampling."""

import datetime as dt
from collections import Counter

import pytest
from pyspark.sql import functions as F

from nextrail.config import SequenceConfig
from nextrail.functions import sampling
from nextrail.operators import sequences as seq
from nextrail.sources.tables import stage

EVENTS = (
    "user_id string, item_id string, event_value double, datetime timestamp_ntz, "
    "event_name string, label boolean, is_train boolean"
)


def train_log(spark, users):
    """``users``: user to list of (item, label)."""
    rows = [
        (user, item, 1.0, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=i), "view", label, True)
        for user, events in users.items()
        for i, (item, label) in enumerate(events)
    ]
    return spark.createDataFrame(rows, EVENTS)


def vocab_of(spark, n):
    items = spark.createDataFrame([(f"i{k}", f"text {k}") for k in range(n)], "item_id string, item_text string")
    return stage(seq.vocabulary(items))


def test_vocabulary_counts_from_one(spark):
    idx = [r["item_idx"] for r in vocab_of(spark, 30).collect()]
    assert sorted(idx) == list(range(1, 31))


@pytest.mark.parametrize("labels,kept", [((0, 1, 0), 2), ((0, 0), 0), ((1,), 1), ((1, 0, 0, 1), 4)])
def test_history_is_cut_after_last_positive(spark, heavy_rows, labels, kept):
    events = train_log(spark, {"u": [(f"i{k}", bool(x)) for k, x in enumerate(labels)]})
    got = seq.index_histories(events, vocab_of(spark, 10)).orderBy("pos").collect()
    assert [r["item_id"] for r in got] == [f"i{k}" for k in range(kept)]
    assert [r["pos"] for r in got] == list(range(kept))


def test_unknown_items_are_dropped_with_their_labels(spark, heavy_rows):
    events = train_log(spark, {"u": [("i1", False), ("x", True), ("i2", True), ("y", True)]})
    got = seq.index_histories(events, vocab_of(spark, 5)).orderBy("pos").collect()
    assert [(r["item_id"], r["label"], r["pos"]) for r in got] == [("i1", False, 0), ("i2", True, 1)]


def lengths(spark, *sizes):
    rows = [(f"u{n}", pos) for n in sizes for pos in range(n)]
    return spark.createDataFrame(rows, "user_id string, pos long")


def test_copies(spark):
    got = Counter(r["user_id"] for r in seq.copies_of(lengths(spark, 1, 32, 33, 65), 32).collect())
    assert got == {"u1": 1, "u32": 1, "u33": 2, "u65": 3}


def test_long_histories_have_all_copies(spark):
    # More copies than one block holds.
    got = seq.copies_of(lengths(spark, 10_000), 1)
    assert sorted(r["copy"] for r in got.collect()) == list(range(10_000))


def test_subsets_are_uniform(spark):
    picks = spark.range(4000).select(
        sampling.choose(F.lit(5).cast("long"), F.lit(2).cast("long"), F.col("id")).alias("s")
    )
    got = Counter(tuple(sorted(r["s"])) for r in picks.collect())
    assert len(got) == 10 and all(300 < n < 500 for n in got.values())
    shuffled = spark.range(3000).select(
        sampling.shuffled(F.array(*[F.lit(i) for i in range(3)]), F.col("id")).alias("s")
    )
    got = Counter(tuple(r["s"]) for r in shuffled.collect())
    assert len(got) == 6 and all(400 < n < 600 for n in got.values())


def history_items(users, user):
    return [item for item, _ in users[user]]


@pytest.mark.parametrize("lookahead", [0, 3])
def test_examples(spark, heavy_rows, partitions, lookahead):
    config = SequenceConfig(max_seq_length=8, pos_lookahead=lookahead, batch_size=3, seed=7)
    users = {
        "long": [(f"i{k * 7 % 60}", k % 4 != 1) for k in range(45)],
        "short": [("i1", True), ("i2", True), ("i3", True)],
        "single": [("i5", True)],
        "everything": [(f"i{k}", True) for k in range(60)],
        "almost": [(f"i{k}", True) for k in range(57)],
    }
    events = train_log(spark, users)
    results = []
    for count in (1, 5):
        partitions(count)
        vocab = vocab_of(spark, 60)
        past = stage(seq.index_histories(events, vocab))
        examples = seq.build_examples(past, vocab, 60, config)
        results.append(examples.orderBy("user_id", "copy").collect())
    assert results[0] == results[1]

    names = {r["item_idx"]: r["item_id"] for r in vocab.collect()}
    by_user = Counter(r["user_id"] for r in results[0])
    assert by_user == {"long": 6, "short": 1, "single": 1, "everything": 8, "almost": 8}
    for row in results[0]:
        mine = users[row["user_id"]]
        ids = history_items(users, row["user_id"])
        size = min(8, len(mine) - 1)
        for role in ("history", "pos", "neg"):
            assert len(row[f"{role}_item_idx"]) == len(row[f"{role}_item_text"]) == size
        sampled = [names[i] for i in row["history_item_idx"]]
        # Items of these histories are distinct, so places follow from them.
        places = [ids.index(item) for item in sampled]
        assert places == sorted(set(places)) and all(p < len(mine) - 1 for p in places)
        for place, pos in zip(places, row["pos_item_idx"]):
            end = place + 1 + lookahead if lookahead else None
            later = [item for item, label in mine[place + 1 : end] if label]
            assert names[pos] in later if later else pos == 0
        negatives = [names[i] for i in row["neg_item_idx"]]
        if row["user_id"] == "everything":
            assert len(set(negatives)) == size
        else:
            assert not set(negatives) & set(ids)
            if row["user_id"] == "almost":
                assert set(negatives) <= {"i57", "i58", "i59"}
            else:
                assert len(set(negatives)) == size
        for role in ("history", "neg"):
            texts = [f"text {names[i][1:]}" for i in row[f"{role}_item_idx"]]
            assert row[f"{role}_item_text"] == texts
        assert [t is None for t in row["pos_item_text"]] == [i == 0 for i in row["pos_item_idx"]]

    again = seq.build_examples(past, vocab, 60, config, epoch=1).orderBy("user_id", "copy").collect()
    assert again != results[0]

    batched = seq.assign_batches(stage(examples), config).cache()
    sizes = Counter(r["batch_id"] for r in batched.collect())
    assert sorted(sizes.values(), reverse=True) == [3] * 8 and sorted(sizes) == list(range(8))
    padded = seq.pad_batches(batched).collect()
    for batch in sizes:
        rows = [r for r in padded if r["batch_id"] == batch]
        assert {len(r[f"{role}_item_idx"]) for r in rows for role in ("history", "pos", "neg")} == {
            max(r["seq_len"] for r in rows)
        }
    stats = {r["batch_id"]: r for r in seq.batch_stats(batched).collect()}
    assert sum(r["attention_non_zero"] for r in stats.values()) == sum(
        len(r["history_item_idx"]) for r in results[0]
    )


def test_few_copies_are_spread_over_tasks(spark):
    """What is drawn for a copy costs far more than its row: a handful of bytes must not become one task."""
    copies = seq.copies_of(lengths(spark, *range(1, 40)), 8)
    assert copies.select(F.spark_partition_id()).distinct().count() > 1


@pytest.mark.parametrize("lookahead", [0, 2])
def test_positives_are_joined_by_shuffles_alone(spark, lookahead):
    """The samples and the histories are both as long as the log; neither may go to all tasks, however small their files."""
    config = SequenceConfig(max_seq_length=4, pos_lookahead=lookahead)
    log = train_log(spark, {f"u{u}": [(f"i{k}", k % 2 == 0) for k in range(9)] for u in range(6)})
    past = stage(seq.index_histories(log, vocab_of(spark, 10)))
    samples = seq.sample_positions(seq.copies_of(past, 4), config)
    found = seq.sample_positives(samples, past, config)
    rows = found.collect()
    assert len(rows) == 6 * 3 * 4 and all(r["pos_item_idx"] > 0 for r in rows if r["pos"] < 7)
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


def test_negatives_are_drawn_in_all_tasks(spark):
    """The draws cost far more than the rows they start from, so their tasks aren't merged by size."""
    log = train_log(spark, {f"u{u}": [(f"i{k}", True) for k in range(u % 7 + 2)] for u in range(30)})
    past = stage(seq.index_histories(log, vocab_of(spark, 12)))
    config = SequenceConfig(max_seq_length=4)
    samples = stage(seq.sample_positions(seq.copies_of(past, 4), config))
    found = seq.sample_negatives(samples, past, 12, config)
    seen = {(r["user_id"], r["item_idx"]) for r in past.collect()}
    rows = found.collect()
    assert len(rows) == samples.agg(F.sum(F.size("places"))).first()[0]
    assert not any((r["user_id"], r["neg_item_idx"]) in seen for r in rows)
    assert "REPARTITION_BY_NUM" in found._jdf.queryExecution().executedPlan().toString()
