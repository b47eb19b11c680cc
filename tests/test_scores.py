"""Retrieval metrics and losses."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from nextrail.config import LossConfig
from nextrail.operators import losses, metrics
from nextrail.operators.metrics import METRICS, best_run, mean_metrics, retrieval_metrics


def metrics_of(spark, recs, targets, top_k):
    rec_rows = [(q, i, n) for q, ids in recs.items() for n, i in enumerate(ids, 1)]
    target_rows = [(q, i) for q, ids in targets.items() for i in ids]
    got = retrieval_metrics(
        spark.createDataFrame(rec_rows, "query_id string, item_id string, rank int"),
        spark.createDataFrame(target_rows, "query_id string, item_id string"),
        top_k,
    )
    return {r["query_id"]: [round(r[m], 5) for m in METRICS] for r in got.collect()}


def test_metrics(spark):
    got = metrics_of(
        spark,
        {"q": list("abcd"), "short": ["i10", "i3", "i7"], "all": ["a", "b"], "none": ["a"], "idle": ["z"]},
        {"q": ["b", "d", "z", "b"], "short": ["i3"], "all": ["a", "b"], "none": ["x"], "no list": ["x", "y"]},
        4,
    )
    assert got["q"] == [0.49819, 0.5, 0.25, 0.5, 0.66667, 1.0, 0.5]
    # Filled up to four: one hit at rank 2, two misses below it.
    assert got["short"] == [round(1 / math.log2(3), 5), 0.5, 0.66667, 0.25, 1.0, 1.0, 0.5]
    assert got["all"] == [1.0, 1.0, 1.0, 0.5, 1.0, 1.0, 1.0]
    assert got["none"] == got["no list"] == [0.0] * 7
    assert "idle" not in got


def test_auroc_is_zero_without_a_miss(spark):
    got = metrics_of(spark, {"q": ["a", "b"]}, {"q": ["a", "b", "c"]}, 2)
    assert got["q"] == [1.0, 1.0, 0.0, 1.0, 0.66667, 1.0, 1.0]


def test_mean_and_best_run(spark):
    rows = [("r1", 0.2), ("r2", 0.6), ("r3", None), ("r0", 0.6)]
    df = spark.createDataFrame(rows, "run_id string, retrieval_normalized_dcg double")
    assert best_run(df).first()["run_id"] == "r2"
    scores = spark.createDataFrame([(s, *[v] * 7) for s, v in (("val", 0.0), ("val", 1.0), ("test", 0.25))],
                                   "stage string, " + ", ".join(f"{m} double" for m in METRICS))
    got = {r["stage"]: (r["n_queries"], r[list(METRICS)[0]]) for r in mean_metrics(scores, "stage").collect()}
    assert got == {"val": (2, 0.5), "test": (1, 0.25)}


def plain_losses(logits, config):
    """One query, target first, in plain arithmetic."""
    target, negatives = logits[0], [
        x for x in logits[1:] if not config.mask_false_negatives or x < logits[0]
    ]
    if config.num_hard_negatives and config.num_hard_negatives < len(logits):
        negatives = sorted(negatives, reverse=True)[: config.num_hard_negatives]
    mean = lambda values: sum(values) / (len(values) + 1e-9)
    soft = lambda x: math.log1p(math.exp(x))
    beyond = [x - target * (1 - config.margin) for x in negatives]
    contrastive = mean([max(x - 1 + config.margin, 0) for x in negatives])
    return {
        "AlignmentLoss": 1 - target,
        "AlignmentContrastiveLoss": 1 - target + contrastive,
        "ContrastiveLoss": contrastive,
        "InfoNCELoss": math.log(sum(math.exp(config.scale * x) for x in [target, *negatives])) - config.scale * target,
        "NCELoss": soft(-target) + mean([soft(x) for x in negatives]),
        "PairwiseHingeLoss": mean([max(x, 0) for x in beyond]),
        "PairwiseLogisticLoss": mean([soft(x) for x in beyond]),
    }


CONFIGS = [
    LossConfig(),
    LossConfig(mask_false_negatives=False),
    LossConfig(num_hard_negatives=2, scale=3.0, margin=0.2),
    LossConfig(num_hard_negatives=50),
]
LOGITS = np.round(np.random.default_rng(2).normal(size=(12, 9)), 1)
LOGITS[3] = LOGITS[3, 0]  # every negative as high as the target
LOGITS[4, 0] = -9.0  # all negatives masked


@pytest.mark.parametrize("config", CONFIGS)
def test_losses_of_a_table(spark, heavy_rows, config):
    rows = [
        (q // 6, f"q{q}", f"c{c:02d}", c, float(x)) for q, line in enumerate(LOGITS) for c, x in enumerate(line)
    ]
    scored = spark.createDataFrame(rows, "batch_id long, query_id string, cand_id string, slot int, dot double")
    scored = losses.mark_target(scored, config)
    got = {r["query_id"]: r for r in losses.query_losses(scored, config).collect()}
    for q, line in enumerate(LOGITS):
        for name, value in plain_losses(line, config).items():
            assert got[f"q{q}"][name] == pytest.approx(value, abs=1e-9)
    sums = losses.batch_losses(scored, config, logits={"dot": "dot", "cosine": "dot"}).collect()
    for row in sums:
        mine = [plain_losses(line, config) for q, line in enumerate(LOGITS) if q // 6 == row["batch_id"]]
        for name in losses.LOSSES:
            assert row[name] == pytest.approx(sum(m[name] for m in mine), abs=1e-8)
            assert row[f"{name}Mean"] == pytest.approx(sum(m[name] for m in mine) / 6, abs=1e-8)


def test_all_negatives_masked_gives_no_loss(spark):
    rows = [(0, "q", f"c{c}", c == 0, x) for c, x in enumerate([0.1, 0.5, 0.9])]
    scored = spark.createDataFrame(rows, "batch_id long, query_id string, cand_id string, is_target boolean, dot double")
    got = losses.query_losses(scored).first()
    assert got["InfoNCELoss"] == pytest.approx(0) and got["PairwiseHingeLoss"] == 0


def test_own_losses_and_metrics(spark, monkeypatch):
    monkeypatch.setattr(losses, "LOSSES", dict(losses.LOSSES))
    losses.register_loss("LargestNegative", "dot", lambda q: F.max(F.when(q.negative, q.logit)))
    rows = [(0, "q", f"c{c}", c == 0, x, x) for c, x in enumerate([0.7, 0.5, 0.9])]
    scored = spark.createDataFrame(
        rows, "batch_id long, query_id string, cand_id string, is_target boolean, dot double, cosine double"
    )
    assert losses.batch_losses(scored).first()["LargestNegative"] == 0.5
    monkeypatch.setattr(metrics, "METRICS", dict(metrics.METRICS))
    metrics.register_metric("n_hits", lambda q: q.count.cast("double"))
    recs = spark.createDataFrame([("q", "a", 1), ("q", "b", 2)], "query_id string, item_id string, rank int")
    targets = spark.createDataFrame([("q", "b"), ("q", "c")], "query_id string, item_id string")
    scores = metrics.retrieval_metrics(recs, targets, 2)
    assert metrics.mean_metrics(scores).first()["n_hits"] == 1


def test_equal_negative_is_masked(spark):
    rows = [(0, "q", "t", 0, 1.0), (0, "q", "a", 1, 1.0), (0, "q", "b", 2, 0.5)]
    scored = spark.createDataFrame(rows, "batch_id long, query_id string, cand_id string, slot int, dot double")
    marked = losses.valid_negatives(losses.mark_target(scored), LossConfig())
    assert [r["cand_id"] for r in marked.where("is_negative").collect()] == ["b"]
    stats = losses.logit_stats(losses.mark_target(scored)).first()
    assert stats["neg_density"] == pytest.approx(0.5) and stats["pos_mean"] == 1.0
    assert stats["neg_min"] == 0.5 and stats["neg_std"] is None


def test_target_choice(spark):
    df = spark.createDataFrame([(0, 0), (1, 1), (0, 1)], "slot int, row int")
    diagonal = losses.mark_target(df, LossConfig(target_position="diagonal"))
    assert [r["is_target"] for r in diagonal.collect()] == [True, True, False]
    given = losses.mark_target(df, LossConfig(target_position=None), "row")
    assert [r["is_target"] for r in given.collect()] == [True, True, False]
    for config, column in ((LossConfig(), "row"), (LossConfig(target_position=None), None)):
        with pytest.raises(ValueError, match="either"):
            losses.mark_target(df, config, column)


def test_info_nce_does_not_depend_on_masked_candidates(spark):
    rows = [(0, "q", "t", True, 10.0), (0, "q", "m", False, 1000.0), (0, "q", "n", False, 5.0)]
    scored = spark.createDataFrame(rows, "batch_id int, query_id string, cand_id string, is_target boolean, dot double")
    for config, want in (
        (LossConfig(), 0.006715348),
        (LossConfig(scale=100.0), 0.0),
        (LossConfig(mask_false_negatives=False), 990.0),
        (LossConfig(mask_false_negatives=False, scale=100.0), 99000.0),
    ):
        assert losses.query_losses(scored, config).first()["InfoNCELoss"] == pytest.approx(want)
