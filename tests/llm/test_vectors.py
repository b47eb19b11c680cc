"""Whitening and hard negatives against plain versions."""

import sys
from pathlib import Path

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))

import brute  # noqa: E402

from nextrail.llm import negatives, queries, topk, whitening  # noqa: E402

SMALL = "/root/testdata/sf0.001"
NAN, INF = float("nan"), float("inf")


# ---- whitening


def spectrum(kind, dims, random):
    if kind == "flat":
        return np.ones(dims)
    if kind == "steep":
        return 10.0 ** -np.arange(dims)
    if kind == "steps":
        return np.repeat([100.0, 10.0, 1.0], -(-dims // 3))[:dims]
    return np.sort(random.random(dims))[::-1] + 0.1


@pytest.mark.parametrize("kind", ["flat", "steep", "steps", "random"])
@pytest.mark.parametrize(("dims", "wanted"), [(3, 8), (30, 8), (200, 12)])
def test_eigenpairs(kind, dims, wanted):
    random = np.random.default_rng(dims)
    turn, _ = np.linalg.qr(random.standard_normal((dims, dims)))
    values = spectrum(kind, dims, random)
    matrix = (turn * values) @ turn.T
    found, vectors = whitening.eigenpairs(lambda q: matrix @ q, dims, wanted, values.sum())
    share = values[:wanted] > 1e-12 * values.sum()
    assert np.allclose(found, values[:wanted][share], rtol=1e-11, atol=1e-13)
    assert np.allclose(vectors.T @ vectors, np.eye(len(found)), atol=1e-12)
    assert np.allclose(matrix @ vectors, vectors * found, atol=1e-12 * values[0])


def test_the_filter_damps_the_unwanted_part():
    values = np.r_[np.linspace(3, 2, 5), np.linspace(1, 0.5, 40)]
    out = whitening.chebyshev(lambda q: values[:, None] * q, np.ones((45, 1)), 0.5, 1.0, 3.0, 8)[:, 0]
    assert out[0] == pytest.approx(1) and np.abs(out[5:]).max() < 1e-4 * np.abs(out[:5]).min()


def plain_whitening(x, components):
    """deviation, eigenvalues, vectors, explained of integer rows, by the full covariance."""
    x = np.array(x, object)
    n, sums = len(x), x.sum(axis=0)
    moved = n * x - sums
    centred = moved.astype(float) / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    count = min(components, int((values > 1e-12 * values.sum()).sum()))
    return (moved**2).sum(axis=1), centred, values[:count], vectors[:, :count], (values / values.sum())[:count]


def check_whitening(got, ids, x, components):
    deviation, centred, values, vectors, explained = plain_whitening(x, components)
    count = len(values)
    assert len(got) == len(ids) * count
    by = {}
    for r in got:
        by.setdefault(r.vec_id, []).append(r)
    projected = centred @ vectors / np.sqrt(values)
    found = np.array([[next(r.whitened for r in by[i] if r.component == c + 1) for c in range(count)] for i in ids])
    found *= np.sign((found * projected).sum(axis=0))
    assert np.abs(found - projected).max() < 1e-7
    for place, i in enumerate(ids):
        for r in by[i]:
            assert (r.n, r.deviation) == (len(ids), deviation[place])
            assert r.explained == pytest.approx(explained[r.component - 1], rel=1e-9)
            assert r.identity_error < 1e-9
    assert len({r.identity_error for r in got}) == 1


def test_whitening_query(spark):
    rows = spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()
    x = [[int(np.floor(64 * float(c))) + 1_000_000 for c in r.embedding] for r in rows]
    check_whitening(queries.op11_whitening(spark, SMALL).collect(), [r.vec_id for r in rows], x, 32)


def test_whitening_of_hard_rows(spark):
    random = np.random.default_rng(1)
    plain = [(i, random.standard_normal(6).tolist()) for i in range(40)]
    odd = [(50, None), (51, [NAN] * 6), (52, [INF] + [0.0] * 5), (53, [None] + [0.0] * 5)]
    table = brute.frame(spark, [*plain, *odd], "vec_id long, embedding array<float>")
    vectors = table.withColumn("x", F.transform(topk.quantised(F.col("embedding"), 64), lambda c: c + 1_000_000))
    x = [[int(np.floor(64 * float(np.float32(c)))) + 1_000_000 for c in v] for _, v in plain]
    check_whitening(whitening.whiten(vectors, 4).collect(), [i for i, _ in plain], x, 4)
    assert whitening.whiten(vectors.where("false"), 4).count() == 0
    assert whitening.whiten(vectors.where("vec_id = 3"), 4).count() == 0
    assert whitening.whiten(vectors.where("vec_id > 49"), 4).count() == 0
    twice = whitening.whiten(vectors.where("vec_id < 3").unionByName(vectors.where("vec_id = 1")), 4).collect()
    assert {r.component for r in twice} == {1, 2} and len(twice) == 8 and {r.n for r in twice} == {4}
    unknown = vectors.where("vec_id < 9").withColumn("vec_id", F.lit(None).cast("string"))
    assert {r.vec_id for r in whitening.whiten(unknown, 2).collect()} == {None}
    with pytest.raises(ValueError, match="length"):
        whitening.whiten(spark.createDataFrame([(1, [1]), (2, [1, 2])], "vec_id long, x array<long>"), 2)


def test_a_deviation_that_is_no_long_is_null(spark):
    far = spark.createDataFrame([(1, [0]), (2, [2**33])], "vec_id long, x array<long>")
    assert [r.deviation for r in whitening.whiten(far, 1).collect()] == [None, None]


# ---- hard negatives


@settings(max_examples=50, deadline=None)
@given(st.integers(1, 70), st.integers(1, 70), st.integers(1, 70), st.sampled_from([1, 2, 7, 32]), st.integers(0, 99))
def test_strassen_is_exact(rows, inner, columns, leaf, seed):
    random = np.random.default_rng(seed)
    a, b = random.integers(-(2**26), 2**26, (rows, inner)), random.integers(-(2**26), 2**26, (inner, columns))
    assert (negatives.strassen(a, b, leaf) == a @ b).all()


@settings(max_examples=50, deadline=None)
@given(st.lists(st.lists(st.tuples(st.integers(-5, 5), st.integers(0, 99)), max_size=40), max_size=5), st.integers(1, 6))
def test_heaps_merge(parts, size):
    heap = negatives.Heap(size)
    for part in parts:
        heap.merge(np.array([s for s, _ in part], np.int64), np.array([i for _, i in part], np.int64))
    want = sorted((-s, i) for part in parts for s, i in part)[:size]
    assert [(-s, i) for s, i in zip(heap.scores.tolist(), heap.ids.tolist(), strict=True)] == want


def plain_mining(rows, every, positives, negatives_, window):
    low, whole, high = window
    out = []
    for anchor, label, vector in rows:
        if anchor % every:
            continue
        scored = sorted((-int(np.dot(vector, v)), i, other) for i, other, v in rows if i != anchor)
        for score, positive, _ in [s for s in scored if s[2] == label][:positives]:
            inside = [s for s in scored if s[2] != label and low * -score <= whole * -s[0] <= high * -score]
            out += [(anchor, positive, rank + 1, i, -score, -s) for rank, (s, i, _) in enumerate(inside[:negatives_])]
    return out


@pytest.mark.parametrize(("tile", "task", "anchors"), [(3, 5, 2), (4096, 65_536, 256)])
def test_mining_of_hard_rows(spark, monkeypatch, tile, task, anchors):
    for name, value in (("TILE_ROWS", tile), ("TASK_ROWS", task), ("ANCHOR_ROWS", anchors)):
        monkeypatch.setattr(negatives, name, value)
    random = np.random.default_rng(2)
    rows = [(i, int(random.integers(0, 3)), random.integers(-3, 9, 5).tolist()) for i in range(60)]
    rows += [(60 + i, label, list(v)) for i, (_, label, v) in enumerate(rows[:20])]  # ties
    odd = [(80, 0, None), (90, None, [1] * 5), (None, 0, [1] * 5)]
    table = brute.frame(spark, [*rows, *odd], "vec_id long, label int, vector array<long>")
    got = negatives.mine(table, 10, 3, 4, (30, 100, 90))
    assert sorted(map(tuple, got.collect())) == sorted(plain_mining(rows, 10, 3, 4, (30, 100, 90)))
    assert negatives.mine(table.where("false"), 10, 3, 4, (30, 100, 90)).count() == 0
    assert negatives.mine(table.where("label = 1"), 10, 3, 4, (30, 100, 90)).count() == 0
    # Repeated rows count as often as they are there.
    twice = negatives.mine(table.unionByName(table), 10, 3, 4, (30, 100, 90))
    once = {r[0] for r in got.collect()}
    assert {r.anchor_id for r in twice.collect()} >= once


def test_unfit_vectors_are_an_error(spark):
    rows = [(0, 1, [2**40, 1]), (1, 1, [1, 1])]
    with pytest.raises(ValueError, match="64 bits"):
        negatives.mine(spark.createDataFrame(rows, "vec_id long, label int, vector array<long>"), 1, 1, 1, (30, 100, 90))
    with pytest.raises(ValueError, match="length"):
        negatives.mine(spark.createDataFrame([(0, 1, [1]), (1, 1, [1, 2])], "vec_id long, label int, vector array<long>"), 1, 1, 1, (30, 100, 90))
