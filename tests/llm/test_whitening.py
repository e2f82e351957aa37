from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewater.llm import queries, whitening

rng = np.random.default_rng(3)
TURN = np.linalg.qr(rng.normal(size=(24, 24)))[0]
CASES = {
    "plain": rng.normal(size=(200, 24)),
    "graded": rng.normal(size=(200, 24)) * 10.0 ** -np.arange(0, 6, 0.25),
    "clusters": np.repeat([3.0, 2.0, 1.0], 8)[:, None] * (1 + 1e-12 * rng.normal(size=(24, 1))) * TURN,
    "close": np.repeat([3.0, 1.0], 12)[:, None] * (1 + 1e-5 * rng.normal(size=(24, 1))) * TURN,
    "low rank": rng.normal(size=(200, 5)) @ rng.normal(size=(5, 24)),
    "zeros": rng.normal(size=(200, 24)) * (np.arange(24) % 5 > 0),
    "one column": np.ones((7, 1)),
    "nothing": np.zeros((7, 3)),
}


@pytest.mark.parametrize("name", CASES)
def test_solver(name):
    a = CASES[name]
    r = np.linalg.qr(a, mode="r")
    values, kept, vectors = whitening.principal(r, a.shape[1])
    want = np.linalg.svd(a, compute_uv=False) ** 2
    top = max(want[0], 1e-300)
    assert np.abs(values - want).max() <= 1e-13 * top
    assert len(kept) == int((want > 1e-20 * top).sum() if want[0] else 0)
    assert np.allclose(vectors.T @ vectors, np.eye(len(kept)), atol=1e-11)
    assert np.abs(a.T @ (a @ vectors) - vectors * kept).max(initial=0) <= 1e-13 * top


def test_small_values_are_found_to_high_relative_accuracy():
    # the product of the squared diagonal is the product of the values, however far apart they are
    q, e = 10.0 ** -np.arange(0.0, 24, 2), 10.0 ** -np.arange(1.0, 23, 2)
    values = whitening.qd_values(q, e)
    assert values[-1] < 1e-20 and np.isclose(np.log(values).sum(), np.log(q).sum(), rtol=1e-13)


def slow(vectors):
    """(n, deviations, components up to sign, variance shares) straight from the definitions."""
    x = np.array([[int(np.floor(64 * np.float64(c))) + 1_000_000 for c in v] for v in vectors], dtype=object)
    n, s = len(x), x.sum(axis=0)
    exact = n * x - s
    centred = (exact / n).astype(float)
    e, u = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(-e)[:32]
    return n, [int(v) for v in (exact * exact).sum(axis=1)], centred @ u[:, order] / np.sqrt(e[order]), e[order] / e.sum()


def test_every_row_of_the_table(spark):
    folder = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{folder}/embeddings.parquet").orderBy("vec_id").collect()
    n, deviations, y, shares = slow([r.embedding for r in rows])
    got = defaultdict(dict)
    for r in queries.op13_whitening(spark, folder).collect():
        assert r.n == n and r.identity_error < 1e-9
        got[r.vec_id][r.component] = r
    assert list(sorted(got)) == [r.vec_id for r in rows] and all(sorted(v) == list(range(1, 33)) for v in got.values())
    table = np.array([[got[r.vec_id][k].whitened for k in range(1, 33)] for r in rows])
    assert np.allclose(table * np.sign((table * y).sum(axis=0)), y, atol=1e-8)
    assert [got[r.vec_id][1].deviation for r in rows] == deviations
    assert np.allclose([got[rows[0].vec_id][k].explained for k in range(1, 33)], shares, rtol=1e-10)


def run(spark, rows, **more):
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5).select("vec_id", whitening.whole(F.col("embedding")).alias("vector"))
    return whitening.whiten(table, whitening.fit(table, **more)).collect()


def test_many_tasks_and_blocks_agree(spark, monkeypatch):
    monkeypatch.setattr(whitening, "FAN_IN", 2)
    vectors = rng.normal(size=(300, 6)).astype(np.float32)
    got = run(spark, [(i, v.tolist()) for i, v in enumerate(vectors)], components=4)
    n, deviations, y, _ = slow(vectors)
    table = np.zeros((300, 4))
    for r in got:
        table[r.vec_id, r.component - 1] = r.whitened
        assert r.deviation == deviations[r.vec_id]
    assert len(got) == 1200 and np.allclose(table * np.sign((table * y[:, :4]).sum(axis=0)), y[:, :4], atol=1e-9)


def test_nulls_repeats_and_no_variance(spark):
    rows = [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (None, [0.0, 5.0]), (2, None), (3, [float("nan"), 1.0]), (4, [None, 1.0]), (5, [float("inf"), 0.0]), (6, [3.0]), (7, [])]
    got = run(spark, rows)
    assert sorted((r.vec_id or 0, r.component) for r in got) == [(0, 1), (0, 2), (1, 1), (1, 1), (1, 2), (1, 2), (6, 1), (6, 2), (7, 1), (7, 2)]
    assert {r.n for r in got} == {5} and got[0].identity_error < 1e-12
    assert run(spark, []) == [] and run(spark, [(1, [1.0, 2.0])]) == [] and run(spark, [(i, [2.0, float(i)]) for i in range(4)])[0].explained == 1.0
    assert run(spark, [(1, []), (2, [])]) == []
    assert whitening._deviations(np.array([[1 << 32, 1], [1 << 20, 3]])) == [None, (1 << 40) + 9]
