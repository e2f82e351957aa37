import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewater.llm import topk


def slow(rows, k, queries):
    clean = []
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            clean.append((i, [int(np.floor(256 * np.float64(np.float32(x)))) for x in v]))
    out = []
    for q in queries:
        if asked := [v for i, v in clean if i == q]:
            scored = sorted((-sum(a * b for a, b in zip(min(asked), v)), i) for i, v in clean if i != q)[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored)]
    return sorted(out)


def run(spark, rows, k, every):
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").select("vec_id", topk.quantised(F.col("embedding")).alias("vector"))
    return sorted(tuple(r) for r in topk.exact_top_k(table, table.where(f"vec_id % {every} = 0"), k).collect())


@pytest.mark.parametrize("scale", [1.0, 3e5])
def test_against_brute_force(spark, scale, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK_VECTORS", 100)
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, scale) for _ in range(12)]) for i in range(350)]
    rows += [(i + 350, rows[i][1]) for i in range(40)]  # ties
    assert run(spark, rows, 5, 10) == slow(rows, 5, range(0, 400, 10))


def test_stops_early_on_proof():
    rng = np.random.default_rng(1)
    centres = rng.integers(-60, 60, (20, 32))
    vectors = centres[rng.integers(0, 20, 3000)] + rng.integers(-4, 5, (3000, 32))
    found = topk.ImpactIndex(vectors).search(vectors[:5], 3, np.eye(5, 3000, dtype=bool))
    assert all(len(rows) < 300 for rows, _ in found)


def test_nulls_and_few_vectors(spark):
    rows = [(0, [1.0, 2.0]), (2, [1.0]), (3, None), (4, [float("nan"), 1.0]), (6, [None, 1.0]), (8, [float("inf")]), (None, [1.0, 1.0]), (2, [1.0]), (10, [0.0, 0.0]), (12, [])]
    assert run(spark, rows, 5, 2) == slow(rows, 5, [0, 2, 10, 12])
    assert run(spark, [], 5, 2) == []
    assert run(spark, [(0, [1.0])], 5, 2) == []


def test_rows_of_a_repeated_id_are_candidates_each(spark):
    rows = [(1, [3.0, 1.0])] * 7 + [(1, [9.0, 0.0]), (2, [1.0, 1.0]), (2, [2.0, 5.0]), (2, [2.0, 5.0]), (4, [1.0, 0.0]), (3, [8.0, 8.0])]
    for k in (2, 5, 20):
        want = slow(rows, k, [2, 4])
        if k == 20:  # of the seven alike all are here
            assert sum(r[2] == 1 for r in want) == 16
        assert run(spark, rows, k, 2) == want
