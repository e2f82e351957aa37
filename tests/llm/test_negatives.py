import random

import numpy as np
import pytest
from check_oracle import compare, connect

from tidewater.llm import negatives, queries

SCHEMA = "vec_id long, label int, embedding array<float>"


def slow(rows, every=50):
    clean = []
    for i, label, v in rows:
        if i is not None and label is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            clean.append((i, (label + 1) % 10 if i % 7 == 0 else label, [int(np.floor(256 * np.float64(np.float32(x)))) for x in v]))
    out = []
    for a, la, va in clean:
        if a % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(va, v)), i, label) for i, label, v in clean if i != a)
        for s, p, _ in [x for x in scored if x[2] == la][:5]:
            fit = [x for x in scored if x[2] != la and 50 * -s <= 100 * -x[0] <= 95 * -s][:3]
            out += [(a, p, n + 1, i, -s, -t) for n, (t, i, _) in enumerate(fit)]
    return sorted(out)


def run(spark, rows, every=50, **more):
    table = negatives.labelled(spark.createDataFrame(rows, SCHEMA))
    return sorted(tuple(r) for r in negatives.hard_negatives(table, table.where(f"vec_id % {every} = 0"), **more).collect())


def test_matches_check_sql(spark):
    folder = "/root/testdata/sf0.001"
    ok, why, n = compare(spark, connect(folder), queries.op12_hard_negatives, queries.ORACLE_SQL["op12_hard_negatives"], folder)
    assert ok and n > 10, why


@pytest.mark.parametrize("scale", [0.3, 40.0, 3e5])
def test_against_brute_force(spark, scale):
    rng = random.Random(4)
    rows = [(i, 3 if rng.random() < 0.4 else rng.randrange(10), [rng.gauss(0.2 * scale, scale) for _ in range(9)]) for i in range(260)]
    rows += [(i + 260, rows[i][1], rows[i - i % 3][2]) for i in range(40)]  # ties
    want = slow(rows, 10)
    assert len(want) > 50 and run(spark, rows, 10, block=70) == want


@pytest.mark.parametrize("size", [3, 150, 20_000, 10**6, 10**8 - 1])
def test_fields_unpack_exactly(size):
    rng = np.random.default_rng(size)
    vectors, anchors = rng.integers(-size, size + 1, (37, 24)), rng.integers(-size // 3 - 1, size // 3 + 2, (5, 24))
    vectors[0], anchors[0] = size, -(size // 3) - 1
    packed = negatives.Packed(vectors, np.abs(anchors).max())
    assert packed.fields > 1
    assert (packed.scores(anchors) == anchors.astype(object) @ vectors.T.astype(object)).all()


def test_nulls_repeats_and_few_rows(spark):
    rows = [(0, 1, [1.0, 2.0]), (1, 1, [2.0, 2.0]), (1, 1, [2.0, 2.0]), (2, 2, [1.0]), (3, 2, None), (4, None, [1.0, 1.0]), (5, 2, [float("nan"), 1.0]), (6, 2, [None, 1.0]), (None, 2, [1.0, 1.0]),
            (8, 2, [2.0, 0.5]), (8, 2, [2.0, 0.5]), (10, 1, [0.0, 0.0]), (12, 4, []), (50, 2, [float("inf")]), (100, 9, [-1.0, 0.0])]
    assert run(spark, rows) == slow(rows) != []
    twice = rows + [(0, 1, [1.0, 2.0])]
    assert run(spark, twice) == slow(twice)
    assert run(spark, []) == []
    assert run(spark, [(0, 1, [1.0])]) == []
    extra = spark.createDataFrame([(0, 1, [1.0], "a"), (1, 1, [1.0], "b")], SCHEMA + ", number string")
    assert negatives.hard_negatives(negatives.labelled(extra), negatives.labelled(extra)).count() == 0


def test_nulls_and_repeats_with_a_negative_on_the_edge(spark):
    # vec_id 0 is divisible by 7, so its label 0 counts as 1; a negative has just half of its positive's score
    rows = [(0, 0, [1.0, 2.0]), (1, 1, [2.0, 2.0]), (1, 1, [2.0, 2.0]), (2, 2, [1.0]), (3, 2, None), (4, None, [1.0, 1.0]), (5, 2, [float("nan"), 1.0]), (6, 2, [None, 1.0]), (None, 2, [1.0, 1.0]),
            (8, 2, [2.0, 0.5]), (8, 2, [2.0, 0.5]), (10, 1, [0.0, 0.0]), (12, 4, []), (50, 2, [float("inf")]), (100, 9, [-1.0, 0.0])]
    assert run(spark, rows) == slow(rows) != []
