import pytest
from check_oracle import compare, connect
from pyspark.sql import functions as F

from tidewater.llm import mixing, queries


@pytest.mark.parametrize("name", ["op2_topk", "op5_mixing", "op10_lines"])
def test_check_sql(spark, name):
    folder = "/root/testdata/sf0.001"
    ok, why, _ = compare(spark, connect(folder), queries.QUERIES[name], queries.ORACLE_SQL[name], folder)
    assert ok, why


def test_targets_stop_at_three_times_the_source(spark):
    rows = spark.createDataFrame([("a", 1000), ("b", 10), ("c", 10), (None, 200), ("d", 0)], "source string, size long")
    got = {r.source: r.target for r in mixing.source_targets(rows).collect()}
    assert got["b"] == 30 and got["c"] == 30 and got["d"] == 0
    # a has weight 1 and the missing source, last in order, weight 2; 2 * (1220 - 60) / 3 exceeds three times 200
    assert got[None] == 600 and got["a"] == pytest.approx(1220 - 60 - 600)


def test_taken_sums_to_the_target_and_reruns_agree(spark, prose):
    first, second = ([tuple(r) for r in mixing.mix(prose).collect()] for _ in range(2))
    assert first == second
    sums = mixing.mix(prose).groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("g"), F.max(F.col("taken") - 3 * F.col("size")).alias("over")).collect()
    assert all(abs(r.t - r.g) <= 0.5 and r.over <= 0 for r in sums)


def test_mixed_texts_have_the_taken_words(spark, prose):
    plan = {r.doc_id: r.taken for r in mixing.mix(prose).collect()}
    out = mixing.mixed_documents(prose)
    assert out.columns == prose.columns
    words = {r.doc_id: r.w for r in out.groupBy("doc_id").agg(F.sum(mixing.words_in(F.col("text"))).alias("w")).collect()}
    assert words == {k: v for k, v in plan.items() if v}


def test_nulls_empties_and_repeated_rows(frame):
    docs = frame((1, "a b c", "x"), (1, "a b c", "x"), (None, "d e", None), (2, None, "x"), (3, "", None), extra="target")
    got = sorted((r.doc_id or 0, r.size, r.source_size) for r in mixing.mix(docs).collect())
    assert got == [(0, 2, 2), (1, 3, 6), (1, 3, 6), (2, 0, 6), (3, 0, 2)]
    assert sum(len(r.text.split()) for r in mixing.mixed_documents(docs).collect()) == sum(r.taken for r in mixing.mix(docs).collect())
    assert mixing.mix(docs.limit(0)).count() == 0 and mixing.mixed_documents(docs.limit(0)).count() == 0


def test_columns_named_as_the_plan_names_its_own(frame):
    docs = frame((1, "a b c"), (2, "d e"), extra="before").withColumn("source_size", F.lit(7)).withColumn("size", F.lit(1)).withColumn("position", F.lit(0.5))
    got = mixing.mixed_documents(docs)
    assert got.columns == docs.columns
    assert {(r.source_size, r.size, r.position) for r in got.collect()} == {(7, 1, 0.5)}
