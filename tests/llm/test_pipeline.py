import corpus_pipeline

from tidewater.llm import mixing
from tidewater.llm.common import settle


def test_stages_end_to_end(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = settle(stage(spark, docs, folder), f"test-{name}")
        assert docs.columns == columns
    by_stages = {tuple(r) for r in corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect()}
    assert 0 < docs.count() <= 3 * before
    assert {tuple(r) for r in corpus_pipeline.run(spark, folder).collect()} == by_stages


def test_empty_table_passes_through(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = settle(stage(spark, docs, folder), "test-empty")
    assert docs.count() == 0


def test_training_order_reaches_the_sequences(spark, prose):
    mixed = mixing.mixed_documents(prose)
    want = [r.doc_id for r in mixed.collect()]
    assert len(set(want)) < len(want)  # some are taken more than once
    stored = settle(mixed, "test-mixed")
    got = corpus_pipeline.packed(spark, stored, "/root/testdata/sf0.001").collect()
    assert [r.doc_id for r in sorted(got, key=lambda r: r.position) if r.start == 0] == want
    assert sorted(r.position for r in got if r.start == 0) == list(range(len(want)))
    for length in {r.length for r in got}:
        bucket = sorted((r for r in got if r.length == length), key=lambda r: r.sequence_id)
        assert [(r.position, r.start) for r in bucket] == sorted((r.position, r.start) for r in bucket)
        assert [r.sequence_id for r in bucket] == [16 * i + length.bit_length() - 1 for i in range(len(bucket))]
