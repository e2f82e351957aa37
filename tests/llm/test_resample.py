import re

import numpy as np

from tidewater.llm import resample


def test_grams_in_arrays_agree_with_tokens():
    grams = resample.NGrams(1 << 20)
    for text in ("Ab cd, ab  cd!! ééx", "", " \n", "a", "a b", "x" * 3000 + " y"):
        tokens = re.findall(rb"[0-9A-Za-z\x80-\xff]+|[^0-9A-Za-z\x80-\xff \t-\r]+", text.encode())
        found = grams.of(text.encode())
        assert len(found) == len(tokens) + max(0, len(tokens) - 1)
        # a token hashes alike wherever it stands
        assert found[: len(tokens)].tolist() == [int(grams.of(t)[0]) for t in tokens]


def test_kth_largest_is_exact(spark):
    rng = np.random.default_rng(2)
    values = np.concatenate([rng.normal(0, 1, 4000), np.full(500, 0.25), [1e9, -1e9]])
    rows = spark.createDataFrame([(float(v),) for v in values], "v double")
    order = sorted(values, reverse=True)
    for k in (1, 17, 2000, 4502):
        assert resample.kth_largest(rows, "v", k, fetch=50) == order[k - 1]
    assert resample.kth_largest(rows, "v", 5000) is None and resample.kth_largest(rows.limit(0), "v", 1) is None


def test_held_out_labels_and_share(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    found = resample.resample(docs, labels)
    assert found.where("selected").count() == round(labels.agg({"quality": "avg"}).first()[0] * docs.count())
    rows = found.join(labels, "doc_id").where(resample.held_out(labels["doc_id"])).select("quality", "log_weight", "selected").toPandas()
    pos, neg = rows[rows.quality == 1], rows[rows.quality == 0]
    assert np.mean([(neg.log_weight < x).mean() for x in pos.log_weight]) > 0.97
    assert pos.selected.mean() > 0.97 and neg.selected.mean() < 0.15


def test_nulls_empties_and_repeated_rows(spark, frame):
    docs = frame((1, "good words here"), (1, "good words here"), (None, None), (2, ""), extra="selected")
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 1), (2, None)], "doc_id long, quality int")
    got = resample.resample(docs, labels, share=1.0).collect()
    assert len(got) == 4 and all(r.selected for r in got)
    assert not any(r.selected for r in resample.resample(docs, labels, share=0.0).collect())
    assert resample.resample(docs, labels.limit(0)).where("log_weight = 0").count() == 4
    assert resample.resample(docs.limit(0), labels).count() == 0
