from tidewater.llm import toxicity


def test_held_out_scores_and_calibration(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    found = toxicity.score(docs.join(labels.select("doc_id", "toxic"), "doc_id"), toxicity.fit(docs, labels)).withColumn("out", toxicity.held_out(docs["doc_id"])).where("out").select("toxic", "score", "predicted").toPandas()
    pos, neg = found[found.toxic == 1].score, found[found.toxic == 0].score
    assert sum((neg < p).mean() + (neg == p).mean() / 2 for p in pos) / len(pos) > 0.93
    hit = found[found.predicted == 1]
    assert (hit.toxic == 1).mean() > 0.97 and len(hit) > 0.7 * len(pos)


def test_identity_terms_carry_no_score(spark, frame):
    rows, labels = [], []
    for i in range(400):
        toxic = i % 4 == 0
        # most toxic texts name a group, few others do: an unfair sample
        group = "muslims" if i % (5 if not toxic else 2) == 0 else "people"
        rows.append((i, f"the {group} are {'scum' if toxic else 'kind'} w{i} in town"))
        labels.append((i, int(toxic)))
    labels = spark.createDataFrame(labels, "doc_id long, toxic int")
    plain = toxicity.fit(frame(*rows), labels, fairness=0.0)
    fair = toxicity.fit(frame(*rows), labels)
    assert abs(fair.weights.get("muslims", 0.0)) < 0.05
    assert abs(fair.score("the muslims are in town") - fair.score("the jews are in town")) < 0.01
    assert fair.score("the people are scum") > 0.5 > fair.score("the muslims are kind")
    assert plain.score("the muslims are scum") > 0.5


def test_nulls_empties_and_clashing_columns(spark, frame):
    docs = frame((1, "you scum"), (2, None), (None, ""), (2, None), extra="score")
    labels = spark.createDataFrame([(1, 1), (2, None), (None, 1), (1, 1)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    assert toxicity.drop_toxic(docs, model).columns == docs.columns
    assert toxicity.drop_toxic(docs, toxicity.Model(-3.0, {"scum": 6.0})).count() == 3
    assert {r.predicted for r in toxicity.score(docs.drop("score"), model).collect()} == {0}
    empty = labels.limit(0)
    assert toxicity.fit(docs.limit(0), empty).score("anything") < 0.5
    assert toxicity.score(docs.limit(0), model).count() == 0
