"""Model operators on planted signals, ranks and order statistics against plain Python."""

import random
from statistics import median

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewater.operators import models, ranking
from tidewater.operators.ranks import attach_position, attach_ranks, order_statistics


def test_position_keeps_any_output_name(spark):
    rows = [(i, i % 3, (i * 7) % 5) for i in range(60)] + [(99, 0, None)]
    df = spark.createDataFrame(rows, "id long, g int, v int")
    for out, size in (("_at", "_n"), ("position", None), ("_o", "_start")):
        got = attach_position(df, "v", "id", ("g",), out, size, ranges=5)
        assert got.columns == ["id", "g", "v", out, *([size] if size else [])]
        for g in range(3):
            want = sorted((v, i) for i, k, v in rows if k == g and v is not None)
            mine = sorted((r[out], r.v, r.id) for r in got.where(f"g = {g}").collect())
            assert mine == [(n + 1, v, i) for n, (v, i) in enumerate(want)]
    # a column of that name is replaced; hashes of 64 bits are ordered exactly
    big = df.select("id", (F.lit(2**62) + F.col("id")).alias("_at"))
    assert [r._at for r in attach_position(big, "_at", "id", (), "_at", ranges=7).orderBy("id").collect()] == list(range(1, 62))


@pytest.mark.parametrize("descending", [False, True])
def test_ranks_of_several_columns(spark, descending):
    rng = random.Random(1)
    rows = [(i, rng.choice("ab") if i % 9 else None, rng.randrange(8), None if i % 5 == 0 else 2**60 + rng.randrange(4)) for i in range(150)]
    df = spark.createDataFrame(rows, "id long, g string, x int, y long")
    got = {r.id: r for r in attach_ranks(df, {"x_": "x", "y_": "y"}, ("g",), descending, ranges=6).collect()}
    for i, g, *values in rows:
        for name, k, v in zip("xy", (2, 3), values):
            others = [r[k] for r in rows if r[1] == g and r[k] is not None]
            want = (None, None, None) if v is None else (1 + sum((o > v) if descending else (o < v) for o in others), others.count(v), len(others))
            assert tuple(got[i][f"{name}_{p}"] for p in ("rank", "ties", "n")) == want


def test_order_statistics(spark):
    rng = random.Random(2)
    rows = [(rng.choice("ab"), rng.choice([1.5, 2.0, rng.gauss(0, 5)]), None if rng.random() < 0.3 else float(rng.randrange(6)), None) for _ in range(201)]
    df = spark.createDataFrame(rows, "g string, x double, y double, z double")
    got = {r.g: r for r in order_statistics(df, {"m": ("x", 0.5), "p9": ("x", 0.9), "q": ("y", 0.5), "none": ("z", 0.5)}, ("g",), ranges=5).collect()}
    for g in "ab":
        x, y = [r[1] for r in rows if r[0] == g], [r[2] for r in rows if r[0] == g and r[2] is not None]
        assert got[g].m == pytest.approx(median(x)) and got[g].p9 == pytest.approx(np.percentile(x, 90)) and got[g].q == pytest.approx(median(y)) and got[g].none is None
    whole = order_statistics(df, {"m": ("x", 0.5)}).collect()
    assert len(whole) == 1 and whole[0].m == pytest.approx(median(r[1] for r in rows))
    assert order_statistics(df.limit(0), {"m": ("x", 0.5)}).first().m is None


def test_no_value_travels_in_arrays(spark):
    df = spark.range(100).withColumn("v", F.rand(1))
    plan = attach_ranks(df, {"r_": "v"})._jdf.queryExecution().executedPlan().toString()
    assert "percentile" not in plan and "collect_list" not in plan and "BroadcastNestedLoop" not in plan


def _planted(spark, n=240):
    rng = random.Random(6)
    rows = []
    for i in range(n):
        a, b = rng.gauss(0, 1), rng.gauss(0, 1)
        rows.append((i, "low" if i % 2 else "high", "s1", a, b, None if i % 4 else rng.gauss(0, 1), 1000.0 * float(np.exp(0.8 * a + 0.05 * rng.gauss(0, 1))), 50.0))
    return spark.createDataFrame(rows, "task_id long, tier string, combination string, a double, b double, c double, tpch_geo_mean_ms double, tpch_cache_hit_ratio double")


def test_ranker_finds_a_planted_order(spark):
    rows = _planted(spark).withColumn("score", -F.log("tpch_geo_mean_ms"))
    ranked = models.ranker(rows, "score", ["a", "b", "c"])
    assert ranking.rmse_spearman(ranked, "score", "rank_score").first().spearman_rho > 0.9
    pairs = models.bounded_pairs(rows, ["score"], ("tier",), (1, 3, 120))
    assert [tuple(r) for r in pairs.groupBy("tier", "offset").count().orderBy("tier", "offset").collect()] == [(t, o, 120) for t in ("high", "low") for o in (1, 3)]
    same = models.ranker(rows.withColumn("score", F.lit(1.0)), "score", ["a"]).select("rank_score").distinct().collect()
    assert [r[0] for r in same] == [0.0]


def test_stack_equals_a_plain_solve(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(90, 2))
    y = 3 + x @ [2.0, -1.0] + 0.1 * rng.normal(size=90)
    actual = spark.createDataFrame([(i, float(v)) for i, v in enumerate(y)], "task_id long, y double")
    oofs = {n: spark.createDataFrame([(i, float(v)) for i, v in enumerate(x[:, k])], "task_id long, predicted double") for k, n in enumerate("pq")}
    got = models.stack(oofs, actual, "y", alpha=2.0)
    found = {r.task_id: r for r in got.collect()}
    folds = np.array([found[i].fold for i in range(90)])
    for k in set(folds):
        rest = folds != k
        centre = x[rest].mean(axis=0)
        z = x[rest] - centre
        w = np.linalg.solve(z.T @ z + 2.0 * np.eye(2), z.T @ (y[rest] - y[rest].mean()))
        want = y[rest].mean() + (x[folds == k] - centre) @ w
        assert np.allclose([found[i].stacked for i in np.flatnonzero(folds == k)], want)
    metrics = {r.fold: r for r in models.fold_metrics(got, "y", "stacked").collect()}
    assert sorted(metrics) == [-1, 0, 1, 2, 3, 4] and metrics[-1].spearman_rho > 0.9 and metrics[-1].n == 90


def test_learning_curve_and_importance_see_the_signal(spark):
    rows = _planted(spark)
    curve = {r.train_size: r for r in models.learning_curve(rows, ["a", "b"], (20, 100, None), 3, maxIter=4).collect()}
    assert {k: r.draws for k, r in curve.items()} == {20: 3, 100: 3, -1: 1} and curve[-1].rho_mean > 0.8 and curve[-1].rmse_mean < curve[20].rmse_mean
    found = {r.feature: r for r in models.importance(rows, ["a", "b", "c"], maxIter=4).collect()}
    assert found["a"].rho_loss > 0.5 and abs(found["b"].rho_loss) < 0.2
    assert sum(r.share_pct for r in models.stage_importance(models.importance(rows, ["a", "b"], maxIter=2)).collect()) == pytest.approx(100, abs=0.05)


def test_search_climbs_its_rungs(spark):
    rows = _planted(spark, 120)
    found = models.search(rows, ["a", "b"], trials=6, rungs=((1 / 200, 1, 3), (1 / 100, 2, 1)), parallelism=4)
    lines = found.collect()
    assert [(r.rung, r.trial) for r in lines if r.rung == 0] == [(0, i) for i in range(7)] and len(lines) == 11
    for rung, kept in ((0, 3), (1, 1)):
        judged = sorted((r.rmse, r.trial) for r in lines if r.rung == rung and r.trial)
        assert sorted(r.trial for r in lines if r.rung == rung and r.trial and r.goes_on) == sorted(i for _, i in judged[:kept])
    assert all(r.rounds == max(1, round(int(r.setting["maxIter"]) / (200, 100)[r.rung])) and r.folds == r.rung + 1 for r in lines)
    gain = models.search_gain(found).first()
    last = {r.trial: r.rmse for r in lines if r.rung == 1}
    assert gain.base_rmse == last[0] and gain.best_rmse == min(last.values()) and gain.gain_pct >= 0
    again = models.search(rows, ["a", "b"], trials=6, rungs=((1 / 200, 1, 3),), parallelism=2).collect()
    assert [(r.trial, r.setting) for r in again] == [(r.trial, r.setting) for r in lines if r.rung == 0]
    assert models.search(rows.limit(0), ["a"], trials=2).count() == 0


def test_listed_values_are_encoded_once(spark):
    from tidewater.functions import values as V
    from tidewater.plans import workload
    from tidewater.sources import workload_views

    t = workload_views.tables(spark, "/root/testdata/sf0.001")
    fast = workload._encoded(t)
    by_row = t.tasks.select("task_id", F.expr(workload.CONFIG).alias("c")).select("task_id", *[V.encode(p, F.try_element_at("c", F.lit(p))).alias(f"cfg_{p}") for p in workload.SET_PARAMS])
    assert sorted(map(str, fast.collect())) == sorted(map(str, by_row.collect()))
    # a task's text is neither cut nor parsed
    plan = fast._jdf.queryExecution().optimizedPlan().toString().lower()
    assert not any(word in plan for word in ("regexp", "rlike", "split", "try_cast"))
    odd = spark.createDataFrame([(x,) for x in ("on", " TRUE ", "off", "yes", "none", "1e3", " 2 ", "inf", "-Infinity", "NaN", "nano", "0x1p3", "", "e", None)], "x string")
    plain = F.lower(F.trim("x")).try_cast("double")
    want = F.when(F.col("x").isNull(), F.lit(None).cast("double")).when(plain.isNotNull(), plain).when(F.lower(F.trim("x")).isin("on", "true"), 1.0).otherwise(0.0)
    for r in odd.select(V.switch("x").alias("a"), want.alias("b"), V.number("x").alias("c"), F.col("x").try_cast("double").alias("d")).collect():
        assert str(r.a) == str(r.b) and str(r.c) == str(r.d)


def test_fits_read_settled_inputs(spark):
    rows = _planted(spark).coalesce(1)
    assert models.spread(rows).rdd.getNumPartitions() > 1
    oofs = models.out_of_folds(models.spread(rows), {n: ("geo_mean_tpch", c) for n, c in (("ab", ["a", "b"]), ("a", ["a"]))}, maxIter=2)
    for found in oofs.values():
        assert found.count() == found.select("task_id").distinct().count() == 240
        # what reads the predictions doesn't run the models again
        assert "UDF" not in found._jdf.queryExecution().optimizedPlan().toString()
    columns = ["a", "b", "c"]
    ready = models.prepare(rows, columns).withColumn("_y", F.log("tpch_geo_mean_ms"))
    by_pipeline = models.specialist(columns, maxIter=2).fit(ready).transform(ready).select("task_id", "_p").orderBy("task_id").collect()
    settled = models.fit_specialist(ready, columns, maxIter=2).transform(ready).select("task_id", "_p").orderBy("task_id").collect()
    assert len(settled) == 240 and np.corrcoef([r._p for r in settled], [r._p for r in by_pipeline])[0, 1] > 0.99


def test_recorded_queries_give_the_same_as_all(spark):
    from tidewater.operators import features

    summary = {"exec_ms_per_query": {"q1": 5.25, "q17": 3.0, "q99": None, "x": 1.0}, "failure_reason_per_query": {"q1": "ok", "q2": "ok", "q99": "timeout"}}
    listed = {"queries": [{"id": 3, "exec_ms": 7.0, "failure_reason": "timeout"}, {"id": 3, "exec_ms": 8.0, "failure_reason": "ok"}, {"id": 95, "exec_ms": 1.0, "failure_reason": "ok"}, {"id": None}]}
    docs = [(1, "done", {"summary": summary}, {"summary": summary}), (2, "abandoned", listed, listed), (3, None, None, {}), (4, "running", listed, None), (2, "abandoned", None, listed)]
    rows = [{"task_id": i, "status": s, "tpc_h": h, "tpc_ds": d} for i, s, h, d in docs]
    df = spark.createDataFrame(rows, features.DOCUMENT_SCHEMA)
    every = features.query_rows(df).collect()
    assert len(every) == 4 * 118
    totals = {(r.suite, r.id): r for r in features.query_totals(df).collect()}
    assert len(totals) == 118
    for (suite, i), r in totals.items():
        mine = [e for e in every if (e.suite, e.id) == (suite, i)]
        assert (r.tasks, r.total_ms, r.least_ms, r.timeouts) == (4, sum(e.ms for e in mine), min(e.ms for e in mine), sum(e.timed_out for e in mine))
    by_hand = {("tpc_h", 1): (5.25, 0), ("tpc_h", 2): (900000.0, 0), ("tpc_ds", 99): (900000.0, 1), ("tpc_h", 4): (900000.0, 1)}
    assert {k: next((e.ms, e.timed_out) for e in every if e.task_id == 1 and (e.suite, e.id) == k) for k in by_hand} == by_hand
    for r in features.imputed_counts(df).collect():
        mine = [e for e in every if (e.task_id, e.suite) == (r.task_id, r.suite)]
        assert (r.imputed, r.queries) == (sum(e.timed_out for e in mine), len(mine))
    # listed queries: the last entry counts, any good one clears the flag
    assert [(e.ms, e.timed_out) for e in every if (e.task_id, e.suite, e.id) == (2, "tpc_h", 3)][0] == (8.0, 0)
    assert features.query_totals(df.limit(0)).count() == 0
    # what is counted is what documents mention, not a row for every query of every task
    assert "transform([1," not in features.query_totals(df)._jdf.queryExecution().optimizedPlan().toString()


def test_equal_inputs_are_merged_without_loss(spark):
    rng = random.Random(9)
    rows = [(i, float(i % 3), None if i % 2 else float(i % 7 > 3), float(np.exp(i % 3 + (i % 7 > 3) + 0.3 * rng.gauss(0, 1)))) for i in range(12_000)]
    df = spark.createDataFrame(rows, "task_id long, a double, b double, tpch_geo_mean_ms double")
    # no draws: merged rows must grow the very trees of the rows they stand for
    settings = {"maxIter": 3, "subsamplingRate": 1.0, "featureSubsetStrategy": "all", "minInstancesPerNode": 1}
    ready = models.prepare(df, ["a", "b"]).withColumn("_y", F.log("tpch_geo_mean_ms"))
    plain = {r.task_id: r._p for r in models.specialist(["a", "b"], **settings).fit(ready).transform(ready).collect()}
    merged = {r.task_id: r._p for r in models.fit_specialist(ready, ["a", "b"], **settings).transform(ready).collect()}
    assert len(merged) == 12_000 and all(abs(merged[i] - plain[i]) < 1e-9 for i in plain)
    cells = models.merge(df, ["a", "b"], {"t": (F.log("tpch_geo_mean_ms"), F.col("tpch_geo_mean_ms"))})
    assert cells.count() <= 9 * models.FOLDS * models.PIECES and cells.rdd.getNumPartitions() == 1
    sums = cells.agg(F.sum("_n_t"), F.sum(F.col("_n_t") * F.col("_y_t")), F.sum(F.col("_within_t") + F.col("_n_t") * F.col("_actual_t") ** 2)).first()
    y = np.array([r[3] for r in rows])
    assert sums[0] == 12_000 and np.allclose(sums[1:], [np.log(y).sum(), (y * y).sum()])
    # medians are those of the rows outside the fold
    fold = {r.task_id: r.f for r in df.select("task_id", models.fold().alias("f")).collect()}
    for k, middle in models.medians(cells, ["a", "b"], "_n_t", [0, 3]).items():
        rest = [r for r in rows if fold[r[0]] != k]
        assert tuple(middle.first()) == (median(r[1] for r in rest), median(r[2] for r in rest if r[2] is not None))


def test_counted_correlation_equals_that_of_rows(spark):
    rng = random.Random(4)
    rows = [(g, rng.gauss(0, 1) // 0.2, rng.gauss(0, 1)) for g in range(3) for _ in range(150)]
    df = spark.createDataFrame(rows, "g int, p double, y double")
    want = {r.g: r.spearman_rho for r in ranking.rmse_spearman(df, "y", "p", ("g",)).collect()}
    ranked = ranking.percent_rank(df, "y", "_r", ("g",)).withColumn("_r", F.col("_r") - F.lit(151 / 300))
    counted = ranked.groupBy("g", "p").agg(F.count("*").alias("n"), F.sum("_r").alias("s"))
    total = ranked.where("g = 0").agg(F.sum(F.col("_r") * F.col("_r")).alias("_squares"))
    assert {r.g: r.spearman_rho for r in ranking.counted_correlation(counted, "p", "g", "n", "s", total).collect()} == want


def test_pairs_meet_without_a_broadcast(spark):
    rows = _planted(spark).withColumn("score", -F.log("tpch_geo_mean_ms"))
    # settled rows of few values are small in files: their size must not make the driver hold them
    plan = models.bounded_pairs(rows, ["score"], ("tier",))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    actual = rows.select("task_id", "score")
    assert "Broadcast" not in models.stack({"p": actual.withColumnRenamed("score", "predicted")}, actual, "score")._jdf.queryExecution().executedPlan().toString()


def test_weightings_share_the_ranks_of_the_real_score(spark):
    rng = random.Random(8)
    rows = [(i, rng.choice(["low", "high"]), "s1", float(rng.randrange(60)), float(rng.randrange(20)), None if i % 31 == 0 else float(rng.randrange(200)), float(rng.randrange(30))) for i in range(400)]
    df = spark.createDataFrame(rows, "task_id long, tier string, combination string, pred_geo_tpch double, pred_cache_tpch double, tpch_geo_mean_ms double, tpch_cache_hit_ratio double")
    got = {r.w_geo: r.spearman_rho for r in ranking.weight_search(df).collect()}
    known = df.where("tpch_geo_mean_ms is not null").withColumn("_g", ranking._better("pred_geo_tpch", "minimize"))
    both = ranking.percent_ranks(ranking.composite_score(known, "real"), {"_a": "_g", "_b": "pred_cache_tpch"}, ranking.GROUP)
    for w in (0.4, 0.65, 0.95):
        tried = both.withColumn("_p", F.lit(w) * F.col("_a") + F.lit(round(1 - w, 2)) * F.col("_b"))
        assert got[w] == ranking.rmse_spearman(tried, "real", "_p").first().spearman_rho
    assert len(got) == 12 and [r.spearman_rho for r in ranking.weight_search(df.limit(0)).collect()] == [None] * 12


def test_ranked_ratios_read_the_sales_once(spark):
    from tidewater import registry

    plan = registry.queries()["ds_q49"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "lineitem.parquet" not in plan and "settled-" in plan


def test_curve_places_few_narrow_rows(spark, monkeypatch):
    rng = random.Random(11)
    rows = [(i, float(i % 3), None if i % 2 else float(i % 7 > 3), float(np.exp(i % 3 + 0.3 * rng.gauss(0, 1)))) for i in range(12_000)]
    df = spark.createDataFrame(rows, "task_id long, a double, b double, tpch_geo_mean_ms double")
    placed, place = [], models.attach_position

    def spy(df, *args, **kwargs):
        placed.append(df)
        return place(df, *args, **kwargs)

    monkeypatch.setattr(models, "attach_position", spy)
    curve = {r.train_size: r for r in models.learning_curve(df, ["a", "b"], (20, 60, None), 3, maxIter=4).collect()}
    assert {k: r.draws for k, r in curve.items()} == {20: 3, 60: 3, -1: 1} and curve[-1].rmse_mean < curve[20].rmse_mean and curve[-1].rho_mean > 0.8
    (near,) = placed
    assert not {"a", "b"} & set(near.columns)
    pool = df.where(models.fold("task_id", 5) != 0)
    assert near.count() < pool.count() / 10
    for draw in range(3):
        least = [r[0] for r in pool.select("task_id").orderBy(F.xxhash64(F.lit(draw), "task_id")).limit(60).collect()]
        mine = [r[0] for r in near.where(f"_draw = {draw}").orderBy("_h").limit(60).select("task_id").collect()]
        assert mine == least


def test_trees_of_one_task_equal_mllib(spark):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    from tidewater.operators import boosting

    rng = np.random.default_rng(5)
    x = [rng.normal(size=900), rng.integers(0, 4, 900).astype(float), rng.integers(0, 60, 900) / 7, np.ones(900)]
    y, n = x[0] + np.sin(x[1]) + 0.1 * x[2] + 0.3 * rng.normal(size=900), rng.integers(1, 4, 900).astype(float)
    rows = spark.createDataFrame([(*map(float, r), float(a), float(b)) for r, a, b in zip(np.column_stack(x), y, n)], "a double, b double, c double, d double, y double, n double").coalesce(1)
    rows = VectorAssembler(inputCols=list("abcd"), outputCol="_x").transform(rows)
    tree = GBTRegressor(featuresCol="_x", labelCol="y", predictionCol="_p", weightCol="n", maxIter=5, maxDepth=5, minInfoGain=0.001, stepSize=0.1)
    want = [r._p for r in tree.fit(rows).transform(rows).collect()]
    settings = {"maxDepth": 5, "stepSize": 0.1, "subsamplingRate": 1.0, "featureSubsetStrategy": "all", "minInstancesPerNode": 1, "minInfoGain": 0.001, "seed": 1}
    assert np.allclose(boosting.grow(x, y, n, 5, **settings).predict(x), want, atol=1e-9)
    # a draw doesn't hang on the order of rows
    back = boosting.grow([c[::-1] for c in x], y[::-1], n[::-1], 5, **{**settings, "subsamplingRate": 0.7, "featureSubsetStrategy": "0.6"})
    assert np.allclose(back.predict(x), boosting.grow(x, y, n, 5, **{**settings, "subsamplingRate": 0.7, "featureSubsetStrategy": "0.6"}).predict(x))
    assert [boosting.median(np.array([3.0, np.nan, 1.0, 2.0]), np.array(w)) for w in ([1.0, 9.0, 1.0, 1.0], [2.0, 1.0, 1.0, 1.0], [0.0, 1.0, 1.0, 3.0])] == [2.0, 2.5, 2.0]


@pytest.mark.parametrize("name, work", [
    ("ml_07_learning_curve", "learning_curve"),
    ("rk_05_out_of_fold", "out_of_fold"),
    ("ml_08_predict", "fit_all"),
    ("ml_05_stage_importance", "importance"),
    ("ml_05_importance", "importance"),
    ("ml_04_stack_metrics", "out_of_folds"),
    ("ml_04_stack", "out_of_folds"),
    ("ml_03_search", "search"),
    ("ml_03_rungs", "search"),
    ("ml_02_ablation", "ablation"),
    ("ml_01_target_metrics", "target_metrics"),
])
def test_entries_run_all_published_rounds(spark, monkeypatch, name, work):
    from tidewater import registry

    class Seen(Exception):
        pass

    def spy(*args, **settings):
        raise Seen(settings)

    monkeypatch.setattr(models, work, spy)
    with pytest.raises(Seen) as found:
        registry.queries()[name](spark, "/root/testdata/sf0.001")
    (settings,) = found.value.args
    assert not set(models.TREES) & set(settings) and settings.get("rungs", models.RUNGS) == models.RUNGS and settings.get("trials", 80) == 80


def _recurring(spark, n=6_000):
    rng = random.Random(12)
    rows = [(i, float(i % 3), None if i % 2 else float(i % 7 > 3), float(np.exp(i % 3 + (i % 7 > 3) + 0.3 * rng.gauss(0, 1)))) for i in range(n)]
    return spark.createDataFrame(rows, "task_id long, a double, b double, tpch_geo_mean_ms double")


def test_folds_of_one_task_equal_mllib(spark, monkeypatch):
    ready, settings = models.spread(_recurring(spark)), {"maxIter": 3, "subsamplingRate": 1.0, "featureSubsetStrategy": "all", "minInstancesPerNode": 1}
    found = []
    for most in (models.LOCAL_ROWS, 0):
        monkeypatch.setattr(models, "LOCAL_ROWS", most)
        (oof,) = models.out_of_folds(ready, {"x": ("geo_mean_tpch", ["a", "b"])}, **settings).values()
        found.append({r.task_id: (r.fold, r.predicted) for r in oof.collect()})
    here, there = found
    assert len(here) == len(there) == 6_000 and all(here[i][0] == there[i][0] and here[i][1] == pytest.approx(there[i][1], rel=1e-9) for i in here)


def test_search_of_one_task_equals_mllib(spark, monkeypatch):
    def settings(trials, rows, seed):
        plain = {**models.TREES, "maxIter": 4, "subsamplingRate": 1.0, "featureSubsetStrategy": "all", "minInstancesPerNode": 1}
        return [{**plain, "maxDepth": 1 + i, "stepSize": 0.1 * (i + 1)} for i in range(trials + 1)]

    monkeypatch.setattr(models, "draw_settings", settings)
    rows, found = _recurring(spark), []
    for most in (models.LOCAL_ROWS, 0):
        monkeypatch.setattr(models, "LOCAL_ROWS", most)
        found.append({(r.rung, r.trial): (r.rmse, r.goes_on, r.rounds) for r in models.search(rows, ["a", "b"], trials=2, rungs=((0.5, 1, 1), (1.0, 2, 1))).collect()})
    here, there = found
    assert set(here) == set(there) and len(here) == 5 and all(here[k][1:] == there[k][1:] and here[k][0] == pytest.approx(there[k][0], rel=1e-9) for k in here)
