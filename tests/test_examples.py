"""Worked examples with hand-computed results."""

import pytest
from pyspark.sql import functions as F

from tidewater.functions import values as V
from tidewater.functions.semantics import idiv, not_in, round_to_int
from tidewater.operators import configspace, costs, features, querylog, ranking, telemetry
from tidewater.operators.ranks import attach_rank


def _log(spark, rows):
    cols = "task_id long, suite string, id int, failure_reason string, exec_ms double, shared_hit long, shared_read long, temp_written_blocks long, temp_read_blocks long, workers_launched int"
    return spark.createDataFrame(rows, cols).withColumn("success", F.col("failure_reason") == "ok")


def test_suite_times(spark):
    rows = [(1, "tpc_h", i, r, ms, 0, 0, None, None, None) for i, (r, ms) in enumerate([("ok", 100.0), ("ok", 200.0), ("ok", 400.0), ("timeout", 900000.0), ("technical", None)], 1)]
    s = querylog.suite_summary(_log(spark, rows)).first()
    assert (s.total_exec_ms, s.max_exec_ms, s.min_exec_ms, s.median_exec_ms, s.p95_exec_ms) == (900700.0, 900000.0, 100.0, 300.0, 900000.0)
    assert s.stddev_exec_ms == pytest.approx(449883.351, abs=1e-3) and s.geo_mean_exec_ms == pytest.approx(1638.073, abs=1e-3)
    assert (s.n_queries_successful, s.n_queries_timed_out, s.n_queries_technical) == (3, 1, 1)


def test_buffers(spark):
    rows = [(1, "tpc_h", 1, "ok", 1.0, 90, 10, 0, 0, 0), (1, "tpc_h", 2, "ok", 1.0, 50, 50, 5, 0, 2), (1, "tpc_h", 3, "ok", 1.0, 0, 0, None, None, None)]
    s = querylog.suite_summary(_log(spark, rows)).first()
    assert (s.total_shared_hit, s.total_shared_read, s.overall_cache_hit_ratio, s.queries_with_spill) == (140, 60, 70.0, 1)
    assert (s.queries_with_parallelism, s.avg_workers_launched) == (1, 0.67)
    assert spark.sql("select 0 h, 0 r").select(querylog.hit_ratio("h", "r").alias("x")).first().x is None


def test_failure_classes(spark):
    rows = [(None, 0, 5.0), ("killed", 137, None), ("ERROR: canceling STATEMENT due to statement timeout", 1, None), ("connection lost", 1, None)]
    got = querylog.classify(spark.createDataFrame(rows, "error string, exit_code int, exec_ms double")).collect()
    assert [(r.failure_reason, r.exec_ms) for r in got] == [("ok", 5.0), ("oom", 1350000.0), ("timeout", 900000.0), ("technical", None)]


def test_abandoned_document(spark):
    q = {"n_success": 1, "n_failed": 1, "total_ms": None, "summary": None, "queries": [{"id": 1, "exec_ms": 100.0, "failure_reason": "ok"}, {"id": 2, "exec_ms": None, "failure_reason": "technical"}]}
    doc = {"task_id": 1, "tier": "low", "combination": "s1", "status": "abandoned", "duration_s": 1.0, "abandoned_reason": "timeout", "pg_config": {"shared_buffers": "1GB", "jit": "on"}, "tpc_h": q, "tpc_ds": None}
    row = features.feature_rows(spark.createDataFrame([doc], features.DOCUMENT_SCHEMA))
    assert len(row.columns) == 299
    r = row.first()
    assert r.tpch_total_ms == 17100100.0
    assert (r.tpch_q1_ms, r.tpch_q1_timed_out, r.tpch_q2_ms, r.tpch_q2_timed_out, r.tpch_q3_ms, r.tpch_q3_timed_out) == (100.0, 0, 900000.0, 1, 900000.0, 1)
    assert r.tpch_q17_ms is None and r.tpch_q17_timed_out is None and r.tpcds_q95_ms is None
    assert (r.cfg_shared_buffers, r.cfg_jit, r.cfg_work_mem, r.vcpus) == (1024.0, 1.0, None, 2)


def test_summary_flags(spark):
    s = {"n_success": 1, "n_failed": 0, "total_ms": 1.0, "queries": None, "summary": {"geo_mean_exec_ms": 1.0, "overall_cache_hit_ratio": None, "queries_with_spill": 0, "exec_ms_per_query": {"q1": 5.0, "q2": None}, "failure_reason_per_query": {"q1": "ok", "q2": "technical"}}}
    doc = {"task_id": 1, "tier": "x", "combination": "s1", "status": "done", "duration_s": 1.0, "abandoned_reason": None, "pg_config": None, "tpc_h": s, "tpc_ds": None}
    r = features.feature_rows(spark.createDataFrame([doc], features.DOCUMENT_SCHEMA)).first()
    assert (r.tpch_q1_timed_out, r.tpch_q2_timed_out, r.tpch_q3_timed_out, r.tpch_q2_ms, r.vcpus) == (0, 1, 1, 900000.0, None)


def test_values(spark):
    r = spark.sql("select '1GB' a, '512MB' b, '512kB' c, 64 d, 'on' e, 'off' f, 1 g, 'abc' h").select(
        *[V.memory_mb(x).alias(x) for x in "abcd"], *[V.switch(x).alias(x) for x in "efg"], V.number("h").alias("h")
    ).first()
    assert tuple(r) == (1024.0, 512.0, 0.5, 64.0, 1.0, 0.0, 1.0, None)
    z = spark.sql("select 7 a, 2 b, cast(380.00 as decimal(7,2)) / 50 c").select(idiv("a", "b").alias("q"), round_to_int("c").alias("s")).first()
    assert (z.q, z.s) == (3, 8)


def test_percent_rank(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (2.0,), (4.0,), (None,)], "v double")
    got = sorted((r.v, r.p) for r in ranking.percent_rank(df, "v", "p").collect() if r.v)
    assert got == [(1.0, 0.25), (2.0, 0.625), (2.0, 0.625), (4.0, 1.0)]


@pytest.mark.parametrize("descending", [False, True])
def test_rank_equals_window(spark, descending):
    df = spark.range(3000).selectExpr("id", "id % 3 g", "case when id % 3 = 0 then 7.5 else pmod(hash(id), 400) / 3.0 end v")
    df = df.withColumn("v", F.col("v").cast("double"))
    got = {r.id: (r["rank"], r.ties, r.n) for r in attach_rank(df, "v", ("g",), descending=descending, ranges=8).collect()}
    order = "desc" if descending else ""
    want = df.selectExpr("id", f"rank() over (partition by g order by v {order}) r", "count(*) over (partition by g, v) t", "count(*) over (partition by g) n").collect()
    assert all(got[w.id] == (w.r, w.t, w.n) for w in want)


def test_scores(spark):
    df = spark.createDataFrame([(1, 100.0, 10.0), (2, 200.0, 30.0), (3, 400.0, 20.0)], "task_id long, tpch_geo_mean_ms double, tpch_cache_hit_ratio double").selectExpr("*", "'low' tier", "'s1' combination")
    got = {r.task_id: round(r.score, 6) for r in ranking.composite_score(df).collect()}
    assert got == {1: 0.766667, 2: 0.783333, 3: 0.45}
    cand = df.selectExpr("task_id candidate_idx", "tpch_geo_mean_ms pred_geo_tpch", "1.0D pred_geo_tpcds", "tpch_cache_hit_ratio pred_cache_tpch", "0.0D pred_spill_tpcds")
    scored = {r.candidate_idx: r.score for r in ranking.predicted_scores(cand).collect()}
    assert scored == {1: 0.65, 2: 0.675, 3: 0.175}
    with pytest.raises(ValueError):
        ranking.check_request("huge", "s1")


def test_energy_wraps(spark):
    df = spark.createDataFrame([(1, 0.0, 9000000), (1, 4.0, 1000000)], "task_id long, timestamp_s double, rapl_energy_uj long")
    r = telemetry.energy(df, 10000000).first()
    assert (r.rapl_energy_total_j, r.rapl_avg_power_w) == (2.0, 0.5)


def test_rate_across_blocks(spark):
    df = spark.createDataFrame([(1, i, i * 1000.0, i * 1000 * 1048576) for i in range(20)], "task_id long, event_id long, timestamp_s double, b long")
    got = sorted((r.event_id, r.mb) for r in telemetry.counter_rate(df, {"mb": "b"}).collect())
    assert got == [(0, 0.0)] + [(i, 1.0) for i in range(1, 20)]


def test_decode_and_baseline(spark):
    q = F.lit(0.34)
    r = spark.range(1).select(
        configspace.pick(F.array(*[F.lit(x) for x in "abc"]), q).alias("a"), configspace.uniform(1, 4, F.lit(0.5), 3).alias("b"), configspace.randint(1, 4, F.lit(0.5)).alias("c")
    ).first()
    assert tuple(r) == ("b", 2.5, 2)
    got = {x.tier: (x.shared_buffers, x.effective_cache_size, x.work_mem, x.max_parallel_workers, x.max_parallel_workers_per_gather)
           for x in configspace.rule_based(spark.createDataFrame([("low",), ("medium",), ("high",)], "tier string")).collect()}
    assert got == {"low": ("512MB", "1536MB", "5461kB", 8, 2), "medium": ("1024MB", "3072MB", "11915kB", 4, 2), "high": ("1280MB", "3840MB", "14246kB", 6, 3)}


def test_generated_configs(spark):
    slots = spark.range(60).selectExpr("id slot", "split_part('low,medium,high', ',', cast(1 + id % 3 as int)) tier", "'s1_s2' combination")
    lhs = configspace.lhs_quantiles(slots, 7, ["work_mem", "jit"]).collect()
    per = {}
    for r in lhs:
        per.setdefault((r.tier, r.param), []).append(int(r.q * r.n))
    assert all(sorted(v) == list(range(20)) for v in per.values())
    made = configspace.generate(slots, 7, 40).collect()
    assert {r.status for r in made} == {"filled"}
    assert len(made) == 60 and len({(r.tier, tuple(sorted(r.config.items()))) for r in made}) == 60
    again = configspace.generate(slots, 7, 40).collect()
    assert {(r.slot, tuple(sorted(r.config.items()))) for r in made} == {(r.slot, tuple(sorted(r.config.items()))) for r in again}


def test_generation_tells_which_slots_it_could_not_fill(spark):
    slots = spark.range(300).selectExpr("id slot", "'low' tier", "'s3' combination")
    made = configspace.generate(slots, 7).collect()
    held = [tuple(sorted(r.config.items())) for r in made if r.status == "filled"]
    assert len(made) == 300 and len(held) == len(set(held)) == 256
    assert all(r.config is None for r in made if r.status == "exhausted")


def test_costs(spark):
    df = spark.createDataFrame([(1, "medium", "done", 3600.0)], "task_id long, tier string, status string, duration_s double")
    r = costs.run_costs(df).first()
    assert (round(r.cost_usd, 6), round(r.cost_brl, 6), round(r.cost_per_sf, 6)) == (0.17, 0.9775, 0.085)
    runs = spark.range(11).selectExpr("id task_id", "'low' tier", "'done' status", "cast(id as double) duration_s")
    assert costs.at_percentile(costs.run_costs(runs), 0.9).first().task_id == 9


def test_not_in_is_null_aware(spark):
    left = spark.createDataFrame([(1,), (2,), (None,)], "k int")
    one = spark.createDataFrame([(1,)], "o int")
    null = spark.createDataFrame([(1,), (None,)], "o int")
    assert [r.k for r in not_in(left, "k", one, "o").collect()] == [2]
    assert not_in(left, "k", null, "o").collect() == []
    assert not_in(left, "k", one.where("false"), "o").count() == 3


def test_hypercube_deals_each_group_without_a_row_per_parameter(spark):
    slots = spark.range(0, 1310, 1, 4).selectExpr("id slot", "case when id < 7 then 'low' when id < 310 then 'medium' else 'high' end tier", "'s1' combination")
    wide = configspace.lhs_wide(slots, 3)
    assert "Generate" not in wide._jdf.queryExecution().executedPlan().toString()
    rows = wide.collect()
    for tier, n in (("low", 7), ("medium", 303), ("high", 1000)):
        group = [r for r in rows if r.tier == tier]
        columns = {c: [int(r[c] * n) for r in sorted(group, key=lambda r: r.slot)] for c in wide.columns if c.startswith("q_")}
        assert all(sorted(v) == list(range(n)) for v in columns.values())
    # any two parameters fall into the same half about as often as not
    halves = [[2 * x < 1000 for x in v] for v in columns.values()]
    same = [sum(a == b for a, b in zip(x, y)) for i, x in enumerate(halves) for y in halves[:i]]
    assert len(same) == 528 and 400 < min(same) and max(same) < 600
    assert abs(sum(same) / len(same) - 500) < 5
    chi = sum((x - 500) ** 2 / 250 for x in same) / len(same)
    assert 0.5 < chi < 2


def test_choices_fit_the_machine(spark):
    assert configspace.fitting("shared_buffers", "low") == ("384MB", "512MB") and configspace.fitting("shared_buffers", "high") == ("1024MB", "1280MB", "1408MB")
    assert configspace.fitting("effective_cache_size", "medium", shared=1024.0) == ("2GB", "2560MB", "3GB")
    assert configspace.fitting("work_mem", "high", few=False) == ("32MB", "64MB") and configspace.fitting("work_mem", "high", few=True) == ("32MB", "64MB", "128MB", "256MB")


def test_duplicates_are_counted_by_group(spark):
    rows = spark.createDataFrame([("low", "s3", {"a": "1"}), ("low", "s3", {"a": "1"}), ("low", "s3", {"a": "1"}), ("high", "s3", {"a": "1"}), ("high", "s3", {"a": "2"})], "tier string, combination string, config map<string,string>")
    assert {(r.tier, r.duplicates) for r in configspace.duplicates(rows).collect()} == {("low", 2), ("high", 0)}


def test_facts_meet_after_the_lookups_of_each(spark):
    from tidewater.plans import retail_star
    from tidewater.sources import tpcds_views

    plan = retail_star.q85(tpcds_views.tables(spark, "/root/testdata/sf0.001"))._jdf.queryExecution().analyzed().toString()
    joins = [line for line in plan.splitlines() if "Join Inner" in line]
    at = {name: next(i for i, line in enumerate(joins) if name in line) for name in ("wr_order_number", "ca_address_sk", "s_cd_demo_sk", "d_date_sk")}
    # the plan is printed from the top: what comes later is joined earlier
    assert all(at["wr_order_number"] < at[x] for x in ("ca_address_sk", "s_cd_demo_sk", "d_date_sk"))
