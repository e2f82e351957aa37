"""Workload records (query runs, hardware samples, task states) over the given tables.

They stand in for a measuring harness: runs come from order lines, tasks from
orders, samples and state changes from events, counters from parts, suppliers
and customers.
"""

from __future__ import annotations

from tidewater.sources.views import Tables, View, idiv, pick

TIERS = "low,medium,high"
COMBINATIONS = "s1,s2,s3,s1_s2,s1_s3,s2_s3,s1_s2_s3"
STATUSES = "pending,running,done,failed,abandoned"

_KIND = "CASE WHEN d >= 0.1 AND f = 'R' THEN 'oom' WHEN d >= 0.09 THEN 'timeout' WHEN d >= 0.08 AND f = 'A' THEN 'technical' ELSE 'ok' END"


def build() -> dict[str, View]:
    v: dict[str, View] = {}
    text = lambda x: f"CAST({x} AS STRING)"
    plan = (
        f"'{{\"Plan\": {{\"Actual Rows\": ' || {text('pk')} || ', \"Shared Hit Blocks\": ' || {text('hit')} || ', \"Shared Read Blocks\": ' || {text('rd')}"
        f" || ', \"Temp Written Blocks\": ' || {text('tw')} || ', \"Workers Launched\": ' || {text('wl')} || '}}, \"Planning Time\": ' || {text('pm')}"
        f" || ', \"Execution Time\": ' || {text('em')} || '}}'"
    )
    v["runs"] = View(
        "lineitem",
        (
            "task_id",
            "CASE WHEN qn <= 22 THEN 'tpc_h' ELSE 'tpc_ds' END AS suite",
            "CAST(CASE WHEN qn <= 22 THEN qn ELSE qn - 22 END AS INT) AS id",
            f"{pick(TIERS, 'task_id')} AS tier",
            f"{pick(COMBINATIONS, idiv('task_id', 3))} AS combination",
            f"CASE WHEN {_KIND} = 'oom' THEN 137 ELSE 0 END AS exit_code",
            f"CASE {_KIND} WHEN 'timeout' THEN 'ERROR: Canceling Statement due to limit' WHEN 'technical' THEN 'connection reset' WHEN 'oom' THEN 'killed' END AS error",
            "em + pm + CAST(pk % 9 AS DOUBLE) - 3 AS wall_ms",
            f"CASE WHEN {_KIND} = 'ok' THEN {plan} END AS plan_json",
            f"{_KIND} AS kind",
            "em",
            "pm",
            "pk",
            "hit",
            "rd",
            "tw",
            "wl",
        ),
        inner=(
            "l_orderkey AS task_id",
            "1 + l_partkey % 121 AS qn",
            "CAST(CAST(round(l_extendedprice * 100) AS BIGINT) * 2 AS DOUBLE) / 1000 AS ep",
            "l_quantity / 8 AS qty",
            "l_discount AS dc",
            "l_returnflag AS rf",
            "l_partkey AS part",
            "l_suppkey AS supp",
        ),
        keys=("task_id", "qn"),
        measures=(
            "max(ep) AS em",
            "max(qty) AS pm",
            "max(dc) AS d",
            "max(rf) AS f",
            "max(part) AS pk",
            "max(supp) * 13 % 4000 AS hit",
            "max(part) * 7 % 900 AS rd",
            "CASE WHEN max(part) % 5 = 0 THEN max(supp) ELSE 0 END AS tw",
            "CAST(max(supp) % 4 AS INT) AS wl",
        ),
    )
    v["tasks"] = View(
        "orders",
        (
            "o_orderkey AS task_id",
            f"{pick(TIERS, 'o_orderkey')} AS tier",
            f"{pick(COMBINATIONS, idiv('o_orderkey', 3))} AS combination",
            "CASE o_orderstatus WHEN 'P' THEN 'abandoned' ELSE 'done' END AS status",
            "CASE WHEN o_orderstatus = 'P' THEN split_part('invalid_config,timeout,max_retries', ',', CAST(1 + o_custkey % 3 AS INT)) ELSE '' END AS abandoned_reason",
            "o_totalprice / 100 AS duration_s",
            "CASE WHEN o_orderkey % 53 = 7 THEN NULL ELSE 300 + CAST((o_orderkey * 7919) % 5003 AS DOUBLE) / 4 END AS tpch_geo_mean_ms",
            "900 + CAST((o_orderkey * 104729) % 9001 AS DOUBLE) / 8 AS tpcds_geo_mean_ms",
            "CASE WHEN o_orderkey % 41 = 9 THEN NULL ELSE CAST((o_orderkey * 7919) % 997 AS DOUBLE) / 10 END AS tpch_cache_hit_ratio",
            "CAST((o_orderkey * 31) % 40 AS INT) AS tpcds_queries_with_spill",
            "310 + CAST((o_orderkey * 7919) % 5003 AS DOUBLE) / 4 + CAST((o_orderkey * 613) % 700 AS DOUBLE) AS pred_geo_tpch",
            "910 + CAST((o_orderkey * 104729) % 9001 AS DOUBLE) / 8 + CAST((o_orderkey * 17) % 300 AS DOUBLE) AS pred_geo_tpcds",
            "CAST((o_orderkey * 7919) % 997 AS DOUBLE) / 10 + CAST((o_orderkey * 29) % 20 AS DOUBLE) AS pred_cache_tpch",
            "CAST((o_orderkey * 31) % 40 AS DOUBLE) + CAST((o_orderkey * 3) % 8 AS DOUBLE) / 4 AS pred_spill_tpcds",
            "o_custkey AS slot",
        ),
    )
    v["settings"] = View(
        "orders",
        (
            "o_custkey AS snapshot",
            f"{pick('work_mem,shared_buffers,jit,lock_timeout,log_level,search_path', 'o_orderkey')} AS name",
            "o_orderpriority AS setting",
            "CASE o_orderstatus WHEN 'P' THEN 'session' ELSE 'default' END AS source",
            "o_orderkey AS version",
        ),
    )
    v["db_counters"] = View("customer", ("'db' || CAST(c_custkey AS STRING) AS datname", "c_custkey * 31 % 700 AS blks_hit", "CASE WHEN c_custkey % 9 = 0 THEN 0 ELSE c_custkey * 17 % 300 END AS blks_read"))
    v["table_counters"] = View("part", (
        "'t' || CAST(p_partkey AS STRING) AS relname", "p_partkey % 6 AS seq_scan", "p_partkey * 37 % 10007 AS seq_tup_read",
        "CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE p_partkey % 50 END AS idx_scan", "p_partkey * 11 % 500 AS heap_blks_read", "p_partkey * 19 % 800 AS heap_blks_hit",
        "CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_partkey % 90 END AS idx_blks_read"))
    v["samples"] = View("events", (
        "user_id AS task_id", "ts", "event_id", "EPOCH_US(ts)) / 1e6 AS timestamp_s",
        "CASE WHEN event_id % 10 = 3 THEN NULL ELSE value / 3 END AS cpu_percent", "value * 20 / 3 AS cpu_freq_mhz", "30 + value / 9 AS cpu_temp_tctl_c",
        "value / 47 AS mem_used_gb", "value / 7 AS mem_percent", "CAST(event_id % 70 AS DOUBLE) AS disk_read_mb_s", "CAST(event_id % 30 AS DOUBLE) AS disk_write_mb_s",
        "CASE WHEN user_id % 2 = 0 THEN value / 3 END AS gpu_edge_c", "CASE WHEN user_id % 3 = 0 THEN value / 7 END AS gpu_junction_c", "CAST(NULL AS DOUBLE) AS gpu_mem_c",
        "CASE WHEN user_id % 4 = 0 THEN LIST_OF(value / 7.3, value / 3.7) ELSE LIST_OF(value / 7.3, value / 3.7, value / 9.1, value / 11.3) END AS cpu_temp_cores_c",
        "LIST_OF(value / 13.7, CASE WHEN event_id % 7 = 0 THEN NULL ELSE value / 3.3 END) AS nvme_temps_c", "LIST_OF(value / 17.3) AS ram_temps_c",
        "CASE WHEN event_id % 11 = 0 THEN NULL ELSE (event_id * 7919 + user_id * 13) % 10000000 END AS rapl_energy_uj",
        "event_id * 1048576 AS read_bytes", "event_id * event_id % 1000003 * 4096 AS write_bytes", "CAST(20000 + event_id % 60000 AS BIGINT) AS raw_millic", "user_id * 1073741824 + event_id AS mem_used_bytes"))
    v["changes"] = View("events", (
        "user_id AS id", "event_id AS change_id", "ts AS updated_at", f"{pick(TIERS, 'user_id')} AS tier", f"{pick(COMBINATIONS, 'user_id')} AS combination",
        "CASE event_type WHEN 'view' THEN 'pending' WHEN 'signup' THEN 'running' WHEN 'click' THEN 'failed' WHEN 'purchase' THEN 'done' ELSE 'abandoned' END AS status",
        "CASE WHEN event_type = 'error' THEN split_part('invalid_config,timeout,max_retries', ',', CAST(1 + event_id % 3 AS INT)) END AS abandoned_reason",
        "CASE WHEN event_type = 'signup' THEN ts END AS claimed_at"))
    return v


SPARK_VIEWS = build()
CHECK_VIEWS = {f"w_{name}": view for name, view in SPARK_VIEWS.items()}


def tables(spark, folder: str) -> Tables:
    return Tables(spark, folder, SPARK_VIEWS)
