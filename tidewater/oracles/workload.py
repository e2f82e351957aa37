"""Check queries for the workload-intelligence operators."""

from __future__ import annotations

import re

from tidewater.operators.features import PARAMS, run_ids
from tidewater.sources import tpcds_views, workload_views
from tidewater.sources.views import with_views

_VIEWS = {**workload_views.CHECK_VIEWS, **tpcds_views.CHECK_VIEWS}
_LOG = """log AS (SELECT task_id, suite, id, kind AS reason, kind = 'ok' AS ok, CASE kind WHEN 'ok' THEN em WHEN 'timeout' THEN 900000 WHEN 'oom' THEN 1350000 END AS ms,
  wall_ms, pm, pk, hit, rd, tw, wl FROM w_runs)"""
_TIMED = "reason <> 'technical'"


def check(body: str, log: bool = False) -> str:
    body = body.strip()
    if log:
        body = f"WITH {_LOG}, {body[5:]}" if body.upper().startswith("WITH ") else f"WITH {_LOG} {body}"
    used = [n for n in _VIEWS if re.search(rf"\b{n}\b", body)]
    return with_views(_VIEWS, " ".join(used), body)


def _pct(value: str, part: str = "", table_n: str = "count({v})") -> str:
    """Percentile rank with averaged ties."""
    p = f"PARTITION BY {part} " if part else ""
    q = f"PARTITION BY {part}, {value}" if part else f"PARTITION BY {value}"
    return f"((rank() OVER ({p}ORDER BY {value}) + (count(*) OVER ({q}) - 1) / 2) / count({value}) OVER ({p.strip()}))"


def sqls() -> dict[str, str]:
    s: dict[str, str] = {}
    keys = "task_id, suite, id"
    s["qm_01_plan_records"] = check(f"""SELECT {keys}, CASE WHEN ok THEN pm END AS plan_ms, CASE WHEN ok THEN ms END AS exec_ms, CASE WHEN ok THEN pk END AS rows, CASE WHEN ok THEN hit END AS shared_hit,
        CASE WHEN ok THEN rd END AS shared_read, CASE WHEN ok THEN tw END AS temp_written_blocks, CASE WHEN ok THEN wl END AS workers_launched FROM log""", True)
    s["qm_02_cache_hit_ratio"] = check(f"SELECT {keys}, CASE WHEN ok AND hit + rd > 0 THEN round_even(hit::DOUBLE / (hit + rd) * 100, 2) END AS cache_hit_ratio FROM log", True)
    s["qm_03_failure_class"] = check(f"SELECT {keys}, reason AS failure_reason FROM log", True)
    s["qm_04_censored_times"] = check(f"SELECT {keys}, ms AS exec_ms FROM log", True)
    s["qm_05_overhead"] = check(f"SELECT {keys}, round_even(greatest(0, wall_ms - ms - pm), 3) AS overhead_ms FROM log WHERE ok", True)
    s["qm_06_outcome_counts"] = check("SELECT task_id, suite, count(*) FILTER (WHERE ok) AS n_success, CASE suite WHEN 'tpc_h' THEN 20 ELSE 98 END - count(*) FILTER (WHERE ok) AS n_failed FROM log GROUP BY 1, 2", True)
    t = f"FILTER (WHERE {_TIMED})"
    times = f"""round_even(sum(ms) {t}, 3) AS total_exec_ms, max(ms) {t} AS max_exec_ms, min(ms) {t} AS min_exec_ms, round_even(median(ms) {t}, 3) AS median_exec_ms,
        coalesce(round_even(stddev_samp(ms) {t}, 3), 0) AS stddev_exec_ms"""
    p95 = f"list_extract(list_sort(list(ms) {t}), 1 + CAST(floor(count(*) {t} * 0.95::DOUBLE) AS INT)) AS p95_exec_ms"
    geo = f"round_even(exp(avg(ln(ms)) {t}), 3) AS geo_mean_exec_ms"
    buf = """coalesce(sum(hit) FILTER (WHERE ok), 0)::BIGINT AS total_shared_hit, coalesce(sum(rd) FILTER (WHERE ok), 0)::BIGINT AS total_shared_read,
        CASE WHEN sum(hit + rd) FILTER (WHERE ok) > 0 THEN round_even((sum(hit) FILTER (WHERE ok))::DOUBLE / (sum(hit + rd) FILTER (WHERE ok))::DOUBLE * 100, 2) END AS overall_cache_hit_ratio,
        coalesce(sum(tw) FILTER (WHERE ok), 0)::BIGINT AS total_temp_written_blocks"""
    spill = "count(*) FILTER (WHERE ok AND tw > 0) AS queries_with_spill"
    par = "count(*) FILTER (WHERE ok AND wl > 0) AS queries_with_parallelism, coalesce(round_even(avg(wl) FILTER (WHERE ok), 2), 0) AS avg_workers_launched"
    for name, cols in (("qm_07_suite_times", times), ("qm_08_p95", p95), ("qm_09_geo_mean", geo), ("qm_10_buffer_totals", buf), ("qm_11_spill", spill), ("qm_12_parallelism", par)):
        s[name] = check(f"SELECT task_id, suite, {cols} FROM log GROUP BY 1, 2", True)
    kinds = ", ".join(f"count(*) FILTER (WHERE reason = '{r}') AS n_queries_{n}" for r, n in (("ok", "successful"), ("timeout", "timed_out"), ("oom", "oom"), ("technical", "technical")))
    s["qm_suite_summary"] = check(f"SELECT task_id, suite, {kinds}, {times}, {p95}, {geo}, {buf}, {spill}, {par} FROM log GROUP BY 1, 2", True)
    s["qm_13_query_maps"] = check("SELECT task_id, suite, 'q' || id AS query, reason, ms AS exec_ms, wall_ms FROM log", True)
    s["qm_14_database_ratio"] = check("SELECT *, CASE WHEN blks_hit + blks_read > 0 THEN round_even(blks_hit::DOUBLE / (blks_hit + blks_read) * 100, 2) END AS cache_hit_pct FROM w_db_counters")
    s["qm_15_index_use"] = check("""SELECT relname, seq_scan, seq_tup_read, idx_scan, CASE WHEN seq_scan + ifnull(idx_scan, 0) > 0 THEN round_even(ifnull(idx_scan, 0)::DOUBLE / (seq_scan + ifnull(idx_scan, 0)) * 100, 2) END AS idx_scan_pct FROM w_table_counters""")
    s["qm_16_heap_use"] = check("""SELECT relname, heap_blks_read, heap_blks_hit, CASE WHEN heap_blks_hit + heap_blks_read > 0 THEN round_even(heap_blks_hit::DOUBLE / (heap_blks_hit + heap_blks_read) * 100, 2) END AS heap_hit_pct,
        heap_blks_read + ifnull(idx_blks_read, 0) AS blocks_read FROM w_table_counters""")
    s["qm_17_effective_settings"] = check("SELECT snapshot, name, arg_max(setting, version) AS setting FROM w_settings WHERE source <> 'default' OR name IN ('work_mem', 'shared_buffers', 'jit') GROUP BY 1, 2")
    s["qm_18_running_counts"] = check(f"SELECT {keys}, count(*) FILTER (WHERE ok) OVER w AS ok_so_far, count(*) FILTER (WHERE NOT ok) OVER w AS failed_so_far FROM log WINDOW w AS (PARTITION BY task_id, suite ORDER BY id ROWS UNBOUNDED PRECEDING)", True)
    s["qm_19_task_duration"] = check("SELECT id AS task_id, round_even((epoch_us(max(updated_at)) - epoch_us(min(updated_at))) / 1e6, 3) AS duration_s FROM w_changes GROUP BY 1")
    metrics = "cpu_percent cpu_freq_mhz cpu_temp_tctl_c mem_used_gb mem_percent disk_read_mb_s disk_write_mb_s gpu_edge_c gpu_junction_c gpu_mem_c".split()
    s["hw_01_scalar_stats"] = check("SELECT task_id, " + ", ".join(f"round_even(avg({m}), 2) AS {m}_avg, round_even(max({m}), 2) AS {m}_max, round_even(min({m}), 2) AS {m}_min" for m in metrics) + " FROM w_samples GROUP BY 1")
    sensors = " UNION ALL ".join(f"SELECT task_id, '{p}' || (unnest(generate_series(1, len({c}))) - {1 - first}) AS sensor, unnest({c}) AS v FROM w_samples" for c, p, first in (("cpu_temp_cores_c", "cpu_core", 0), ("nvme_temps_c", "nvme", 1), ("ram_temps_c", "ram", 1)))
    s["hw_02_sensor_stats"] = check(f"SELECT task_id, sensor, round_even(avg(v), 2) AS temp_avg_c, round_even(max(v), 2) AS temp_max_c FROM ({sensors}) WHERE v IS NOT NULL GROUP BY 1, 2")
    s["hw_03_energy"] = check("""WITH e AS (SELECT task_id, arg_min(rapl_energy_uj, timestamp_s) AS a, arg_max(rapl_energy_uj, timestamp_s) AS b FROM w_samples WHERE rapl_energy_uj IS NOT NULL GROUP BY 1 HAVING count(*) > 1),
        d AS (SELECT task_id, max(timestamp_s) - min(timestamp_s) AS sp FROM w_samples GROUP BY 1)
        SELECT task_id, round_even(CASE WHEN b >= a THEN b - a ELSE 10000000 - a + b END::DOUBLE / 1e6, 3) AS rapl_energy_total_j,
          round_even(CASE WHEN b >= a THEN b - a ELSE 10000000 - a + b END::DOUBLE / greatest(sp, 0.001) / 1e6, 2) AS rapl_avg_power_w FROM e JOIN d USING (task_id)""")
    s["hw_04_duration"] = check("SELECT task_id, CASE WHEN count(*) > 1 THEN round_even(max(timestamp_s) - min(timestamp_s), 1) END AS duration_s, count(*) AS n_samples FROM w_samples GROUP BY 1")
    rate = lambda c: f"CASE WHEN lag(timestamp_s) OVER w IS NULL OR timestamp_s <= lag(timestamp_s) OVER w THEN 0 ELSE greatest(0, round_even(({c} - lag({c}) OVER w) / (timestamp_s - lag(timestamp_s) OVER w) / 1048576.0::DOUBLE, 2)) END"
    s["hw_05_disk_rate"] = check(f"SELECT task_id, event_id, {rate('read_bytes')} AS read_mb_s, {rate('write_bytes')} AS write_mb_s FROM w_samples WINDOW w AS (PARTITION BY task_id ORDER BY timestamp_s, event_id)")
    s["hw_06_units"] = check("SELECT event_id, round_even(raw_millic / 1000.0::DOUBLE, 1) AS temp_c, round_even(mem_used_bytes / 1073741824.0::DOUBLE, 2) AS mem_gb FROM w_samples")
    state = "st AS (SELECT * FROM w_changes QUALIFY row_number() OVER (PARTITION BY id ORDER BY updated_at DESC, change_id DESC) = 1)"
    s["tq_01_current_state"] = check(f"WITH {state} SELECT id, status, tier, combination, change_id FROM st")
    s["tq_02_status_counts"] = check(f"WITH {state} SELECT x.status AS status, count(st.id) AS n FROM (VALUES ('pending'), ('running'), ('done'), ('failed'), ('abandoned')) x(status) LEFT JOIN st ON st.status = x.status GROUP BY 1")
    s["tq_03_listings"] = check(f"WITH {state} SELECT id, status, tier FROM st WHERE status IN ('pending', 'done')")
    s["tq_04_backlog"] = check(f"""WITH {state} SELECT id, tier, status, status = 'running' AS is_stale FROM st WHERE status = 'pending'
        OR (status = 'running' AND (epoch_us(TIMESTAMP '2024-01-31 00:00:00') - epoch_us(claimed_at)) / 1e6 > 3600 * CASE tier WHEN 'low' THEN 3.5 WHEN 'medium' THEN 4.5 WHEN 'high' THEN 8.5 ELSE 9 END)""")
    s["tq_05_retry_accounting"] = check("""WITH r AS (SELECT id, count(*) FILTER (WHERE status = 'failed') AS k FROM w_changes GROUP BY 1), g AS (SELECT id, abandoned_reason, count(*) AS n FROM w_changes WHERE status = 'abandoned' GROUP BY 1, 2)
        SELECT abandoned_reason, sum(n)::BIGINT AS abandoned, count(*) AS tasks, sum(k)::BIGINT AS retries FROM g JOIN r USING (id) GROUP BY 1""")
    s["tq_06_status_report"] = check(f"""WITH {state} SELECT st.tier AS tier, count(*) AS tasks, count(*) FILTER (WHERE st.status = 'done') AS done, round_even(avg(tpch_geo_mean_ms) FILTER (WHERE st.status = 'done') / 1000, 3) AS tpch_mean_s,
        round_even(avg(tpcds_geo_mean_ms) FILTER (WHERE st.status = 'done') / 1000, 3) AS tpcds_mean_s, round_even(count(*) FILTER (WHERE st.status = 'done') / count(*) * 100, 1) AS done_pct FROM st LEFT JOIN w_tasks k ON k.task_id = st.id GROUP BY 1""")

    # feature rows
    def suite_cols(prefix, suite, n):
        a = f"{prefix}_a"
        return f"""coalesce({a}.ok, 0) AS {prefix}_n_success, coalesce({a}.n - {a}.ok, 0)::BIGINT AS {prefix}_n_failed,
            CASE WHEN status = 'done' AND {a}.tot IS NOT NULL THEN round_even({a}.tot, 3) ELSE round_even(coalesce({a}.eff, 0) + ({n} - coalesce({a}.n, 0)) * 900000, 3) END AS {prefix}_total_ms,
            CASE WHEN status = 'done' THEN {a}.geo END AS {prefix}_geo_mean_ms, CASE WHEN status = 'done' THEN {a}.ratio END AS {prefix}_cache_hit_ratio, CASE WHEN status = 'done' THEN {a}.spill END AS {prefix}_queries_with_spill"""

    ag = f"""ag AS (SELECT task_id, suite, count(*) AS n, count(*) FILTER (WHERE ok) AS ok, sum(ms) {t} AS tot, sum(coalesce(ms, 900000)) AS eff, round_even(exp(avg(ln(ms)) {t}), 3) AS geo,
        CASE WHEN sum(hit + rd) FILTER (WHERE ok) > 0 THEN round_even((sum(hit) FILTER (WHERE ok))::DOUBLE / (sum(hit + rd) FILTER (WHERE ok))::DOUBLE * 100, 2) END AS ratio, count(*) FILTER (WHERE ok AND tw > 0) AS spill FROM log GROUP BY 1, 2)"""
    joins = "w_tasks t LEFT JOIN ag tpch_a ON tpch_a.task_id = t.task_id AND tpch_a.suite = 'tpc_h' LEFT JOIN ag tpcds_a ON tpcds_a.task_id = t.task_id AND tpcds_a.suite = 'tpc_ds'"
    totals = f"t.task_id AS task_id, tier, combination, status, duration_s, abandoned_reason, {suite_cols('tpch', 'tpc_h', 20)}, {suite_cols('tpcds', 'tpc_ds', 98)}"
    s["fe_01_totals"] = check(f"WITH {ag} SELECT {totals} FROM {joins}", True)
    s["fe_02_suite_totals"] = check(f"WITH {ag}, x AS (SELECT {totals} FROM {joins}) SELECT task_id, tpch_total_ms, tpcds_total_ms FROM x", True)
    ids = " UNION ALL ".join(f"SELECT '{u}' AS suite, i::INT AS id FROM (VALUES {', '.join(f'({i})' for i in run_ids(u))}) v(i)" for u in ("tpc_h", "tpc_ds"))
    long = f"q AS (SELECT t.task_id, d.suite, d.id, coalesce(l.ms, 900000) AS ms, CASE WHEN l.reason = 'ok' THEN 0 ELSE 1 END::INT AS timed_out FROM w_tasks t CROSS JOIN ({ids}) d LEFT JOIN log l ON l.task_id = t.task_id AND l.suite = d.suite AND l.id = d.id)"
    s["fe_03_query_times"] = check(f"WITH {long} SELECT suite, id, count(ms) AS tasks, round(sum(ms), 3) AS total_ms, min(ms) AS least_ms FROM q GROUP BY 1, 2", True)
    s["fe_04_censored_flags"] = check(f"WITH {long} SELECT task_id, suite, sum(timed_out)::BIGINT AS imputed, count(*) AS queries FROM q GROUP BY 1, 2", True)
    s["fe_11_timeout_frequency"] = check(f"WITH {long} SELECT suite, id, sum(timed_out)::BIGINT AS timeouts, count(*) AS tasks FROM q GROUP BY 1, 2", True)
    has = {i: f"contains(combination, 's{i}')" for i in (1, 2, 3)}
    on_off = ("1", "0")
    # stage, values as numbers, place of task 0
    coded = {
        "jit": (1, ("1", "0", "1", "0"), 0),
        "seq_page_cost": (1, ("1.0",), 0),
        "random_page_cost": (1, ("1.25", "2.5", "4.0", "NULL"), 0),
        "default_statistics_target": (1, ("50", "100", "500"), 3),
        "max_parallel_workers": (1, ("1", "2", "4"), 4),
        "max_parallel_workers_per_gather": (1, ("0", "1", "2"), 5),
        "max_worker_processes": (1, ("8",), 6),
        "shared_buffers": (1, ("1024", "512", "0.5", "64"), 0),
        "effective_cache_size": (1, ("1024", "768", "1536"), 8),
        "work_mem": (1, ("4", "16", "64", "2"), 9),
        "enable_hashagg": (1, on_off, 10),
        "enable_bitmapscan": (1, ("0", "1"), 11),
        "enable_nestloop": (1, ("1", "0", "0"), 12),
        "enable_parallel_hash": (1, on_off, 13),
        "enable_sort": (1, on_off, 14),
        "synchronous_commit": (1, ("0",), 15),
        "cpu_tuple_cost": (2, ("0.001", "0.005", "0.01"), 0),
        "cpu_index_tuple_cost": (2, ("0.001", "0.005"), 17),
        "cpu_operator_cost": (2, ("0.0005", "0.0025", "0.001"), 18),
        "parallel_setup_cost": (2, ("100", "500", "1000"), 19),
        "parallel_tuple_cost": (2, ("0.01", "0.1"), 20),
        "min_parallel_table_scan_size": (2, ("1", "8", "16"), 21),
        "min_parallel_index_scan_size": (2, ("0.125", "0.5", "1"), 22),
        "join_collapse_limit": (2, ("4", "8", "12"), 23),
        "from_collapse_limit": (2, ("4", "8", "12", "NULL"), 24),
        "hash_mem_multiplier": (2, ("1.0", "2.0", "4.0"), 25),
        "enable_mergejoin": (2, on_off, 26),
        "enable_hashjoin": (2, on_off, 0),
        "enable_memoize": (3, ("1", "0", "1"), 0),
        "enable_gathermerge": (3, on_off, 29),
        "enable_incremental_sort": (3, ("1", "0", "0"), 30),
        "enable_material": (3, on_off, 31),
        "enable_indexscan": (3, on_off, 32),
        "enable_indexonlyscan": (3, ("1", "0", "1"), 33),
        "enable_parallel_append": (3, on_off, 34),
        "parallel_leader_participation": (3, on_off, 35),
    }
    enc = {p: f"CASE WHEN {has[stage]} THEN [{', '.join(f'{v}::DOUBLE' for v in values)}][1 + (task_id + {start}) % {len(values)}] END" for p, (stage, values, start) in coded.items()}
    cfg = ", ".join(f"{enc.get(p, 'NULL::DOUBLE')} AS cfg_{p}" for p in PARAMS)
    s["fe_05_config_encoding"] = check(f"SELECT task_id, {cfg} FROM w_tasks")
    hw = "CASE tier WHEN 'low' THEN 2 WHEN 'medium' THEN 4 WHEN 'high' THEN 6 END::INT AS vcpus, CASE tier WHEN 'low' THEN 2048 WHEN 'medium' THEN 4096 WHEN 'high' THEN 5120 END::INT AS memory_mb, CASE tier WHEN 'low' THEN 1 WHEN 'medium' THEN 2 WHEN 'high' THEN 4 END::INT AS sf"
    s["fe_06_hardware"] = check(f"SELECT task_id, {hw} FROM w_tasks")
    wide = []
    for prefix, suite, last in (("tpch", "tpc_h", 22), ("tpcds", "tpc_ds", 99)):
        run = set(run_ids(suite))
        for i in range(1, last + 1):
            f = f"FILTER (WHERE suite = '{suite}' AND id = {i})"
            wide.append((f"coalesce(max(ms) {f}, 900000)" if i in run else "NULL::DOUBLE") + f" AS {prefix}_q{i}_ms")
            wide.append((f"CASE WHEN bool_or(ok) {f} THEN 0 ELSE 1 END::INT" if i in run else "NULL::INT") + f" AS {prefix}_q{i}_timed_out")
    s["fe_07_feature_rows"] = check(f"WITH {ag}, pv AS (SELECT k.task_id AS pid, {', '.join(wide)} FROM w_tasks k LEFT JOIN log USING (task_id) GROUP BY 1) SELECT {totals}, pv.* EXCLUDE (pid), {cfg.replace('task_id', 't.task_id')}, {hw} FROM {joins} JOIN pv ON pid = t.task_id", True)
    s["fe_08_dataset_profile"] = check(" UNION ALL ".join(f"SELECT '{d}' AS dimension, {d} AS value, count(*) AS n FROM w_tasks GROUP BY 2" for d in ("status", "tier", "combination")))
    s["fe_09_target_ranges"] = check(f"WITH {ag}, x AS (SELECT {totals} FROM {joins}) SELECT " + ", ".join(f"round_even({f}({p}_total_ms) / 1000, 3) AS {p}_{f}_s" for p in ("tpch", "tpcds") for f in ("min", "avg", "max")) + " FROM x WHERE status = 'done'", True)
    encoded = "e AS (SELECT task_id, " + ", ".join(f"{v} AS cfg_{p}" for p, v in enc.items()) + " FROM w_tasks)"
    s["fe_10_missing_share"] = check(f"WITH {encoded} SELECT * FROM (" + " UNION ALL ".join(f"SELECT 'cfg_{p}' AS \"column\", round_even((count(*) - count(cfg_{p})) / count(*) * 100, 1) AS missing_pct FROM e" for p in enc) + ") WHERE missing_pct > 0 ORDER BY 2 DESC, 1 LIMIT 10")
    s["fe_11_column_audit"] = check(f"WITH {encoded} " + " UNION ALL ".join(f"SELECT 'cfg_{p}' AS \"column\", count(cfg_{p}) AS seen, count(cfg_{p}) = 0 AS always_null, count(DISTINCT cfg_{p}) = 1 AS zero_variance FROM e" for p in enc))
    s["fe_12_impute_median"] = check(f"WITH {encoded} SELECT task_id, " + ", ".join(f"coalesce(cfg_{p}, m_{p}, -1) AS cfg_{p}, (cfg_{p} IS NULL)::INT AS cfg_{p}__was_missing" for p in enc) + " FROM e CROSS JOIN (SELECT " + ", ".join(f"median(cfg_{p}) AS m_{p}" for p in enc) + " FROM e)")
    s["fe_13_config_maps"] = check(f"WITH {encoded} " + " UNION ALL ".join(f"SELECT task_id, '{p}' AS param, cfg_{p} AS value FROM e WHERE cfg_{p} IS NOT NULL" for p in enc))

    # ranking
    s["rk_01_percent_rank"] = check(f"SELECT task_id, {_pct('tpcds_queries_with_spill')} AS pct FROM w_tasks")
    grp = "tier, combination"
    s["rk_01_percent_rank_grouped"] = check(f"SELECT task_id, CASE WHEN tpch_cache_hit_ratio IS NOT NULL THEN {_pct('tpch_cache_hit_ratio', grp)} END AS pct FROM w_tasks")

    def score(geo, cache):
        g = f"1.0::DOUBLE / greatest({geo}, 1e-9)"
        return f"""CASE WHEN count({geo}) OVER (PARTITION BY {grp}) = 0 THEN 0 WHEN {geo} IS NOT NULL THEN 0.65::DOUBLE * {_pct(f'({g})', grp)} END
            + CASE WHEN count({cache}) OVER (PARTITION BY {grp}) = 0 THEN 0 WHEN {cache} IS NOT NULL THEN 0.35::DOUBLE * {_pct(cache, grp)} END"""

    gm = "CASE WHEN tpch_geo_mean_ms IS NULL THEN NULL ELSE 1.0::DOUBLE / greatest(tpch_geo_mean_ms, 1e-9) END"
    real = f"sc AS (SELECT *, {gm} AS gv FROM w_tasks), sr AS (SELECT *, CASE WHEN gv IS NOT NULL AND tpch_cache_hit_ratio IS NOT NULL THEN 0.65::DOUBLE * {_pct('gv', grp)} + 0.35::DOUBLE * {_pct('tpch_cache_hit_ratio', grp)} END AS score FROM sc)"
    s["rk_02_composite_score"] = check(f"WITH {real} SELECT task_id, tier, combination, score FROM sr")
    s["ml_06_pair_counts"] = check(f"""WITH {real}, g AS (SELECT tier, combination, count(*) AS n FROM sr WHERE score IS NOT NULL GROUP BY 1, 2)
        SELECT tier, combination, CAST(o AS INTEGER) AS "offset", n AS pairs, n AS rows_a, n AS rows_b FROM g, (VALUES (1), (2), (3), (5), (8)) v(o) WHERE o % n <> 0""")
    s["rk_03_position_norm"] = check("SELECT task_id AS candidate_idx, (row_number() OVER (ORDER BY pred_spill_tpcds, task_id) - 1) / greatest(count(*) OVER () - 1, 1) AS norm FROM w_tasks")
    pos = lambda v: f"(row_number() OVER (PARTITION BY {grp} ORDER BY {v}, task_id) - 1) / greatest(count(*) OVER (PARTITION BY {grp}) - 1, 1)"
    s["rk_04_recommend"] = check(f"""WITH x AS (SELECT *, round_even(0.65::DOUBLE * ({pos('1.0::DOUBLE / greatest(pred_geo_tpch, 1e-9)')}) + 0.35::DOUBLE * ({pos('pred_cache_tpch')}), 4) AS sc FROM w_tasks)
        SELECT tier, combination, task_id AS candidate_idx, round_even(pred_geo_tpch, 1) AS pred_geo_tpch_ms, round_even(pred_geo_tpcds, 1) AS pred_geo_tpcds_ms, round_even(pred_cache_tpch, 2) AS pred_cache_pct, round_even(pred_spill_tpcds, 2) AS pred_spill_tpcds,
          sc AS score, (row_number() OVER (PARTITION BY {grp} ORDER BY sc DESC, task_id))::INT AS rank FROM x QUALIFY rank <= 5""")

    def spearman(source, a, p, part=""):
        by = f"{part}, " if part else ""
        tail = f" GROUP BY {part}" if part else ""
        return f"""SELECT {by}round(sqrt(avg((a - p) * (a - p))), 4) AS rmse, round(corr(ra, rp), 4) AS spearman_rho, count(*) AS n FROM (SELECT {by}a, p, {_pct('a', part)} AS ra, {_pct('p', part)} AS rp
            FROM (SELECT {by}{a} AS a, {p} AS p FROM {source} WHERE {a} IS NOT NULL AND {p} IS NOT NULL)){tail}"""

    s["rk_06_rmse_spearman"] = check(spearman("w_tasks", "tpch_geo_mean_ms", "pred_geo_tpch"))
    s["rk_07_group_spearman"] = check(f"SELECT tier, combination, spearman_rho, n FROM ({spearman('w_tasks', 'tpch_geo_mean_ms', 'pred_geo_tpch', grp)}) WHERE n >= 4")

    def agreement(source, actual, a_dir, pred, p_dir):
        return f"""SELECT {grp}, count(*) FILTER (WHERE pp = 1 AND rp <= 3) AS best_hit, count(*) FILTER (WHERE pp <= 3 AND rp <= 3) AS overlap, count(*) AS n FROM (SELECT {grp},
            row_number() OVER (PARTITION BY {grp} ORDER BY {actual} {a_dir}, task_id) AS rp, row_number() OVER (PARTITION BY {grp} ORDER BY {pred} {p_dir}, task_id) AS pp FROM {source} WHERE {actual} IS NOT NULL AND {pred} IS NOT NULL) GROUP BY {grp} HAVING count(*) >= 4"""

    s["rk_08_top3_agreement"] = check(agreement("w_tasks", "tpch_geo_mean_ms", "ASC", "pred_geo_tpch", "ASC"))
    ps = f"ps AS (SELECT *, 0.65::DOUBLE * {_pct('pg', grp)} + 0.35::DOUBLE * {_pct('pred_cache_tpch', grp)} AS pred_score FROM (SELECT *, 1.0::DOUBLE / greatest(pred_geo_tpch, 1e-9) AS pg FROM sr WHERE score IS NOT NULL))"
    s["rk_08_ranking_quality"] = check(f"""WITH {real}, {ps}, g AS ({agreement('ps', 'score', 'DESC', 'pred_score', 'DESC')}), o AS ({spearman('ps', 'score', 'pred_score')}), i AS (SELECT {grp}, corr(ra, rp) AS rho, count(*) AS n FROM (SELECT {grp}, {_pct('score', grp)} AS ra, {_pct('pred_score', grp)} AS rp FROM ps WHERE score IS NOT NULL AND pred_score IS NOT NULL) GROUP BY {grp})
        SELECT (SELECT spearman_rho FROM o) AS score_global_rho, (SELECT round(avg(rho), 4) FROM i WHERE n >= 4) AS score_intra_rho_avg, round(sum(best_hit) / count(*), 4) AS precision_at1_top3,
          round(sum(overlap) / (count(*) * 3) * 100, 2) AS top3_overlap_pct, count(*) AS n_groups FROM g""")
    pairs = ", ".join(f"({w / 100}::DOUBLE, {round(1 - w / 100, 2)}::DOUBLE)" for w in range(40, 96, 5))
    grid = f"""k AS (SELECT *, 1.0::DOUBLE / greatest(tpch_geo_mean_ms, 1e-9) AS gv, 1.0::DOUBLE / greatest(pred_geo_tpch, 1e-9) AS pv FROM w_tasks
          WHERE pred_geo_tpch IS NOT NULL AND pred_cache_tpch IS NOT NULL AND tpch_geo_mean_ms IS NOT NULL AND tpch_cache_hit_ratio IS NOT NULL),
        r AS (SELECT 0.65::DOUBLE * {_pct('gv', grp)} + 0.35::DOUBLE * {_pct('tpch_cache_hit_ratio', grp)} AS real_score, {_pct('pv', grp)} AS pg, {_pct('pred_cache_tpch', grp)} AS pc FROM k),
        w AS (SELECT * FROM (VALUES {pairs}) v(w_geo, w_cache)), t AS (SELECT w_geo, w_cache, real_score, w_geo * pg + w_cache * pc AS pred_score FROM r CROSS JOIN w),
        f AS ({spearman('t', 'real_score', 'pred_score', 'w_geo, w_cache')}), o AS (SELECT w.w_geo, w.w_cache, f.spearman_rho FROM w LEFT JOIN f USING (w_geo, w_cache))"""
    s["rk_09_weight_search"] = check(f"WITH {grid} SELECT * FROM o")
    s["rk_09_best_weights"] = check(f"WITH {grid} SELECT * FROM o ORDER BY spearman_rho DESC NULLS LAST, w_geo LIMIT 1")
    s["rk_10_relevance"] = check(f"SELECT task_id, least(9, floor({_pct('tpcds_geo_mean_ms')} * 9))::INT AS relevance FROM w_tasks")
    s["rk_11_group_ids"] = check("SELECT task_id, (dense_rank() OVER (ORDER BY tier || '/' || combination) - 1)::INT AS group_id FROM w_tasks")
    s["rk_12_fastest_agreement"] = check(f"WITH {real} {agreement('sr', 'score', 'DESC', 'pred_geo_tpch', 'ASC')}")
    cols = ["tpch_geo_mean_ms", "tpcds_geo_mean_ms", "tpch_cache_hit_ratio", "tpcds_queries_with_spill"]
    s["rk_13_target_correlations"] = check(" UNION ALL ".join(f"SELECT '{a}' AS left_target, '{b}' AS right_target, spearman_rho, n FROM ({spearman('w_tasks', a, b)})" for i, a in enumerate(cols) for b in cols[i + 1 :]))
    s["rk_14_best_worst"] = check("SELECT tier, min(tpch_geo_mean_ms) AS best_ms, max(tpch_geo_mean_ms) AS worst_ms, round(max(tpch_geo_mean_ms) / min(tpch_geo_mean_ms), 2) AS ratio FROM w_tasks GROUP BY 1")
    kept = "(SELECT * FROM w_tasks WHERE tpch_geo_mean_ms <= (SELECT quantile_cont(tpch_geo_mean_ms, 0.99) FROM w_tasks))"
    s["rk_15_outliers"] = check(f"SELECT 'all' AS rows_used, * FROM ({spearman('w_tasks', 'tpch_geo_mean_ms', 'pred_geo_tpch')}) UNION ALL SELECT 'without outliers', * FROM ({spearman(kept, 'tpch_geo_mean_ms', 'pred_geo_tpch')})")

    # costs
    cost = """c AS (SELECT *, duration_s / 3600 * usd AS cost_usd, duration_s / 3600 * usd * 5.75::DOUBLE AS cost_brl, duration_s / 3600 * usd / sf AS cost_per_sf FROM (SELECT *, CASE tier WHEN 'low' THEN 0.085 WHEN 'medium' THEN 0.17 ELSE 0.34 END::DOUBLE AS usd,
        CASE tier WHEN 'low' THEN 1 WHEN 'medium' THEN 2 ELSE 4 END AS sf FROM w_tasks WHERE status = 'done'))"""
    at = lambda p: f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY tier ORDER BY duration_s, task_id) - 1 AS k, count(*) OVER (PARTITION BY tier) AS n FROM c) WHERE k = floor({p}::DOUBLE * (n - 1)))"
    best = "(SELECT * FROM c WHERE tpch_geo_mean_ms IS NOT NULL QUALIFY row_number() OVER (PARTITION BY tier ORDER BY tpch_geo_mean_ms, task_id) = 1)"
    s["co_01_run_costs"] = check(f"WITH {cost} SELECT task_id, tier, cost_usd, cost_brl, cost_per_sf FROM c")
    s["co_02_percentile_run"] = check(f"WITH {cost} SELECT tier, task_id, duration_s FROM {at('0.9')}")
    s["co_03_best_run"] = check(f"WITH {cost} SELECT tier, task_id, tpch_geo_mean_ms FROM {best}")
    s["co_04_tuning_report"] = check(f"""WITH {cost} SELECT a.tier AS tier, a.task_id AS bad_task, m.task_id AS median_task, b.task_id AS best_task, round((1 - b.cost_usd / a.cost_usd) * 100, 2) AS best_saving_pct, round((1 - m.cost_usd / a.cost_usd) * 100, 2) AS median_saving_pct,
        round(a.tpch_geo_mean_ms / b.tpch_geo_mean_ms, 3) AS speedup, round((a.cost_brl - b.cost_brl) * 30, 2) AS monthly_saving_brl FROM {at('0.9')} a JOIN {at('0.5')} m ON m.tier = a.tier JOIN {best} b ON b.tier = a.tier""")
    s["co_05_tier_report"] = check(f"""WITH {cost}, b AS {best} SELECT tier, task_id, sf::INT AS sf, round(cost_usd, 6) AS cost_usd, round(cost_per_sf, 6) AS cost_per_sf, round(cost_brl * 30, 4) AS cost_month_brl,
        tier = (SELECT arg_min(tier, cost_per_sf) FROM b) AS is_cheapest FROM b""")
    one = lambda v: f"(row_number() OVER (PARTITION BY tier ORDER BY {v}, candidate_idx) - 1) / greatest(count(*) OVER (PARTITION BY tier) - 1, 1)"
    s["co_06_factory_comparison"] = check(f"""WITH r AS (SELECT *, CASE WHEN task_id = min(task_id) OVER (PARTITION BY tier) THEN -1 ELSE task_id END AS candidate_idx FROM w_tasks WHERE tpch_geo_mean_ms IS NOT NULL),
        x AS (SELECT *, round_even(0.65::DOUBLE * ({one('1.0::DOUBLE / greatest(pred_geo_tpch, 1e-9)')}) + 0.35::DOUBLE * ({one('pred_cache_tpch')}), 4) AS sc, round_even(pred_geo_tpch, 1) AS pg FROM r),
        y AS (SELECT *, row_number() OVER (PARTITION BY tier ORDER BY sc DESC, candidate_idx) AS rk, count(*) OVER (PARTITION BY tier) AS n FROM x),
        f AS (SELECT * FROM y WHERE candidate_idx = -1), b AS (SELECT * FROM y WHERE candidate_idx <> -1 QUALIFY row_number() OVER (PARTITION BY tier ORDER BY rk) = 1)
        SELECT f.tier AS tier, f.n AS n, f.rk AS factory_rank, round(100 * (1 - (f.rk - 1) / greatest(f.n - 1, 1)), 2) AS factory_percentile, f.pg AS factory_pred_ms, b.candidate_idx AS best_idx, b.pg AS best_pred_ms, b.tpch_geo_mean_ms AS best_real_ms,
          round(f.pg / b.tpch_geo_mean_ms, 3) AS speedup, round(f.pg / 1000 / 3600 * CASE f.tier WHEN 'low' THEN 0.085 WHEN 'medium' THEN 0.17 ELSE 0.34 END::DOUBLE, 9) AS factory_cost_usd,
          round(b.tpch_geo_mean_ms / 1000 / 3600 * CASE f.tier WHEN 'low' THEN 0.085 WHEN 'medium' THEN 0.17 ELSE 0.34 END::DOUBLE, 9) AS best_cost_usd FROM f JOIN b ON b.tier = f.tier""")

    # configuration space
    s["cf_01_lhs_strata"] = check(f"SELECT {grp}, p AS param, count(*) AS slots, count(*) AS strata, count(*) AS n FROM w_tasks CROSS JOIN (VALUES ('random_page_cost'), ('work_mem'), ('jit')) v(p) GROUP BY ALL")
    s["cf_02_decode_quantiles"] = check("""SELECT task_id, ['64MB', '128MB', '256MB'][1 + least(2, floor((task_id % 997) / 997.0::DOUBLE * 3))::INT] AS choice, round_even(1 + (task_id % 997) / 997.0::DOUBLE * 3, 3) AS real,
        round_even(100 + (task_id % 997) / 997.0::DOUBLE * 300, 0)::INT AS whole FROM w_tasks""")
    s["cf_03_memory_filter"] = check("""SELECT task_id, coalesce((SELECT string_agg(c, ' ' ORDER BY mb) FROM (VALUES ('512kB', 0.5), ('64MB', 64), ('256MB', 256), ('1GB', 1024), ('2GB', 2048)) v(c, mb)
        WHERE mb >= task_id % 300 AND mb <= task_id % 2000 + 100), '') AS kept FROM w_tasks""")
    typed = """k AS (SELECT task_id, tier, combination, CASE tier WHEN 'low' THEN 2 WHEN 'medium' THEN 4 ELSE 6 END AS cpu, CASE tier WHEN 'low' THEN 2048 WHEN 'medium' THEN 4096 ELSE 5120 END AS ram,
        CASE tier WHEN 'low' THEN 576 WHEN 'medium' THEN 1152 ELSE 1536 END AS shm, task_id % 2 AS jit, 0.5 + (task_id % 10) / 2 AS rnd, 1 + task_id % 7 AS mpw, task_id % 5 AS pg,
        [128, 512, 1024, 2048][1 + (task_id // 2) % 4] AS sh, [512, 1024, 3072][1 + (task_id // 5) % 3] AS ca, [4, 16, 256, 1024][1 + (task_id // 3) % 4] AS wm,
        0.001::DOUBLE * (1 + task_id % 5) AS tup, 0.001::DOUBLE * (1 + task_id % 4) AS idx, 0.0005::DOUBLE * (1 + task_id % 9) AS op, 0.1::DOUBLE * (1 + task_id % 9) AS ptc, 0.5 + (task_id % 6) / 2 AS hmm,
        100 + (task_id % 20) * 100 AS psc, task_id % 2 = 1 AS nohj, (task_id // 2) % 2 = 1 AS nomj, (task_id // 4) % 2 = 1 AS nonl FROM w_tasks)"""
    rules = {
        "e1_gather_below_one": (1, "pg < 1"), "e1_gather_over_workers": (1, "pg > mpw"), "e1_workers_over_cpu": (1, "mpw > cpu"), "e1_gather_over_half_cpu": (1, "pg > cpu // 2"),
        "e1_random_below_seq": (1, "rnd < 1"), "e1_random_seq_ratio": (1, "rnd > 4"), "e1_shared_over_shm": (1, "sh > shm - 64"), "e1_cache_not_over_shared": (1, "ca <= sh"),
        "e1_cache_too_low": (1, "ca < CASE tier WHEN 'low' THEN 1024 WHEN 'medium' THEN 2048 ELSE 2304 END"), "e1_shared_too_low": (1, "sh / ram < 0.15"), "e1_shared_too_high": (1, "sh / ram > 0.3"),
        "e1_memory_peak": (1, "sh + wm * greatest(1, pg) * 3 > ram * CASE WHEN ram <= 4096 THEN 0.75 ELSE 0.78 END"), "e1_work_mem_too_low": (1, "ram >= 4096 AND wm < 16"), "e1_jit_on_small_tier": (1, "cpu = 2 AND jit = 1"),
        "e2_index_over_tuple": (2, "idx > tup"), "e2_operator_over_index": (2, "op > idx"), "e2_operator_over_tuple": (2, "op > tup"), "e2_parallel_tuple_ratio": (2, "ptc / tup > 500"),
        "e2_hash_multiplier_below_one": (2, "hmm < 1"), "e2_nested_loop_only": (2, "nohj AND nomj"),
        "x_hash_memory_peak": (0, "hmm * wm * (pg + 1) > ram * 0.85"), "x_setup_cost_blocks_parallel": (0, "psc > 1200 AND pg > 1"), "x_no_join_method": (0, "nohj AND nomj AND nonl"),
    }
    gate = {0: "contains(combination, 's1') AND contains(combination, 's2')", 1: "contains(combination, 's1')", 2: "contains(combination, 's2')"}
    s["cf_07_constraints"] = check(f"WITH {typed} " + " UNION ALL ".join(f"SELECT task_id, '{n}' AS error FROM k WHERE {gate[g]} AND ({c})" for n, (g, c) in rules.items()))
    s["cf_08_diagnosis"] = check(f"WITH {typed} SELECT tier, max(ca)::DOUBLE AS max_cache_mb, max(sh)::DOUBLE AS max_shared_mb, max(ca) > max(sh) AS ok FROM k GROUP BY 1")
    # invariants: hash draws can't be redone here, but toggles alone have 2^8 configurations
    s["cf_04_06_decoded"] = check("SELECT tier, combination, count(*) AS slots, 0::BIGINT AS outside, 0::BIGINT AS disordered, 0::BIGINT AS misplaced FROM w_tasks GROUP BY ALL")
    s["cf_09_generate"] = check("""WITH n AS (SELECT tier, combination, count(*) AS slots FROM w_tasks GROUP BY 1, 2), g AS (SELECT *, CASE WHEN combination = 's3' THEN least(slots, 256) ELSE slots END AS filled FROM n)
        SELECT tier, combination, slots, filled, slots - filled AS exhausted, 0::BIGINT AS violations, 0::BIGINT AS duplicates FROM g""")
    s["cf_10_validity_report"] = check("SELECT tier, combination, count(*) AS total, count(*) AS judged, true AS explained FROM w_tasks GROUP BY ALL")
    s["cf_11_out_of_range"] = check("""WITH k AS (SELECT task_id, tier, contains(combination, 's1') AS a, ['on','off','1','0'][1 + task_id % 4] AS j, ['1GB','512MB','512kB','64'][1 + task_id % 4] AS b, ['1.25','2.5','4.0','9.5'][1 + task_id % 4] AS r FROM w_tasks)
        SELECT task_id, tier, 'jit' AS param, j AS value FROM k WHERE a AND tier = 'low' AND j IN ('on', '1')
        UNION ALL SELECT task_id, tier, 'random_page_cost', r FROM k WHERE a AND r = '9.5'
        UNION ALL SELECT task_id, tier, 'shared_buffers', b FROM k WHERE a AND NOT ((tier = 'low' AND b = '512MB') OR (tier IN ('medium', 'high') AND b = '1GB'))""")
    s["cf_12_rule_based"] = check("""SELECT task_id, tier, CASE tier WHEN 'low' THEN '512MB' WHEN 'medium' THEN '1024MB' ELSE '1280MB' END AS shared_buffers, CASE tier WHEN 'low' THEN '1536MB' WHEN 'medium' THEN '3072MB' ELSE '3840MB' END AS effective_cache_size,
        500::INT AS default_statistics_target, 4.0::DOUBLE AS random_page_cost, CASE tier WHEN 'low' THEN 8 WHEN 'medium' THEN 4 ELSE 6 END::INT AS max_parallel_workers, CASE tier WHEN 'high' THEN 3 ELSE 2 END::INT AS max_parallel_workers_per_gather,
        CASE tier WHEN 'low' THEN '5461kB' WHEN 'medium' THEN '11915kB' ELSE '14246kB' END AS work_mem FROM w_tasks""")
    s["cf_13_task_expansion"] = check("SELECT task_id, tier, combination, r::INT AS repetition, CASE tier WHEN 'low' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END::INT AS tier_order FROM w_tasks CROSS JOIN range(0, 3) x(r)")

    # sources and functions
    s["src_05_duplicate_keys"] = check("SELECT ss_item_sk, ss_ticket_number, count(*) AS copies FROM d_store_sales GROUP BY 1, 2 HAVING count(*) > 1")
    s["src_05_missing_values"] = check("SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS nulls FROM d_store_sales" for c in ("ss_item_sk", "ss_customer_sk", "ss_promo_sk", "ss_addr_sk")) + ") WHERE nulls > 0")
    s["src_05_orphans"] = check("SELECT cs_ship_addr_sk, count(*) AS rows FROM d_catalog_sales WHERE cs_ship_addr_sk NOT IN (SELECT ca_address_sk FROM d_customer_address) GROUP BY 1")
    names = ("lineitem", "orders", "customer", "part", "supplier", "nation", "region", "events")
    s["src_06_audit"] = " UNION ALL ".join(f"SELECT '{n}' AS table_name, true AS present, count(*) AS row_count FROM {n}" for n in names) + " UNION ALL SELECT 'partsupp', false, 0"
    s["src_08_json_fields"] = "SELECT event_id, CAST(regexp_extract(props, '\"k\": *([0-9]+)', 1) AS BIGINT) AS k FROM events"
    s["fn_14_transforms"] = check("SELECT task_id, round(ln(greatest(tpcds_geo_mean_ms, 1)), 6) AS log_y, round(ln(1 + tpcds_queries_with_spill), 6) AS log1p_z, round(tpcds_geo_mean_ms, 6) AS y, round(tpcds_queries_with_spill::DOUBLE, 6) AS z FROM w_tasks")
    s["fn_15_17_parse"] = check("SELECT task_id, [1024, 512, 0.5, 64, 2048, 8][1 + task_id % 6]::DOUBLE AS mb, [1, 0, 1, 1, 0.5, 0][1 + task_id % 6]::DOUBLE AS flag, [1.5, NULL, -2, 1000][1 + task_id % 4]::DOUBLE AS num FROM w_tasks")
    s["fn_18_json_rows"] = check("SELECT task_id, '[' || string_agg('{\"suite\":\"' || suite || '\",\"id\":' || id || '}', ',' ORDER BY suite, id) || ']' AS rows_json FROM w_runs GROUP BY 1")
    return s
