"""Check SQL of the loads, statistics and sinks."""

from __future__ import annotations

from tidewater.sources.views import with_views
from tidewater.sources.workload_views import CHECK_VIEWS

_KEYS = {"lineitem": ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"), "orders": ("o_orderkey", "o_custkey"), "customer": ("c_custkey", "c_nationkey")}


def sqls() -> dict[str, str]:
    tasks = "task_id, combination, duration_s, tpch_geo_mean_ms, tier"
    check = lambda body: with_views(CHECK_VIEWS, "w_tasks", body)
    return {
        "src_01_delimited_load": "SELECT CAST(c_custkey AS BIGINT) AS c_custkey, c_name, CASE WHEN c_custkey % 5 <> 0 THEN CAST(c_nationkey AS INT) END AS c_nationkey, CAST(CAST(c_acctbal AS DECIMAL(12,2)) AS DOUBLE) AS c_acctbal FROM customer",
        "src_02_suite_load": "SELECT 'customer' AS table_name, count(*) AS rows, CAST(sum(c_custkey) AS BIGINT) AS key_sum FROM customer UNION ALL SELECT 'supplier', count(*), CAST(sum(s_suppkey) AS BIGINT) FROM supplier",
        "src_04_statistics": " UNION ALL ".join(
            f"SELECT '{n}' AS table_name, '{c}' AS column_name, count(*) AS rows, count(*) - count({c}) AS nulls, CAST(min({c}) AS BIGINT) AS low, CAST(max({c}) AS BIGINT) AS high, true AS distinct_near FROM {n}" for n, columns in _KEYS.items() for c in columns
        ),
        "src_09_features": check(f"SELECT {tasks} FROM w_tasks WHERE tier IN (SELECT tier FROM w_tasks WHERE status = 'done' AND combination = 's1' AND tier <> 'low')"),
        "src_09_features_as_csv": check(f"SELECT {tasks} FROM w_tasks"),
        "src_12_metric_runs": check("SELECT 'a' AS run_id, tier, count(*) AS n, CAST(sum(task_id) AS BIGINT) AS task_sum FROM w_tasks GROUP BY tier UNION ALL SELECT 'b', tier, count(*), CAST(sum(task_id) AS BIGINT) FROM w_tasks WHERE status = 'done' GROUP BY tier"),
    }
