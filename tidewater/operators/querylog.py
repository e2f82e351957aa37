"""Query-log metrics: plan records, failure classes, per-suite summaries, counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.functions.semantics import agg, ordered

# What a censored run counts as, in milliseconds.
TIMEOUT_MS = 900_000.0
OOM_MS = 1_350_000.0
OOM_EXIT = 137

PLAN_SCHEMA = (
    "`Plan` struct<`Actual Rows`: bigint, `Shared Hit Blocks`: bigint, `Shared Read Blocks`: bigint, `Shared Written Blocks`: bigint, "
    "`Shared Dirtied Blocks`: bigint, `Temp Read Blocks`: bigint, `Temp Written Blocks`: bigint, `Workers Planned`: int, `Workers Launched`: int>, "
    "`Planning Time` double, `Execution Time` double"
)
LOG_KEYS = ["task_id", "suite", "id"]


def plan_records(runs: DataFrame, plan: str = "plan_json") -> DataFrame:
    """Root-node measures of each run's plan; hit and read default to zero."""
    p = F.from_json(plan, PLAN_SCHEMA)
    node = lambda name: F.col("_p").getField("Plan").getField(name)
    out = runs.withColumn("_p", p)
    ran = F.col(plan).isNotNull()
    return (
        out.withColumn("plan_ms", F.col("_p").getField("Planning Time"))
        .withColumn("exec_ms", F.col("_p").getField("Execution Time"))
        .withColumn("rows", node("Actual Rows"))
        .withColumn("shared_hit", F.when(ran, F.coalesce(node("Shared Hit Blocks"), F.lit(0))))
        .withColumn("shared_read", F.when(ran, F.coalesce(node("Shared Read Blocks"), F.lit(0))))
        .withColumn("shared_written", node("Shared Written Blocks"))
        .withColumn("shared_dirtied", node("Shared Dirtied Blocks"))
        .withColumn("temp_read_blocks", node("Temp Read Blocks"))
        .withColumn("temp_written_blocks", node("Temp Written Blocks"))
        .withColumn("workers_planned", node("Workers Planned"))
        .withColumn("workers_launched", node("Workers Launched"))
        .drop("_p")
    )


def hit_ratio(hit: str, read: str) -> Column:
    """Cache-hit percentage to two digits; NULL when nothing was touched."""
    return F.expr(f"case when {hit} + {read} > 0 then bround(cast({hit} as double) / ({hit} + {read}) * 100, 2) end")


def classify(runs: DataFrame) -> DataFrame:
    """Failure class of each run, and the censored time that stands for it."""
    message = F.lower("error")
    reason = (
        F.when(F.col("error").isNull(), "ok")
        .when(F.col("exit_code") == OOM_EXIT, "oom")
        .when(message.contains("statement timeout") | message.contains("canceling statement"), "timeout")
        .otherwise("technical")
    )
    out = runs.withColumn("failure_reason", reason).withColumn("success", F.col("failure_reason") == "ok")
    return out.withColumn(
        "exec_ms",
        F.when(F.col("success"), F.col("exec_ms"))
        .when(F.col("failure_reason") == "timeout", F.lit(TIMEOUT_MS))
        .when(F.col("failure_reason") == "oom", F.lit(OOM_MS)),
    )


def query_log(runs: DataFrame) -> DataFrame:
    """One row per task, suite and query, ready for every metric below. No shuffle."""
    return classify(plan_records(runs)).withColumn("cache_hit_ratio", hit_ratio("shared_hit", "shared_read"))


def overhead(log: DataFrame) -> DataFrame:
    """Fixed cost around successful runs, never below zero."""
    ms = F.greatest(F.lit(0.0), F.expr("wall_ms - exec_ms - coalesce(plan_ms, 0)"))
    return log.where("success").select(*LOG_KEYS, F.bround(ms, 3).alias("overhead_ms"))


def suite_summary(log: DataFrame) -> DataFrame:
    """Every scalar of a suite's summary from one shuffle by task and suite.

    The rows of a task's suite are at most its queries. They are numbered by time, and the median and the 95th percentile are the
    times with certain numbers, so all aggregates are plain sums and bounds over rows that lie together: no list is built.
    """
    timed = "failure_reason in ('ok', 'timeout', 'oom') and exec_ms is not null"
    suite = Window.partitionBy("task_id", "suite")
    numbered = log.withColumn("_ms", F.expr(f"case when {timed} then exec_ms end"))
    numbered = numbered.withColumns({"_at": F.row_number().over(suite.orderBy(F.col("_ms").asc_nulls_last())), "_n": F.count("_ms").over(suite)})
    ok = "failure_reason = 'ok'"
    # the middle one or two
    middle = "0.5D * max(_ms) filter (where _at = (_n + 1) div 2) + 0.5D * max(_ms) filter (where _at = _n div 2 + 1)"
    out = numbered.groupBy("task_id", "suite").agg(
        *agg(
            *[f"count_if(failure_reason = '{r}') as n_queries_{n}" for r, n in (("ok", "successful"), ("timeout", "timed_out"), ("oom", "oom"), ("technical", "technical"))],
            "bround(sum(_ms), 3) as total_exec_ms",
            "case when every(exec_ms > 0) filter (where _ms is not null) then bround(exp(avg(ln(_ms))), 3) end as geo_mean_exec_ms",
            "bround(max(_ms), 3) as max_exec_ms",
            "bround(min(_ms), 3) as min_exec_ms",
            "coalesce(bround(stddev_samp(_ms), 3), 0.0D) as stddev_exec_ms",
            *[f"coalesce(sum({c}) filter (where {ok}), 0) as total_{c}" for c in ("shared_hit", "shared_read", "temp_read_blocks", "temp_written_blocks")],
            f"count_if({ok} and temp_written_blocks > 0) as queries_with_spill",
            f"count_if({ok} and workers_launched > 0) as queries_with_parallelism",
            f"coalesce(bround(avg(coalesce(workers_launched, 0)) filter (where {ok}), 2), 0.0D) as avg_workers_launched",
            f"bround({middle}, 3) as median_exec_ms",
            "bround(max(_ms) filter (where _at = cast(floor(_n * 0.95D) as int) + 1), 3) as p95_exec_ms",
        )
    )
    return out.withColumn("overall_cache_hit_ratio", hit_ratio("total_shared_hit", "total_shared_read"))


def outcome_counts(log: DataFrame, planned: dict[str, int]) -> DataFrame:
    """Successes, and failures as planned minus successes."""
    plan = F.create_map(*[F.lit(x) for pair in planned.items() for x in pair])
    out = log.groupBy("task_id", "suite").agg(F.count_if("success").alias("n_success"))
    return out.withColumn("n_failed", plan[F.col("suite")] - F.col("n_success"))


def query_maps(log: DataFrame) -> DataFrame:
    """Per-query maps keyed ``q{id}``; bounded by the suite's queries."""

    def packed(value):
        entries = F.array_sort(F.collect_list(F.struct(F.concat(F.lit("q"), F.col("id").cast("string")).alias("k"), F.col(value).alias("v"))))
        return F.map_from_entries(entries)

    return log.groupBy("task_id", "suite").agg(
        packed("exec_ms").alias("exec_ms_per_query"), packed("wall_ms").alias("wall_ms_per_query"), packed("failure_reason").alias("failure_reason_per_query")
    )


def running_counts(log: DataFrame) -> DataFrame:
    """Successes and failures so far after each query of a task's suite."""
    line = Window.partitionBy("task_id", "suite").orderBy("id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return log.select(
        *LOG_KEYS, F.count_if("success").over(line).alias("ok_so_far"), F.count_if(~F.col("success")).over(line).alias("failed_so_far")
    )


def task_duration(changes: DataFrame) -> DataFrame:
    """First and last state change of a task and the seconds between them."""
    out = changes.groupBy(F.col("id").alias("task_id")).agg(F.min("updated_at").alias("started_at"), F.max("updated_at").alias("finished_at"))
    micros = F.expr("unix_micros(to_timestamp(finished_at)) - unix_micros(to_timestamp(started_at))")
    return out.withColumn("duration_s", F.bround(micros / 1e6, 3))


def database_ratio(counters: DataFrame) -> DataFrame:
    return counters.withColumn("cache_hit_pct", hit_ratio("blks_hit", "blks_read"))


def index_use(counters: DataFrame) -> DataFrame:
    """Share of scans through an index, most sequential reads first."""
    pct = hit_ratio("coalesce(idx_scan, 0)", "seq_scan")
    return ordered(counters.select("relname", "seq_scan", "seq_tup_read", "idx_scan", pct.alias("idx_scan_pct")), "-seq_tup_read", "relname")


def heap_use(counters: DataFrame) -> DataFrame:
    pct = hit_ratio("heap_blks_hit", "heap_blks_read")
    reads = F.expr("heap_blks_read + coalesce(idx_blks_read, 0)").alias("blocks_read")
    return ordered(counters.select("relname", "heap_blks_read", "heap_blks_hit", pct.alias("heap_hit_pct"), reads), "-blocks_read", "relname")


# Settings reported whatever their source.
REPORTED_SETTINGS = (
    "shared_buffers", "work_mem", "maintenance_work_mem", "effective_cache_size", "wal_buffers", "checkpoint_completion_target", "max_wal_size",
    "min_wal_size", "random_page_cost", "seq_page_cost", "cpu_tuple_cost", "cpu_index_tuple_cost", "cpu_operator_cost", "effective_io_concurrency",
    "max_worker_processes", "max_parallel_workers", "max_parallel_workers_per_gather", "parallel_tuple_cost", "parallel_setup_cost", "jit",
    "bgwriter_lru_maxpages", "bgwriter_delay", "bgwriter_lru_multiplier", "autovacuum_vacuum_cost_delay", "autovacuum_vacuum_scale_factor",
    "autovacuum_analyze_scale_factor",
)


def effective_settings(settings: DataFrame, version: str = "version") -> DataFrame:
    """Map of the settings that matter per snapshot: changed ones and the reported list."""
    kept = settings.where((F.col("source") != "default") | F.col("name").isin(*REPORTED_SETTINGS))
    latest = kept.groupBy("snapshot", "name").agg(F.max_by("setting", version).alias("setting"))
    # a map holds one entry per setting name, so its size is bounded by the catalogue
    return latest.groupBy("snapshot").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "setting")))).alias("settings"))
