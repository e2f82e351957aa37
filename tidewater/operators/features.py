"""Task documents to feature rows.

A document is one nested row, so everything per query is a lookup in its own
maps and arrays: the wide row is a projection, and no shuffle, cross join or
pivot is needed however many tasks there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.functions.values import encode
from tidewater.operators.querylog import TIMEOUT_MS
from tidewater.operators.ranks import order_statistics, settle

_QUERY = "struct<id: int, exec_ms: double, failure_reason: string>"
_SUMMARY = "struct<geo_mean_exec_ms: double, overall_cache_hit_ratio: double, queries_with_spill: bigint, exec_ms_per_query: map<string, double>, failure_reason_per_query: map<string, string>>"
_SUITE = f"struct<n_success: bigint, n_failed: bigint, total_ms: double, summary: {_SUMMARY}, queries: array<{_QUERY}>>"
DOCUMENT_SCHEMA = (
    "task_id bigint, tier string, combination string, status string, duration_s double, abandoned_reason string, "
    f"pg_config map<string, string>, tpc_h {_SUITE}, tpc_ds {_SUITE}"
)
# suite -> (column prefix, last query id, ids never run)
SUITES = {"tpc_h": ("tpch", 22, (17, 20)), "tpc_ds": ("tpcds", 99, (95,))}

# The parameters of each sampling stage, in column order.
STAGE1 = (
    "jit", "seq_page_cost", "random_page_cost", "default_statistics_target", "max_parallel_workers", "max_parallel_workers_per_gather", "max_worker_processes",
    "shared_buffers", "effective_cache_size", "work_mem", "enable_hashagg", "enable_bitmapscan", "enable_nestloop", "enable_parallel_hash", "enable_sort", "synchronous_commit",
)
STAGE2 = (
    "cpu_tuple_cost", "cpu_index_tuple_cost", "cpu_operator_cost", "parallel_setup_cost", "parallel_tuple_cost", "min_parallel_table_scan_size",
    "min_parallel_index_scan_size", "join_collapse_limit", "from_collapse_limit", "hash_mem_multiplier", "enable_mergejoin", "enable_hashjoin",
)
STAGE3 = (
    "enable_memoize", "enable_gathermerge", "enable_incremental_sort", "enable_material", "enable_indexscan", "enable_indexonlyscan", "enable_parallel_append",
    "parallel_leader_participation",
)
PARAMS = STAGE1 + STAGE2 + STAGE3
# constant in every sampled configuration, so no model input
CONSTANT_PARAMS = ("seq_page_cost", "max_worker_processes", "synchronous_commit")
# Tier -> vCPUs, memory in MB, scale factor.
TIER_HARDWARE = {"low": (2, 2048, 1), "medium": (4, 4096, 2), "high": (6, 5120, 4)}
HARDWARE = ("vcpus", "memory_mb", "sf")


def run_ids(suite: str) -> list[int]:
    _, last, skipped = SUITES[suite]
    return [i for i in range(1, last + 1) if i not in skipped]


def suite_total_ms(suite: str) -> Column:
    """The recorded total, else measured times with the time limit for every missing one."""
    queries = F.coalesce(F.col(f"{suite}.queries"), F.array().cast(f"array<{_QUERY}>"))
    measured = F.aggregate(queries, F.lit(0.0), lambda acc, q: acc + F.coalesce(q["exec_ms"], F.lit(TIMEOUT_MS)))
    imputed = measured + (F.lit(len(run_ids(suite))) - F.size(queries)) * TIMEOUT_MS
    return F.bround(F.coalesce(F.col(f"{suite}.total_ms"), imputed), 3)


def _listed(suite: str, qid: Column) -> Column:
    # the last entry of a query wins
    return F.try_element_at(F.filter(F.col(f"{suite}.queries"), lambda q: q["id"] == qid), F.lit(-1))


def _key(qid: Column) -> Column:
    return F.concat(F.lit("q"), qid.cast("string"))


def query_ms(suite: str, qid: Column) -> Column:
    """Time of one query: from the summary map if there is one, else from the list."""
    times = F.col(f"{suite}.summary.exec_ms_per_query")
    value = F.when(times.isNotNull(), F.try_element_at(times, _key(qid))).otherwise(_listed(suite, qid)["exec_ms"])
    return F.bround(F.coalesce(value, F.lit(TIMEOUT_MS)), 3)


def query_timed_out(suite: str, qid: Column) -> Column:
    """1 where the time is imputed, 0 where it was measured."""
    reasons = F.col(f"{suite}.summary.failure_reason_per_query")
    listed_ok = F.exists(F.coalesce(F.col(f"{suite}.queries"), F.array().cast(f"array<{_QUERY}>")), lambda q: (q["id"] == qid) & (q["failure_reason"] == "ok"))
    ok = F.when(reasons.isNotNull(), F.coalesce(F.try_element_at(reasons, _key(qid)) == "ok", F.lit(False))).otherwise(listed_ok)
    return F.when(ok, 0).otherwise(1)


def hardware(name: str, tier: str = "tier") -> Column:
    i = HARDWARE.index(name)
    out = F.lit(None).cast("int")
    for t, spec in TIER_HARDWARE.items():
        out = F.when(F.col(tier) == t, spec[i]).otherwise(out)
    return out


def meta_and_totals() -> list[Column]:
    cols = [F.col("task_id"), F.coalesce("tier", F.lit("")).alias("tier"), F.coalesce("combination", F.lit("")).alias("combination"),
            F.coalesce("status", F.lit("unknown")).alias("status"), F.col("duration_s"), F.coalesce("abandoned_reason", F.lit("")).alias("abandoned_reason")]
    for suite, (prefix, _, _) in SUITES.items():
        cols += [
            F.coalesce(F.col(f"{suite}.n_success"), F.lit(0)).alias(f"{prefix}_n_success"),
            F.coalesce(F.col(f"{suite}.n_failed"), F.lit(0)).alias(f"{prefix}_n_failed"),
            suite_total_ms(suite).alias(f"{prefix}_total_ms"),
            F.col(f"{suite}.summary.geo_mean_exec_ms").alias(f"{prefix}_geo_mean_ms"),
            F.col(f"{suite}.summary.overall_cache_hit_ratio").alias(f"{prefix}_cache_hit_ratio"),
            F.col(f"{suite}.summary.queries_with_spill").alias(f"{prefix}_queries_with_spill"),
        ]
    return cols


def config_columns() -> list[Column]:
    return [encode(p, F.try_element_at("pg_config", F.lit(p))).alias(f"cfg_{p}") for p in PARAMS]


def _with_recorded(documents: DataFrame) -> DataFrame:
    """Times and flags of the run queries that a document mentions, as a map by id; all others are imputed (``TIMEOUT_MS``, 1)."""
    df = documents.where("status is null or status <> 'running'")
    for suite in SUITES:
        df = df.withColumn(f"_q_{suite}", F.map_from_entries(F.transform(_recorded_ids(suite), _measured(suite))))
    return df


def _recorded_ids(suite: str) -> Column:
    summary = F.col(f"{suite}.summary")
    ids = [F.transform(F.map_keys(summary[m]), lambda k: F.substring(k, 2, 9).try_cast("int")) for m in ("exec_ms_per_query", "failure_reason_per_query")]
    ids.append(F.transform(F.col(f"{suite}.queries"), lambda q: q["id"]))
    none = F.array().cast("array<int>")
    return F.array_intersect(F.concat(*[F.coalesce(x, none) for x in ids]), F.array(*[F.lit(i) for i in run_ids(suite)]))


def _measured(suite: str):
    return lambda i: F.struct(i, F.struct(query_ms(suite, i).alias("ms"), query_timed_out(suite, i).alias("timed_out")))


_IMPUTED = {"ms": float(TIMEOUT_MS), "timed_out": 1}


def feature_rows(documents: DataFrame) -> DataFrame:
    """The 299-column feature row of every finished or abandoned task."""
    cols = meta_and_totals()
    for name, kind in (("ms", "double"), ("timed_out", "int")):
        for suite, (prefix, last, skipped) in SUITES.items():
            empty = F.lit(None).cast(kind)
            value = lambda i: F.coalesce(F.try_element_at(f"_q_{suite}", F.lit(i))[name], F.lit(_IMPUTED[name]))
            cols += [(empty if i in skipped else value(i)).alias(f"{prefix}_q{i}_{name}") for i in range(1, last + 1)]
    cols += config_columns() + [hardware(h).alias(h) for h in HARDWARE]
    return _with_recorded(documents).select(*cols)


def query_rows(documents: DataFrame) -> DataFrame:
    """Long form: one row per task and query that the suites run."""
    parts = []
    for suite in SUITES:
        parts.append(F.transform(F.array(*[F.lit(i) for i in run_ids(suite)]), _tagged(suite)))
    return _with_recorded(documents).select("task_id", F.explode(F.concat(*parts)).alias("q")).select("task_id", "q.*")


def _tagged(suite: str):
    def row(i):
        found = F.try_element_at(F.col(f"_q_{suite}"), i)
        return F.struct(F.lit(suite).alias("suite"), i.alias("id"), *[F.coalesce(found[n], F.lit(v)).alias(n) for n, v in _IMPUTED.items()])

    return row


def query_totals(documents: DataFrame) -> DataFrame:
    """(suite, id, tasks, total_ms, least_ms, timeouts) of ``query_rows`` by query, from the recorded rows: all others are alike and only counted."""
    entry = lambda suite: lambda e: F.struct(F.lit(suite).alias("suite"), e["key"].alias("id"), e["value"]["ms"].alias("ms"), e["value"]["timed_out"].alias("timed_out"))
    task = F.array(F.expr("named_struct('suite', cast(null as string), 'id', 0, 'ms', 0.0D, 'timed_out', 0)"))
    rows = _with_recorded(documents).select(F.explode(F.concat(task, *[F.transform(F.map_entries(f"_q_{s}"), entry(s)) for s in SUITES])).alias("q")).select("q.*")
    # a row for each query
    found = settle(rows.groupBy("suite", "id").agg(F.count("*").alias("_n"), F.sum("ms").alias("_sum"), F.min("ms").alias("_min"), F.sum("timed_out").alias("_out")))
    ids = F.array(*[F.struct(F.lit(s).alias("suite"), F.lit(i).alias("id")) for s in SUITES for i in run_ids(s)])
    every = found.where("suite is null").select(F.col("_n").alias("tasks"), F.explode(ids).alias("q")).select("q.*", "tasks")
    rest = F.col("tasks") - F.coalesce("_n", F.lit(0))
    return every.join(found, ["suite", "id"], "left").select(
        "suite", "id", "tasks", (F.coalesce("_sum", F.lit(0.0)) + rest * F.lit(float(TIMEOUT_MS))).alias("total_ms"),
        F.least("_min", F.when(rest > 0, F.lit(float(TIMEOUT_MS)))).alias("least_ms"), (F.coalesce("_out", F.lit(0)) + rest).alias("timeouts"),
    )


def imputed_counts(documents: DataFrame) -> DataFrame:
    """(task_id, suite, imputed, queries) of ``query_rows`` by task and suite, counted within each document."""
    one = lambda s: F.struct(F.lit(s).alias("suite"), (len(run_ids(s)) - F.size(F.filter(F.map_values(f"_q_{s}"), lambda v: v["timed_out"] == 0))).alias("imputed"), F.lit(len(run_ids(s))).alias("queries"))
    rows = _with_recorded(documents).select("task_id", F.explode(F.array(*[one(s) for s in SUITES])).alias("q")).select("task_id", "q.*")
    return rows.groupBy("task_id", "suite").agg(F.sum("imputed").alias("imputed"), F.sum("queries").alias("queries"))


def dataset_profile(rows: DataFrame) -> DataFrame:
    """Counts by status, tier and combination from one grouped pass."""
    base = rows.groupBy("status", "tier", "combination").agg(F.count(F.lit(1)).alias("n"))
    packed = F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).alias("value")) for d in ("status", "tier", "combination")])
    return base.select(F.explode(packed).alias("d"), "n").groupBy("d.dimension", "d.value").agg(F.sum("n").alias("n"))


def target_ranges(rows: DataFrame) -> DataFrame:
    """Least, mean and greatest suite totals of finished tasks, in seconds."""
    done = rows.where("status = 'done'")
    cols = []
    for prefix, _, _ in SUITES.values():
        c = f"{prefix}_total_ms"
        cols += [F.bround(f(c) / 1000, 3).alias(f"{prefix}_{n}_s") for n, f in (("min", F.min), ("avg", F.avg), ("max", F.max))]
    return done.agg(*cols)


def _melt(wide: DataFrame, names: list[str], pattern: str, fields: list[str]) -> DataFrame:
    packed = F.array(*[F.struct(F.lit(n).alias("column"), *[F.col(f"`{pattern.format(n, f)}`").alias(f) for f in fields]) for n in names])
    return wide.select(F.explode(packed).alias("m")).select("m.*")


def missing_share(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Percentage of NULLs per column, columns with none left out; ten worst first."""
    shares = rows.agg(*[(F.avg(F.col(c).isNull().cast("double")) * 100).alias(f"{c}|pct") for c in columns])
    out = _melt(shares, columns, "{}|{}", ["pct"]).where("pct > 0").select("column", F.bround("pct", 1).alias("missing_pct"))
    return out.orderBy(F.col("missing_pct").desc(), "column").limit(10)


def column_audit(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Columns that are always NULL or never vary."""
    stats = []
    for c in columns:
        stats += [F.count(c).alias(f"{c}|seen"), F.min(c).cast("double").alias(f"{c}|low"), F.max(c).cast("double").alias(f"{c}|high")]
    out = _melt(rows.agg(*stats), columns, "{}|{}", ["seen", "low", "high"])
    return out.select("column", "seen", (F.col("seen") == 0).alias("always_null"), F.expr("seen > 0 and low = high").alias("zero_variance"))


def timeout_frequency(documents: DataFrame) -> DataFrame:
    """How often each query's time was imputed."""
    out = query_totals(documents).select("suite", "id", "timeouts", "tasks")
    return out.orderBy(F.col("timeouts").desc(), "suite", "id")


def impute_median(rows: DataFrame, columns: list[str]) -> DataFrame:
    """NULLs become the column median, with an indicator; columns never seen become -1."""
    medians = order_statistics(rows, {f"_m_{c}": (c, 0.5) for c in columns})
    out = rows.crossJoin(medians)
    kept = [c for c in rows.columns if c not in columns]
    filled = [F.coalesce(F.col(c).cast("double"), F.col(f"_m_{c}"), F.lit(-1.0)).alias(c) for c in columns]
    flags = [F.col(c).isNull().cast("int").alias(f"{c}__was_missing") for c in columns]
    return out.select(*kept, *filled, *flags)


def config_of(row_columns: list[str]) -> Column:
    """The configuration map of a wide row: sampled parameters only."""
    entries = [x for c in row_columns for x in (F.lit(c.removeprefix("cfg_")), F.col(c))]
    return F.map_filter(F.create_map(*entries), lambda k, v: v.isNotNull())


def documents_from(tasks: DataFrame, log: DataFrame, summary: DataFrame, config: Column) -> DataFrame:
    """Assemble documents from a task table, its query log and suite summaries.

    Finished tasks carry summaries, abandoned ones the list of their queries. A
    task has at most one entry per query, which bounds every collected list.
    """
    per_suite = []
    for suite in SUITES:
        mine = F.col("suite") == suite
        entry = F.when(mine, F.struct(F.col("id"), F.col("exec_ms"), F.col("failure_reason")))
        per_suite.append(F.array_sort(F.collect_list(entry)).alias(f"_{suite}"))
    lists = log.groupBy("task_id").agg(*per_suite)
    stats = F.struct("geo_mean_exec_ms", "overall_cache_hit_ratio", "queries_with_spill", "total_exec_ms", "n_queries_successful")
    sums = summary.groupBy(F.col("task_id").alias("_tid")).agg(*[F.first(F.when(F.col("suite") == s, stats), ignorenulls=True).alias(f"_s_{s}") for s in SUITES])
    rows = tasks.join(lists, "task_id", "left").join(sums, F.col("task_id") == F.col("_tid"), "left")
    done = F.col("status") == "done"
    cols = [F.col(c) for c in ("task_id", "tier", "combination", "status", "duration_s", "abandoned_reason")] + [config.alias("pg_config")]
    for suite in SUITES:
        listed = F.coalesce(F.col(f"_{suite}"), F.array().cast(f"array<{_QUERY}>"))
        s = F.col(f"_s_{suite}")
        named = lambda field, q=listed: F.map_from_entries(F.transform(q, lambda e: F.struct(_key(e["id"]), e[field])))
        summary_col = F.struct(
            s["geo_mean_exec_ms"].alias("geo_mean_exec_ms"), s["overall_cache_hit_ratio"].alias("overall_cache_hit_ratio"),
            s["queries_with_spill"].alias("queries_with_spill"), named("exec_ms").alias("exec_ms_per_query"), named("failure_reason").alias("failure_reason_per_query"),
        )
        ok = F.coalesce(s["n_queries_successful"], F.lit(0))
        cols.append(
            F.struct(
                ok.alias("n_success"),
                (F.size(listed) - ok).alias("n_failed"),
                F.when(done, s["total_exec_ms"]).alias("total_ms"),
                F.when(done, summary_col).alias("summary"),
                F.when(~done, listed).alias("queries"),
            ).cast(_SUITE).alias(suite)
        )
    return rows.select(*cols)
