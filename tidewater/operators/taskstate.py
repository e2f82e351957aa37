"""Task-state analytics over an append-only log of state changes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.functions.semantics import ordered

STATUSES = ("pending", "running", "done", "failed", "abandoned")
# Hours a claim stays valid, by tier.
LEASE_HOURS = {"low": 3.5, "medium": 4.5, "high": 8.5}
OTHER_LEASE_HOURS = 9.0


def current_state(changes: DataFrame, order: str = "change_id") -> DataFrame:
    """The last change of each task; combined map-side, one row per task shuffled."""
    row = F.struct(*[c for c in changes.columns if c != "id"])
    latest = changes.groupBy("id").agg(F.max_by(row, F.struct("updated_at", order)).alias("s"))
    return latest.select("id", "s.*")


def status_counts(state: DataFrame) -> DataFrame:
    """Tasks per status, every known status present."""
    counts = state.agg(*[F.count_if(F.col("status") == s).alias(s) for s in STATUSES])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(s).alias("status"), F.col(s).alias("n")) for s in STATUSES])).alias("x")).select("x.*")


def listing(state: DataFrame, status: str) -> DataFrame:
    return ordered(state.where(F.col("status") == status), "id")


def lease_s(tier: str = "tier"):
    rule = F.lit(OTHER_LEASE_HOURS)
    for name, hours in LEASE_HOURS.items():
        rule = F.when(F.col(tier) == name, F.lit(hours)).otherwise(rule)
    return rule * 3600.0


def backlog(state: DataFrame, now: str) -> DataFrame:
    """Tasks that could be taken: pending ones first, then claims past their lease."""
    age = F.expr(f"(unix_micros(to_timestamp('{now}')) - unix_micros(to_timestamp(claimed_at))) / 1e6")
    out = state.withColumn("claim_age_s", age).where((F.col("status") == "pending") | ((F.col("status") == "running") & (F.col("claim_age_s") > lease_s())))
    out = out.withColumn("is_stale", F.col("status") == "running")
    return ordered(out.select("id", "tier", "status", "is_stale"), "is_stale", "id")


def retry_accounting(changes: DataFrame) -> DataFrame:
    """Abandonments by reason, and how often their tasks had failed before."""
    per_task = changes.groupBy("id").agg(F.count_if(F.col("status") == "failed").alias("retries"))
    gone = changes.where("status = 'abandoned'").groupBy("id", "abandoned_reason").agg(F.count(F.lit(1)).alias("times"))
    out = gone.join(per_task, "id").groupBy("abandoned_reason").agg(
        F.sum("times").alias("abandoned"), F.count(F.lit(1)).alias("tasks"), F.sum("retries").alias("retries")
    )
    return ordered(out, "abandoned_reason")


def status_report(state: DataFrame, totals: DataFrame) -> DataFrame:
    """Share of finished tasks and mean suite times of the finished ones, per tier."""
    joined = state.join(totals.withColumnRenamed("task_id", "id"), "id", "left")
    done = F.col("status") == "done"
    out = joined.groupBy("tier").agg(
        F.count(F.lit(1)).alias("tasks"),
        F.count_if(done).alias("done"),
        F.bround(F.avg(F.when(done, F.col("tpch_ms"))) / 1000, 3).alias("tpch_mean_s"),
        F.bround(F.avg(F.when(done, F.col("tpcds_ms"))) / 1000, 3).alias("tpcds_mean_s"),
    )
    return ordered(out.withColumn("done_pct", F.bround(F.col("done") / F.col("tasks") * 100, 1)), "tier")
