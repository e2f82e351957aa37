"""Cost of measured runs, within and across tiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.functions.semantics import ordered
from tidewater.operators.features import hardware
from tidewater.operators.ranking import predicted_scores
from tidewater.operators.ranks import attach_position

# Hourly price in USD by tier, exchange rate, runs per month.
TIER_PRICE = {"low": 0.085, "medium": 0.170, "high": 0.340}
BRL_PER_USD = 5.75
RUNS_PER_MONTH = 30


def _price(tier: str = "tier"):
    out = F.lit(None).cast("double")
    for name, usd in TIER_PRICE.items():
        out = F.when(F.col(tier) == name, F.lit(usd)).otherwise(out)
    return out


def run_costs(results: DataFrame) -> DataFrame:
    """Cost of each finished run in USD, BRL and USD per scale unit."""
    done = results.where("status = 'done'").withColumn("sf", hardware("sf"))
    cost = done.withColumn("cost_usd", F.col("duration_s") / 3600 * _price())
    return cost.withColumn("cost_brl", F.col("cost_usd") * BRL_PER_USD).withColumn("cost_per_sf", F.col("cost_usd") / F.col("sf"))


def at_percentile(costs: DataFrame, share: float, tie: str = "task_id") -> DataFrame:
    """The run at a percentile of duration per tier: a real row, nothing interpolated."""
    placed = attach_position(costs, "duration_s", tie, ("tier",), "_at", "_n")
    return placed.where(F.col("_at") == F.floor(F.lit(share) * (F.col("_n") - 1)) + 1).drop("_at", "_n")


def best_run(costs: DataFrame, value: str = "tpch_geo_mean_ms", tie: str = "task_id") -> DataFrame:
    """The run with the least mean query time per tier."""
    row = F.struct(*[c for c in costs.columns if c != "tier"])
    best = costs.where(F.col(value).isNotNull()).groupBy("tier").agg(F.min_by(row, F.struct(value, tie)).alias("r"))
    return best.select("tier", "r.*")


def tuning_report(costs: DataFrame) -> DataFrame:
    """Per tier: a bad, a middling and the best run, savings and speed-up."""
    bad, mid, best = at_percentile(costs, 0.9), at_percentile(costs, 0.5), best_run(costs)

    def named(df, prefix):
        cols = [F.col(c).alias(f"{prefix}_{c}") for c in ("task_id", "cost_usd", "cost_brl", "tpch_geo_mean_ms")]
        return df.select(F.col("tier").alias(f"{prefix}_tier"), *cols)

    rows = named(bad, "bad").join(named(mid, "mid"), F.col("bad_tier") == F.col("mid_tier")).join(named(best, "best"), F.col("bad_tier") == F.col("best_tier"))
    out = rows.select(
        F.col("bad_tier").alias("tier"), F.col("bad_task_id").alias("bad_task"), F.col("mid_task_id").alias("median_task"), F.col("best_task_id").alias("best_task"),
        F.round((1 - F.col("best_cost_usd") / F.col("bad_cost_usd")) * 100, 2).alias("best_saving_pct"),
        F.round((1 - F.col("mid_cost_usd") / F.col("bad_cost_usd")) * 100, 2).alias("median_saving_pct"),
        F.round(F.col("bad_tpch_geo_mean_ms") / F.col("best_tpch_geo_mean_ms"), 3).alias("speedup"),
        F.round((F.col("bad_cost_brl") - F.col("best_cost_brl")) * RUNS_PER_MONTH, 2).alias("monthly_saving_brl"),
    )
    return ordered(out, "tier")


def tier_report(costs: DataFrame) -> DataFrame:
    """Best run of each tier by cost per scale unit, the cheapest tier marked."""
    best = best_run(costs).select("tier", "task_id", "sf", F.round("cost_usd", 6).alias("cost_usd"), F.round("cost_per_sf", 6).alias("cost_per_sf"), F.round(F.col("cost_brl") * RUNS_PER_MONTH, 4).alias("cost_month_brl"))
    cheapest = best.agg(F.min_by("tier", F.struct("cost_per_sf", "tier")).alias("_c"))
    return ordered(best.crossJoin(cheapest).withColumn("is_cheapest", F.col("tier") == F.col("_c")).drop("_c"), "tier")


def factory_comparison(candidates: DataFrame, factory_idx: int, measured: str = "tpch_geo_mean_ms", by: tuple[str, ...] = ("tier",)) -> DataFrame:
    """Place of the factory configuration among the candidates of each tier."""
    scored = predicted_scores(candidates.drop(measured), "candidate_idx", by)
    is_factory = F.col("candidate_idx") == factory_idx
    factory = scored.where(is_factory).select(*[F.col(b).alias(f"_f_{b}") for b in by], F.col("score").alias("_fs"), F.col("pred_geo_tpch_ms").alias("factory_pred_ms"))
    same = [F.col(b) == F.col(f"_f_{b}") for b in by]
    beside = scored.join(factory, same)
    # an equal score with a smaller index is listed first
    ahead = ~is_factory & ((F.col("score") > F.col("_fs")) | ((F.col("score") == F.col("_fs")) & (F.col("candidate_idx") < factory_idx)))
    others = F.when(~is_factory, F.struct("score", -F.col("candidate_idx")))
    out = beside.groupBy(*by, "factory_pred_ms").agg(
        F.count(F.lit(1)).alias("n"), (F.count_if(ahead) + 1).alias("factory_rank"), F.max_by("candidate_idx", others).alias("best_idx"), F.max_by("pred_geo_tpch_ms", others).alias("best_pred_ms")
    )
    real = candidates.select(*[F.col(b).alias(f"_m_{b}") for b in by], F.col("candidate_idx").alias("_mi"), F.col(measured).alias("best_real_ms"))
    joined = out.join(real, [F.col(b) == F.col(f"_m_{b}") for b in by] + [F.col("best_idx") == F.col("_mi")])
    hours = lambda c: F.col(c) / 1000 / 3600 * _price()
    return joined.select(
        *by, "n", "factory_rank", F.round(100 * (1 - (F.col("factory_rank") - 1) / F.greatest(F.col("n") - 1, F.lit(1))), 2).alias("factory_percentile"),
        "factory_pred_ms", "best_idx", "best_pred_ms", "best_real_ms", F.round(F.col("factory_pred_ms") / F.col("best_real_ms"), 3).alias("speedup"),
        F.round(hours("factory_pred_ms"), 9).alias("factory_cost_usd"), F.round(hours("best_real_ms"), 9).alias("best_cost_usd"),
    )
