"""Scores, ranks and the quality of predicted rankings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.operators.ranks import _value_table, attach_position, attach_ranks, order_statistics, settle
from tidewater.plans.retail import group_total

GROUP = ("tier", "combination")
SLICES = 4096  # of a weighting's values, which lie between 0 and 1
# Target column, transform, direction and weight in the score.
TARGETS = {
    "geo_mean_tpch": ("tpch_geo_mean_ms", "log", "minimize", 0.65),
    "geo_mean_tpcds": ("tpcds_geo_mean_ms", "log", "minimize", 0.0),
    "cache_hit_tpch": ("tpch_cache_hit_ratio", "none", "maximize", 0.35),
    "spill_tpcds": ("tpcds_queries_with_spill", "log1p", "minimize", 0.0),
}
COMBINATIONS = ("s1", "s2", "s3", "s1_s2", "s1_s3", "s2_s3", "s1_s2_s3")


def percent_ranks(df: DataFrame, values: dict[str, str], by: tuple[str, ...] = ()) -> DataFrame:
    """Percentile ranks ``{out: value}`` with ties averaged, over the non-NULL rows of a group."""
    prefixes = {f"_p{i}_": (out, value) for i, (out, value) in enumerate(values.items())}
    ranked = attach_ranks(df, {p: value for p, (_, value) in prefixes.items()}, by)
    outs = {out: (F.col(f"{p}rank") + (F.col(f"{p}ties") - 1) / 2) / F.col(f"{p}n") for p, (out, _) in prefixes.items()}
    return ranked.withColumns(outs).drop(*[f"{p}{x}" for p in prefixes for x in ("rank", "ties", "n")])


def percent_rank(df: DataFrame, value: str, out: str, by: tuple[str, ...] = ()) -> DataFrame:
    """``percent_ranks`` of one value."""
    return percent_ranks(df, {out: value}, by)


def _better(value: str, direction: str) -> Column:
    x = F.col(value).cast("double")
    return F.lit(1.0) / F.greatest(x, F.lit(1e-9)) if direction == "minimize" else x


def composite_score(rows: DataFrame, out: str = "score", columns: dict[str, tuple[str, str, float]] | None = None, by: tuple[str, ...] = GROUP) -> DataFrame:
    """Weighted sum of percentile ranks within a group.

    A target that is NULL throughout a group adds nothing; one NULL among
    values leaves the row without a score. ``columns`` maps a name to its
    column, direction and weight.
    """
    columns = columns or {n: (c, d, w) for n, (c, _, d, w) in TARGETS.items() if w > 0}
    seen = group_total(rows, list(by), *[f"count({c}) as _seen_{n}" for n, (c, _, _) in columns.items()])
    score = F.lit(0.0)
    for name, (column, direction, weight) in columns.items():
        # NULL must stay NULL: greatest() would skip it
        seen = seen.withColumn(f"_v_{name}", F.when(F.col(column).isNotNull(), _better(column, direction)))
        score = score + F.when(F.col(f"_seen_{name}") == 0, F.lit(0.0)).otherwise(F.lit(weight) * F.col(f"_r_{name}"))
    names = list(columns)
    seen = percent_ranks(seen, {f"_r_{n}": f"_v_{n}" for n in names}, by)
    return seen.withColumn(out, score).drop(*[f"_{k}_{n}" for k in ("seen", "v", "r") for n in names])


def position_norm(df: DataFrame, value: str, out: str, tie: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Zero-based position in ascending order over n-1; ties in order of ``tie``."""
    placed = attach_position(df, value, tie, by, "_pos", "_n")
    return placed.withColumn(out, (F.col("_pos") - 1) / F.greatest(F.col("_n") - 1, F.lit(1))).drop("_pos", "_n")


PREDICTED = {"geo_mean_tpch": "pred_geo_tpch", "geo_mean_tpcds": "pred_geo_tpcds", "cache_hit_tpch": "pred_cache_tpch", "spill_tpcds": "pred_spill_tpcds"}


def predicted_scores(candidates: DataFrame, idx: str = "candidate_idx", by: tuple[str, ...] = (), weights: dict[str, float] | None = None) -> DataFrame:
    """Score of every candidate relative to its batch, with rounded predictions."""
    weights = weights or {n: w for n, (_, _, _, w) in TARGETS.items() if w > 0}
    rows, score = candidates, F.lit(0.0)
    for name, weight in weights.items():
        # positions are taken from the candidates themselves and joined by index, so each further one adds a pass and no nesting
        valued = candidates.select(*by, idx, _better(PREDICTED[name], TARGETS[name][2]).alias("_v"))
        placed = position_norm(valued, "_v", f"_r_{name}", idx, by).select(*[F.col(b).alias(f"_b_{b}") for b in by], F.col(idx).alias("_i"), f"_r_{name}")
        same = F.col(idx) == F.col("_i")
        for b in by:
            same = same & F.col(b).eqNullSafe(F.col(f"_b_{b}"))
        rows = rows.join(placed, same).drop("_i", *[f"_b_{b}" for b in by])
        score = score + F.lit(weight) * F.col(f"_r_{name}")
    return rows.select(
        *by, idx, F.bround(PREDICTED["geo_mean_tpch"], 1).alias("pred_geo_tpch_ms"), F.bround(PREDICTED["geo_mean_tpcds"], 1).alias("pred_geo_tpcds_ms"),
        F.bround(PREDICTED["cache_hit_tpch"], 2).alias("pred_cache_pct"), F.bround(PREDICTED["spill_tpcds"], 2).alias("pred_spill_tpcds"), F.bround(score, 4).alias("score"),
    )


def check_request(tier: str, combination: str) -> None:
    from tidewater.operators.features import TIER_HARDWARE

    if tier not in TIER_HARDWARE:
        raise ValueError(f"unknown tier {tier!r}; one of {sorted(TIER_HARDWARE)}")
    if combination not in COMBINATIONS:
        raise ValueError(f"unknown combination {combination!r}; one of {COMBINATIONS}")


def recommend(candidates: DataFrame, k: int = 5, by: tuple[str, ...] = GROUP, idx: str = "candidate_idx") -> DataFrame:
    """The k best candidates of every batch, best first."""
    scored = predicted_scores(candidates, idx, by)
    order = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    ranked = scored.withColumn("rank", F.row_number().over(order.orderBy(F.col("score").desc(), idx)))
    return ranked.where(F.col("rank") <= k)


def _correlation(df: DataFrame, actual: str, predicted: str, by: tuple[str, ...]) -> DataFrame:
    """RMSE, rank correlation (rho) and row count of predictions, not rounded."""
    rows = df.where(F.col(actual).isNotNull() & F.col(predicted).isNotNull())
    ranked = percent_ranks(rows, {"_ra": actual, "_rp": predicted}, by)
    err = F.col(actual).cast("double") - F.col(predicted).cast("double")
    return ranked.groupBy(*by).agg(F.sqrt(F.avg(err * err)).alias("rmse"), F.corr("_ra", "_rp").alias("rho"), F.count(F.lit(1)).alias("n"))


def rmse_spearman(df: DataFrame, actual: str, predicted: str, by: tuple[str, ...] = ()) -> DataFrame:
    """RMSE, rank correlation and row count of predictions."""
    return _correlation(df, actual, predicted, by).select(*by, F.round("rmse", 4).alias("rmse"), F.round("rho", 4).alias("spearman_rho"), "n")


def counted_correlation(counted: DataFrame, value: str, by: str, n: str, centred: str, total: DataFrame) -> DataFrame:
    """(by, spearman_rho): rank correlation of each group from its values, how many rows have each (``n``) and the sum of these rows'
    other ranks less their mean (``centred``). ``total`` is one row of the sum of squares of all centred ranks, the same in every group.
    """
    table = _value_table(counted, [value], [by], False, None, n, centred)
    rank = (F.col("__before") + (F.col("__ties") + 1) / 2) / F.col("__n") - (F.col("__n") + 1) / (2 * F.col("__n"))
    sums = table.groupBy(F.col("__b0").alias(by)).agg(F.sum(F.col("__sum") * rank).alias("_both"), F.sum(F.col("__ties") * rank * rank).alias("_own"))
    return sums.crossJoin(total).select(by, F.round(F.try_divide("_both", F.sqrt(F.col("_own") * F.col("_squares"))), 4).alias("spearman_rho"))


def group_spearman(df: DataFrame, actual: str, predicted: str, by: tuple[str, ...] = GROUP, least: int = 4) -> DataFrame:
    """Rank correlation inside each group of at least ``least`` rows."""
    out = rmse_spearman(df, actual, predicted, by).where(F.col("n") >= least)
    return out.select(*by, "spearman_rho", "n")


def _top3(df: DataFrame, value: str, idx: str, by: tuple[str, ...], name: str, ascending: bool = False) -> DataFrame:
    order = F.col(value).asc_nulls_last() if ascending else F.col(value).desc_nulls_last()
    # three rows per group and task survive before the shuffle
    placed = df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(order, idx))).where(F.col(name) <= 3)
    return placed.select(*by, idx, name)


def top3_agreement(df: DataFrame, actual: str, predicted: str, idx: str = "task_id", by: tuple[str, ...] = GROUP, least: int = 4, predicted_ascending: bool = False, actual_ascending: bool = False) -> DataFrame:
    """Per group: is the predicted best among the true three best, and how many of three agree."""
    rows = df.where(F.col(actual).isNotNull() & F.col(predicted).isNotNull())
    sizes = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    real = _top3(rows, actual, idx, by, "real_place", actual_ascending)
    guess = _top3(rows, predicted, idx, by, "pred_place", predicted_ascending)
    both = guess.join(real, [*by, idx], "left").groupBy(*by).agg(
        F.count_if((F.col("pred_place") == 1) & F.col("real_place").isNotNull()).alias("best_hit"), F.count("real_place").alias("overlap")
    )
    return both.join(sizes, list(by)).select(*by, "best_hit", "overlap", "n")


def ranking_quality(df: DataFrame, actual: str, predicted: str, idx: str = "task_id", by: tuple[str, ...] = GROUP) -> DataFrame:
    """One row: global and mean in-group correlation, precision at one, top-3 overlap."""
    groups = top3_agreement(df, actual, predicted, idx, by)
    hits = groups.agg(
        F.round(F.sum("best_hit") / F.count(F.lit(1)), 4).alias("precision_at1_top3"),
        F.round(F.sum("overlap") / (F.count(F.lit(1)) * 3) * 100, 2).alias("top3_overlap_pct"),
        F.count(F.lit(1)).alias("n_groups"),
    )
    inside = _correlation(df, actual, predicted, by).where("n >= 4 and not isnan(rho)").agg(F.round(F.avg("rho"), 4).alias("score_intra_rho_avg"))
    overall = rmse_spearman(df, actual, predicted).select(F.col("spearman_rho").alias("score_global_rho"))
    return overall.crossJoin(inside).crossJoin(hits)


def weight_search(rows: DataFrame, by: tuple[str, ...] = GROUP) -> DataFrame:
    """Rank correlation of the predicted with the real score for twelve weightings; each has its row, without data too.

    Rows without a known target or a prediction leave row by row. The percentile ranks of both predictions and of the real score are
    computed once; rows with the same two predictions are counted with the sum of their real ranks. A weighting only combines the two,
    and its values meet once, by a hash of (weighting, slice of the value): a slice starts where the counts of those before it end.
    """
    wanted = ("pred_geo_tpch", "pred_cache_tpch", "tpch_geo_mean_ms", "tpch_cache_hit_ratio")
    known = rows.where(" and ".join(f"{c} is not null" for c in wanted)).withColumn("_g", _better("pred_geo_tpch", "minimize"))
    known = known.select(*by, *wanted, "_g")
    real = composite_score(known, "real_score", None, by).select(*by, "real_score", "_g", "pred_cache_tpch")
    # ranks of ranks: three numbers a row are settled before the next are taken
    both = settle(percent_ranks(real, {"_pg": "_g", "_pc": "pred_cache_tpch"}, by).select("real_score", "_pg", "_pc").where("real_score is not null"))
    ranked = settle(percent_rank(both, "real_score", "_rr").select("_pg", "_pc", (F.col("_rr") - F.lit(0.5)).alias("_rr")))
    # ranks are centred at a half here; the half row by which their mean is above it is taken off the sums
    total = ranked.agg(F.count("*").alias("_rows"), F.sum(F.pow(F.col("_rr"), 2.0)).alias("_squares"))
    total = settle(total.select("_rows", (F.col("_squares") - F.lit(0.25) / F.when(F.col("_rows") > 0, F.col("_rows"))).alias("_squares")))
    pairs = [(w / 100, round(1 - w / 100, 2)) for w in range(40, 96, 5)]
    grid = F.array(*[F.struct(F.lit(g).alias("w_geo"), F.lit(c).alias("w_cache")) for g, c in pairs])
    counted = settle(ranked.groupBy("_pg", "_pc").agg(F.count("*").alias("_n"), F.sum("_rr").alias("_s")))
    tried = counted.select("_pg", "_pc", "_n", "_s", F.posexplode(grid).alias("_w", "w")).select(
        F.col("_w").cast("byte").alias("_w"), (F.col("w.w_geo") * F.col("_pg") + F.col("w.w_cache") * F.col("_pc")).alias("_v"), "_n", "_s"
    )
    tried = tried.withColumn("_slice", F.floor(F.col("_v") * SLICES).cast("int"))
    before = Window.partitionBy("_w").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = tried.groupBy("_w", "_slice").agg(F.sum("_n").alias("_here")).select("_w", "_slice", F.coalesce(F.sum("_here").over(before), F.lit(0)).alias("_start"))
    values = tried.repartition("_w", "_slice").groupBy("_w", "_slice", "_v").agg(F.sum("_n").alias("_ties"), F.sum("_s").alias("_s"))
    inside = Window.partitionBy("_w", "_slice").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    placed = values.withColumn("_inside", F.coalesce(F.sum("_ties").over(inside), F.lit(0))).join(starts, ["_w", "_slice"]).crossJoin(total)
    rank = (F.col("_start") + F.col("_inside") + (F.col("_ties") + 1) / 2) / F.col("_rows") - (F.col("_rows") + 1) / (2 * F.col("_rows"))
    sums = placed.groupBy("_w").agg(F.sum(F.col("_s") * rank).alias("_both"), F.sum(F.col("_ties") * rank * rank).alias("_own"), F.max("_squares").alias("_squares"))
    found = sums.select(F.get(grid, F.col("_w").cast("int")).alias("w"), F.round(F.try_divide("_both", F.sqrt(F.col("_own") * F.col("_squares"))), 4).alias("spearman_rho")).select("w.*", "spearman_rho")
    every = rows.sparkSession.range(1).select(F.explode(grid).alias("w")).select("w.*")
    return every.join(found, ["w_geo", "w_cache"], "left")


def best_weights(grid: DataFrame) -> DataFrame:
    """The weighting with the highest correlation, the smallest time weight on ties."""
    return grid.agg(F.max_by(F.struct("w_geo", "w_cache", "spearman_rho"), F.struct(F.col("spearman_rho"), -F.col("w_geo"))).alias("b")).select("b.*")


def relevance(df: DataFrame, score: str = "score", out: str = "relevance") -> DataFrame:
    """Grade 0-9 from the percentile rank of the score over all rows."""
    ranked = percent_rank(df.where(F.col(score).isNotNull()), score, "_pct")
    return ranked.withColumn(out, F.least(F.greatest(F.floor(F.col("_pct") * 9), F.lit(0)), F.lit(9)).cast("int")).drop("_pct")


def group_ids(df: DataFrame, by: tuple[str, ...] = GROUP, out: str = "group_id") -> DataFrame:
    """Dense zero-based id of each group in name order; numbered on the distinct names."""
    label = F.concat_ws("/", *by)
    names = df.select(label.alias("_label")).distinct()
    ids = names.withColumn(out, F.dense_rank().over(Window.orderBy("_label")) - 1)
    return df.withColumn("_l", label).join(ids, F.col("_l") == F.col("_label")).drop("_l", "_label")


def target_correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rank correlation of every pair of targets, each over its complete rows."""
    out = None
    for i, a in enumerate(columns):
        for b in columns[i + 1 :]:
            pair = rmse_spearman(df, a, b).select(F.lit(a).alias("left_target"), F.lit(b).alias("right_target"), "spearman_rho", "n")
            out = pair if out is None else out.unionAll(pair)
    return out


def best_worst_ratio(df: DataFrame, value: str = "tpch_geo_mean_ms") -> DataFrame:
    out = df.where(F.col(value).isNotNull()).groupBy("tier").agg(F.min(value).alias("best_ms"), F.max(value).alias("worst_ms"))
    return out.withColumn("ratio", F.round(F.col("worst_ms") / F.col("best_ms"), 2))


def outlier_sensitivity(df: DataFrame, actual: str, predicted: str, share: float = 0.99) -> DataFrame:
    """Error and correlation with and without the rows above a percentile of the actual value."""
    rows = df.where(F.col(actual).isNotNull() & F.col(predicted).isNotNull())
    limit = order_statistics(rows, {"_limit": (actual, share)})
    kept = rows.crossJoin(limit).where(F.col(actual) <= F.col("_limit")).drop("_limit")
    named = [rmse_spearman(d, actual, predicted).select(F.lit(n).alias("rows_used"), "rmse", "spearman_rho", "n") for n, d in (("all", rows), ("without outliers", kept))]
    return named[0].unionAll(named[1])
