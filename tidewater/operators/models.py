"""Performance models on MLlib: specialists, ablation, search, stacking, importance, ranking."""

from __future__ import annotations

import math
import pickle
import random
import sys
import uuid
from functools import reduce
from multiprocessing.pool import ThreadPool

import numpy as np
import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import Imputer, VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.functions.values import from_scale, to_scale
from tidewater.operators import boosting
from tidewater.operators.features import HARDWARE, STAGE1, STAGE2, STAGE3
from tidewater.operators.ranking import TARGETS, counted_correlation, percent_rank, relevance, rmse_spearman
from tidewater.operators.ranks import attach_position, order_statistics, settle
from tidewater.session import checkpoint_dir

FOLDS = 5
SEED = 42
PIECES = 32  # rows with the same inputs are merged into so many weighted ones at most, in each fold
MERGED_ROWS = 20_000  # weighted rows in a part
LOCAL_ROWS = 100_000  # weighted rows whose trees are grown in one task; beyond it MLlib's distributed trees take over
# The published tree settings.
TREES = {"maxIter": 400, "maxDepth": 4, "stepSize": 0.04, "subsamplingRate": 0.8, "featureSubsetStrategy": "0.8", "minInstancesPerNode": 5, "seed": SEED}
STAGE_OF = {**{f"cfg_{p}": "S1" for p in STAGE1}, **{f"cfg_{p}": "S2" for p in STAGE2}, **{f"cfg_{p}": "S3" for p in STAGE3}, **{h: "HW" for h in HARDWARE}}


def fold(key: str = "task_id", folds: int = FOLDS, seed: int = SEED):
    """A fold number from a hash of the row key: the same on every run."""
    return F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(folds)).cast("int")


def _inputs(columns: list[str]) -> list:
    """Median imputation and missing flags fitted on the training rows only."""
    return [
        Imputer(strategy="median", inputCols=columns, outputCols=[f"_f_{c}" for c in columns]),
        VectorAssembler(inputCols=[f"_f_{c}" for c in columns] + [f"_m_{c}" for c in columns], outputCol="_x", handleInvalid="keep"),
    ]


def prepare(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Double columns, a flag per column for values not sampled."""
    doubles = [F.col(c).cast("double").alias(c) for c in columns]
    flags = [F.col(c).isNull().cast("double").alias(f"_m_{c}") for c in columns]
    return rows.select(*[c for c in rows.columns if c not in columns], *doubles, *flags)


def _usable(rows: DataFrame, columns: list[str]) -> list[str]:
    # a column that is NULL throughout has no median
    seen = rows.agg(*[F.count(c).alias(c) for c in columns]).first()
    return [c for c in columns if seen[c]]


def spread(rows: DataFrame, key: str = "task_id") -> DataFrame:
    """Rows in as many parts as the cluster runs tasks, settled: fits read them many times, and a table may come in a single part."""
    spark = rows.sparkSession
    return settle(rows.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), key))


def together(work, jobs: list, parallelism: int) -> list:
    """Results of independent fits, in order; a few of them share the cluster."""
    with ThreadPool(parallelism) as threads:
        return threads.map(inheritable_thread_target(work), jobs, chunksize=1)


def in_one_task(rows: DataFrame, work, schema: str) -> DataFrame:
    """The columns that ``work`` makes of all rows, an Arrow table, in one task; nothing of no rows."""
    names = [part.split()[0] for part in schema.split(", ")]

    def run(batches):
        found = list(batches)
        if found:
            yield pa.record_batch([pa.array(c) for c in work(pa.Table.from_batches(found))], names)

    return rows.coalesce(1).mapInArrow(run, schema)


def specialist(columns: list[str], label: str = "_y", **settings) -> Pipeline:
    tree = GBTRegressor(featuresCol="_x", labelCol=label, predictionCol="_p", **{**TREES, **settings})
    return Pipeline(stages=[*_inputs(columns), tree])


def merge(rows: DataFrame, columns: list[str], labels: dict[str, tuple[Column, Column]], folds: int = FOLDS, inputs: DataFrame | None = None) -> DataFrame:
    """(columns, _fold, for each label n: _n_n, _y_n, _actual_n, _within_n): rows with the same inputs as a few weighted ones, settled.

    ``labels`` holds (value on the trees' scale, value on its own scale) by name. A tree splits by sums of weights, labels and their
    squares, and the spread inside equal inputs is the same on either side of a split: weighted means grow the trees of their rows. In
    each fold equal inputs stay apart in up to ``PIECES`` parts by a hash of the key, from which the trees draw. ``_within`` is the sum
    of squares about ``_actual``, so errors are those of the rows too. Where merging would not halve the rows they stay as they are.
    With ``inputs``, rows carry the two hashes of their inputs, by which this table holds the columns.
    """
    sums, plain = [], []
    for name, (label, actual) in labels.items():
        actual = actual.cast("double")
        plain += [actual.isNotNull().cast("long").alias(f"_n_{name}"), F.when(actual.isNotNull(), label).alias(f"_y_{name}"), actual.alias(f"_actual_{name}"), F.lit(0.0).alias(f"_within_{name}")]
        sums += [F.count(actual).alias(f"_n_{name}"), F.avg(F.when(actual.isNotNull(), label)).alias(f"_y_{name}"), F.avg(actual).alias(f"_actual_{name}"), (F.var_pop(actual) * F.count(actual)).alias(f"_within_{name}")]
    keyed = rows.select("*", fold(folds=folds).alias("_fold"), F.pmod(F.xxhash64(F.lit(SEED + 1), "task_id"), F.lit(PIECES)).alias("_piece"))
    own = [F.col(c).cast("double").alias(c) for c in columns] if inputs is None else ["_in0", "_in1"]
    same = columns if inputs is None else own
    # merge: inputs of few values look small in files, and a broadcast would hold all of them in the driver
    wide = (lambda df: df) if inputs is None else (lambda df: df.join(inputs.select(*own, *columns).hint("merge"), own).drop(*own))
    size = keyed.agg(F.count("*").alias("rows"), F.approx_count_distinct(F.xxhash64(*same, "_fold", "_piece")).alias("merged")).first()
    if 2 * size.merged > size.rows:
        return wide(keyed.select(*own, "_fold", *plain))
    merged = settle(wide(keyed.groupBy(*own, "_fold", "_piece").agg(*sums).drop("_piece")))
    return merged.coalesce(max(1, -(-merged.count() // MERGED_ROWS)))


def medians(merged: DataFrame, columns: list[str], weight: str, held: list[int]) -> dict[int, DataFrame]:
    """For each fold held out (-1: none) one row of the columns' exact medians over the rows of all others; 0 for a column without any."""
    counted = merged.groupBy(*columns, "_fold").agg(F.sum(weight).alias("_w")).where("_w > 0")
    kept = counted.withColumn("_k", F.explode(F.array(*[F.lit(k) for k in held]))).where("_fold <> _k")
    found = order_statistics(kept.select("_k", "_w", *[F.nanvl(c, F.lit(None)).alias(c) for c in columns]), {c: (c, 0.5) for c in columns}, ("_k",), weight="_w")
    spark, by_fold = merged.sparkSession, {r["_k"]: r for r in found.collect()}  # a row for each fold
    none = dict.fromkeys(columns, None)
    schema = ", ".join(f"`{c}` double" for c in columns)
    return {k: spark.createDataFrame([tuple(by_fold.get(k, none)[c] or 0.0 for c in columns)], schema).coalesce(1) for k in held}


def input_hashes(columns: list[str], out: str = "_in") -> list[Column]:
    """Two hashes of inputs, 128 bits that tell distinct ones apart; a hash passes over NULLs, so these count as the least double."""
    inputs = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(-sys.float_info.max)) for c in columns])
    return [F.xxhash64(F.lit(SEED + i), inputs).alias(f"{out}{i}") for i in (0, 1)]


def _weighted(merged: DataFrame, columns: list[str], name: str) -> DataFrame:
    """The merged rows that know a label, as the trees read them."""
    known = merged.where(F.col(f"_n_{name}") > 0)
    return prepare(known.select(*columns, "_fold", *[F.col(f"{x}_{name}").alias(x) for x in ("_n", "_y", "_actual", "_within")]), columns)


def fit_specialist(known: DataFrame, columns: list[str], inputs: DataFrame | None = None, **settings) -> PipelineModel:
    """A fitted :func:`specialist`; the trees read merged inputs, and up to ``LOCAL_ROWS`` of them are worked on in one task if inputs come again.

    Others are MLlib's, with its draws; they are imputed and settled once, where the pipeline imputes them in every pass. ``inputs`` is that of :func:`merge`.
    """
    merged = merge(known, columns, {"y": (F.col("_y"), F.col("_y"))}, inputs=inputs)
    *stages, tree = specialist(columns, **settings).getStages()
    schema = ", ".join(f"`{c}` double" for c in columns)
    size = merged.agg(F.count("*").alias("rows"), F.approx_count_distinct(F.xxhash64(*columns)).alias("inputs")).first()
    if 2 * size.inputs <= size.rows <= LOCAL_ROWS:

        def work(table):
            trees = boosting.fit(boosting.raw_inputs(table, columns), table.column("_y_y").to_numpy(), table.column("_n_y").to_numpy(), **{**TREES, **settings})
            return [trees.middle], [pickle.dumps((trees.features, trees.weights, trees.nodes()))]

        found = in_one_task(merged.where("_n_y > 0").select("_n_y", "_y_y", *columns), work, "middle array<double>, nodes binary").first()
        if found:
            middle = known.sparkSession.createDataFrame([tuple(found["middle"])], schema).coalesce(1)
            filled = Pipeline(stages=stages).fit(prepare(middle, columns))
            path = f"{checkpoint_dir(known.sparkSession)}/trees-{uuid.uuid4().hex}"
            return PipelineModel(stages=[*filled.stages, boosting.stored(found["nodes"], known.sparkSession, path, tree)])
    filled = Pipeline(stages=stages).fit(prepare(medians(merged, columns, "_n_y", [-1])[-1], columns))
    rows = settle(filled.transform(_weighted(merged, columns, "y")).select("_x", "_y", "_n")).coalesce(merged.rdd.getNumPartitions())
    return PipelineModel(stages=[*filled.stages, tree.setWeightCol("_n").fit(rows)])


def out_of_fold(rows: DataFrame, target: str, columns: list[str], parallelism: int = FOLDS, **settings) -> DataFrame:
    """Prediction of every row by the model that did not see its fold, on the original scale."""
    return out_of_folds(spread(rows), {target: (target, columns)}, parallelism, **settings)[target]


def out_of_folds(ready: DataFrame, wanted: dict[str, tuple[str, list[str]]], parallelism: int = 8, **settings) -> dict[str, DataFrame]:
    """``out_of_fold`` for several pairs of target and columns over the same settled rows; their fits share the cluster and the merged rows.

    Up to ``LOCAL_ROWS`` merged rows a fit is one task's work.
    """
    every = list(dict.fromkeys(c for _, columns in wanted.values() for c in columns))
    targets = list(dict.fromkeys(t for t, _ in wanted.values()))
    merged = merge(ready, every, {t: (to_scale(TARGETS[t][0], TARGETS[t][1]), F.col(TARGETS[t][0])) for t in targets})
    usable = dict(zip(targets, together(lambda t: _usable(merged.where(F.col(f"_n_{t}") > 0), every), targets, parallelism)))
    local, parts = merged.count() <= LOCAL_ROWS, merged.rdd.getNumPartitions()
    middle = {} if local else dict(zip(targets, together(lambda t: medians(merged, usable[t], f"_n_{t}", list(range(FOLDS))), targets, parallelism)))

    def predict_locally(target, k, columns):
        def work(table):
            raw, n, y, folds, *hashes = boosting.raw_inputs(table, columns), *[table.column(c).to_numpy() for c in ("_n", "_y", "_fold", "_in0", "_in1")]
            seen, held = folds != k, np.flatnonzero(folds == k)
            trees = boosting.fit(boosting.taken(raw, seen), y[seen], n[seen], **{**TREES, **settings})
            # each of the held inputs is predicted once
            held = held[np.unique(np.column_stack(hashes)[held], axis=0, return_index=True)[1]]
            return *[h[held] for h in hashes], trees.judge(boosting.taken(raw, held))

        known = merged.where(F.col(f"_n_{target}") > 0)
        narrow = known.select(*columns, "_fold", F.col(f"_n_{target}").alias("_n"), F.col(f"_y_{target}").alias("_y"), *input_hashes(columns))
        return in_one_task(narrow, work, "_in0 long, _in1 long, _p double")

    def predict(job):
        name, k = job
        target, asked = wanted[name]
        columns = [c for c in asked if c in usable[target]]
        if local:
            return settle(predict_locally(target, k, columns).select(F.lit(k).alias("_k"), "_in0", "_in1", from_scale("_p", TARGETS[target][1]).alias("predicted")))
        *inputs, tree = specialist(columns, **settings).getStages()
        filled = Pipeline(stages=inputs).fit(prepare(middle[target][k].select(*columns), columns))
        known = _weighted(merged, columns, target)
        # the trees go over their rows many times
        seen = settle(filled.transform(known.where(F.col("_fold") != k)).select("_x", "_y", "_n")).coalesce(parts)
        model = tree.setWeightCol("_n").fit(seen)
        # each of the held inputs is predicted once, whatever the rows that have it
        held = known.where(F.col("_fold") == k).groupBy(*input_hashes(columns)).agg(*[F.any_value(c).alias(c) for c in [*columns, *[f"_m_{c}" for c in columns]]])
        return settle(model.transform(filled.transform(held)).select(F.lit(k).alias("_k"), "_in0", "_in1", from_scale("_p", TARGETS[target][1]).alias("predicted")))

    jobs = [(name, k) for name in wanted for k in range(FOLDS)]
    found = together(predict, jobs, parallelism)

    def place(name):
        target, asked = wanted[name]
        column = TARGETS[target][0]
        columns = [c for c in asked if c in usable[target]]
        rows = ready.where(F.col(column).isNotNull()).select("task_id", F.col(column).alias("actual"), fold().alias("fold"), *input_hashes(columns))
        by_input = reduce(DataFrame.unionAll, [part for (n, _), part in zip(jobs, found) if n == name])
        same = (F.col("fold") == F.col("_k")) & (rows["_in0"] == by_input["_in0"]) & (rows["_in1"] == by_input["_in1"])
        # settled, so that what is made of the predictions joins no more
        return settle(rows.join(by_input, same).select("task_id", "actual", "predicted", "fold"))

    return dict(zip(wanted, together(place, list(wanted), parallelism)))


def target_metrics(rows: DataFrame, columns: list[str], targets=tuple(TARGETS), **settings) -> DataFrame:
    oofs = out_of_folds(spread(rows), {t: (t, columns) for t in targets}, **settings)
    out = [rmse_spearman(oofs[t], "actual", "predicted").select(F.lit(t).alias("target"), "rmse", "spearman_rho", "n") for t in targets]
    return reduce(lambda a, b: a.unionAll(b), out)


def ablation(rows: DataFrame, groups: dict[str, list[str]], target: str = "geo_mean_tpch", **settings) -> DataFrame:
    """Error and correlation with growing sets of input columns."""
    ready = spread(rows)
    known = ready.where(F.col(TARGETS[target][0]).isNotNull())
    present = {label: _usable(known, [c for c in columns if c in rows.columns]) for label, columns in groups.items()}
    oofs = out_of_folds(ready, {label: (target, columns) for label, columns in present.items()}, **settings)
    out = []
    for label, columns in present.items():
        m = rmse_spearman(oofs[label], "actual", "predicted")
        out.append(m.select(F.lit(label).alias("group"), F.lit(len(columns)).alias("n_features"), "rmse", "spearman_rho"))
    return reduce(lambda a, b: a.unionAll(b), out)


# (share of a setting's rounds, folds judged, settings that go on) of each rung; beside those the published setting always goes on.
RUNGS = ((1 / 16, 1, 20), (1 / 4, 2, 5), (1.0, FOLDS, 1))


def draw_settings(trials: int, rows: int, seed: int = SEED) -> list[dict]:
    """The published setting and ``trials`` drawn ones, over the dimensions that MLlib's trees have.

    The published ranges bound a split's gain by its sum over the rows, MLlib by its mean; penalties on leaf weights have no counterpart.
    """
    rng = random.Random(seed)
    out = [dict(TREES)]
    for _ in range(trials):
        # The published ranges.
        out.append({
            "maxIter": rng.randint(200, 800),
            "maxDepth": rng.randint(3, 6),
            "stepSize": math.exp(rng.uniform(math.log(0.01), math.log(0.15))),
            "subsamplingRate": rng.uniform(0.6, 1.0),
            "featureSubsetStrategy": f"{rng.uniform(0.5, 1.0):.3f}",
            "minInstancesPerNode": rng.randint(1, 15),
            "minInfoGain": rng.uniform(0.0, 1.0) / max(rows, 1),
            "seed": seed,
        })
    return out


def search(rows: DataFrame, columns: list[str], target: str = "geo_mean_tpch", trials: int = 80, rungs=RUNGS, seed: int = SEED, parallelism: int = 4) -> DataFrame:
    """(target, rung, trial, rounds, folds, rmse, goes_on, setting): random search that gives more rounds to fewer settings, rung by rung.

    A rung fits each setting that is left with its share of the rounds and judges it, on the target's own scale, on rows of the folds
    that the fit did not see; the best of a rung go on, ties to the smaller trial. Trial 0 is the published setting, which is fitted in
    every rung and counts to none. Inputs are merged (:func:`merge`) and all trials read them settled; up to ``LOCAL_ROWS`` of them a fit is
    one task's work, more are imputed once a fold. A table without known rows gives none.
    """
    column, transform, _, _ = TARGETS[target]
    spark = rows.sparkSession
    schema = "target string, rung int, trial int, rounds int, folds int, rmse double, goes_on boolean, setting map<string, string>"
    merged = merge(spread(rows.where(F.col(column).isNotNull())), columns, {target: (to_scale(column, transform), F.col(column))})
    columns = _usable(merged, columns)
    if not columns:
        return spark.createDataFrame([], schema)
    local, parts = merged.count() <= LOCAL_ROWS, merged.rdd.getNumPartitions()
    ready = _weighted(merged, columns, target)
    middle = {} if local else medians(merged, columns, f"_n_{target}", list(range(max(n for _, n, _ in rungs))))

    def fill(k):
        inputs = Pipeline(stages=_inputs(columns)).fit(prepare(middle[k], columns))
        return settle(inputs.transform(ready).select("_x", "_y", "_n", "_actual", "_within", (F.col("_fold") == k).alias("_held"))).coalesce(parts)

    folds = together(fill, list(middle), parallelism)
    settings = draw_settings(trials, ready.agg(F.sum("_n")).first()[0], seed)

    def judged_locally(trial, k, rounds):
        mine = {**settings[trial], "maxIter": rounds}

        def work(table):
            raw, n, y, folds, actual, within = boosting.raw_inputs(table, columns), *[table.column(c).to_numpy() for c in ("_n", "_y", "_fold", "_actual", "_within")]
            seen, held = folds != k, folds == k
            trees = boosting.fit(boosting.taken(raw, seen), y[seen], n[seen], **mine)
            return n[held], actual[held], within[held], trees.judge(boosting.taken(raw, held))

        return in_one_task(ready.select(*columns, "_n", "_y", "_fold", "_actual", "_within"), work, "_n long, _actual double, _within double, _p double")

    def error(job):
        trial, k, rounds = job
        squares = F.col("_within") + F.col("_n") * F.pow(F.col("_actual") - from_scale("_p", transform), 2.0)
        if local:
            return trial, judged_locally(trial, k, rounds).agg(F.sum(squares).alias("squares"), F.sum("_n").alias("n")).first()
        tree = GBTRegressor(featuresCol="_x", labelCol="_y", predictionCol="_p", weightCol="_n", **{**settings[trial], "maxIter": rounds})
        predicted = tree.fit(folds[k].where("not _held")).transform(folds[k].where("_held"))
        return trial, predicted.agg(F.sum(squares).alias("squares"), F.sum("_n").alias("n")).first()

    lines, left = [], list(range(1, trials + 1))
    for rung, (share, judged, kept) in enumerate(rungs):
        rounds = {i: max(1, round(settings[i]["maxIter"] * share)) for i in [0, *left]}
        jobs = [(i, k, rounds[i]) for i in rounds for k in range(judged)]
        found = together(error, jobs, parallelism)
        rmse = {}
        for i in rounds:
            parts = [r for j, r in found if j == i]
            n = sum(r.n or 0 for r in parts)
            rmse[i] = math.sqrt(sum(r.squares or 0.0 for r in parts) / n) if n else math.inf
        left = sorted(left, key=lambda i: (rmse[i], i))[:kept]
        lines += [(target, rung, i, rounds[i], judged, rmse[i], i == 0 or i in left, {k: str(v) for k, v in settings[i].items()}) for i in rounds]
    return spark.createDataFrame(lines, schema)


def search_gain(found: DataFrame) -> DataFrame:
    """(target, trial, base_rmse, best_rmse, gain_pct): the last rung's best setting against the published one, which is itself the best if none beats it."""
    last = found.join(found.agg(F.max("rung").alias("_last")), F.col("rung") == F.col("_last"))
    best = last.groupBy("target").agg(F.min(F.struct("rmse", "trial")).alias("_best"), F.max(F.when(F.col("trial") == 0, F.col("rmse"))).alias("base_rmse"))
    gain = F.try_divide(F.col("base_rmse") - F.col("_best.rmse"), F.col("base_rmse")) * 100
    return best.select("target", "_best.trial", "base_rmse", F.col("_best.rmse").alias("best_rmse"), gain.alias("gain_pct"))


def stack(oofs: dict[str, DataFrame], actual: DataFrame, label: str, alpha: float = 1.0, folds: int = FOLDS) -> DataFrame:
    """(task_id, label, fold, stacked): ridge over the out-of-fold predictions of the specialists, itself cross-fitted.

    One aggregation gives every fold's row count, sums and products; a fold's weights are solved from those of all other folds, so no
    row is predicted by a model that saw it. The intercept is not penalised. Rows that lack a prediction or the label stay out.
    """
    rows = actual.select("task_id", F.col(label).cast("double").alias(label))
    # merge: settled predictions look small in files, and a broadcast would hold all of them in the driver
    for name, df in oofs.items():
        rows = rows.join(df.select("task_id", F.col("predicted").cast("double").alias(f"oof_{name}")).hint("merge"), "task_id")
    names = [f"oof_{n}" for n in oofs]
    rows = settle(rows.dropna(subset=[label, *names]).withColumn("fold", fold(folds=folds)))
    columns = [*names, label]
    firsts = [F.sum(c).alias(f"s{i}") for i, c in enumerate(columns)]
    products = [F.sum(F.col(x) * F.col(y)).alias(f"p{i}_{j}") for i, x in enumerate(columns) for j, y in enumerate(columns) if j >= i]
    stats = rows.groupBy("fold").agg(F.count("*").alias("n"), *firsts, *products).collect()  # a row for each fold
    stacked = F.lit(None).cast("double")
    for k in range(folds):
        weights, intercept = _ridge([r for r in stats if r.fold != k], len(names), alpha)
        line = F.lit(float(intercept))
        for name, w in zip(names, weights):
            line = line + F.lit(float(w)) * F.col(name)
        stacked = F.when(F.col("fold") == k, line).otherwise(stacked)
    return rows.select("task_id", label, "fold", stacked.alias("stacked"))


def _ridge(stats: list, width: int, alpha: float) -> tuple[np.ndarray, float]:
    """Weights and intercept from sums of row counts, columns and products of columns (the label last)."""
    n = sum(r.n for r in stats)
    if not n:
        return np.zeros(width), 0.0
    mean = np.array([sum(r[f"s{i}"] for r in stats) for i in range(width + 1)]) / n
    gram = np.zeros((width + 1, width + 1))
    for i in range(width + 1):
        for j in range(i, width + 1):
            gram[i, j] = gram[j, i] = sum(r[f"p{i}_{j}"] for r in stats) - n * mean[i] * mean[j]
    weights = np.linalg.solve(gram[:width, :width] + alpha * np.eye(width), gram[:width, width])
    return weights, float(mean[width] - weights @ mean[:width])


def fold_metrics(predicted: DataFrame, actual: str, value: str) -> DataFrame:
    """RMSE and rank correlation of each fold's predictions, and of all (fold -1)."""
    both = predicted.select(actual, value, F.explode(F.array(F.col("fold"), F.lit(-1))).alias("fold"))
    return rmse_spearman(both, actual, value, ("fold",))


def importance(rows: DataFrame, columns: list[str], target: str = "geo_mean_tpch", **settings) -> DataFrame:
    """Loss of rank correlation when one column is shuffled, beside the trees' own measure.

    Every row has a place in a hashed order; a shuffled column takes its values from the row a seeded distance further on. A row
    travels as its rank and two hashes of its inputs, 128 bits that tell distinct inputs apart. Pairs of a row's and its donor's inputs
    are counted, the models score each such pair once for every column, and correlations come from counts and sums of ranks.
    """
    column, transform, _, _ = TARGETS[target]
    known = spread(rows.where(F.col(column).isNotNull()))
    columns = _usable(known, columns)
    ready = prepare(known, columns).withColumn("_y", to_scale(column, transform))
    model = fit_specialist(ready, columns, **settings)
    gains = model.stages[-1].featureImportances
    inputs = settle(ready.groupBy(*input_hashes(columns, "_own")).agg(*[F.any_value(c).alias(c) for c in columns]))
    ranked = percent_rank(ready.select("task_id", "_y", *input_hashes(columns, "_own")), "_y", "_ry")
    placed = attach_position(ranked.withColumn("_h", F.xxhash64(F.lit(SEED), "task_id")), "_h", "task_id", (), "_at", "_size")
    placed = settle(placed.select("_at", "_size", "_own0", "_own1", (F.col("_ry") - (F.col("_size") + 1) / (2 * F.col("_size"))).alias("_ry")))
    distance = F.pmod(F.xxhash64(F.lit(SEED), F.lit(0)), F.greatest(F.col("_size") - 1, F.lit(1))) + 1
    donors = placed.select((F.pmod(F.col("_at") - 1 - distance, F.col("_size")) + 1).alias("_at"), F.col("_own0").alias("_don0"), F.col("_own1").alias("_don1"))
    hashes = ["_own0", "_own1", "_don0", "_don1"]
    # merge: a broadcast would hold all rows in the driver, for narrow sorted rows look small in files
    pairs = settle(placed.join(donors.hint("merge"), "_at").groupBy(*hashes).agg(F.count("*").alias("_n"), F.sum("_ry").alias("_s")))
    total = placed.agg(F.sum(F.col("_ry") * F.col("_ry")).alias("_squares"))
    both = pairs.join(inputs, ["_own0", "_own1"]).join(inputs.select(F.col("_own0").alias("_don0"), F.col("_own1").alias("_don1"), *[F.col(c).alias(f"_d_{c}") for c in columns]), ["_don0", "_don1"])
    # number -1 is the table as it is
    tried = settle(both.drop(*hashes)).withColumn("_c", F.explode(F.sequence(F.lit(-1), F.lit(len(columns) - 1))))
    tried = tried.select("_c", "_n", "_s", *[F.when(F.col("_c") == i, F.col(f"_d_{c}")).otherwise(F.col(c)).alias(c) for i, c in enumerate(columns)])
    scored = model.transform(prepare(tried, columns)).groupBy("_c", "_p").agg(F.sum("_n").alias("_n"), F.sum("_s").alias("_s"))
    scored = settle(counted_correlation(scored, "_p", "_c", "_n", "_s", total).select("_c", "spearman_rho"))
    base = scored.where("_c = -1").select(F.col("spearman_rho").alias("_base"))
    named = F.array(*[F.struct(F.lit(c).alias("feature"), F.lit(STAGE_OF.get(c, "HW")).alias("stage"), F.lit(float(gains[i] + gains[i + len(columns)])).alias("gain")) for i, c in enumerate(columns)])
    out = scored.where("_c >= 0").crossJoin(base).withColumn("_name", F.get(named, F.col("_c")))
    return out.select("_name.feature", "_name.stage", F.round(F.col("_base") - F.col("spearman_rho"), 4).alias("rho_loss"), "_name.gain")


def stage_importance(features: DataFrame) -> DataFrame:
    """Each stage's share of the trees' gain, in percent."""
    sums = features.groupBy("stage").agg(F.sum("gain").alias("gain"))
    whole = sums.agg(F.sum("gain").alias("_w"))
    return sums.crossJoin(whole).select("stage", F.round(F.try_divide(F.col("gain"), F.col("_w")) * 100, 2).alias("share_pct"))


OFFSETS = (1, 2, 3, 5, 8)


def bounded_pairs(rows: DataFrame, keep: list[str], by: tuple[str, ...], offsets: tuple[int, ...] = OFFSETS, key: str = "task_id") -> DataFrame:
    """Pairs (a, b) of rows of a group: each row with those ``offsets`` places further on in the group's hashed order, which is a ring.

    Linear in the group, where all pairs would be its square. A distance that is a multiple of the group's size is no pair.
    """
    # only what the pairs keep is sorted
    placed = attach_position(rows.select(*by, key, *keep, F.xxhash64(F.lit(SEED), key).alias("_h")), "_h", key, by, "_at", "_size")
    placed = settle(placed.select(*by, key, *keep, "_at", "_size"))
    left = placed.withColumn("_offset", F.explode(F.array(*[F.lit(o) for o in offsets]))).where("pmod(_offset, _size) <> 0")
    left = left.withColumn("_to", F.pmod(F.col("_at") - 1 + F.col("_offset"), F.col("_size")) + 1)
    a = left.select(*[F.col(g).alias(f"_g_{g}") for g in by], "_to", "_offset", F.struct(key, *keep).alias("a"))
    b = placed.select(*by, "_at", F.struct(key, *keep).alias("b"))
    same = F.col("_to") == F.col("_at")
    for g in by:
        same = same & F.col(f"_g_{g}").eqNullSafe(F.col(g))
    # merge: wide rows of few values look small in files, and a broadcast would hold all of them in the driver
    return a.join(b.hint("merge"), same).select(*by, F.col("_offset").alias("offset"), "a", "b")


def ranker(rows: DataFrame, score: str, columns: list[str], by: tuple[str, ...] = ("tier", "combination"), offsets: tuple[int, ...] = OFFSETS, **settings) -> DataFrame:
    """Pairwise ranking: which of two rows of a group has the better relevance grade, learnt from the difference of their inputs.

    Pairs are bounded (:func:`bounded_pairs`), those of equal grade teach nothing. Rows meet by hashes of their inputs, pairs of the same
    inputs are counted and weigh as many. A logistic regression without intercept gives the weights, whose sum over a row's inputs is its
    ``rank_score``. Groups whose pairs are all equal, or a table without pairs, give 0.
    """
    graded = relevance(rows.where(F.col(score).isNotNull()), score)
    columns = _usable(graded, columns)
    ready = settle(prepare(graded, columns).withColumn("_y", F.col("relevance").cast("double")))
    inputs = Pipeline(stages=_inputs(columns)).fit(ready)
    parts = [f"_f_{c}" for c in columns] + [f"_m_{c}" for c in columns]
    hashed = ready.select(*by, "task_id", "_y", *input_hashes(columns))
    pairs = bounded_pairs(hashed, ["_y", "_in0", "_in1"], by, offsets).where("a._y <> b._y")
    sides = [F.col(f"{x}._in{i}").alias(f"_{x}{i}") for x in "ab" for i in (0, 1)]
    counted = settle(pairs.groupBy((F.col("a._y") > F.col("b._y")).cast("double").alias("_label"), *sides).agg(F.count("*").cast("double").alias("_n")))
    out = [*by, "task_id", score, "relevance"]
    if counted.select("_label").distinct().count() < 2:
        return ready.select(*out, F.lit(0.0).alias("rank_score"))
    distinct = ready.groupBy(*input_hashes(columns)).agg(*[F.any_value(c).alias(c) for c in [*columns, *[f"_m_{c}" for c in columns]]])
    distinct = settle(inputs.transform(distinct).select("_in0", "_in1", *parts))
    met = counted
    for x in "ab":
        # merge: a table of inputs can be large in memory and small in files
        met = met.join(distinct.select(F.col("_in0").alias(f"_{x}0"), F.col("_in1").alias(f"_{x}1"), *[F.col(p).alias(f"{x}{p}") for p in parts]).hint("merge"), [f"_{x}0", f"_{x}1"])
    differences = settle(met.select("_label", "_n", *[(F.col(f"a{p}") - F.col(f"b{p}")).alias(p) for p in parts]))
    learner = LogisticRegression(featuresCol="_x", labelCol="_label", weightCol="_n", fitIntercept=False, **{"maxIter": 100, "regParam": 1e-4, **settings})
    weights = learner.fit(VectorAssembler(inputCols=parts, outputCol="_x").transform(differences)).coefficients.toArray()
    line = reduce(lambda a, b: a + b, [F.lit(float(w)) * F.col(p) for w, p in zip(weights, parts)])
    return inputs.transform(ready).select(*out, line.alias("rank_score"))


def learning_curve(rows: DataFrame, columns: list[str], sizes=(15, 25, 50, 100, 200, 400, None), repeats: int = 10, target: str = "geo_mean_tpch", parallelism: int = 4, **settings) -> DataFrame:
    """(train_size, draws, rho_mean, rho_sd, rmse_mean): test correlation and error for growing training sets, -1 for the whole pool.

    A repeat orders the pool by its hash, and its training sets are prefixes of that one order. The whole pool is the same in every repeat
    and is fitted once. Sizes beyond the pool are the whole pool again. A row travels as its label and two hashes of its inputs; only
    those that can be among a repeat's first, by counts of the hashes' leading bits, are placed. The models judge each of the test rows'
    distinct inputs once, and the metrics come from counts and sums over the rows that have it.
    """
    column, transform, _, _ = TARGETS[target]
    spark, same = rows.sparkSession, ["_in0", "_in1"]
    # settled as it comes: no wide row is shuffled
    known = settle(rows.where(F.col(column).isNotNull()).select("task_id", to_scale(column, transform).alias("_y"), *columns))
    narrow = known.select("task_id", "_y", *input_hashes(columns))
    if known.rdd.getNumPartitions() < spark.sparkContext.defaultParallelism:
        narrow = narrow.repartition("task_id")
    narrow = settle(narrow.withColumn("_test", fold("task_id", 5, SEED) == 0))
    inputs = settle(known.groupBy(*input_hashes(columns)).agg(*[F.any_value(c).cast("double").alias(c) for c in columns]))
    columns = _usable(inputs, columns)
    if not columns:
        return spark.createDataFrame([], "train_size int, draws long, rho_mean double, rho_sd double, rmse_mean double")
    test, pool = narrow.where("_test"), narrow.where("not _test")
    most = max([n for n in sizes if n is not None], default=0)
    each = pool.withColumn("_draw", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1)))).withColumn("_h", F.xxhash64("_draw", "task_id")).withColumn("_bits", F.shiftright("_h", 52))
    before = Window.partitionBy("_draw").orderBy("_bits").rowsBetween(Window.unboundedPreceding, -1)
    counts = each.groupBy("_draw", "_bits").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    last = {r["_draw"]: r["_last"] for r in counts.where(F.col("_before") < most).groupBy("_draw").agg(F.max("_bits").alias("_last")).collect()}  # a row for each repeat
    near = each.where(F.col("_bits") <= F.get(F.array(*[F.lit(last.get(r)).cast("long") for r in range(repeats)]), F.col("_draw")))
    placed = attach_position(near.select("_draw", "task_id", "_h", "_y", *same), "_h", "task_id", ("_draw",), "_at").where(F.col("_at") <= most)
    # merge: inputs of few values look small in files, and a broadcast would hold all of them in the driver
    drawn = settle(placed.join(inputs.hint("merge"), same).select("_draw", "_at", "task_id", "_y", *columns))
    jobs = [(n, r) for n in sizes for r in range(repeats if n is not None else 1)]

    def fit(job):
        n, r = job
        if n is None:
            return fit_specialist(pool, columns, inputs, **settings)
        mine = drawn.where((F.col("_draw") == r) & (F.col("_at") <= n))
        if n > LOCAL_ROWS:
            return fit_specialist(mine, columns, **settings)

        def work(table):
            y = table.column("_y").to_numpy()
            return ([boosting.fit(boosting.raw_inputs(table, columns), y, np.ones(len(y)), **{**TREES, **settings}).dump()],)

        found = in_one_task(mine.select("_y", *columns), work, "trees binary").first()
        return found and found["trees"]

    models = together(fit, jobs, parallelism)
    mean = F.lit(0.5) + F.try_divide(F.lit(0.5), F.lit(test.count()))
    ranked = settle(percent_rank(test.select("_y", *same), "_y", "_ry").select("_y", *same, (F.col("_ry") - mean).alias("_ry")))
    total = ranked.agg(F.sum(F.col("_ry") * F.col("_ry")).alias("_squares"))
    met = ranked.groupBy(*same).agg(F.count("*").alias("_n"), F.sum("_ry").alias("_s"), F.avg("_y").alias("_mean"), (F.var_pop("_y") * F.count("*")).alias("_within"))
    judged = settle(met.join(inputs.hint("merge"), same).select("_n", "_s", "_mean", "_within", *columns))
    sums, schema = ["_n", "_s", "_mean", "_within"], "_model int, _n long, _s double, _mean double, _within double, _p double"
    grown = [(i, m) for i, m in enumerate(models) if isinstance(m, bytes)]

    def judge(batches):
        fitted = [(i, boosting.Trees.load(m)) for i, m in grown]
        for b in batches:
            raw = boosting.raw_inputs(pa.Table.from_batches([b]), columns)
            for i, trees in fitted:
                yield pa.record_batch([pa.array(np.full(b.num_rows, i, dtype="int32")), *[b.column(c) for c in sums], pa.array(trees.judge(raw))], ["_model", *sums, "_p"])

    by_model = [judged.mapInArrow(judge, schema)]
    by_model += [m.transform(prepare(judged, columns)).select(F.lit(i).alias("_model"), *sums, "_p") for i, m in enumerate(models) if isinstance(m, PipelineModel)]
    squares = F.col("_within") + F.col("_n") * F.pow(F.col("_mean") - F.col("_p"), 2.0)
    found = settle(reduce(DataFrame.unionAll, by_model).groupBy("_model", "_p").agg(F.sum("_n").alias("_n"), F.sum("_s").alias("_s"), F.sum(squares).alias("_e")))
    rho = counted_correlation(found, "_p", "_model", "_n", "_s", total)
    runs = found.groupBy("_model").agg(F.round(F.sqrt(F.sum("_e") / F.sum("_n")), 4).alias("rmse")).join(rho, "_model", "left")
    size = F.get(F.array(*[F.lit(n if n is not None else -1) for n, _ in jobs]), F.col("_model"))
    return runs.groupBy(size.alias("train_size")).agg(
        F.count(F.lit(1)).alias("draws"), F.round(F.avg("spearman_rho"), 4).alias("rho_mean"), F.round(F.stddev_pop("spearman_rho"), 4).alias("rho_sd"), F.round(F.avg("rmse"), 4).alias("rmse_mean")
    )


def fit_all(rows: DataFrame, columns: list[str], **settings) -> dict[str, PipelineModel]:
    """One fitted model per target on all its rows."""
    settled = spread(rows)

    def fit(target):
        column, transform, _, _ = TARGETS[target]
        known = settled.where(F.col(column).isNotNull())
        ready = prepare(known, columns).withColumn("_y", to_scale(column, transform))
        return fit_specialist(ready, _usable(known, columns), **settings)

    return dict(zip(TARGETS, together(fit, list(TARGETS), len(TARGETS))))


def predict_all(models: dict[str, PipelineModel], rows: DataFrame, columns: list[str]) -> DataFrame:
    """Predictions of all targets, back on their own scales; a chain of narrow transforms."""
    df = prepare(rows, columns)
    for target, model in models.items():
        df = model.transform(df).withColumn(f"pred_{target}", from_scale("_p", TARGETS[target][1])).drop("_p", "_x", *[f"_f_{c}" for c in columns])
    return df.drop(*[f"_m_{c}" for c in columns])


def save(models: dict[str, PipelineModel], folder: str) -> None:
    for target, model in models.items():
        model.write().overwrite().save(f"{folder.rstrip('/')}/{target}")


def load(folder: str, targets=tuple(TARGETS)) -> dict[str, PipelineModel]:
    return {t: PipelineModel.load(f"{folder.rstrip('/')}/{t}") for t in targets}
