"""Loads, statistics and sinks over files that are written from the given tables."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from tidewater.session import checkpoint_dir
from tidewater.sources import files
from tidewater.sources.views import read_table

CUSTOMER = "c_custkey bigint, c_name string, c_nationkey int, c_acctbal decimal(12,2)"


def _folder(spark) -> str:
    return os.path.join(checkpoint_dir(spark), f"store-{uuid.uuid4().hex}")


def _delimited_customers(t, path: str) -> None:
    """Pipe-delimited text with a trailing delimiter, names padded to 30 characters and every fifth nation empty."""
    fields = ["cast(c_custkey as string)", "rpad(c_name, 30, ' ')", "if(c_custkey % 5 = 0, '', cast(c_nationkey as string))", "cast(cast(c_acctbal as decimal(12,2)) as string)", "''"]
    read_table(t.spark, t.folder, "customer").selectExpr(f"concat_ws('|', {', '.join(fields)})").write.mode("overwrite").text(path)


def src_01_delimited_load(t):
    path = _folder(t.spark)
    _delimited_customers(t, path)
    return files.read_delimited(t.spark, path, CUSTOMER, empty_is_null=True)


def src_02_suite_load(t):
    """Two of three declared tables have a file; each that has comes with its rows and keys."""
    folder = _folder(t.spark)
    _delimited_customers(t, f"{folder}/customer.tbl")
    read_table(t.spark, t.folder, "supplier").selectExpr("concat(s_suppkey, '|', s_name, '|')").write.text(f"{folder}/supplier.tbl")
    loaded = files.load_suite(t.spark, folder, {"customer": CUSTOMER, "supplier": "s_suppkey bigint, s_name string", "partsupp": "ps_partkey bigint"}, "tbl")
    found = [df.agg(F.lit(name).alias("table_name"), F.count("*").alias("rows"), F.sum(df.columns[0]).alias("key_sum")) for name, df in loaded.items()]
    return found[0].unionAll(found[1])


STATISTICS = {"lineitem": ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"], "orders": ["o_orderkey", "o_custkey"], "customer": ["c_custkey", "c_nationkey"]}


def src_04_statistics(t):
    """What the catalogue holds on the tables' keys after they were analysed; distinct counts are estimates, and near if within 15 %."""
    spark = t.spark
    known = files.declare(spark, {n: f"{t.folder}/{n}.parquet" for n in STATISTICS}, f"stats_{uuid.uuid4().hex}")
    try:
        found = files.statistics(spark, known, STATISTICS)
    finally:
        files.forget(spark, known)
    exact = None
    for name, columns in STATISTICS.items():
        counts = read_table(spark, t.folder, name).agg(*[F.countDistinct(c).alias(c) for c in columns])
        rows = counts.unpivot([], columns, "column_name", "exact").withColumn("table_name", F.lit(name))
        exact = rows if exact is None else exact.unionAll(rows)
    near = F.abs(F.col("distinct") - F.col("exact")) <= F.greatest(0.15 * F.col("exact"), F.lit(1))
    return found.join(exact, ["table_name", "column_name"]).select("table_name", "column_name", "rows", "nulls", "low", "high", near.alias("distinct_near"))


FEATURES = ["task_id", "combination", "duration_s", "tpch_geo_mean_ms", "tier"]


def src_09_features(t):
    """The feature table by tier, read for the tiers of some tasks; folders of tiers that can't be among them aren't scanned."""
    path = _folder(t.spark)
    files.write_features(t.tasks.select(*FEATURES), path)
    wanted = t.tasks.where("status = 'done' and combination = 's1' and tier <> 'low'").select("tier").distinct()
    return files.read_features(t.spark, path).join(wanted, "tier").select(*FEATURES)


def src_09_features_as_csv(t):
    path = _folder(t.spark)
    files.write_features(t.tasks.select(*FEATURES), path, "csv")
    schema = "task_id bigint, combination string, duration_s double, tpch_geo_mean_ms double, tier string"
    return files.read_features(t.spark, path, schema, "csv")


def src_12_metric_runs(t):
    """Two runs, the second one repeated over fewer tasks: it replaces itself and leaves the first alone."""
    path = _folder(t.spark)
    for run, where in (("a", "true"), ("b", "true"), ("b", "status = 'done'")):
        metrics = t.tasks.where(where).groupBy("tier").agg(F.count("*").alias("n"), F.sum("task_id").alias("task_sum"))
        files.append_metrics(metrics, path, run)
    return t.spark.read.parquet(path).select("run_id", "tier", "n", "task_sum")


QUERIES = {name: f for name, f in list(globals().items()) if name.startswith("src_") and callable(f)}
