"""What several operators share: durable tables, row keys, distributed numbering."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewater.session import checkpoint_dir

#: Stands for a missing doc_id in keys and orders: after every real one.
NO_ID = 2**63 - 1

#: Rows that one task of a numbering pass takes.
ROWS_PER_BUCKET = 50_000


def settle(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared checkpoint folder and read back.

    Cuts the lineage, so that later jobs neither repeat the work nor see another outcome of it, and survives lost executors.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Deletes the files of a settled table that nothing reads any more."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for parent in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(parent)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def share_package(spark: SparkSession) -> None:
    """Hands this package to the Python workers, unless their path has it already (installed, or on PYTHONPATH)."""
    root = Path(__file__).resolve().parents[2]
    context = spark.sparkContext
    listed = {Path(p).resolve() for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p}
    if root in listed or Path.cwd() == root or getattr(context, "_tidewater_shared", False):
        return
    with tempfile.TemporaryDirectory() as folder:
        context.addPyFile(shutil.make_archive(f"{folder}/tidewater", "zip", root, "tidewater"))
    context._tidewater_shared = True


def documents(spark: SparkSession, folder: str) -> DataFrame:
    share_package(spark)
    return spark.read.parquet(f"{folder}/documents.parquet")


def id_key(doc_id: str = "doc_id") -> Column:
    """doc_id with missing ones after all others."""
    return F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID))


def text_or_empty(text: str = "text") -> Column:
    return F.coalesce(F.col(text), F.lit(""))


def buckets_for(rows: int, least: int = 1) -> int:
    return max(least, -(-rows // ROWS_PER_BUCKET))


def running_before(df: DataFrame, group: list[Column], bucket: Column, order: list[Column], amount: str, out: str) -> DataFrame:
    """Adds ``out``: the sum of ``amount`` over the rows of the same group that come earlier, by (bucket, order).

    Two levels, so that a hot group is never one task: sums of (group, bucket) are added up first, and only rows of one bucket meet.
    ``amount`` may be a column of ones, which numbers the rows from 0.
    """
    keys = [f"__g{i}" for i in range(len(group))]
    df = df.withColumns({**{k: g for k, g in zip(keys, group)}, "__b": bucket})
    totals = df.groupBy(*keys, "__b").agg(F.sum(amount).alias("__sum"))
    # few rows: one for each group and bucket
    before = Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*keys, "__b", F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__before"))
    inside = Window.partitionBy(*keys, "__b").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn(out, F.coalesce(F.sum(amount).over(inside), F.lit(0)))
    left, right = df.alias("d"), totals.alias("t")
    same = F.col("d.__b") == F.col("t.__b")
    for k in keys:
        same &= F.col(f"d.{k}").eqNullSafe(F.col(f"t.{k}"))
    plain = [c for c in df.columns if c not in (*keys, "__b", out)]
    return left.join(right, same, "left").select(*[F.col(f"d.`{c}`") for c in plain], (F.col(f"d.{out}") + F.coalesce(F.col("t.__before"), F.lit(0))).cast("long").alias(out))
