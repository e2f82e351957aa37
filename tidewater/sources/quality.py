"""Data quality: keys, required columns, references, presence and row counts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Key values that occur more than once, with their count."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")


def missing_values(df: DataFrame, columns: list[str]) -> DataFrame:
    """Count of NULLs per required column, violations only; one pass."""
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    packed = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("nulls")) for c in columns])
    return counts.select(F.explode(packed).alias("x")).select("x.*").where("nulls > 0")


def orphans(child: DataFrame, keys: list[str], parent: DataFrame, parent_keys: list[str]) -> DataFrame:
    """Distinct child key values without a parent row; NULL keys refer to nothing and pass."""
    side = child.select(*keys).where(" and ".join(f"{k} is not null" for k in keys)).groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"))
    to = parent.select(*[F.col(p).alias(f"_p{i}") for i, p in enumerate(parent_keys)])
    on = reduce(lambda a, b: a & b, [F.col(k) == F.col(f"_p{i}") for i, k in enumerate(keys)])
    return side.join(to, on, "left_anti")


def audit(tables: dict[str, DataFrame], expected: list[str]) -> DataFrame:
    """Presence and row count of every expected table."""
    spark = next(iter(tables.values())).sparkSession
    counts = [df.agg(F.lit(n).alias("table_name"), F.count(F.lit(1)).alias("row_count")) for n, df in tables.items()]
    counted = reduce(lambda a, b: a.unionAll(b), counts)
    names = spark.createDataFrame([(n,) for n in expected], "expected string")
    out = names.join(counted, F.col("expected") == F.col("table_name"), "left")
    return out.select(F.col("expected").alias("table_name"), F.col("table_name").isNotNull().alias("present"), F.coalesce("row_count", F.lit(0)).alias("row_count"))
