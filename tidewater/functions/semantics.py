"""Column helpers that pin the source database's semantics in one place.

Money is exact decimal, integer division truncates, NULLs sort last when
ascending and first when descending, and averages are taken as an exact sum
divided once in double precision.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def ordering(*specs: str) -> list[Column]:
    """Sort keys: ``"a"`` ascending with NULLs last, ``"-a"`` descending with NULLs first."""
    return [F.expr(s[1:]).desc_nulls_first() if s.startswith("-") else F.expr(s).asc_nulls_last() for s in specs]


def ordered(df: DataFrame, *specs: str) -> DataFrame:
    return df.orderBy(*ordering(*specs))


def top(df: DataFrame, *specs: str, n: int = 100) -> DataFrame:
    """Top-n by the given keys; plans as TakeOrderedAndProject, never a full sort."""
    return df.orderBy(*ordering(*specs)).limit(n)


def link(df: DataFrame, other: DataFrame, on: str, how: str = "inner") -> DataFrame:
    """Join on a SQL condition; the engine picks the strategy from checked sizes."""
    return df.join(other, F.expr(on), how)


def mean(x: str) -> Column:
    """Exact sum divided once, as a double (the source's AVG is numeric, not rounded to six digits)."""
    return F.expr(f"cast(sum({x}) as double) / count({x})")


def ratio(num: str, den: str) -> Column:
    return F.expr(f"cast({num} as double) / cast({den} as double)")


def idiv(a: str, b: str) -> Column:
    """Integer division that truncates, as the source does for int and bigint."""
    return F.expr(f"({a}) div ({b})")


def round_to_int(x: str) -> Column:
    """Numeric to integer rounding half away from zero; a plain cast would truncate."""
    return F.expr(f"cast(round({x}) as int)")


def agg(*exprs: str) -> list[Column]:
    return [F.expr(e) for e in exprs]


def isin(column: str, values) -> str:
    """SQL text for an IN list of literals."""
    items = ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in values)
    return f"{column} in ({items})"


def plain_numbers(df: DataFrame) -> DataFrame:
    """Report form of a result: decimals leave as doubles, names and order unchanged."""
    fields = df.schema.fields
    if not any(isinstance(f.dataType, T.DecimalType) for f in fields):
        return df
    return df.select(
        *[F.col(f"`{f.name}`").cast("double").alias(f.name) if isinstance(f.dataType, T.DecimalType) else F.col(f"`{f.name}`") for f in fields]
    )


def not_in(df: DataFrame, key: str, other: DataFrame, other_key: str) -> DataFrame:
    """Null-aware NOT IN that stays an equi anti join at any size.

    One NULL on the right side empties the result; a NULL key on the left is
    kept only when the right side is empty. The two facts needed about the
    right side come from a one-row aggregate, so nothing is broadcast whole.
    """
    facts = other.agg(F.count(F.lit(1)).alias("_n"), F.count(other_key).alias("_nn"))
    kept = df.join(other.select(F.col(other_key).alias("_k")), F.col(key) == F.col("_k"), "left_anti")
    return kept.crossJoin(facts).where(f"_n = 0 or (_n = _nn and {key} is not null)").drop("_n", "_nn")
