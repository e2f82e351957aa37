"""Exact ranks, positions and order statistics without gathering a group in one task.

A window ordered over a whole group sorts that group in a single task. Here
the rows (for ranks: the counts of distinct values) are dealt out by ranges of
(group, value) first, and each keeps the number of its range. Counts per range
give each range its start; only rows of one range are sorted together. The
number is written with the rows once, so whatever is computed again agrees.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.session import checkpoint_dir


def settle(df: DataFrame) -> DataFrame:
    """Write rows to the checkpoint folder, once, and go on from there; survives lost executors."""
    path = f"{checkpoint_dir(df.sparkSession)}/settled-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _keys(df: DataFrame, value: str, descending: bool) -> tuple[Column, Column]:
    """A double and a long that order the values exactly: whole numbers and long decimals have more digits than a double holds."""
    kind, x = df.schema[value].dataType, F.col(f"`{value}`")
    if isinstance(kind, (T.LongType, T.IntegerType, T.ShortType, T.ByteType)):
        exact = x.cast("long")
    elif isinstance(kind, T.DecimalType) and 15 < kind.precision <= 18:
        exact = (x.cast(f"decimal(38,{kind.scale})") * F.lit(10**kind.scale).cast("decimal(20,0)")).cast("long")
    else:
        exact = F.lit(0).cast("long")
    coarse = x.cast("double")
    return (-coarse, F.bitwise_not(exact)) if descending else (coarse, exact)


def _ranged(df: DataFrame, order: list, ranges: int | None) -> DataFrame:
    """The rows with the number of their range of ``order``, settled."""
    dealt = df.repartitionByRange(ranges, *order) if ranges else df.repartitionByRange(*order)
    return settle(dealt.withColumn("__range", F.spark_partition_id()))


def _starts(ranged: DataFrame, by: list[str], amount: Column) -> DataFrame:
    """For each group and range the rows in earlier ranges, and the rows of the group; one row per range reaches the window."""
    per_range = ranged.groupBy(*by, "__range").agg(F.sum(amount).alias("__rows"))
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    before = group.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    keys = [F.col(b).alias(f"__s_{b}") for b in by]
    return per_range.select(*keys, F.col("__range").alias("__s_range"), F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__start"), F.sum("__rows").over(group).alias("__n"))


def _all_same(pairs: list[tuple]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(x).eqNullSafe(F.col(y)) for x, y in pairs])


def _value_table(df: DataFrame, values: list[str], by: list[str], descending: bool, ranges: int | None, weight: str | None = None, carry: str | None = None) -> DataFrame:
    """(__which, by, __o, __x, __ties, __before, __n): every distinct value of every column with its ties and the rows before it.

    One pass counts the values of all columns; only these counts are dealt out by range and sorted. A row counts ``weight`` times;
    ``carry`` is a column whose sum for each value comes along as __sum.
    """
    keys = [_keys(df, v, descending) for v in values]
    entries = [F.when(F.col(f"`{v}`").isNotNull(), F.struct(F.lit(i).alias("which"), o.alias("o"), x.alias("x"))) for i, (v, (o, x)) in enumerate(zip(values, keys))]
    names = [f"__b{i}" for i in range(len(by))]
    more = {n: F.col(f"`{c}`") for n, c in (("__weight", weight), ("__carry", carry)) if c}
    long = df.select(*[F.col(f"`{b}`").alias(n) for b, n in zip(by, names)], *[c.alias(n) for n, c in more.items()], F.explode(F.array_compact(F.array(*entries))).alias("__v"))
    group = ["__which", *names]
    long = long.select(*names, *more, F.col("__v.which").alias("__which"), F.col("__v.o").alias("__o"), F.col("__v.x").alias("__x"))
    sums = [F.sum("__weight").alias("__ties") if weight else F.count(F.lit(1)).alias("__ties"), *([F.sum("__carry").alias("__sum")] if carry else [])]
    counted = long.groupBy(*group, "__o", "__x").agg(*sums)
    ranged = _ranged(counted, [*group, "__o", "__x"], ranges)
    inside = Window.partitionBy(*group, "__range").orderBy("__o", "__x").rowsBetween(Window.unboundedPreceding, -1)
    placed = ranged.withColumn("__inside", F.coalesce(F.sum("__ties").over(inside), F.lit(0)))
    starts = _starts(ranged, group, F.col("__ties"))
    joined = placed.join(starts, _all_same([(g, f"__s_{g}") for g in group] + [("__range", "__s_range")]))
    return joined.select(*group, "__o", "__x", "__ties", *(["__sum"] if carry else []), (F.col("__start") + F.col("__inside")).alias("__before"), "__n")


def attach_ranks(df: DataFrame, values: dict[str, str], by: tuple[str, ...] = (), descending: bool = False, ranges: int | None = None) -> DataFrame:
    """Add ``{prefix}rank``, ``{prefix}ties`` and ``{prefix}n`` within ``by`` for each value column of ``{prefix: column}``.

    ``rank`` is 1 plus the rows ordered strictly before, ``ties`` the rows with the same value, ``n`` the non-NULL rows of the group.
    NULL values get NULLs. The values of all columns are counted and settled together; ``ranges`` is the number of ranges, by
    default that of a shuffle.
    """
    by, columns, out = list(by), list(values.values()), df
    table = _value_table(df, columns, by, descending, ranges)
    for i, (prefix, value) in enumerate(values.items()):
        o, x = _keys(df, value, descending)
        keys = {f"__k{i}_{name}": F.col(name) for name in [*[f"__b{n}" for n in range(len(by))], "__o", "__x"]}
        found = table.where(F.col("__which") == i).select(
            *[c.alias(k) for k, c in keys.items()], (F.col("__before") + 1).alias(f"{prefix}rank"), F.col("__ties").alias(f"{prefix}ties"), F.col("__n").alias(f"{prefix}n")
        )
        same = (o == F.col(f"__k{i}___o")) & (x == F.col(f"__k{i}___x"))
        for n, b in enumerate(by):
            same = same & F.col(f"`{b}`").eqNullSafe(F.col(f"__k{i}___b{n}"))
        out = out.join(found, same, "left").drop(*keys)
    return out


def attach_rank(df: DataFrame, value: str, by: tuple[str, ...] = (), prefix: str = "", descending: bool = False, ranges: int | None = None) -> DataFrame:
    """``attach_ranks`` for one value."""
    return attach_ranks(df, {prefix: value}, by, descending, ranges)


def attach_position(df: DataFrame, value: str, tie: str, by: tuple[str, ...] = (), out: str = "position", size: str | None = None, ranges: int | None = None) -> DataFrame:
    """One-based position in ascending order of ``value``, equal values in order of ``tie``; rows without a value are left out.

    ``size`` names a column for the rows of the group. A frequent value is cut into ranges by ``tie``.
    """
    by = list(by)
    order = [*[F.col(f"`{b}`") for b in by], F.col(f"`{value}`"), F.col(f"`{tie}`")]
    ranged = _ranged(df.where(F.col(f"`{value}`").isNotNull()), order, ranges)
    starts = _starts(ranged, by, F.lit(1))
    inside = Window.partitionBy(*by, "__range").orderBy(value, tie)
    placed = ranged.withColumn("__inside", F.row_number().over(inside))
    found = placed.join(starts, _all_same([*[(b, f"__s_{b}") for b in by], ("__range", "__s_range")]))
    added = [(F.col("__start") + F.col("__inside")).alias(out)] + ([F.col("__n").alias(size)] if size else [])
    return found.select(*[F.col(f"`{c}`") for c in df.columns if c not in (out, size)], *added)


def order_statistics(df: DataFrame, shares: dict[str, tuple[str, float]], by: tuple[str, ...] = (), ranges: int | None = None, weight: str | None = None) -> DataFrame:
    """Exact percentiles ``{out: (column, share)}`` of the non-NULL values, interpolated linearly; a row per group of ``by``.

    All columns and groups are counted in one pass, and each percentile is read from the one or two values whose places surround it:
    no list of values is gathered anywhere. A column that is NULL throughout a group has a NULL there. A row counts ``weight`` times.
    """
    by, columns = list(by), list(dict.fromkeys(c for c, _ in shares.values()))
    table = _value_table(df, columns, by, False, ranges, weight)
    sums = []
    for name, (column, share) in shares.items():
        place = F.lit(share) * (F.col("__n") - 1)
        mine, first, last = F.col("__which") == columns.index(column), F.col("__before"), F.col("__before") + F.col("__ties") - 1
        weight = lambda at: F.when((first <= at) & (at <= last), F.lit(1.0)).otherwise(F.lit(0.0))
        low, high = F.floor(place), F.ceil(place)
        part = F.when(low == high, weight(low)).otherwise((high - place) * weight(low) + (place - low) * weight(high))
        sums.append(F.sum(F.when(mine & (part > 0), part * F.col("__o"))).alias(name))
    found = table.groupBy(*[f"__b{i}" for i in range(len(by))]).agg(*sums)
    return found.withColumnsRenamed({f"__b{i}": b for i, b in enumerate(by)})
