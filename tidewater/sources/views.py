"""Projections that present the given tables under another model's names.

A view is one base table, an optional inner projection and an outer one. Spark
applies them as narrow selects, so column pruning reaches the Parquet scan;
the same expressions, rendered as SQL, are the common table expressions of the
check queries.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SCHEMAS: dict[str, object] = {}

# The few spellings the two SQL dialects do not share: marker -> (Spark, check engine).
_SPELLINGS = {"EPOCH_US(": ("unix_micros(to_timestamp(", "(epoch_us("), "LIST_OF(": ("array(", "list_value(")}


def spell(text: str, spark: bool) -> str:
    for marker, forms in _SPELLINGS.items():
        text = text.replace(marker, forms[0 if spark else 1])
    return text


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Read one table; its schema is looked up once per path, not once per query."""
    path = f"{folder.rstrip('/')}/{name}.parquet"
    if path not in _SCHEMAS:
        _SCHEMAS[path] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[path]).parquet(path)


def idiv(a: str, b: int) -> str:
    """Floor division of non-negative integers, valid in both dialects."""
    return f"CAST(floor(({a}) / {b}) AS BIGINT)"


def pick(words: str, index: str, sep: str = ",") -> str:
    """The word at a zero-based index of a separated list."""
    n = len(words.split(sep))
    return f"split_part('{words}', '{sep}', CAST(1 + ({index}) % {n} AS INT))"


@dataclass(frozen=True)
class View:
    base: str  # table name, or "range:<rows>" for a fixed-size dimension
    select: tuple[str, ...]
    inner: tuple[str, ...] = ()
    where: str = ""
    group: str = ""
    keys: tuple[str, ...] = ()  # with ``measures``: an aggregation between inner and outer projection
    measures: tuple[str, ...] = ()

    def frame(self, spark: SparkSession, folder: str) -> DataFrame:
        if self.base.startswith("range:"):
            df = spark.range(0, int(self.base[6:]), 1, 1).withColumnRenamed("id", "i")
        else:
            df = read_table(spark, folder, self.base)
        if self.where:
            df = df.where(self.where)
        if self.group:
            df = df.select(*self.group.split(", ")).distinct()
        if self.inner:
            df = df.selectExpr(*[spell(e, True) for e in self.inner])
        if self.keys:
            df = df.groupBy(*self.keys).agg(*[F.expr(m) for m in self.measures])
        return df.selectExpr(*[spell(e, True) for e in self.select])

    def sql(self) -> str:
        source = f"range(0, {self.base[6:]}) AS r(i)" if self.base.startswith("range:") else self.base
        where = f" WHERE {self.where}" if self.where else ""
        if self.group:
            source, where = f"(SELECT DISTINCT {self.group} FROM {source}{where})", ""
        if self.inner:
            source, where = f"(SELECT {', '.join(self.inner)} FROM {source}{where})", ""
        if self.keys:
            keys = ", ".join(self.keys)
            source, where = f"(SELECT {keys}, {', '.join(self.measures)} FROM {source}{where} GROUP BY {keys})", ""
        return spell(f"SELECT {', '.join(self.select)} FROM {source}{where}", False)


class Tables:
    """Attribute access to views over a folder: ``t.store_sales`` is a DataFrame."""

    def __init__(self, spark: SparkSession, folder: str, views: dict[str, View], year_shift: int = 0):
        self.spark = spark
        self.folder = folder
        self.year_shift = year_shift
        self._views = views
        self._frames: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name not in self._views:
            raise AttributeError(name)
        if name not in self._frames:
            self._frames[name] = self._views[name].frame(self.spark, self.folder)
        return self._frames[name]

    def day(self, iso: str) -> str:
        """A date literal, moved by whole years when the data covers other years."""
        return f"DATE '{int(iso[:4]) + self.year_shift}{iso[4:]}'"


class StoredTables(Tables):
    """The same access over tables already stored under their own names (Parquet folders)."""

    def __init__(self, spark: SparkSession, folder: str, names):
        super().__init__(spark, folder, {n: None for n in names})

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name not in self._views:
            raise AttributeError(name)
        if name not in self._frames:
            self._frames[name] = read_table(self.spark, self.folder, name)
        return self._frames[name]


def with_views(views: dict[str, View], names: str, body: str) -> str:
    """Check query text: the named views as common table expressions, then the body."""
    parts = [f"{n} AS ({views[n].sql()})" for n in names.split()]
    head = "WITH " + ", ".join(parts)
    body = body.strip()
    if body.upper().startswith("WITH "):
        return f"{head}, {body[5:]}"
    return f"{head} {body}"
