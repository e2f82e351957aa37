"""Scalar rules for parameter values and target transforms, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Parameters read as switches and as memory sizes.
BOOL_PARAMS = (
    "jit", "enable_hashagg", "enable_bitmapscan", "enable_nestloop", "enable_parallel_hash", "enable_sort", "enable_mergejoin", "enable_hashjoin",
    "enable_memoize", "enable_gathermerge", "enable_incremental_sort", "enable_material", "enable_indexscan", "enable_indexonlyscan",
    "enable_parallel_append", "parallel_leader_participation", "synchronous_commit",
)
MEMORY_PARAMS = ("shared_buffers", "effective_cache_size", "work_mem", "min_parallel_table_scan_size", "min_parallel_index_scan_size", "wal_buffers")


def _col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def parsed(text: Column) -> Column:
    """The double that a text spells, NULL where it spells none. What has no digit and is not infinite or NaN isn't tried: each failure costs an exception."""
    return F.when(text.rlike("[0-9]|(?i:inf|nan)"), text.try_cast("double"))


def memory_mb(x) -> Column:
    """Memory text in MB: GB, MB and kB suffixes in any case, plain numbers as they are."""
    text = F.trim(_col(x).cast("string"))
    number = parsed(F.regexp_extract(text, r"^([-+0-9.eE]+?)\s*(?i:gb|mb|kb)?$", 1))
    unit = F.lower(F.regexp_extract(text, r"((?i)gb|mb|kb)$", 1))
    return F.when(unit == "gb", number * 1024.0).when(unit == "kb", number / 1024.0).otherwise(number)


def switch(x) -> Column:
    """on/1/true as 1.0, other numbers as they are, anything else as 0.0."""
    text = F.lower(F.trim(_col(x).cast("string")))
    return F.when(text.isin("on", "true"), 1.0).when(text.isNotNull(), F.coalesce(parsed(text), F.lit(0.0)))


def number(x) -> Column:
    """A number, or NULL where the text is none."""
    return parsed(_col(x).cast("string"))


def encode(name: str, x) -> Column:
    """A parameter value as a double, by the rule of its kind."""
    if name in BOOL_PARAMS:
        return switch(x)
    return memory_mb(x) if name in MEMORY_PARAMS else number(x)


def to_scale(x, transform: str) -> Column:
    y = _col(x).cast("double")
    return {"log": F.ln(F.greatest(y, F.lit(1.0))), "log1p": F.log1p(y), "none": y}[transform]


def from_scale(x, transform: str) -> Column:
    y = _col(x).cast("double")
    return {"log": F.exp(y), "log1p": F.expm1(y), "none": y}[transform]


def json_rows(df, key: str, *columns: str):
    """Rows of a group as one JSON array, ordered by the packed columns."""
    return df.groupBy(key).agg(F.to_json(F.array_sort(F.collect_list(F.struct(*columns)))).alias("rows_json"))
