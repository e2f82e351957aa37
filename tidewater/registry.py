"""Every query by key, with its check SQL where one exists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidewater.functions.semantics import plain_numbers
from tidewater.oracles import retail_sets as retail_sets_sql
from tidewater.oracles import retail_star as retail_star_sql
from tidewater.oracles import retail_windows as retail_windows_sql
from tidewater.oracles import stores as stores_sql
from tidewater.oracles import tpch as tpch_sql
from tidewater.oracles import workload as workload_sql
from tidewater.plans import live, retail_sets, retail_star, retail_windows, stores, tpch, workload
from tidewater.sources import tpcds_views, tpch_views, workload_views

Query = Callable[[SparkSession, str], DataFrame]


# Literals of the published queries that the given tables are too small for.
_ANY_PROFIT = ((-1000000, 1000000),) * 3
ARGUMENTS = {
    "ds_q13": {"deps": (tuple(range(10)),) * 3, "profits": _ANY_PROFIT},
    "ds_q23": {"share": 0.1},
    "ds_q49": {"floor": 1000},
    "ds_q64": {
        "marital": ("M", "S", "W", "D", "U"),
        "education": ("College", "Advanced Degree", "2 yr Degree", "4 yr Degree", "Primary", "Secondary", "Unknown"),
        "low": 0,
        "high": 1000000,
    },
    "ds_q85": {"profits": _ANY_PROFIT},
}


def _bind(name, plan, tables) -> Query:
    return lambda spark, folder: plain_numbers(plan(tables(spark, folder), **ARGUMENTS.get(name, {})))


def queries() -> dict[str, Query]:
    out: dict[str, Query] = {}
    for name, plan in tpch.QUERIES.items():
        out[name] = _bind(name, plan, tpch_views.tables)
    retail = {**retail_star.QUERIES, **retail_sets.QUERIES, **retail_windows.QUERIES}
    for name in sorted(retail):
        out[name] = _bind(name, retail[name], tpcds_views.tables)
    for name, plan in {**workload.QUERIES, **live.QUERIES, **stores.QUERIES}.items():
        out[name] = _bind(name, plan, workload_views.tables)
    return out


def oracle_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    out.update(tpch_sql.sqls())
    for module in (retail_star_sql, retail_sets_sql, retail_windows_sql, workload_sql, stores_sql):
        out.update(module.sqls())
    out.update(live.check_sql())
    return out
