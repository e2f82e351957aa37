"""Shared steps of the retail plans: dimension lookups and the three channels."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.functions.semantics import link


def hit(fact: DataFrame, dim: DataFrame, on: str, cond: str | None = None, *keep: str) -> DataFrame:
    """Keep fact rows whose dimension row passes ``cond``; carry only the kept columns."""
    key = on.split("=")[1].strip()
    side = (dim.where(cond) if cond else dim).select(key, *[k for k in keep if k != key])
    out = link(fact, side, on)
    return out if key in keep else out.drop(key)


def on_days(t, fact: DataFrame, key: str, cond: str, *keep: str) -> DataFrame:
    return hit(fact, t.date_dim, f"{key} = d_date_sk", cond, *keep)


def span(start: str, days: int, before: int = 0) -> str:
    """A calendar condition around a start day."""
    low = f"date_sub(DATE '{start}', {before})" if before else f"DATE '{start}'"
    return f"d_date between {low} and date_add(DATE '{start}', {days})"


def pivot_sums(column: str, labels: dict[str, str], value: str, empty: str = "") -> list:
    """One conditional sum per label: a pivot with a fixed list, in one pass."""
    tail = f" else {empty}" if empty else ""
    return [F.expr(f"sum(case when {column} = {key} then {value}{tail} end)").alias(name) for name, key in labels.items()]


def group_total(df: DataFrame, keys: list[str], *exprs: str) -> DataFrame:
    """Attach per-group totals by aggregate and join-back.

    The same result as an unordered window, but a group is never gathered in
    one task: the totals are combined map-side and the small side is joined.
    """
    totals = df.groupBy(*[F.col(k).alias(f"_g_{k}") for k in keys]).agg(*[F.expr(e) for e in exprs])
    on = " and ".join(f"{k} <=> _g_{k}" for k in keys)
    return link(df, totals, on).drop(*[f"_g_{k}" for k in keys])


@dataclass(frozen=True)
class Channel:
    name: str
    sales: str
    p: str
    customer: str
    address: str
    order: str
    returns: str
    r: str
    return_order: str
    return_amount: str

    def sold(self, t) -> DataFrame:
        return getattr(t, self.sales)

    def returned(self, t) -> DataFrame:
        return getattr(t, self.returns)

    def with_returns(self, t, df: DataFrame, how: str = "left") -> DataFrame:
        """Sales lines beside their return line, matched on order and item."""
        on = f"{self.p}_{self.order} = {self.r}_{self.return_order} and {self.p}_item_sk = {self.r}_item_sk"
        return link(df, self.returned(t), on, how)


STORE = Channel("store", "store_sales", "ss", "ss_customer_sk", "ss_addr_sk", "ticket_number", "store_returns", "sr", "ticket_number", "sr_return_amt")
CATALOG = Channel("catalog", "catalog_sales", "cs", "cs_bill_customer_sk", "cs_bill_addr_sk", "order_number", "catalog_returns", "cr", "order_number", "cr_return_amount")
WEB = Channel("web", "web_sales", "ws", "ws_bill_customer_sk", "ws_bill_addr_sk", "order_number", "web_returns", "wr", "order_number", "wr_return_amt")
