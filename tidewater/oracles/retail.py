"""Helpers for the retail check queries."""

from __future__ import annotations

import re

from tidewater.sources.tpcds_views import CHECK_VIEWS
from tidewater.sources.views import with_views


def check(body: str) -> str:
    """Prefix the body with the views it names (``d_store_sales`` and so on)."""
    used = [n for n in CHECK_VIEWS if re.search(rf"\b{n}\b", body)]
    return with_views(CHECK_VIEWS, " ".join(used), body)


def avg(x: str) -> str:
    return f"sum({x})::DOUBLE / count({x})"


def total(x: str, name: str) -> str:
    return f"sum({x})::DOUBLE AS {name}"


# channel prefix -> sales view, returns view, billing customer, billing address, order key, return prefix, return amount
CH = {
    "ss": ("d_store_sales", "d_store_returns", "ss_customer_sk", "ss_addr_sk", "ticket_number", "sr", "sr_return_amt"),
    "cs": ("d_catalog_sales", "d_catalog_returns", "cs_bill_customer_sk", "cs_bill_addr_sk", "order_number", "cr", "cr_return_amount"),
    "ws": ("d_web_sales", "d_web_returns", "ws_bill_customer_sk", "ws_bill_addr_sk", "order_number", "wr", "wr_return_amt"),
}


def sold(p: str) -> str:
    """Sales of a channel joined to their sale day."""
    return f"{CH[p][0]} JOIN d_date_dim ON {p}_sold_date_sk = d_date_sk"


def returned(p: str, kind: str = "LEFT") -> str:
    sales, back, _, _, order, r, _ = CH[p]
    return f"{kind} JOIN {back} ON {r}_{order} = {p}_{order} AND {r}_item_sk = {p}_item_sk"
