"""Retail queries built on subqueries and set operations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.functions.semantics import agg, idiv, isin, link, mean, ordered, round_to_int, top
from tidewater.plans.retail import CATALOG, STORE, WEB, group_total, hit, on_days, span
from tidewater.plans.retail_star import WANTED_ZIPS

# The postal codes the store-profit query asks for.
PROFIT_ZIPS = (
    "24128", "76232", "65084", "87816", "83926", "77556", "20548", "26114", "57678", "66455", "41207", "26161", "00212", "90578", "73602",
    "39559", "41062", "48442", "48408", "71526", "56804", "32412", "58843", "43339", "42775", "31234", "56569", "85268", "71791", "57029",
    "73167", "54561", "53034", "41796", "75625", "37272", "51997", "60099", "69016", "69227", "25263", "65393", "52005", "97294", "16226",
    "62964", "10174", "80583", "88150", "37615",
)


def _stack(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionAll(b), parts)


def _above_usual(totals: DataFrame, place: str) -> DataFrame:
    """Customers whose total is over 1.2 times the average of their place."""
    known = totals.where(f"{place} is not null")
    return group_total(known, [place], "cast(sum(total_return) as double) / count(total_return) as usual").where(
        "cast(total_return as double) > usual * 1.2D"
    )


def q1(t):
    back = on_days(t, t.store_returns, "sr_returned_date_sk", "d_year = 2000")
    totals = back.groupBy("sr_customer_sk", "sr_store_sk").agg(F.sum("sr_return_amt").alias("total_return"))
    rows = hit(_above_usual(totals, "sr_store_sk"), t.store, "sr_store_sk = s_store_sk", "s_state = 'TN'")
    return top(hit(rows, t.customer, "sr_customer_sk = c_customer_sk", None, "c_customer_id").select("c_customer_id"), "c_customer_id")


def _returners(t, ch, amount, year, person_cols):
    r = ch.r
    back = on_days(t, ch.returned(t), f"{r}_returned_date_sk", f"d_year = {year}")
    back = hit(back, t.customer_address, f"{r}_returning_addr_sk = ca_address_sk", None, "ca_state")
    totals = back.groupBy(F.col(f"{r}_returning_customer_sk").alias("who"), F.col("ca_state").alias("place")).agg(F.sum(amount).alias("total_return"))
    person = ["c_customer_id", "c_salutation", "c_first_name", "c_last_name"]
    address = [f"ca_{c}" for c in ("street_number", "street_name", "street_type", "suite_number", "city", "county", "state", "zip", "country", "gmt_offset", "location_type")]
    rows = hit(_above_usual(totals, "place"), t.customer, "who = c_customer_sk", None, *person, *person_cols, "c_current_addr_sk")
    rows = hit(rows, t.customer_address, "c_current_addr_sk = ca_address_sk", "ca_state = 'GA'", *address)
    out = rows.select(*person, *person_cols, *address, F.col("total_return").alias("ctr_total_return"))
    return top(out, *person, *address, "ctr_total_return")


def q30(t):
    return _returners(t, WEB, "wr_return_amt", 2002, ["c_preferred_cust_flag"])


def q81(t):
    return _returners(t, CATALOG, "cr_return_amt_inc_tax", 2000, [])


def q6(t):
    month = t.date_dim.where("d_year = 2001 and d_moy = 1").select(F.col("d_month_seq").alias("wanted")).distinct()
    days = link(t.date_dim, month, "d_month_seq = wanted", "left_semi").select("d_date_sk")
    dear = group_total(t.item.where("i_category is not null"), ["i_category"], "cast(sum(i_current_price) as double) / count(i_current_price) as usual").where(
        "cast(i_current_price as double) > 1.2D * usual"
    )
    sold = link(t.store_sales, days, "ss_sold_date_sk = d_date_sk")
    sold = hit(sold, dear, "ss_item_sk = i_item_sk")
    sold = hit(sold, t.customer, "ss_customer_sk = c_customer_sk", None, "c_current_addr_sk")
    sold = hit(sold, t.customer_address, "c_current_addr_sk = ca_address_sk", None, "ca_state")
    return top(sold.groupBy(F.col("ca_state").alias("state")).agg(F.count(F.lit(1)).alias("cnt")).where("cnt >= 10"), "-cnt", "state", n=10)


def q8(t):
    zip5 = F.substring("ca_zip", 1, 5)
    listed = t.customer_address.select(zip5.alias("zip5")).where(isin("zip5", PROFIT_ZIPS))
    preferred = hit(t.customer.where("c_preferred_cust_flag = 'Y'"), t.customer_address, "c_current_addr_sk = ca_address_sk", None, "ca_zip")
    crowded = preferred.groupBy(zip5.alias("zip5")).agg(F.count(F.lit(1)).alias("cnt")).where("cnt > 10").select("zip5")
    zips = listed.intersect(crowded)
    stores = link(t.store, zips, "substr(s_zip, 1, 5) = zip5").select("s_store_sk", "s_store_name")
    sold = on_days(t, t.store_sales, "ss_sold_date_sk", "d_qoy = 2 and d_year = 2000")
    return top(link(sold, stores, "ss_store_sk = s_store_sk").groupBy("s_store_name").agg(F.sum("ss_net_profit").alias("sum_net_profit")), "s_store_name")


def q9(t, floors=(74129, 122840, 56580, 10097, 15098)):
    # fifteen scalar subqueries over one table: a single pass of conditional aggregates
    parts, picks = [], []
    for i, floor in enumerate(floors, 1):
        inside = f"ss_quantity between {20 * i - 19} and {20 * i}"
        parts += [F.expr(f"count_if({inside})").alias(f"n{i}")]
        for name in ("ss_ext_discount_amt", "ss_net_paid"):
            parts += agg(f"sum(case when {inside} then {name} end) as s_{name}{i}", f"count(case when {inside} then {name} end) as c_{name}{i}")
        average = "cast(s_{0}{1} as double) / nullif(c_{0}{1}, 0)"
        picks.append(F.expr(f"case when n{i} > {floor} then {average.format('ss_ext_discount_amt', i)} else {average.format('ss_net_paid', i)} end").alias(f"bucket{i}"))
    return t.reason.where("r_reason_sk = 1").crossJoin(t.store_sales.agg(*parts)).select(*picks)


def _buyers(t, fact, p, who, days):
    """Distinct customers of a fact in a period; the distinct runs map-side first."""
    return on_days(t, fact, f"{p}_sold_date_sk", days).select(F.col(who).alias("buyer")).distinct()


def _active(t, days, address_cond, *cols):
    people = hit(t.customer, t.customer_address, "c_current_addr_sk = ca_address_sk", address_cond, "ca_state")
    people = hit(people, t.customer_demographics, "c_current_cdemo_sk = cd_demo_sk", None, *cols)
    store = _buyers(t, t.store_sales, "ss", "ss_customer_sk", days)
    web = _buyers(t, t.web_sales, "ws", "ws_bill_customer_sk", days)
    catalog = _buyers(t, t.catalog_sales, "cs", "cs_ship_customer_sk", days)
    return link(people, store, "c_customer_sk = buyer", "left_semi"), web, catalog


def q10(t):
    keys = ["cd_gender", "cd_marital_status", "cd_education_status"]
    counties = isin("ca_county", ("Rush County", "Toole County", "Jefferson County", "Dona Ana County", "La Porte County"))
    people, web, catalog = _active(t, "d_year = 2002 and d_moy between 1 and 4", counties, *keys, "cd_purchase_estimate")
    people = link(people, web.unionAll(catalog), "c_customer_sk = buyer", "left_semi")
    out = people.groupBy(*keys).agg(*agg("count(*) as cnt1", "avg(cd_purchase_estimate) as avg1", "count(*) as cnt2", "count(*) as cnt3"))
    return top(out, *keys)


def q35(t):
    deps = ["cd_dep_count", "cd_dep_employed_count", "cd_dep_college_count"]
    keys = ["ca_state", "cd_gender", "cd_marital_status", *deps]
    people, web, catalog = _active(t, "d_year = 2002 and d_qoy between 1 and 3", None, "cd_gender", "cd_marital_status", *deps)
    people = link(people, web.unionAll(catalog), "c_customer_sk = buyer", "left_semi")
    stats = []
    for i, d in enumerate(deps, 1):
        stats += agg(f"count(*) as cnt{i}", f"min({d}) as min{i}", f"max({d}) as max{i}", f"avg({d}) as avg{i}")
    return top(people.groupBy(*keys).agg(*stats), *keys)


def q69(t):
    keys = ["cd_gender", "cd_marital_status", "cd_education_status", "cd_purchase_estimate", "cd_credit_rating"]
    people, web, catalog = _active(t, "d_year = 2002 and d_moy between 1 and 3", "ca_state in ('KY', 'GA', 'NM')", *keys)
    people = link(people, web.unionAll(catalog), "c_customer_sk = buyer", "left_anti")
    return top(people.groupBy(*keys).agg(*agg("count(*) as cnt1", "count(*) as cnt2", "count(*) as cnt3")), *keys)


def q14(t):
    triple = ["i_brand_id", "i_class_id", "i_category_id"]
    years = "d_year between 1999 and 2001"
    kinds, spent, months = [], [], []
    for ch in (STORE, CATALOG, WEB):
        p = ch.p
        sold = on_days(t, ch.sold(t), f"{p}_sold_date_sk", years, "d_year", "d_moy")
        spent.append(sold.agg(*agg(f"sum({p}_quantity * {p}_list_price) as amount", f"count({p}_quantity * {p}_list_price) as n")))
        items = hit(sold.select(f"{p}_item_sk").distinct(), t.item, f"{p}_item_sk = i_item_sk", None, *triple)
        kinds.append(items.select(*triple).distinct().withColumn("channel", F.lit(ch.name)))
        november = hit(sold.where("d_year = 2001 and d_moy = 11"), t.item, f"{p}_item_sk = i_item_sk", None, *triple)
        months.append(
            november.groupBy(F.lit(ch.name).alias("channel"), *triple).agg(*agg(f"sum({p}_quantity * {p}_list_price) as sales", "count(*) as number_sales"))
        )
    # in all three channels: one count per triple instead of chained intersections
    common = _stack(kinds).groupBy(*[F.col(k).alias(f"x_{k}") for k in triple]).agg(F.countDistinct("channel").alias("channels")).where("channels = 3")
    average = _stack(spent).agg(F.expr("cast(sum(amount) as double) / sum(n)").alias("average_sales"))
    rows = link(_stack(months), common, " and ".join(f"{k} = x_{k}" for k in triple), "left_semi")
    rows = rows.crossJoin(average).where("cast(sales as double) > average_sales")
    out = rows.rollup("channel", *triple).agg(F.sum("sales").alias("total_sales"), F.sum("number_sales").alias("total_number_sales"))
    return top(out, "channel", *triple)


def _unreturned_orders(t, ch, wanted, own_warehouse):
    """Lines of orders shipped from several warehouses and never returned."""
    p, order = ch.p, f"{ch.p}_{ch.order}"
    ids = wanted.select(F.col(order).alias("wanted_order")).distinct()
    spread = (
        link(ch.sold(t), ids, f"{order} = wanted_order", "left_semi")
        .groupBy(F.col(order).alias("spread_order"))
        .agg(*agg(f"min({p}_warehouse_sk) as lo", f"max({p}_warehouse_sk) as hi"))
        .where("lo <> hi")
    )
    rows = wanted.where(f"{p}_warehouse_sk is not null") if own_warehouse else wanted
    rows = link(rows, spread, f"{order} = spread_order", "left_semi")
    rows = link(rows, ch.returned(t), f"{order} = {ch.r}_{ch.return_order}", "left_anti")
    return rows.agg(
        F.countDistinct(order).alias("order_count"), F.sum(f"{p}_ext_ship_cost").alias("total_shipping_cost"), F.sum(f"{p}_net_profit").alias("total_net_profit")
    )


def q16(t):
    wanted = on_days(t, t.catalog_sales, "cs_ship_date_sk", span("2002-02-01", 60))
    wanted = hit(wanted, t.customer_address, "cs_ship_addr_sk = ca_address_sk", "ca_state = 'GA'")
    wanted = hit(wanted, t.call_center, "cs_call_center_sk = cc_call_center_sk", "cc_county = 'Williamson County'")
    return _unreturned_orders(t, CATALOG, wanted, True)


def _web_wanted(t):
    wanted = on_days(t, t.web_sales, "ws_ship_date_sk", span("2000-02-01", 60))
    wanted = hit(wanted, t.customer_address, "ws_ship_addr_sk = ca_address_sk", "ca_state = 'IL'")
    return hit(wanted, t.web_site, "ws_web_site_sk = web_site_sk", "web_company_name = 'pri'")


def q94(t):
    return _unreturned_orders(t, WEB, _web_wanted(t), True)


def q95(t):
    # order numbers are never NULL, so NOT IN over them is a plain anti join
    return _unreturned_orders(t, WEB, _web_wanted(t), False)


def q23(t, share=0.95):
    years = "d_year in (2000, 2001, 2002, 2003)"
    frequent = (
        hit(on_days(t, t.store_sales, "ss_sold_date_sk", years, "d_date"), t.item, "ss_item_sk = i_item_sk", None, "i_item_desc")
        .groupBy(F.substring("i_item_desc", 1, 30).alias("itemdesc"), "ss_item_sk", "d_date")
        .agg(F.count(F.lit(1)).alias("cnt"))
        .where("cnt > 4")
        .select(F.col("ss_item_sk").alias("item_sk"))
        .distinct()
    )
    # one pass per customer gives both the all-time and the in-period total
    dated = link(t.store_sales, t.date_dim.where(years).select("d_date_sk"), "ss_sold_date_sk = d_date_sk", "left")
    totals = dated.where("ss_customer_sk is not null").groupBy("ss_customer_sk").agg(
        *agg("sum(ss_quantity * ss_sales_price) as ssales", "sum(case when d_date_sk is not null then ss_quantity * ss_sales_price end) as csales")
    )
    totals = link(totals, t.customer.select("c_customer_sk"), "ss_customer_sk = c_customer_sk", "left_semi")
    bar = totals.agg(F.max("csales").alias("cmax"))
    best = totals.crossJoin(bar).where(f"cast(ssales as double) > {share}D * cast(cmax as double)").select(F.col("ss_customer_sk").alias("best"))
    parts = []
    for ch in (CATALOG, WEB):
        p = ch.p
        sold = on_days(t, ch.sold(t), f"{p}_sold_date_sk", "d_year = 2000 and d_moy = 2")
        sold = link(sold, frequent, f"{p}_item_sk = item_sk", "left_semi")
        sold = link(sold, best, f"{ch.customer} = best", "left_semi")
        parts.append(sold.select(F.expr(f"{p}_quantity * {p}_list_price as sales")))
    return _stack(parts).agg(F.sum("sales").alias("total_sales"))


def q24(t):
    stores = t.store.where("s_market_id = 8").select("s_store_sk", "s_store_name", "s_state", "s_zip")
    sold = STORE.with_returns(t, link(t.store_sales, stores, "ss_store_sk = s_store_sk"), "inner")
    sold = hit(sold, t.customer, "ss_customer_sk = c_customer_sk", None, "c_last_name", "c_first_name", "c_birth_country", "c_current_addr_sk")
    people = t.customer_address.select("ca_address_sk", "ca_state", "ca_zip", "ca_country")
    sold = link(sold, people, "c_current_addr_sk = ca_address_sk and s_zip = ca_zip").where("c_birth_country <> upper(ca_country)")
    style = ["i_color", "i_current_price", "i_manager_id", "i_units", "i_size"]
    sold = hit(sold, t.item, "ss_item_sk = i_item_sk", None, *style)
    names = ["c_last_name", "c_first_name", "s_store_name"]
    paid = sold.groupBy(*names, "ca_state", "s_state", *style).agg(F.sum("ss_net_paid").alias("netpaid"))
    usual = paid.agg(mean("netpaid").alias("usual"))
    out = paid.where("i_color = 'pale'").groupBy(*names).agg(F.sum("netpaid").alias("paid")).crossJoin(usual)
    return ordered(out.where("cast(paid as double) > 0.05D * usual").select(*names, "paid"), *names)


def q28(t):
    # low quantity, high quantity, least list price, least coupon, least wholesale cost
    bands = ((0, 5, 11, 460, 14), (6, 10, 91, 1430, 32), (11, 15, 66, 920, 4), (16, 20, 142, 3054, 80), (21, 25, 135, 14180, 38), (26, 30, 28, 6415, 42))
    rule = "case " + " ".join(
        f"when ss_quantity between {a} and {b} and (ss_list_price between {lp} and {lp + 10} or ss_coupon_amt between {c} and {c + 1000} "
        f"or ss_wholesale_cost between {w} and {w + 20}) then {i}"
        for i, (a, b, lp, c, w) in enumerate(bands, 1)
    ) + " end"
    # counts per distinct price first: plain and distinct measures then need one small second pass
    prices = t.store_sales.select(F.expr(rule).alias("band"), "ss_list_price").where("band is not null").groupBy("band", "ss_list_price").agg(F.count(F.lit(1)).alias("n"))
    cols = []
    for i in range(1, 7):
        mine = f"band = {i} and ss_list_price is not null"
        cols += agg(
            f"cast(sum(case when {mine} then ss_list_price * n end) as double) / nullif(sum(case when {mine} then n end), 0) as b{i}_lp",
            f"coalesce(sum(case when {mine} then n end), 0) as b{i}_cnt",
            f"count_if({mine}) as b{i}_cntd",
        )
    return prices.agg(*cols)


def _three_channels(t, items, key, days):
    parts = []
    for ch in (STORE, CATALOG, WEB):
        p = ch.p
        sold = on_days(t, ch.sold(t), f"{p}_sold_date_sk", days)
        sold = hit(sold, items, f"{p}_item_sk = i_item_sk", None, key)
        sold = hit(sold, t.customer_address, f"{ch.address} = ca_address_sk", "ca_gmt_offset = -5")
        parts.append(sold.select(key, F.col(f"{p}_ext_sales_price").alias("price")))
    # sums of channel sums are sums: one aggregate over the stacked channels
    return _stack(parts).groupBy(key).agg(F.sum("price").alias("total_sales"))


def q33(t):
    makers = t.item.where("i_category = 'Electronics'").select(F.col("i_manufact_id").alias("maker")).distinct()
    items = link(t.item, makers, "i_manufact_id = maker", "left_semi")
    return top(_three_channels(t, items, "i_manufact_id", "d_year = 1998 and d_moy = 5"), "-total_sales", "i_manufact_id")


def q56(t):
    items = t.item.where("i_color in ('slate', 'blanched', 'burnished')")
    return top(_three_channels(t, items, "i_item_id", "d_year = 2001 and d_moy = 2"), "-total_sales", "i_item_id")


def q60(t):
    music = t.item.where("i_category = 'Music'").select(F.col("i_item_id").alias("music_id")).distinct()
    items = link(t.item, music, "i_item_id = music_id", "left_semi")
    return top(_three_channels(t, items, "i_item_id", "d_year = 1998 and d_moy = 9"), "i_item_id", "-total_sales")


def _channel_days(t):
    """Name and day with one flag per channel: set operations become one grouping."""
    parts = []
    for ch in (STORE, CATALOG, WEB):
        seen = on_days(t, ch.sold(t), f"{ch.p}_sold_date_sk", "d_month_seq between 1200 and 1211", "d_date").select(F.col(ch.customer).alias("who"), "d_date").distinct()
        named = hit(seen, t.customer, "who = c_customer_sk", None, "c_last_name", "c_first_name")
        parts.append(named.select("c_last_name", "c_first_name", "d_date", F.lit(ch.p).alias("seen_in")))
    flags = agg(*[f"max(seen_in = '{p}') as in_{p}" for p in ("ss", "cs", "ws")])
    return _stack(parts).groupBy("c_last_name", "c_first_name", "d_date").agg(*flags)


def q38(t):
    return _channel_days(t).where("in_ss and in_cs and in_ws").agg(F.count(F.lit(1)).alias("cnt"))


def q87(t):
    return _channel_days(t).where("in_ss and not in_cs and not in_ws").agg(F.count(F.lit(1)).alias("cnt"))


def q41(t):
    # category, colours, units, sizes
    variants = (
        ("Women", ("powder", "khaki"), ("Ounce", "Oz"), ("medium", "extra large")),
        ("Women", ("brown", "honeydew"), ("Bunch", "Ton"), ("N/A", "small")),
        ("Men", ("floral", "deep"), ("N/A", "Dozen"), ("petite", "large")),
        ("Men", ("light", "cornflower"), ("Box", "Pound"), ("medium", "extra large")),
        ("Women", ("midnight", "snow"), ("Pallet", "Gross"), ("medium", "extra large")),
        ("Women", ("cyan", "papaya"), ("Cup", "Dram"), ("N/A", "small")),
        ("Men", ("orange", "frosted"), ("Each", "Tbl"), ("petite", "large")),
        ("Men", ("forest", "ghost"), ("Lb", "Bundle"), ("medium", "extra large")),
    )
    either = " or ".join(f"(i_category = '{c}' and {isin('i_color', k)} and {isin('i_units', u)} and {isin('i_size', z)})" for c, k, u, z in variants)
    makers = t.item.where(either).groupBy(F.col("i_manufact").alias("maker")).agg(F.count(F.lit(1)).alias("item_cnt")).where("item_cnt > 1")
    return top(link(t.item.where("i_manufact_id between 738 and 778"), makers, "i_manufact = maker", "left_semi").select("i_product_name").distinct(), "i_product_name")


def q45(t):
    chosen = t.item.where("i_item_sk in (2, 3, 5, 7, 11, 13, 17, 19, 23, 29)").select(F.col("i_item_id").alias("chosen_id")).distinct()
    items = link(t.item, chosen, "i_item_id = chosen_id", "left").select("i_item_sk", F.expr("chosen_id is not null").alias("is_chosen"))
    sold = on_days(t, t.web_sales, "ws_sold_date_sk", "d_qoy = 2 and d_year = 2001")
    sold = hit(sold, items, "ws_item_sk = i_item_sk", None, "is_chosen")
    sold = hit(sold, t.customer, "ws_bill_customer_sk = c_customer_sk", None, "c_current_addr_sk")
    sold = hit(sold, t.customer_address, "c_current_addr_sk = ca_address_sk", None, "ca_zip", "ca_county")
    wanted = sold.where(f"{isin('substr(ca_zip, 1, 5)', WANTED_ZIPS)} or is_chosen")
    return top(wanted.groupBy("ca_zip", "ca_county").agg(F.sum("ws_sales_price").alias("sum_sales_price")), "ca_zip", "ca_county")


def q54(t):
    dresses = t.item.where("i_category = 'Women' and i_class = 'accessories'")
    parts = []
    for ch in (CATALOG, WEB):
        p = ch.p
        sold = on_days(t, ch.sold(t), f"{p}_sold_date_sk", "d_moy = 1 and d_year = 1999")
        parts.append(hit(sold, dresses, f"{p}_item_sk = i_item_sk").select(F.col(ch.customer).alias("who")))
    people = link(t.customer.select("c_customer_sk", "c_current_addr_sk"), _stack(parts).distinct(), "c_customer_sk = who", "left_semi")
    # every store of the customer's county and state counts the sale once: carry their number
    stores = t.store.groupBy("s_county", "s_state").agg(F.count(F.lit(1)).alias("stores"))
    homes = link(t.customer_address, stores, "ca_county = s_county and ca_state = s_state").select("ca_address_sk", "stores")
    people = link(people, homes, "c_current_addr_sk = ca_address_sk")
    first = t.date_dim.where("d_year = 1999 and d_moy = 1").agg(F.min("d_month_seq").alias("m"))
    days = t.date_dim.crossJoin(first).where("d_month_seq between m and m + 3").select("d_date_sk")
    sold = link(t.store_sales, days, "ss_sold_date_sk = d_date_sk").groupBy("ss_customer_sk").agg(F.sum("ss_ext_sales_price").alias("spent"))
    revenue = link(sold, people, "ss_customer_sk = c_customer_sk").select(F.expr("spent * stores as revenue"))
    segments = revenue.select(round_to_int("revenue / 50").alias("segment"))
    out = segments.groupBy("segment").agg(F.count(F.lit(1)).alias("num_customers")).select("segment", "num_customers", F.expr("segment * 50 as segment_base"))
    return top(out, "segment", "num_customers")


def q58(t, start="2000-01-03", days=30):
    revs = []
    for ch in (STORE, CATALOG, WEB):
        p = ch.p
        sold = on_days(t, ch.sold(t), f"{p}_sold_date_sk", span(start, days))
        revs.append(
            hit(sold, t.item, f"{p}_item_sk = i_item_sk", None, "i_item_id").groupBy(F.col("i_item_id").alias(f"{p}_id")).agg(F.sum(f"{p}_ext_sales_price").alias(f"{p}_item_rev"))
        )
    near = " and ".join(f"{a}_item_rev between 0.9 * {b}_item_rev and 1.1 * {b}_item_rev" for a in ("ss", "cs", "ws") for b in ("ss", "cs", "ws") if a != b)
    rows = link(link(revs[0], revs[1], "ss_id = cs_id"), revs[2], "ss_id = ws_id").where(near)
    whole = "cast(ss_item_rev + cs_item_rev + ws_item_rev as double)"
    cols = [F.col("ss_id").alias("item_id")]
    for p, name in (("ss", "ratio"), ("cs", "ratio2"), ("ws", "ratio3")):
        cols += [F.col(f"{p}_item_rev"), F.expr(f"cast({p}_item_rev as double) / {whole} / 3").alias(name)]
    return top(rows.select(*cols), "item_id", "ss_item_rev", "cs_item_rev", "ws_item_rev")


def q83(t):
    named = t.date_dim.where("d_date in (DATE '2000-06-30', DATE '2000-09-27', DATE '2000-11-17')").select(F.col("d_week_seq").alias("week")).distinct()
    days = link(t.date_dim, named, "d_week_seq = week", "left_semi").select("d_date_sk")
    parts = []
    for ch in (STORE, CATALOG, WEB):
        r = ch.r
        back = link(ch.returned(t), days, f"{r}_returned_date_sk = d_date_sk")
        parts.append(hit(back, t.item, f"{r}_item_sk = i_item_sk", None, "i_item_id").groupBy(F.col("i_item_id").alias(f"{r}_id")).agg(F.sum(f"{r}_return_quantity").alias(f"{r}_item_qty")))
    rows = link(link(parts[0], parts[1], "sr_id = cr_id"), parts[2], "sr_id = wr_id").withColumn("total_qty", F.expr("sr_item_qty + cr_item_qty + wr_item_qty"))
    cols = [F.col("sr_id").alias("item_id")]
    for r in ("sr", "cr", "wr"):
        # whole-number division, then times 100, as the source computes it
        cols += [F.col(f"{r}_item_qty"), (idiv(f"{r}_item_qty", "total_qty") * 100).alias(f"{r}_dev")]
    return top(rows.select(*cols, "total_qty"), "item_id", "sr_item_qty")


def q97(t):
    parts = []
    for ch in (STORE, CATALOG):
        p = ch.p
        sold = on_days(t, ch.sold(t), f"{p}_sold_date_sk", "d_month_seq between 1200 and 1211")
        parts.append(sold.select(F.col(ch.customer).alias("who"), F.col(f"{p}_item_sk").alias("what"), F.lit(p).alias("seen_in")))
    # a row without a customer matches nothing and counts nowhere
    pairs = _stack(parts).where("who is not null").groupBy("who", "what").agg(*agg("max(seen_in = 'ss') as in_ss", "max(seen_in = 'cs') as in_cs"))
    return pairs.agg(
        *agg("count_if(in_ss and not in_cs) as store_only", "count_if(in_cs and not in_ss) as catalog_only", "count_if(in_ss and in_cs) as store_and_catalog")
    )


def q78(t):
    def kept(ch):
        p = ch.p
        sold = on_days(t, ch.sold(t), f"{p}_sold_date_sk", "d_year = 2001", "d_year")
        sold = ch.with_returns(t, sold, "left_anti")
        return sold.groupBy(F.col("d_year").alias(f"{p}_year"), F.col(f"{p}_item_sk").alias(f"{p}_item"), F.col(ch.customer).alias(f"{p}_customer")).agg(
            *agg(f"sum({p}_quantity) as {p}_qty", f"sum({p}_wholesale_cost) as {p}_wc", f"sum({p}_sales_price) as {p}_sp")
        )

    rows = kept(STORE)
    for ch in (WEB, CATALOG):
        p = ch.p
        rows = link(rows, kept(ch), f"{p}_year = ss_year and {p}_item = ss_item and {p}_customer = ss_customer", "left")
    rows = rows.withColumn("all_qty", F.expr("coalesce(ws_qty, 0) + coalesce(cs_qty, 0) + ss_qty")).where("all_qty > 0")
    out = rows.select(
        *agg("ss_year as ss_sold_year", "ss_item as ss_item_sk", "ss_customer as ss_customer_sk", "ss_qty div all_qty as store_pct", "ss_qty as store_qty",
             "ss_wc as store_wholesale_cost", "ss_sp as store_sales_price")
    )
    return top(out, "ss_sold_year", "ss_item_sk", "ss_customer_sk", "store_pct", "store_qty", "store_wholesale_cost", "store_sales_price")


def q75(t):
    kind = ["i_brand_id", "i_class_id", "i_category_id", "i_manufact_id"]
    parts = []
    for ch in (CATALOG, STORE, WEB):
        p, r = ch.p, ch.r
        sold = on_days(t, ch.sold(t), f"{p}_sold_date_sk", "d_year in (2001, 2002)", "d_year")
        sold = ch.with_returns(t, hit(sold, t.item, f"{p}_item_sk = i_item_sk", "i_category = 'Books'", *kind))
        parts.append(
            sold.select(
                "d_year", *kind, *agg(f"{p}_quantity - coalesce({r}_return_quantity, 0) as sales_cnt", f"{p}_ext_sales_price - coalesce({ch.return_amount}, 0) as sales_amt")
            )
        )
    # UNION, not UNION ALL: equal detail rows count once
    detail = _stack(parts).where(" and ".join(f"{k} is not null" for k in kind)).distinct()
    years = detail.groupBy(*kind).agg(
        *agg(*[f"sum(case when d_year = {y} then {x} end) as {x}_{y}" for y in (2001, 2002) for x in ("sales_cnt", "sales_amt")])
    )
    fell = years.where("cast(sales_cnt_2002 as double) / cast(sales_cnt_2001 as double) < 0.9D")
    out = fell.select(
        *agg("2001 as prev_year", "2002 as curr_year", *kind, "sales_cnt_2001 as prev_yr_cnt", "sales_cnt_2002 as curr_yr_cnt",
             "sales_cnt_2002 - sales_cnt_2001 as sales_cnt_diff", "sales_amt_2002 - sales_amt_2001 as sales_amt_diff")
    )
    return top(out, "sales_cnt_diff", "sales_amt_diff", *kind)


def q64(t, market=7, marital=("D",), education=("Unknown",), low=15045, high=65045):
    # one filtered set of lines serves both roles of the self join
    lines = on_days(t, t.store_sales, "ss_sold_date_sk", "d_year = 1999")
    lines = hit(lines, t.item, "ss_item_sk = i_item_sk", "i_color in ('maroon', 'burnished', 'dim') and i_category = 'Women'", "i_manufact_id")
    lines = hit(lines, t.customer_demographics, "ss_cdemo_sk = cd_demo_sk", f"{isin('cd_marital_status', marital)} and {isin('cd_education_status', education)}", "cd_marital_status", "cd_education_status")
    lines = hit(lines, t.household_demographics, "ss_hdemo_sk = hd_demo_sk", None, "hd_income_band_sk")
    lines = hit(lines, t.income_band, "hd_income_band_sk = ib_income_band_sk", None, "ib_lower_bound", "ib_upper_bound")
    lines = hit(lines, t.customer_address, "ss_addr_sk = ca_address_sk", "ca_country = 'United States'")
    first = hit(lines.where(f"ib_lower_bound >= {low} and ib_upper_bound <= {high}"), t.store, "ss_store_sk = s_store_sk", f"s_market_id = {market}")
    first = first.select(*agg("ss_customer_sk as a_who", "ss_ticket_number as a_ticket", "i_manufact_id as a_maker", "ib_lower_bound as a_band",
                              "cd_marital_status as a_marital", "cd_education_status as a_education"))
    back = on_days(t, t.store_returns, "sr_returned_date_sk", "d_year = 2000")
    second = link(lines, back, "ss_item_sk = sr_item_sk and ss_ticket_number = sr_ticket_number")
    same = "a_who = ss_customer_sk and a_ticket = ss_ticket_number and a_maker = i_manufact_id and a_band = ib_lower_bound"
    pairs = link(first, second, f"{same} and a_marital = cd_marital_status and a_education = cd_education_status")
    people = hit(pairs, t.customer, "sr_customer_sk = c_customer_sk", None, "c_last_name", "c_first_name", "c_customer_id")
    cols = ["c_last_name", "c_first_name", "c_customer_id"]
    return top(people.select(*cols), *cols)


_IDS = (1, 6, 8, 9, 10, 14, 16, 23, 24, 28, 30, 33, 35, 38, 41, 45, 54, 56, 58, 60, 64, 69, 75, 78, 81, 83, 87, 94, 95, 97)
QUERIES = {f"ds_q{i:02d}": globals()[f"q{i}"] for i in _IDS}
