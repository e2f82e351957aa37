"""Retail queries that are star joins ending in one aggregate or a lookup."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewater.functions.semantics import agg, isin, link, mean, ordered, ratio, top
from tidewater.plans.retail import CATALOG, STORE, WEB, group_total, hit, on_days, pivot_sums, span

WEEK = {f"{d[:3].lower()}_sales": f"'{d}'" for d in ("Sunday", "Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday")}
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
LAG_BUCKETS = ("<= 30 as d30", "between 31 and 60 as d31_60", "between 61 and 90 as d61_90", "between 91 and 120 as d91_120", "> 120 as gt120")


def _brand_sales(t, item_cond, day_cond, *extra):
    sold = on_days(t, t.store_sales, "ss_sold_date_sk", day_cond, "d_year")
    return hit(sold, t.item, "ss_item_sk = i_item_sk", item_cond, "i_brand_id", "i_brand", "i_category_id", "i_category", "i_manufact_id", "i_manufact", *extra)


def q3(t):
    sold = _brand_sales(t, "i_manufact_id = 128", "d_moy = 11")
    out = sold.groupBy("d_year", F.col("i_brand_id").alias("brand_id"), F.col("i_brand").alias("brand")).agg(F.sum("ss_ext_sales_price").alias("sum_agg"))
    return top(out, "d_year", "-sum_agg", "brand_id", "brand")


def q42(t):
    sold = _brand_sales(t, "i_manager_id = 1", "d_moy = 11 and d_year = 2000")
    out = sold.groupBy("d_year", "i_category_id", "i_category").agg(F.sum("ss_ext_sales_price").alias("sum_sales"))
    return top(out, "-sum_sales", "d_year", "i_category_id", "i_category")


def q52(t):
    sold = _brand_sales(t, "i_manager_id = 1", "d_moy = 11 and d_year = 2000")
    out = sold.groupBy("d_year", F.col("i_brand_id").alias("brand_id"), F.col("i_brand").alias("brand")).agg(F.sum("ss_ext_sales_price").alias("ext_price"))
    return top(out, "d_year", "-ext_price", "brand_id", "brand")


def q55(t):
    sold = _brand_sales(t, "i_manager_id = 36", "d_moy = 12 and d_year = 2001")
    out = sold.groupBy(F.col("i_brand_id").alias("brand_id"), F.col("i_brand").alias("brand")).agg(F.sum("ss_ext_sales_price").alias("ext_price"))
    return top(out, "-ext_price", "brand_id", "brand")


def q19(t):
    sold = _brand_sales(t, "i_manager_id = 7", "d_moy = 11 and d_year = 1999")
    sold = hit(sold, t.customer, "ss_customer_sk = c_customer_sk", None, "c_current_addr_sk")
    sold = hit(sold, t.customer_address, "c_current_addr_sk = ca_address_sk", None, "ca_zip")
    sold = hit(sold, t.store, "ss_store_sk = s_store_sk", None, "s_zip").where("substr(ca_zip, 1, 5) <> substr(s_zip, 1, 5)")
    out = sold.groupBy(F.col("i_brand_id").alias("brand_id"), F.col("i_brand").alias("brand"), "i_manufact_id", "i_manufact").agg(
        F.sum("ss_ext_sales_price").alias("ext_price")
    )
    return top(out, "-ext_price", "brand", "brand_id", "i_manufact_id", "i_manufact")


def _demographic_averages(t, ch, cdemo):
    p = ch.p
    sold = on_days(t, ch.sold(t), f"{p}_sold_date_sk", "d_year = 2000")
    sold = hit(sold, t.customer_demographics, f"{cdemo} = cd_demo_sk", "cd_gender = 'M' and cd_marital_status = 'S' and cd_education_status = 'College'")
    sold = hit(sold, t.promotion, f"{p}_promo_sk = p_promo_sk", "p_channel_email = 'N' or p_channel_event = 'N'")
    sold = hit(sold, t.item, f"{p}_item_sk = i_item_sk", None, "i_item_id")
    measures = ("quantity", "list_price", "coupon_amt", "sales_price")
    return top(sold.groupBy("i_item_id").agg(*[mean(f"{p}_{m}").alias(f"agg{i}") for i, m in enumerate(measures, 1)]), "i_item_id")


def q7(t):
    return _demographic_averages(t, STORE, "ss_cdemo_sk")


def q26(t):
    return _demographic_averages(t, CATALOG, "cs_bill_cdemo_sk")


def _class_share(t, ch):
    keys = ["i_item_id", "i_item_desc", "i_category", "i_class", "i_current_price"]
    sold = on_days(t, ch.sold(t), f"{ch.p}_sold_date_sk", span("1999-02-22", 30))
    sold = hit(sold, t.item, f"{ch.p}_item_sk = i_item_sk", "i_category in ('Sports', 'Books', 'Home')", *keys)
    revenue = sold.groupBy(*keys).agg(F.sum(f"{ch.p}_ext_sales_price").alias("itemrevenue"))
    shares = group_total(revenue, ["i_class"], "sum(itemrevenue) as class_revenue").select(
        *keys, "itemrevenue", F.expr("cast(itemrevenue as double) * 100 / cast(class_revenue as double)").alias("revenueratio")
    )
    return top(shares, "i_category", "i_class", "i_item_id", "i_item_desc", "revenueratio")


def q12(t):
    return _class_share(t, WEB)


def q20(t):
    return _class_share(t, CATALOG)


def q98(t):
    return _class_share(t, STORE)


def _either(*packages):
    return " or ".join(f"({p})" for p in packages)


def _address_pack(states, low, high, profit):
    return f"{isin('ca_state', states)} and {profit} between {low} and {high}"


def q13(t, deps=((3,), (1,), (1,)), profits=((100, 200), (150, 300), (50, 250))):
    sold = on_days(t, t.store_sales, "ss_sold_date_sk", "d_year = 2001")
    sold = hit(sold, t.store, "ss_store_sk = s_store_sk")
    sold = hit(sold, t.household_demographics, "ss_hdemo_sk = hd_demo_sk", None, "hd_dep_count")
    sold = hit(sold, t.customer_demographics, "ss_cdemo_sk = cd_demo_sk", None, "cd_marital_status", "cd_education_status")
    sold = hit(sold, t.customer_address, "ss_addr_sk = ca_address_sk", "ca_country = 'United States'", "ca_state")

    def person(marital, education, low, high, counts):
        return (
            f"cd_marital_status = '{marital}' and cd_education_status = '{education}' "
            f"and ss_sales_price between {low} and {high} and {isin('hd_dep_count', counts)}"
        )

    return (
        sold.where(_either(person("M", "Advanced Degree", 100, 150, deps[0]), person("S", "College", 50, 100, deps[1]), person("W", "2 yr Degree", 150, 200, deps[2])))
        .where(
            _either(
                _address_pack(("TX", "OH"), *profits[0], "ss_net_profit"),
                _address_pack(("OR", "NM", "KY"), *profits[1], "ss_net_profit"),
                _address_pack(("VA", "TX", "MS"), *profits[2], "ss_net_profit"),
            )
        )
        .agg(
            mean("ss_quantity").alias("avg_quantity"),
            mean("ss_ext_sales_price").alias("avg_ext_sales_price"),
            mean("ss_ext_wholesale_cost").alias("avg_ext_wholesale_cost"),
            F.sum("ss_ext_wholesale_cost").alias("sum_ext_wholesale_cost"),
        )
    )


def q48(t):
    sold = on_days(t, t.store_sales, "ss_sold_date_sk", "d_year = 2000")
    sold = hit(sold, t.store, "ss_store_sk = s_store_sk")
    sold = hit(sold, t.customer_demographics, "ss_cdemo_sk = cd_demo_sk", None, "cd_marital_status", "cd_education_status")
    sold = hit(sold, t.customer_address, "ss_addr_sk = ca_address_sk", "ca_country = 'United States'", "ca_state")

    def person(marital, education, low, high):
        return f"cd_marital_status = '{marital}' and cd_education_status = '{education}' and ss_sales_price between {low} and {high}"

    return (
        sold.where(_either(person("M", "4 yr Degree", 100, 150), person("D", "2 yr Degree", 50, 100), person("S", "College", 150, 200)))
        .where(
            _either(
                _address_pack(("CO", "OH", "TX"), 0, 2000, "ss_net_profit"),
                _address_pack(("OR", "MN", "KY"), 150, 300, "ss_net_profit"),
                _address_pack(("VA", "CA", "MS"), 50, 250, "ss_net_profit"),
            )
        )
        .agg(F.sum("ss_quantity").alias("total_quantity"))
    )


def q85(t, profits=((100, 200), (150, 300), (50, 250))):
    persons = (("M", "Advanced Degree", 100, 150), ("S", "College", 50, 100), ("W", "2 yr Degree", 150, 200))
    places = (("IN", "OH", "NJ"), ("WI", "CT", "KY"), ("LA", "IA", "AR"))
    # what can be settled on one side goes before the join of the two facts
    wanted = _either(*[f"cd_marital_status = '{marital}' and cd_education_status = '{education}'" for marital, education, _, _ in persons])
    people = t.customer_demographics.where(wanted).select("cd_demo_sk", "cd_marital_status", "cd_education_status")
    payer = people.select(*[F.col(c).alias(f"p_{c}") for c in people.columns])
    sender = people.select(*[F.col(c).alias(f"s_{c}") for c in people.columns])
    back = link(t.web_returns, payer, "wr_refunded_cdemo_sk = p_cd_demo_sk")
    back = link(
        back,
        sender,
        "wr_returning_cdemo_sk = s_cd_demo_sk and p_cd_marital_status = s_cd_marital_status and p_cd_education_status = s_cd_education_status",
    )
    states = isin("ca_state", [x for place in places for x in place])
    back = hit(back, t.customer_address, "wr_refunded_addr_sk = ca_address_sk", f"ca_country = 'United States' and {states}", "ca_state")
    sold = on_days(t, t.web_sales, "ws_sold_date_sk", "d_year = 2000")
    sold = hit(sold, t.web_page, "ws_web_page_sk = wp_web_page_sk")
    sold = sold.where(_either(*[f"ws_sales_price between {low} and {high}" for _, _, low, high in persons]))
    pair = link(sold, back, "ws_item_sk = wr_item_sk and ws_order_number = wr_order_number")
    pair = hit(pair, t.reason, "wr_reason_sk = r_reason_sk", None, "r_reason_desc")

    def person(marital, education, low, high):
        return f"p_cd_marital_status = '{marital}' and p_cd_education_status = '{education}' and ws_sales_price between {low} and {high}"

    out = (
        pair.where(_either(*[person(*p) for p in persons]))
        .where(_either(*[_address_pack(place, *profit, "ws_net_profit") for place, profit in zip(places, profits)]))
        .groupBy("r_reason_desc")
        .agg(mean("ws_quantity").alias("avg_qty"), mean("wr_refunded_cash").alias("avg_refunded_cash"), mean("wr_fee").alias("avg_fee"))
        .select(F.expr("substr(r_reason_desc, 1, 20)").alias("reason"), "avg_qty", "avg_refunded_cash", "avg_fee")
    )
    return top(out, "reason", "avg_qty", "avg_refunded_cash", "avg_fee")


WANTED_ZIPS = ("85669", "86197", "88274", "83405", "86475", "85392", "85460", "80348", "81792")


def q15(t):
    sold = on_days(t, t.catalog_sales, "cs_sold_date_sk", "d_qoy = 2 and d_year = 2001")
    sold = hit(sold, t.customer, "cs_bill_customer_sk = c_customer_sk", None, "c_current_addr_sk")
    sold = hit(sold, t.customer_address, "c_current_addr_sk = ca_address_sk", None, "ca_zip", "ca_state")
    wanted = sold.where(f"{isin('substr(ca_zip, 1, 5)', WANTED_ZIPS)} or ca_state in ('CA', 'WA', 'GA') or cs_sales_price > 500")
    return top(wanted.groupBy("ca_zip").agg(F.sum("cs_sales_price").alias("sum_sales_price")), "ca_zip")


def _chain(t, sold, returned, bought):
    """Store sale, its return, and a catalog purchase of the item by the same customer."""
    sales = on_days(t, t.store_sales, "ss_sold_date_sk", sold)
    back = on_days(t, t.store_returns, "sr_returned_date_sk", returned)
    again = on_days(t, t.catalog_sales, "cs_sold_date_sk", bought)
    both = link(sales, back, "ss_customer_sk = sr_customer_sk and ss_item_sk = sr_item_sk and ss_ticket_number = sr_ticket_number")
    rows = link(both, again, "sr_customer_sk = cs_bill_customer_sk and sr_item_sk = cs_item_sk")
    rows = hit(rows, t.store, "ss_store_sk = s_store_sk", None, "s_store_id", "s_store_name", "s_state")
    return hit(rows, t.item, "ss_item_sk = i_item_sk", None, "i_item_id", "i_item_desc")


def q17(t):
    later = "d_quarter_name in ('2001Q1', '2001Q2', '2001Q3')"
    keys = ["i_item_id", "i_item_desc", "s_state"]
    cols = []
    for label, x in (("store_sales", "ss_quantity"), ("store_returns", "sr_return_quantity"), ("catalog_sales", "cs_quantity")):
        cov = f"round(stddev_samp({x}) / avg({x}), 6)"
        # the catalog deviation column carries the coefficient too, as published
        deviation = cov if label == "catalog_sales" else f"round(stddev_samp({x}), 6)"
        cols += agg(
            f"count({x}) as {label}_quantitycount",
            f"avg({x}) as {label}_quantityave",
            f"{deviation} as {label}_quantitystdev",
            f"{cov} as {label}_quantitycov",
        )
    return top(_chain(t, "d_quarter_name = '2001Q1'", later, later).groupBy(*keys).agg(*cols), *keys)


def q25(t):
    keys = ["i_item_id", "i_item_desc", "s_store_id", "s_store_name"]
    later = "d_moy between 4 and 10 and d_year = 2001"
    sums = agg("sum(ss_net_profit) as store_sales_profit", "sum(sr_net_loss) as store_returns_loss", "sum(cs_net_profit) as catalog_sales_profit")
    return top(_chain(t, "d_moy = 4 and d_year = 2001", later, later).groupBy(*keys).agg(*sums), *keys)


def q29(t):
    keys = ["i_item_id", "i_item_desc", "s_store_id", "s_store_name"]
    rows = _chain(t, "d_moy = 9 and d_year = 1999", "d_moy between 9 and 12 and d_year = 1999", "d_year in (1999, 2000, 2001)")
    sums = agg("sum(ss_quantity) as store_sales_quantity", "sum(sr_return_quantity) as store_returns_quantity", "sum(cs_quantity) as catalog_sales_quantity")
    return top(rows.groupBy(*keys).agg(*sums), *[f"-{k}" for k in keys])


def _by_month(t, ch, net):
    p = ch.p
    keys = ["w_warehouse_name", "w_warehouse_sq_ft", "w_city", "w_county", "w_state", "w_country"]
    sold = on_days(t, ch.sold(t), f"{p}_sold_date_sk", "d_year = 2001", "d_year", "d_moy")
    sold = hit(sold, t.time_dim, f"{p}_sold_time_sk = t_time_sk", "t_time between 30838 and 59638")
    sold = hit(sold, t.ship_mode, f"{p}_ship_mode_sk = sm_ship_mode_sk", "sm_carrier in ('DHL', 'BARIAN')")
    sold = hit(sold, t.warehouse, f"{p}_warehouse_sk = w_warehouse_sk", None, *keys)
    months = {m: str(i) for i, m in enumerate(MONTHS, 1)}
    sales = pivot_sums("d_moy", {f"{m}_sales": i for m, i in months.items()}, f"{p}_sales_price * {p}_quantity", "0")
    nets = pivot_sums("d_moy", {f"{m}_net": i for m, i in months.items()}, f"{net} * {p}_quantity", "0")
    rows = sold.groupBy(*keys, F.lit("DHL,BARIAN").alias("ship_carriers"), F.col("d_year").alias("year1")).agg(*sales, *nets)
    return top(rows, "w_warehouse_name")


def q22(t):
    return _by_month(t, WEB, "ws_net_paid")


def q66(t):
    return _by_month(t, CATALOG, "cs_net_paid_inc_ship")


def _excess_discount(t, ch, manufacturer):
    p = ch.p
    sold = on_days(t, ch.sold(t), f"{p}_sold_date_sk", span("2000-01-27", 90)).select(f"{p}_item_sk", f"{p}_ext_discount_amt")
    # items of the one manufacturer first: the average needs no other item
    sold = hit(sold, t.item, f"{p}_item_sk = i_item_sk", f"i_manufact_id = {manufacturer}")
    limits = sold.groupBy(F.col(f"{p}_item_sk").alias("limit_item")).agg(mean(f"{p}_ext_discount_amt").alias("usual"))
    over = link(sold, limits, f"{p}_item_sk = limit_item and cast({p}_ext_discount_amt as double) > 1.3D * usual")
    return over.agg(F.sum(f"{p}_ext_discount_amt").alias("excess_discount_amount"))


def q32(t):
    return _excess_discount(t, CATALOG, 977)


def q92(t):
    return _excess_discount(t, WEB, 350)


def _stocked(t, ch, low, high, start, makers):
    keys = ["i_item_id", "i_item_desc", "i_current_price"]
    items = t.item.where(f"i_current_price between {low} and {high} and {isin('i_manufact_id', makers)}")
    held = on_days(t, t.inventory.where("inv_quantity_on_hand between 100 and 500"), "inv_date_sk", span(start, 60))
    # only existence matters: semi joins keep one row per item
    items = link(items, held, "inv_item_sk = i_item_sk", "left_semi")
    items = link(items, ch.sold(t), f"{ch.p}_item_sk = i_item_sk", "left_semi")
    return top(items.select(*keys).distinct(), *keys)


def q37(t):
    return _stocked(t, CATALOG, 68, 98, "2000-02-01", (677, 940, 694, 808))


def q82(t):
    return _stocked(t, STORE, 62, 92, "2000-05-25", (129, 270, 821, 423))


def q40(t):
    sold = on_days(t, t.catalog_sales, "cs_sold_date_sk", span("2000-03-11", 30, 30), "d_date")
    sold = hit(sold, t.item, "cs_item_sk = i_item_sk", "i_current_price between 0.99 and 1.49", "i_item_id")
    sold = CATALOG.with_returns(t, sold)
    sold = hit(sold, t.warehouse, "cs_warehouse_sk = w_warehouse_sk", None, "w_state")
    net = "cs_sales_price - coalesce(cr_refunded_cash, 0)"
    out = sold.groupBy("w_state", "i_item_id").agg(
        *agg(
            f"sum(case when d_date < DATE '2000-03-11' then {net} else 0 end) as sales_before",
            f"sum(case when d_date >= DATE '2000-03-11' then {net} else 0 end) as sales_after",
        )
    )
    return top(out, "w_state", "i_item_id")


def q43(t):
    sold = on_days(t, t.store_sales, "ss_sold_date_sk", "d_year = 1998", "d_day_name")
    sold = hit(sold, t.store, "ss_store_sk = s_store_sk", "s_gmt_offset = -5", "s_store_name", "s_store_id")
    out = sold.groupBy("s_store_name", "s_store_id").agg(*pivot_sums("d_day_name", WEEK, "ss_sales_price"))
    return top(out, "s_store_name", "s_store_id", *WEEK)


def _tickets(t, days, households, stores, *store_cols):
    sold = on_days(t, t.store_sales, "ss_sold_date_sk", days)
    sold = hit(sold, t.household_demographics, "ss_hdemo_sk = hd_demo_sk", households)
    return hit(sold, t.store, "ss_store_sk = s_store_sk", stores, *store_cols)


def _bought_elsewhere(t, days, stores, measures, outputs):
    sold = _tickets(t, days, "hd_dep_count = 4 or hd_vehicle_count = 3", stores)
    sold = hit(sold, t.customer_address, "ss_addr_sk = ca_address_sk", None, "ca_city").withColumnRenamed("ca_city", "bought_city")
    tickets = sold.groupBy("ss_ticket_number", "ss_customer_sk", "ss_addr_sk", "bought_city").agg(*agg(*measures))
    people = hit(tickets, t.customer, "ss_customer_sk = c_customer_sk", None, "c_last_name", "c_first_name", "c_current_addr_sk")
    people = hit(people, t.customer_address, "c_current_addr_sk = ca_address_sk", None, "ca_city").where("ca_city <> bought_city")
    cols = ["c_last_name", "c_first_name", "ca_city", "bought_city", "ss_ticket_number", *outputs]
    return top(people.select(*cols), "c_last_name", "ss_ticket_number", *[c for c in cols if c not in ("c_last_name", "ss_ticket_number")])


def q46(t):
    return _bought_elsewhere(
        t,
        "d_dow in (6, 0) and d_year in (1999, 2000, 2001)",
        "s_city in ('Fairview', 'Midway')",
        ("sum(ss_coupon_amt) as amt", "sum(ss_net_profit) as profit"),
        ("amt", "profit"),
    )


def q68(t):
    return _bought_elsewhere(
        t,
        "d_dom between 1 and 2 and d_year in (1999, 2000, 2001)",
        "s_city in ('Midway', 'Fairview')",
        ("sum(ss_ext_sales_price) as extended_price", "sum(ss_ext_list_price) as list_price", "sum(ss_ext_tax) as extended_tax"),
        ("extended_price", "extended_tax", "list_price"),
    )


def q79(t):
    sold = _tickets(
        t,
        "d_dow = 1 and d_year in (1999, 2000, 2001)",
        "hd_dep_count = 6 or hd_vehicle_count > 2",
        "s_number_employees between 200 and 295",
        "s_city",
    )
    tickets = sold.groupBy("ss_ticket_number", "ss_customer_sk", "ss_addr_sk", "s_city").agg(
        *agg("sum(ss_coupon_amt) as amt", "sum(ss_net_profit) as profit")
    )
    people = hit(tickets, t.customer, "ss_customer_sk = c_customer_sk", None, "c_last_name", "c_first_name")
    out = people.select("c_last_name", "c_first_name", F.substring("s_city", 1, 30).alias("s_city"), "ss_ticket_number", "amt", "profit")
    return top(out, "c_last_name", "c_first_name", "s_city", "profit", "ss_ticket_number", "amt")


def _ticket_counts(t, days, per_vehicle, counties, low, high, *order):
    # integer division truncates in the source, so the ratio test is on whole numbers
    households = (
        "hd_buy_potential in ('>10000', 'Unknown') and hd_vehicle_count > 0 "
        f"and (case when hd_vehicle_count > 0 then hd_dep_count div hd_vehicle_count end) > {per_vehicle}"
    )
    sold = _tickets(t, days, households, isin("s_county", counties))
    tickets = sold.groupBy("ss_ticket_number", "ss_customer_sk").agg(F.count(F.lit(1)).alias("cnt")).where(f"cnt between {low} and {high}")
    names = ["c_last_name", "c_first_name", "c_salutation", "c_preferred_cust_flag"]
    people = hit(tickets, t.customer, "ss_customer_sk = c_customer_sk", None, *names)
    return top(people.select(*names, "ss_ticket_number", "cnt"), *order)


def q34(t):
    return _ticket_counts(
        t,
        "(d_dom between 1 and 3 or d_dom between 25 and 28) and d_year in (1999, 2000, 2001)",
        1.2,
        ("Williamson County",),
        15,
        20,
        "c_last_name", "c_first_name", "c_salutation", "-c_preferred_cust_flag", "ss_ticket_number", "cnt",
    )


def q73(t):
    return _ticket_counts(
        t,
        "(d_dom between 1 and 2 or d_dom between 25 and 28) and d_year in (2000, 2001, 2002)",
        1,
        ("Williamson County", "Franklin Parish", "Bronx County", "Orange County"),
        1,
        5,
        "-cnt", "c_last_name", "c_first_name", "c_salutation", "-c_preferred_cust_flag", "ss_ticket_number",
    )


def _lag_counts(days):
    return agg(*[f"count_if({days} {bucket.split(' as ')[0]}) as {bucket.split(' as ')[1]}" for bucket in LAG_BUCKETS])


def q50(t):
    keys = ["s_store_name", "s_company_id", "s_street_number", "s_street_name", "s_street_type", "s_suite_number", "s_city", "s_county", "s_state", "s_zip"]
    sold = on_days(t, t.store_sales, "ss_sold_date_sk", "d_month_seq between 1200 and 1211")
    pairs = link(sold, t.store_returns, "ss_customer_sk = sr_customer_sk and ss_item_sk = sr_item_sk and ss_ticket_number = sr_ticket_number")
    pairs = hit(pairs, t.store, "ss_store_sk = s_store_sk", None, *keys)
    return top(pairs.groupBy(*keys).agg(*_lag_counts("(sr_returned_date_sk - ss_sold_date_sk)")), *keys)


def _shipping_lag(t, ch, place, on, name, warehouse):
    p = ch.p
    sold = on_days(t, ch.sold(t), f"{p}_ship_date_sk", "d_month_seq between 1200 and 1211")
    sold = hit(sold, t.warehouse, f"{p}_warehouse_sk = w_warehouse_sk", None, "w_warehouse_name")
    sold = hit(sold, t.ship_mode, f"{p}_ship_mode_sk = sm_ship_mode_sk", None, "sm_type")
    sold = hit(sold, place, on, None, name)
    out = sold.groupBy(F.substring("w_warehouse_name", 1, 20).alias(warehouse), "sm_type", name).agg(*_lag_counts(f"({p}_ship_date_sk - {p}_sold_date_sk)"))
    return top(out, warehouse, "sm_type", name)


def q62(t):
    return _shipping_lag(t, WEB, t.web_site, "ws_web_site_sk = web_site_sk", "web_name", "warehouse")


def q99(t):
    return _shipping_lag(t, CATALOG, t.call_center, "cs_call_center_sk = cc_call_center_sk", "cc_name", "warehouse")


def q61(t):
    sold = on_days(t, t.store_sales, "ss_sold_date_sk", "d_year = 1998 and d_moy = 11")
    sold = hit(sold, t.item, "ss_item_sk = i_item_sk", "i_category = 'Jewelry'")
    sold = hit(sold, t.store, "ss_store_sk = s_store_sk")
    sold = hit(sold, t.promotion, "ss_promo_sk = p_promo_sk", None, "p_channel_dmail", "p_channel_email", "p_channel_tv")
    sold = hit(sold, t.customer, "ss_customer_sk = c_customer_sk", None, "c_current_addr_sk")
    sold = hit(sold, t.customer_address, "c_current_addr_sk = ca_address_sk", "ca_gmt_offset = -7")
    sums = sold.agg(
        F.expr("sum(case when 'Y' in (p_channel_dmail, p_channel_email, p_channel_tv) then ss_ext_sales_price else 0 end)").alias("promotional_sales"),
        F.sum("ss_ext_sales_price").alias("all_sales"),
    )
    return sums.select("promotional_sales", "all_sales", (ratio("promotional_sales", "all_sales") * 100).alias("promo_percent"))


def q65(t):
    sold = on_days(t, t.store_sales, "ss_sold_date_sk", "d_month_seq between 1200 and 1211")
    revenue = sold.groupBy("ss_store_sk", "ss_item_sk").agg(F.sum("ss_sales_price").alias("revenue"))
    low = group_total(revenue, ["ss_store_sk"], "cast(sum(revenue) as double) / count(revenue) as ave").where("cast(revenue as double) <= 0.1D * ave")
    low = hit(low, t.store, "ss_store_sk = s_store_sk", None, "s_store_name")
    low = hit(low, t.item, "ss_item_sk = i_item_sk", None, "i_item_desc", "i_current_price", "i_wholesale_cost", "i_brand")
    cols = ["s_store_name", "i_item_desc", "revenue", "i_current_price", "i_wholesale_cost", "i_brand"]
    return top(low.select(*cols), *cols)


def q71(t):
    parts = []
    for ch in (WEB, CATALOG, STORE):
        p = ch.p
        sold = on_days(t, ch.sold(t), f"{p}_sold_date_sk", "d_moy = 11 and d_year = 2001")
        parts.append(sold.select(F.col(f"{p}_ext_sales_price").alias("price"), F.col(f"{p}_sold_time_sk").alias("time_sk"), F.col(f"{p}_item_sk").alias("item_sk")))
    sold = parts[0].unionAll(parts[1]).unionAll(parts[2])
    sold = hit(sold, t.item, "item_sk = i_item_sk", "i_manager_id = 1", "i_brand_id", "i_brand")
    sold = hit(sold, t.time_dim, "time_sk = t_time_sk", None, "t_hour", "t_minute")
    out = sold.groupBy(F.col("i_brand_id").alias("brand_id"), F.col("i_brand").alias("brand"), "t_hour", "t_minute").agg(F.sum("price").alias("ext_price"))
    return top(out, "-ext_price", "brand_id", "brand", "t_hour", "t_minute")


def q72(t):
    # demographics, year and price cut the catalog side before it meets inventory
    sold = on_days(t, t.catalog_sales, "cs_sold_date_sk", "d_year = 2001", "d_date", "d_week_seq")
    sold = sold.withColumnRenamed("d_date", "sold_on").withColumnRenamed("d_week_seq", "sold_week")
    sold = hit(sold, t.household_demographics, "cs_bill_hdemo_sk = hd_demo_sk", "hd_buy_potential = '>10000'")
    sold = hit(sold, t.customer_demographics, "cs_bill_cdemo_sk = cd_demo_sk", "cd_marital_status = 'M'")
    sold = hit(sold, t.item, "cs_item_sk = i_item_sk", "i_current_price > 1.49", "i_item_desc")
    sold = hit(sold, t.date_dim, "cs_ship_date_sk = d_date_sk", None, "d_date").where("d_date > date_add(sold_on, 5)")
    sold = link(sold, t.promotion.select("p_promo_sk"), "cs_promo_sk = p_promo_sk", "left")
    # sum the catalog rows per item and week, so inventory multiplies counts and not rows
    asked = sold.groupBy("cs_item_sk", "i_item_desc", "sold_week").agg(*agg("count_if(p_promo_sk is null) as no_p", "count_if(p_promo_sk is not null) as yes_p"))
    held = on_days(t, t.inventory, "inv_date_sk", "d_year between 2000 and 2002", "d_week_seq")
    held = held.groupBy("inv_item_sk", "inv_warehouse_sk", "d_week_seq").agg(F.count(F.lit(1)).alias("held_rows"))
    rows = link(asked, held, "cs_item_sk = inv_item_sk and sold_week = d_week_seq")
    rows = hit(rows, t.warehouse, "inv_warehouse_sk = w_warehouse_sk", None, "w_warehouse_name")
    out = rows.groupBy("i_item_desc", "w_warehouse_name", "d_week_seq").agg(
        *agg("sum(no_p * held_rows) as no_promo", "sum(yes_p * held_rows) as promo", "sum((no_p + yes_p) * held_rows) as total_cnt")
    )
    return top(out, "-total_cnt", "i_item_desc", "w_warehouse_name", "d_week_seq")


def q76(t):
    parts = []
    for ch in (STORE, WEB, CATALOG):
        p = ch.p
        sold = on_days(t, ch.sold(t).where(f"{p}_promo_sk is null"), f"{p}_sold_date_sk", "true", "d_year", "d_qoy")
        sold = hit(sold, t.item, f"{p}_item_sk = i_item_sk", None, "i_category")
        parts.append(
            sold.groupBy(F.lit(ch.name).alias("channel"), F.lit(f"{p}_promo_sk").alias("col_name"), "d_year", "d_qoy", "i_category").agg(
                F.count(F.lit(1)).alias("sales_cnt"), F.sum(f"{p}_ext_sales_price").alias("sales_amt")
            )
        )
    # channels never share a key, so each is aggregated on its own
    return top(parts[0].unionAll(parts[1]).unionAll(parts[2]), "channel", "col_name", "d_year", "d_qoy", "i_category")


def q84(t):
    people = hit(t.customer, t.customer_address, "c_current_addr_sk = ca_address_sk", "ca_city = 'Edgewood'")
    people = hit(people, t.household_demographics, "c_current_hdemo_sk = hd_demo_sk", None, "hd_income_band_sk")
    people = hit(people, t.income_band, "hd_income_band_sk = ib_income_band_sk", "ib_lower_bound >= 38128 and ib_upper_bound <= 88128")
    people = hit(people, t.customer_demographics, "c_current_cdemo_sk = cd_demo_sk", None, "cd_demo_sk")
    # returns are counted by demographics first: a customer meets one row, and no more than 100 copies of any can be among the first 100
    returned = t.store_returns.groupBy("sr_cdemo_sk").agg(F.count(F.lit(1)).alias("times"))
    rows = link(returned, people, "sr_cdemo_sk = cd_demo_sk")
    out = rows.select(
        F.col("c_customer_id").alias("customer_id"), F.expr("coalesce(c_last_name, '') || ', ' || coalesce(c_first_name, '')").alias("customername"), "times"
    )
    first = top(out, "customer_id", "customername")
    return top(first.select("customer_id", "customername", F.explode(F.sequence(F.lit(1).cast("bigint"), F.least("times", F.lit(100)))).alias("copy")).drop("copy"), "customer_id", "customername")


def q88(t):
    slots = [("h8_30_to_9", 8, ">="), ("h9_to_9_30", 9, "<"), ("h9_30_to_10", 9, ">="), ("h10_to_10_30", 10, "<"),
             ("h10_30_to_11", 10, ">="), ("h11_to_11_30", 11, "<"), ("h11_30_to_12", 11, ">="), ("h12_to_12_30", 12, "<")]
    families = _either("hd_dep_count = 3 and hd_vehicle_count <= 5", "hd_dep_count = 0 and hd_vehicle_count <= 2", "hd_dep_count = 1 and hd_vehicle_count <= 3")
    sold = hit(t.store_sales, t.household_demographics, "ss_hdemo_sk = hd_demo_sk", families)
    sold = hit(sold, t.store, "ss_store_sk = s_store_sk", "s_store_name = 'ese'")
    sold = hit(sold, t.time_dim, "ss_sold_time_sk = t_time_sk", "t_hour between 8 and 12", "t_hour", "t_minute")
    return sold.agg(*agg(*[f"count_if(t_hour = {h} and t_minute {op} 30) as {name}" for name, h, op in slots]))


def q90(t):
    sold = hit(t.web_sales, t.household_demographics, "ws_ship_hdemo_sk = hd_demo_sk", "hd_dep_count = 0")
    sold = hit(sold, t.web_page, "ws_web_page_sk = wp_web_page_sk", "wp_char_count between 5000 and 5200")
    sold = hit(sold, t.time_dim, "ws_sold_time_sk = t_time_sk", "t_hour in (8, 9, 19, 20)", "t_hour")
    counts = sold.agg(*agg("count_if(t_hour in (8, 9)) as amc", "count_if(t_hour in (19, 20)) as pmc"))
    return counts.select(ratio("amc", "pmc").alias("am_pm_ratio"))


def q91(t):
    back = on_days(t, t.catalog_returns, "cr_returned_date_sk", "d_year = 1998 and d_moy = 11")
    back = hit(back, t.customer, "cr_returning_customer_sk = c_customer_sk", None, "c_current_addr_sk", "c_current_cdemo_sk", "c_current_hdemo_sk")
    back = hit(back, t.customer_address, "c_current_addr_sk = ca_address_sk", "ca_gmt_offset = -7")
    back = hit(
        back,
        t.customer_demographics,
        "c_current_cdemo_sk = cd_demo_sk",
        "cd_marital_status in ('M', 'U') and cd_education_status in ('Advanced Degree', 'College', '4 yr Degree')",
        "cd_marital_status",
        "cd_education_status",
    )
    back = hit(
        back,
        t.household_demographics,
        "c_current_hdemo_sk = hd_demo_sk",
        "(hd_buy_potential like 'Unknown%' or hd_buy_potential like '>10000%') and hd_vehicle_count > 0",
    )
    back = hit(back, t.call_center, "cr_call_center_sk = cc_call_center_sk", None, "cc_call_center_id", "cc_name", "cc_manager")
    keys = ["cc_call_center_id", "cc_name", "cc_manager", "cd_marital_status", "cd_education_status"]
    out = back.groupBy(*keys).agg(F.sum("cr_net_loss").alias("returns_loss"))
    return top(
        out.select(
            F.col("cc_call_center_id").alias("call_center"), F.col("cc_name").alias("call_center_name"), F.col("cc_manager").alias("manager"), "returns_loss"
        ),
        "-returns_loss", "call_center", "call_center_name", "manager",
    )


def q93(t):
    back = hit(t.store_returns, t.reason, "sr_reason_sk = r_reason_sk", "r_reason_desc = 'Did not like the color'")
    # the reason test drops sales without a return, so the outer join is an inner one
    sold = link(t.store_sales, back, "sr_item_sk = ss_item_sk and sr_ticket_number = ss_ticket_number")
    kept = "case when sr_return_quantity is not null then (ss_quantity - sr_return_quantity) * ss_sales_price else ss_quantity * ss_sales_price end"
    return top(sold.groupBy("ss_customer_sk").agg(F.expr(f"sum({kept})").alias("sumsales")), "sumsales", "ss_customer_sk")


def q96(t):
    sold = hit(t.store_sales, t.household_demographics, "ss_hdemo_sk = hd_demo_sk", "hd_dep_count = 0")
    sold = hit(sold, t.store, "ss_store_sk = s_store_sk", "s_store_name = 'ese'")
    sold = hit(sold, t.time_dim, "ss_sold_time_sk = t_time_sk", "t_hour = 8 and t_minute >= 30")
    return sold.agg(F.count(F.lit(1)).alias("cnt"))


_IDS = (3, 7, 12, 13, 15, 17, 19, 20, 22, 25, 26, 29, 32, 34, 37, 40, 42, 43, 46, 48, 50, 52, 55, 61, 62, 65, 66, 68, 71, 72, 73, 76, 79, 82, 84, 85, 88, 90, 91, 92, 93, 96, 98, 99)
QUERIES = {f"ds_q{i:02d}": globals()[f"q{i}"] for i in _IDS}
