"""The 22 order-to-cash queries as DataFrame plans.

Each takes table access ``t`` and returns one DataFrame. Correlated scalar
subqueries are written as an aggregate joined back, self joins that only ask
"is there another row" as one grouped pass, and no join carries a broadcast
hint: the optimizer broadcasts a side only when its size allows.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewater.functions.semantics import agg, isin, link, mean, not_in, ordered, ratio, top

REVENUE = "l_extendedprice * (1 - l_discount)"


def q1(t):
    return ordered(
        t.lineitem.where(f"l_shipdate <= date_sub({t.day('1998-12-01')}, 90)")
        .groupBy("l_returnflag", "l_linestatus")
        .agg(
            F.sum("l_quantity").alias("sum_qty"),
            F.sum("l_extendedprice").alias("sum_base_price"),
            F.expr(f"sum({REVENUE})").alias("sum_disc_price"),
            F.expr(f"sum({REVENUE} * (1 + l_tax))").alias("sum_charge"),
            mean("l_quantity").alias("avg_qty"),
            mean("l_extendedprice").alias("avg_price"),
            mean("l_discount").alias("avg_disc"),
            F.count(F.lit(1)).alias("count_order"),
        ),
        "l_returnflag",
        "l_linestatus",
    )


def _in_region(t, region):
    nations = link(t.nation, t.region.where(f"r_name = '{region}'"), "n_regionkey = r_regionkey")
    return nations.select("n_nationkey", "n_name")


def q2(t):
    europe = link(t.supplier, _in_region(t, "EUROPE"), "s_nationkey = n_nationkey")
    wanted = t.part.where("p_size = 15 and p_type like '%BRASS'").select("p_partkey", "p_mfgr")
    # semi joins reach below whatever the offers are made from; the columns come after
    offers = link(t.partsupp, wanted.select("p_partkey"), "ps_partkey = p_partkey", "left_semi")
    offers = link(link(offers, wanted, "ps_partkey = p_partkey"), europe, "ps_suppkey = s_suppkey")
    cheapest = offers.groupBy(F.col("p_partkey").alias("best_part")).agg(F.min("ps_supplycost").alias("best_cost"))
    return top(
        link(offers, cheapest, "p_partkey = best_part and ps_supplycost = best_cost").select(
            "s_acctbal", "s_name", "n_name", "p_partkey", "p_mfgr", "s_address", "s_phone", "s_comment"
        ),
        "-s_acctbal",
        "n_name",
        "s_name",
        "p_partkey",
    )


def q3(t):
    cutoff = t.day("1995-03-15")
    buyers = t.customer.where("c_mktsegment = 'BUILDING'").select("c_custkey")
    orders = link(t.orders.where(f"o_orderdate < {cutoff}"), buyers, "o_custkey = c_custkey")
    lines = link(t.lineitem.where(f"l_shipdate > {cutoff}"), orders, "l_orderkey = o_orderkey")
    return top(
        lines.groupBy("l_orderkey", "o_orderdate", "o_shippriority")
        .agg(F.expr(f"sum({REVENUE})").alias("revenue"))
        .select("l_orderkey", "revenue", "o_orderdate", "o_shippriority"),
        "-revenue",
        "o_orderdate",
        "l_orderkey",
        n=10,
    )


def q4(t):
    start = t.day("1993-07-01")
    late = t.lineitem.where("l_commitdate < l_receiptdate").select("l_orderkey")
    return ordered(
        link(
            t.orders.where(f"o_orderdate >= {start} and o_orderdate < {start} + interval 3 months"),
            late,
            "l_orderkey = o_orderkey",
            "left_semi",
        )
        .groupBy("o_orderpriority")
        .agg(F.count(F.lit(1)).alias("order_count")),
        "o_orderpriority",
    )


def q5(t):
    start = t.day("1994-01-01")
    orders = t.orders.where(f"o_orderdate >= {start} and o_orderdate < {start} + interval 1 year")
    local = link(t.supplier, _in_region(t, "ASIA"), "s_nationkey = n_nationkey").select("s_suppkey", "s_nationkey", "n_name")
    lines = link(t.lineitem, local, "l_suppkey = s_suppkey")
    sales = link(link(lines, orders, "l_orderkey = o_orderkey"), t.customer, "o_custkey = c_custkey and c_nationkey = s_nationkey")
    return ordered(sales.groupBy("n_name").agg(F.expr(f"sum({REVENUE})").alias("revenue")), "-revenue", "n_name")


def q6(t):
    start = t.day("1994-01-01")
    return (
        t.lineitem.where(f"l_shipdate >= {start} and l_shipdate < {start} + interval 1 year")
        .where("l_discount between 0.05 and 0.07 and l_quantity < 24")
        .agg(F.expr("sum(l_extendedprice * l_discount)").alias("revenue"))
    )


def q7(t):
    pair = t.nation.where("n_name in ('FRANCE', 'GERMANY')").select("n_nationkey", "n_name")
    sellers = link(t.supplier, pair, "s_nationkey = n_nationkey").select("s_suppkey", F.col("n_name").alias("supp_nation"))
    buyers = link(t.customer, pair, "c_nationkey = n_nationkey").select("c_custkey", F.col("n_name").alias("cust_nation"))
    lines = t.lineitem.where(f"l_shipdate between {t.day('1995-01-01')} and {t.day('1996-12-31')}")
    shipped = link(link(link(lines, sellers, "l_suppkey = s_suppkey"), t.orders, "l_orderkey = o_orderkey"), buyers, "o_custkey = c_custkey")
    keys = ["supp_nation", "cust_nation", "l_year"]
    return ordered(
        shipped.where("supp_nation <> cust_nation")
        .withColumn("l_year", F.year("l_shipdate"))
        .groupBy(*keys)
        .agg(F.expr(f"sum({REVENUE})").alias("revenue")),
        *keys,
    )


def q8(t):
    parts = t.part.where("p_type = 'ECONOMY ANODIZED STEEL'").select("p_partkey")
    orders = t.orders.where(f"o_orderdate between {t.day('1995-01-01')} and {t.day('1996-12-31')}")
    buyers = link(t.customer, _in_region(t, "AMERICA"), "c_nationkey = n_nationkey").select("c_custkey")
    sellers = link(t.supplier, t.nation, "s_nationkey = n_nationkey").select("s_suppkey", F.col("n_name").alias("seller_nation"))
    lines = link(link(t.lineitem, parts, "l_partkey = p_partkey"), orders, "l_orderkey = o_orderkey")
    sales = link(link(lines, buyers, "o_custkey = c_custkey"), sellers, "l_suppkey = s_suppkey")
    shares = sales.groupBy(F.year("o_orderdate").alias("o_year")).agg(
        F.expr(f"sum(case when seller_nation = 'BRAZIL' then {REVENUE} else 0 end)").alias("part"),
        F.expr(f"sum({REVENUE})").alias("whole"),
    )
    return ordered(shares.select("o_year", ratio("part", "whole").alias("mkt_share")), "o_year")


def q9(t):
    parts = t.part.where("p_name like '%green%'").select("p_partkey")
    lines = link(t.lineitem, parts, "l_partkey = p_partkey")
    offers = link(t.partsupp, parts, "ps_partkey = p_partkey", "left_semi")
    costed = link(lines, offers, "ps_partkey = l_partkey and ps_suppkey = l_suppkey")
    sellers = link(t.supplier, t.nation, "s_nationkey = n_nationkey").select("s_suppkey", F.col("n_name").alias("nation"))
    sales = link(link(costed, sellers, "l_suppkey = s_suppkey"), t.orders, "l_orderkey = o_orderkey")
    return ordered(
        sales.groupBy("nation", F.year("o_orderdate").alias("o_year")).agg(
            F.expr(f"sum({REVENUE} - ps_supplycost * l_quantity)").alias("sum_profit")
        ),
        "nation",
        "-o_year",
    )


def q10(t):
    start = t.day("1993-10-01")
    orders = t.orders.where(f"o_orderdate >= {start} and o_orderdate < {start} + interval 3 months")
    lines = link(t.lineitem.where("l_returnflag = 'R'"), orders, "l_orderkey = o_orderkey")
    # revenue per customer first: the wide customer columns join one row per key
    spent = lines.groupBy("o_custkey").agg(F.expr(f"sum({REVENUE})").alias("revenue"))
    return top(
        link(link(spent, t.customer, "o_custkey = c_custkey"), t.nation, "c_nationkey = n_nationkey").select(
            "c_custkey", "c_name", "revenue", "c_acctbal", "n_name", "c_address", "c_phone", "c_comment"
        ),
        "-revenue",
        "c_custkey",
        n=20,
    )


def q11(t):
    german = link(t.supplier, t.nation.where("n_name = 'GERMANY'"), "s_nationkey = n_nationkey").select("s_suppkey")
    value = (
        link(t.partsupp, german, "ps_suppkey = s_suppkey", "left_semi")
        .groupBy("ps_partkey")
        .agg(F.expr("sum(ps_supplycost * ps_availqty)").alias("value"))
    )
    # the total is the sum of the same groups, one row
    total = value.agg(F.sum("value").alias("total"))
    return ordered(value.crossJoin(total).where("value > total * 0.0001").select("ps_partkey", "value"), "-value", "ps_partkey")


def q12(t):
    start = t.day("1994-01-01")
    lines = t.lineitem.where(
        "l_shipmode in ('MAIL', 'SHIP') and l_commitdate < l_receiptdate and l_shipdate < l_commitdate "
        f"and l_receiptdate >= {start} and l_receiptdate < {start} + interval 1 year"
    )
    urgent = "o_orderpriority in ('1-URGENT', '2-HIGH')"
    return ordered(
        link(lines, t.orders, "l_orderkey = o_orderkey")
        .groupBy("l_shipmode")
        .agg(*agg(f"count_if({urgent}) as high_line_count", f"count_if(not {urgent}) as low_line_count")),
        "l_shipmode",
    )


def q13(t):
    counted = (
        t.orders.where("o_comment not like '%special%requests%'").groupBy("o_custkey").agg(F.count("o_orderkey").alias("n"))
    )
    per_customer = link(t.customer.select("c_custkey"), counted, "c_custkey = o_custkey", "left")
    return ordered(
        per_customer.groupBy(F.expr("coalesce(n, 0)").alias("c_count")).agg(F.count(F.lit(1)).alias("custdist")),
        "-custdist",
        "-c_count",
    )


def q14(t):
    start = t.day("1995-09-01")
    lines = t.lineitem.where(f"l_shipdate >= {start} and l_shipdate < {start} + interval 1 month")
    sums = link(lines, t.part, "l_partkey = p_partkey").agg(
        F.expr(f"sum(case when p_type like 'PROMO%' then {REVENUE} else 0 end)").alias("promo"),
        F.expr(f"sum({REVENUE})").alias("whole"),
    )
    return sums.select(F.expr("100 * cast(promo as double) / cast(whole as double)").alias("promo_revenue"))


def q15(t):
    start = t.day("1996-01-01")
    revenue = (
        t.lineitem.where(f"l_shipdate >= {start} and l_shipdate < {start} + interval 3 months")
        .groupBy(F.col("l_suppkey").alias("supplier_no"))
        .agg(F.expr(f"sum({REVENUE})").alias("total_revenue"))
    )
    best = revenue.agg(F.max("total_revenue").alias("best"))
    winners = revenue.crossJoin(best).where("total_revenue = best")
    return ordered(
        link(t.supplier, winners, "s_suppkey = supplier_no").select("s_suppkey", "s_name", "s_address", "s_phone", "total_revenue"),
        "s_suppkey",
    )


def q16(t):
    parts = t.part.where("p_brand <> 'Brand#45' and p_type not like 'MEDIUM POLISHED%'").where(
        isin("p_size", (49, 14, 23, 45, 19, 3, 36, 9))
    )
    complaints = t.supplier.where("s_comment like '%Customer%Complaints%'").select("s_suppkey")
    offers = link(t.partsupp, parts.select("p_partkey"), "ps_partkey = p_partkey", "left_semi")
    offers = not_in(link(offers, parts, "ps_partkey = p_partkey"), "ps_suppkey", complaints, "s_suppkey")
    return ordered(
        offers.groupBy("p_brand", "p_type", "p_size").agg(F.countDistinct("ps_suppkey").alias("supplier_cnt")),
        "-supplier_cnt",
        "p_brand",
        "p_type",
        "p_size",
    )


def q17(t):
    parts = t.part.where("p_brand = 'Brand#23' and p_container = 'MED BOX'").select("p_partkey")
    lines = link(t.lineitem, parts, "l_partkey = p_partkey").select("p_partkey", "l_quantity", "l_extendedprice")
    limits = lines.groupBy(F.col("p_partkey").alias("limit_part")).agg(F.expr("0.2").cast("double").alias("_f"), mean("l_quantity").alias("m"))
    small = link(lines, limits, "p_partkey = limit_part and cast(l_quantity as double) < _f * m")
    return small.agg(F.expr("cast(sum(l_extendedprice) as double) / 7.0D").alias("avg_yearly"))


def q18(t, floor=300):
    big = t.lineitem.groupBy("l_orderkey").agg(F.sum("l_quantity").alias("total_qty")).where(f"total_qty > {floor}")
    # the order's quantity is already in `big`: the lines are not read again
    orders = link(t.orders, big, "o_orderkey = l_orderkey")
    return top(
        link(orders, t.customer, "o_custkey = c_custkey").select(
            "c_name", "c_custkey", "o_orderkey", "o_orderdate", "o_totalprice", "total_qty"
        ),
        "-o_totalprice",
        "o_orderdate",
        "o_orderkey",
    )


def q19(t):
    # brand, containers, least quantity (a span of 10 above it), largest size
    offers = (
        ("Brand#12", ("SM CASE", "SM BOX", "SM PACK", "SM PKG"), 1, 5),
        ("Brand#23", ("MED BAG", "MED BOX", "MED PKG", "MED PACK"), 10, 10),
        ("Brand#34", ("LG CASE", "LG BOX", "LG PACK", "LG PKG"), 20, 15),
    )
    either = " or ".join(
        f"(p_brand = '{b}' and {isin('p_container', c)} and l_quantity between {q} and {q + 10} and p_size between 1 and {s})"
        for b, c, q, s in offers
    )
    lines = t.lineitem.where("l_shipmode in ('AIR', 'AIR REG') and l_shipinstruct = 'DELIVER IN PERSON'")
    return link(lines, t.part, f"l_partkey = p_partkey and ({either})").agg(F.expr(f"sum({REVENUE})").alias("revenue"))


def q20(t):
    start = t.day("1994-01-01")
    parts = t.part.where("p_name like 'forest%'").select("p_partkey")
    stock = link(t.partsupp, parts, "ps_partkey = p_partkey", "left_semi")
    shipped = (
        link(t.lineitem.where(f"l_shipdate >= {start} and l_shipdate < {start} + interval 1 year"), parts, "l_partkey = p_partkey", "left_semi")
        .groupBy("l_partkey", "l_suppkey")
        .agg(F.sum("l_quantity").alias("moved"))
    )
    excess = link(stock, shipped, "l_partkey = ps_partkey and l_suppkey = ps_suppkey and ps_availqty > 0.5 * moved")
    canadian = link(t.supplier, t.nation.where("n_name = 'CANADA'"), "s_nationkey = n_nationkey")
    return ordered(link(canadian, excess, "s_suppkey = ps_suppkey", "left_semi").select("s_name", "s_address"), "s_name")


def q21(t):
    # One grouped pass per order answers both subqueries: another supplier
    # exists when the order's least and greatest supplier differ, and no other
    # supplier was late when the late lines name a single one.
    late = "l_receiptdate > l_commitdate"
    per_order = (
        t.lineitem.groupBy("l_orderkey")
        .agg(
            *agg(
                "min(l_suppkey) as lo",
                "max(l_suppkey) as hi",
                f"min(case when {late} then l_suppkey end) as late_lo",
                f"max(case when {late} then l_suppkey end) as late_hi",
                f"count_if({late}) as late_lines",
            )
        )
        .where("lo <> hi and late_lo = late_hi")
    )
    saudi = link(t.supplier, t.nation.where("n_name = 'SAUDI ARABIA'"), "s_nationkey = n_nationkey").select("s_suppkey", "s_name")
    waiting = link(link(per_order, saudi, "late_lo = s_suppkey"), t.orders.where("o_orderstatus = 'F'"), "l_orderkey = o_orderkey")
    return top(waiting.groupBy("s_name").agg(F.sum("late_lines").alias("numwait")), "-numwait", "s_name")


def q22(t):
    codes = isin("cntrycode", ("13", "31", "23", "29", "30", "18", "17"))
    known = t.customer.withColumn("cntrycode", F.substring("c_phone", 1, 2)).where(codes)
    bar = known.where("c_acctbal > 0").agg(mean("c_acctbal").alias("bar"))
    rich = known.crossJoin(bar).where("cast(c_acctbal as double) > bar")
    idle = link(rich, t.orders.select("o_custkey"), "o_custkey = c_custkey", "left_anti")
    return ordered(
        idle.groupBy("cntrycode").agg(F.count(F.lit(1)).alias("numcust"), F.sum("c_acctbal").alias("totacctbal")), "cntrycode"
    )


QUERIES = {f"h_q{i:02d}": globals()[f"q{i}"] for i in range(1, 23)}
