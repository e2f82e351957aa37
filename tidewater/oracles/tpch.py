"""Check queries for the order-to-cash suite, as SQL over the given tables."""

from __future__ import annotations

from tidewater.sources.tpch_views import CHECK_VIEWS
from tidewater.sources.views import with_views

_REV = "l.l_extendedprice * (1 - l.l_discount)"


def _q(tables: str, body: str) -> str:
    return with_views(CHECK_VIEWS, " ".join(f"h_{t}" for t in tables.split()), body)


def sqls() -> dict[str, str]:
    s: dict[str, str] = {}
    s["h_q01"] = _q("lineitem", f"""
        SELECT l_returnflag, l_linestatus, sum(l_quantity)::DOUBLE AS sum_qty, sum(l_extendedprice)::DOUBLE AS sum_base_price,
          sum({_REV})::DOUBLE AS sum_disc_price, sum({_REV} * (1 + l_tax))::DOUBLE AS sum_charge,
          sum(l_quantity)::DOUBLE / count(*) AS avg_qty, sum(l_extendedprice)::DOUBLE / count(*) AS avg_price,
          sum(l_discount)::DOUBLE / count(*) AS avg_disc, count(*) AS count_order
        FROM h_lineitem l WHERE l_shipdate <= DATE '2001-09-02' GROUP BY ALL""")
    s["h_q02"] = _q("part supplier partsupp nation region", """
        WITH offer AS (SELECT * FROM h_partsupp JOIN h_supplier ON ps_suppkey = s_suppkey JOIN h_nation ON s_nationkey = n_nationkey
            JOIN h_region ON n_regionkey = r_regionkey AND r_name = 'EUROPE')
        SELECT s_acctbal::DOUBLE AS s_acctbal, s_name, n_name, p_partkey, p_mfgr, s_address, s_phone, s_comment
        FROM h_part p JOIN offer o ON o.ps_partkey = p.p_partkey
        WHERE p_size = 15 AND p_type LIKE '%BRASS'
          AND ps_supplycost = (SELECT min(x.ps_supplycost) FROM offer x WHERE x.ps_partkey = p.p_partkey)
        ORDER BY o.s_acctbal DESC, n_name, s_name, p_partkey LIMIT 100""")
    s["h_q03"] = _q("customer orders lineitem", f"""
        SELECT l_orderkey, sum({_REV})::DOUBLE AS revenue, o_orderdate, o_shippriority
        FROM h_lineitem l JOIN h_orders ON l_orderkey = o_orderkey JOIN h_customer ON c_custkey = o_custkey
        WHERE c_mktsegment = 'BUILDING' AND o_orderdate < DATE '1998-03-15' AND l_shipdate > DATE '1998-03-15'
        GROUP BY l_orderkey, o_orderdate, o_shippriority ORDER BY sum({_REV}) DESC, o_orderdate, l_orderkey LIMIT 10""")
    s["h_q04"] = _q("orders lineitem", """
        SELECT o_orderpriority, count(*) AS order_count FROM h_orders
        WHERE o_orderdate BETWEEN DATE '1996-07-01' AND DATE '1996-09-30'
          AND o_orderkey IN (SELECT l_orderkey FROM h_lineitem WHERE l_receiptdate > l_commitdate)
        GROUP BY o_orderpriority""")
    s["h_q05"] = _q("customer orders lineitem supplier nation region", f"""
        SELECT n_name, sum({_REV})::DOUBLE AS revenue
        FROM h_lineitem l JOIN h_orders ON l_orderkey = o_orderkey JOIN h_customer ON o_custkey = c_custkey
          JOIN h_supplier ON l_suppkey = s_suppkey AND s_nationkey = c_nationkey
          JOIN h_nation ON s_nationkey = n_nationkey JOIN h_region ON n_regionkey = r_regionkey
        WHERE r_name = 'ASIA' AND year(o_orderdate) = 1997 GROUP BY n_name""")
    s["h_q06"] = _q("lineitem", """
        SELECT sum(l_extendedprice * l_discount)::DOUBLE AS revenue FROM h_lineitem
        WHERE year(l_shipdate) = 1997 AND l_discount IN (0.05, 0.06, 0.07) AND l_quantity < 24""")
    s["h_q07"] = _q("supplier lineitem orders customer nation", f"""
        SELECT sn.n_name AS supp_nation, cn.n_name AS cust_nation, year(l_shipdate)::INT AS l_year, sum({_REV})::DOUBLE AS revenue
        FROM h_lineitem l JOIN h_supplier ON l_suppkey = s_suppkey JOIN h_nation sn ON s_nationkey = sn.n_nationkey
          JOIN h_orders ON l_orderkey = o_orderkey JOIN h_customer ON o_custkey = c_custkey JOIN h_nation cn ON c_nationkey = cn.n_nationkey
        WHERE (sn.n_name, cn.n_name) IN (('FRANCE', 'GERMANY'), ('GERMANY', 'FRANCE')) AND year(l_shipdate) IN (1998, 1999)
        GROUP BY ALL""")
    s["h_q08"] = _q("part supplier lineitem orders customer nation region", f"""
        SELECT year(o_orderdate)::INT AS o_year,
          coalesce(sum({_REV}) FILTER (WHERE sn.n_name = 'BRAZIL'), 0)::DOUBLE / sum({_REV})::DOUBLE AS mkt_share
        FROM h_lineitem l JOIN h_part ON l_partkey = p_partkey JOIN h_supplier ON l_suppkey = s_suppkey
          JOIN h_nation sn ON s_nationkey = sn.n_nationkey JOIN h_orders ON l_orderkey = o_orderkey
          JOIN h_customer ON o_custkey = c_custkey JOIN h_nation cn ON c_nationkey = cn.n_nationkey
          JOIN h_region ON cn.n_regionkey = r_regionkey
        WHERE r_name = 'AMERICA' AND year(o_orderdate) IN (1998, 1999) AND p_type = 'ECONOMY ANODIZED STEEL' GROUP BY 1""")
    s["h_q09"] = _q("part supplier lineitem partsupp orders nation", f"""
        SELECT n_name AS nation, year(o_orderdate)::INT AS o_year, sum({_REV} - ps_supplycost * l_quantity)::DOUBLE AS sum_profit
        FROM h_lineitem l JOIN h_part ON l_partkey = p_partkey JOIN h_supplier ON l_suppkey = s_suppkey
          JOIN h_partsupp ON (ps_partkey, ps_suppkey) = (l_partkey, l_suppkey)
          JOIN h_orders ON l_orderkey = o_orderkey JOIN h_nation ON s_nationkey = n_nationkey
        WHERE contains(p_name, 'green') GROUP BY 1, 2""")
    s["h_q10"] = _q("customer orders lineitem nation", f"""
        SELECT c_custkey, c_name, sum({_REV})::DOUBLE AS revenue, c_acctbal::DOUBLE AS c_acctbal, n_name, c_address, c_phone, c_comment
        FROM h_customer c JOIN h_nation ON c_nationkey = n_nationkey JOIN h_orders ON o_custkey = c_custkey JOIN h_lineitem l ON l_orderkey = o_orderkey
        WHERE l_returnflag = 'R' AND o_orderdate BETWEEN DATE '1996-10-01' AND DATE '1996-12-31'
        GROUP BY c_custkey, c_name, c.c_acctbal, n_name, c_address, c_phone, c_comment
        ORDER BY sum({_REV}) DESC, c_custkey LIMIT 20""")
    s["h_q11"] = _q("partsupp supplier nation", """
        WITH g AS (SELECT ps_partkey, ps_supplycost * ps_availqty AS v FROM h_partsupp JOIN h_supplier ON ps_suppkey = s_suppkey
            JOIN h_nation ON s_nationkey = n_nationkey WHERE n_name = 'GERMANY')
        SELECT ps_partkey, sum(v)::DOUBLE AS value FROM g GROUP BY 1 HAVING sum(v) > (SELECT sum(v) * 0.0001 FROM g)""")
    s["h_q12"] = _q("orders lineitem", """
        SELECT l_shipmode, count(*) FILTER (WHERE left(o_orderpriority, 1) IN ('1', '2')) AS high_line_count,
          count(*) FILTER (WHERE left(o_orderpriority, 1) NOT IN ('1', '2')) AS low_line_count
        FROM h_lineitem JOIN h_orders ON l_orderkey = o_orderkey
        WHERE l_shipmode IN ('SHIP', 'MAIL') AND l_shipdate < l_commitdate AND l_commitdate < l_receiptdate AND year(l_receiptdate) = 1997
        GROUP BY l_shipmode""")
    s["h_q13"] = _q("customer orders", """
        WITH n AS (SELECT c_custkey, count(o_orderkey) AS c_count FROM h_customer
            LEFT JOIN h_orders ON o_custkey = c_custkey AND NOT (o_comment LIKE '%special%requests%') GROUP BY 1)
        SELECT c_count, count(*) AS custdist FROM n GROUP BY 1""")
    s["h_q14"] = _q("lineitem part", f"""
        SELECT 100 * sum(CASE WHEN starts_with(p_type, 'PROMO') THEN {_REV} ELSE 0 END)::DOUBLE / sum({_REV})::DOUBLE AS promo_revenue
        FROM h_lineitem l JOIN h_part ON l_partkey = p_partkey WHERE l_shipdate BETWEEN DATE '1998-09-01' AND DATE '1998-09-30'""")
    s["h_q15"] = _q("lineitem supplier", f"""
        WITH r AS (SELECT l_suppkey, sum({_REV}) AS total FROM h_lineitem l
            WHERE l_shipdate BETWEEN DATE '1999-01-01' AND DATE '1999-03-31' GROUP BY 1)
        SELECT s_suppkey, s_name, s_address, s_phone, total::DOUBLE AS total_revenue
        FROM r JOIN h_supplier ON l_suppkey = s_suppkey WHERE total = (SELECT max(total) FROM r)""")
    s["h_q16"] = _q("partsupp part supplier", """
        SELECT p_brand, p_type, p_size, count(DISTINCT ps_suppkey) AS supplier_cnt FROM h_part JOIN h_partsupp ON p_partkey = ps_partkey
        WHERE p_brand <> 'Brand#45' AND NOT starts_with(p_type, 'MEDIUM POLISHED') AND p_size IN (3, 9, 14, 19, 23, 36, 45, 49)
          AND ps_suppkey NOT IN (SELECT s_suppkey FROM h_supplier WHERE s_comment LIKE '%Customer%Complaints%') GROUP BY ALL""")
    s["h_q17"] = _q("lineitem part", """
        SELECT sum(l_extendedprice)::DOUBLE / 7.0::DOUBLE AS avg_yearly FROM h_lineitem l JOIN h_part p ON p_partkey = l_partkey
        WHERE p_brand = 'Brand#23' AND p_container = 'MED BOX' AND l_quantity::DOUBLE <
          (SELECT 0.2::DOUBLE * (sum(x.l_quantity)::DOUBLE / count(*)) FROM h_lineitem x WHERE x.l_partkey = p.p_partkey)""")
    s["h_q18"] = _q("customer orders lineitem", """
        SELECT c_name, c_custkey, o_orderkey, o_orderdate, o_totalprice::DOUBLE AS o_totalprice, sum(l_quantity)::DOUBLE AS total_qty
        FROM h_customer JOIN h_orders o ON c_custkey = o_custkey JOIN h_lineitem ON l_orderkey = o_orderkey
        GROUP BY c_name, c_custkey, o_orderkey, o_orderdate, o.o_totalprice HAVING sum(l_quantity) > 300
        ORDER BY o.o_totalprice DESC, o_orderdate, o_orderkey LIMIT 100""")
    s["h_q19"] = _q("lineitem part", f"""
        SELECT sum({_REV})::DOUBLE AS revenue FROM h_lineitem l JOIN h_part ON p_partkey = l_partkey
        WHERE l_shipmode IN ('AIR', 'AIR REG') AND l_shipinstruct = 'DELIVER IN PERSON' AND p_size >= 1 AND CASE p_brand
          WHEN 'Brand#12' THEN p_container IN ('SM CASE', 'SM BOX', 'SM PACK', 'SM PKG') AND l_quantity BETWEEN 1 AND 11 AND p_size <= 5
          WHEN 'Brand#23' THEN p_container IN ('MED BAG', 'MED BOX', 'MED PKG', 'MED PACK') AND l_quantity BETWEEN 10 AND 20 AND p_size <= 10
          WHEN 'Brand#34' THEN p_container IN ('LG CASE', 'LG BOX', 'LG PACK', 'LG PKG') AND l_quantity BETWEEN 20 AND 30 AND p_size <= 15
          ELSE false END""")
    s["h_q20"] = _q("supplier nation partsupp part lineitem", """
        WITH moved AS (SELECT l_partkey, l_suppkey, sum(l_quantity) AS q FROM h_lineitem WHERE year(l_shipdate) = 1997 GROUP BY 1, 2)
        SELECT DISTINCT s_name, s_address FROM h_supplier JOIN h_nation ON s_nationkey = n_nationkey AND n_name = 'CANADA'
          JOIN h_partsupp ON ps_suppkey = s_suppkey JOIN h_part ON p_partkey = ps_partkey AND starts_with(p_name, 'forest')
          JOIN moved ON l_partkey = ps_partkey AND l_suppkey = ps_suppkey WHERE 2 * ps_availqty > q""")
    s["h_q21"] = _q("supplier lineitem orders nation", """
        WITH late AS (SELECT * FROM h_lineitem WHERE l_receiptdate > l_commitdate)
        SELECT s_name, count(*) AS numwait FROM late a JOIN h_orders ON o_orderkey = a.l_orderkey AND o_orderstatus = 'F'
          JOIN h_supplier ON s_suppkey = a.l_suppkey JOIN h_nation ON s_nationkey = n_nationkey AND n_name = 'SAUDI ARABIA'
        WHERE EXISTS (FROM h_lineitem b WHERE b.l_orderkey = a.l_orderkey AND b.l_suppkey <> a.l_suppkey)
          AND NOT EXISTS (FROM late b WHERE b.l_orderkey = a.l_orderkey AND b.l_suppkey <> a.l_suppkey)
        GROUP BY s_name ORDER BY numwait DESC, s_name LIMIT 100""")
    s["h_q22"] = _q("customer orders", """
        WITH c AS (SELECT *, left(c_phone, 2) AS cntrycode FROM h_customer WHERE left(c_phone, 2) IN ('13','17','18','23','29','30','31'))
        SELECT cntrycode, count(*) AS numcust, sum(c_acctbal)::DOUBLE AS totacctbal FROM c
        WHERE c_acctbal::DOUBLE > (SELECT sum(c_acctbal)::DOUBLE / count(*) FROM c WHERE c_acctbal > 0)
          AND c_custkey NOT IN (SELECT o_custkey FROM h_orders) GROUP BY 1""")
    return s
