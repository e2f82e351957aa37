"""Check queries for the retail subquery and set-operation plans."""

from __future__ import annotations

from tidewater.oracles.retail import CH, avg, check, returned, sold, total
from tidewater.plans.retail_sets import PROFIT_ZIPS


def sqls() -> dict[str, str]:
    s: dict[str, str] = {}
    s["ds_q01"] = check(f"""
        WITH r AS (SELECT sr_customer_sk AS who, sr_store_sk AS st, sum(sr_return_amt) AS v FROM d_store_returns JOIN d_date_dim ON d_date_sk = sr_returned_date_sk
            WHERE d_year = 2000 GROUP BY 1, 2)
        SELECT c_customer_id FROM r JOIN d_store ON s_store_sk = st AND s_state = 'TN' JOIN d_customer ON c_customer_sk = who
        WHERE v::DOUBLE > (SELECT {avg('x.v')} FROM r x WHERE x.st = r.st) * 1.2::DOUBLE ORDER BY 1 LIMIT 100""")
    addr = "ca_street_number, ca_street_name, ca_street_type, ca_suite_number, ca_city, ca_county, ca_state, ca_zip, ca_country"
    for key, p, amount, year, extra in (("ds_q30", "ws", "wr_return_amt", 2002, "c_preferred_cust_flag,"), ("ds_q81", "cs", "cr_return_amt_inc_tax", 2000, "")):
        r = CH[p][5]
        s[key] = check(f"""
            WITH g AS (SELECT {r}_returning_customer_sk AS who, ca_state AS st, sum({amount}) AS v FROM {CH[p][1]} JOIN d_date_dim ON d_date_sk = {r}_returned_date_sk
                JOIN d_customer_address ON ca_address_sk = {r}_returning_addr_sk WHERE d_year = {year} GROUP BY 1, 2)
            SELECT c_customer_id, c_salutation, c_first_name, c_last_name, {extra} {addr}, ca_gmt_offset::DOUBLE AS ca_gmt_offset, ca_location_type, v::DOUBLE AS ctr_total_return
            FROM g JOIN d_customer ON c_customer_sk = who JOIN d_customer_address ON ca_address_sk = c_current_addr_sk AND ca_state = 'GA'
            WHERE v::DOUBLE > (SELECT {avg('x.v')} FROM g x WHERE x.st = g.st) * 1.2::DOUBLE
            ORDER BY c_customer_id, c_salutation, c_first_name, c_last_name, {addr}, v LIMIT 100""")
    s["ds_q06"] = check(f"""
        SELECT ca_state AS state, count(*) AS cnt FROM {sold('ss')} JOIN d_item i ON i_item_sk = ss_item_sk JOIN d_customer ON c_customer_sk = ss_customer_sk
          JOIN d_customer_address ON ca_address_sk = c_current_addr_sk
        WHERE d_month_seq = (SELECT max(d_month_seq) FROM d_date_dim WHERE (d_year, d_moy) = (2001, 1))
          AND i.i_current_price::DOUBLE > 1.2::DOUBLE * (SELECT {avg('j.i_current_price')} FROM d_item j WHERE j.i_category = i.i_category)
        GROUP BY 1 HAVING count(*) >= 10 ORDER BY 2 DESC, 1 LIMIT 10""")
    zips = ", ".join(f"'{z}'" for z in PROFIT_ZIPS)
    s["ds_q08"] = check(f"""
        WITH z AS (SELECT left(ca_zip, 5) AS z FROM d_customer_address WHERE left(ca_zip, 5) IN ({zips}) INTERSECT
          SELECT left(ca_zip, 5) FROM d_customer JOIN d_customer_address ON ca_address_sk = c_current_addr_sk WHERE c_preferred_cust_flag = 'Y' GROUP BY 1 HAVING count(*) > 10)
        SELECT s_store_name, {total('ss_net_profit', 'sum_net_profit')} FROM {sold('ss')} JOIN d_store ON s_store_sk = ss_store_sk JOIN z ON left(s_zip, 5) = z
        WHERE (d_year, d_qoy) = (2000, 2) GROUP BY 1 ORDER BY 1 LIMIT 100""")
    picks = ", ".join(
        f"(SELECT CASE WHEN count(*) > {n} THEN {avg('ss_ext_discount_amt')} ELSE {avg('ss_net_paid')} END FROM d_store_sales WHERE ss_quantity BETWEEN {20 * i + 1} AND {20 * i + 20}) AS bucket{i + 1}"
        for i, n in enumerate((74129, 122840, 56580, 10097, 15098))
    )
    s["ds_q09"] = check(f"SELECT {picks} FROM d_reason WHERE r_reason_sk = 1")

    def active(days, p, who):
        return f"(SELECT {who} FROM {sold(p)} WHERE {days})"

    def people(days, catalog_web):
        web, cat = active(days, "ws", "ws_bill_customer_sk"), active(days, "cs", "cs_ship_customer_sk")
        test = f"(c_customer_sk IN {web} OR c_customer_sk IN {cat})"
        return f"""d_customer JOIN d_customer_address ON ca_address_sk = c_current_addr_sk JOIN d_customer_demographics ON cd_demo_sk = c_current_cdemo_sk
            WHERE c_customer_sk IN {active(days, 'ss', 'ss_customer_sk')} AND {test if catalog_web else 'NOT ' + test}"""

    s["ds_q10"] = check(f"""
        SELECT cd_gender, cd_marital_status, cd_education_status, count(*) AS cnt1, avg(cd_purchase_estimate) AS avg1, count(*) AS cnt2, count(*) AS cnt3
        FROM {people('d_year = 2002 AND d_moy <= 4', True)} AND ca_county IN ('Dona Ana County', 'Jefferson County', 'La Porte County', 'Rush County', 'Toole County')
        GROUP BY 1, 2, 3 ORDER BY 1, 2, 3 LIMIT 100""")
    deps = ("cd_dep_count", "cd_dep_employed_count", "cd_dep_college_count")
    stats = ", ".join(f"{d}, count(*) AS cnt{i}, min({d}) AS min{i}, max({d}) AS max{i}, avg({d}) AS avg{i}" for i, d in enumerate(deps, 1))
    s["ds_q35"] = check(f"""
        SELECT ca_state, cd_gender, cd_marital_status, {stats} FROM {people('d_year = 2002 AND d_qoy < 4', True)}
        GROUP BY ca_state, cd_gender, cd_marital_status, {', '.join(deps)} ORDER BY ca_state, cd_gender, cd_marital_status, {', '.join(deps)} LIMIT 100""")
    s["ds_q69"] = check(f"""
        SELECT cd_gender, cd_marital_status, cd_education_status, count(*) AS cnt1, cd_purchase_estimate, count(*) AS cnt2, cd_credit_rating, count(*) AS cnt3
        FROM {people('d_year = 2002 AND d_moy <= 3', False)} AND ca_state IN ('GA', 'KY', 'NM') GROUP BY 1, 2, 3, 5, 7 ORDER BY 1, 2, 3, 5, 7 LIMIT 100""")
    kinds = " INTERSECT ".join(f"SELECT i_brand_id, i_class_id, i_category_id FROM {sold(p)} JOIN d_item ON i_item_sk = {p}_item_sk WHERE d_year BETWEEN 1999 AND 2001" for p in CH)
    allq = " UNION ALL ".join(f"SELECT {p}_quantity * {p}_list_price AS v FROM {sold(p)} WHERE d_year BETWEEN 1999 AND 2001" for p in CH)
    months = " UNION ALL ".join(
        f"""SELECT '{n}' AS channel, i_brand_id, i_class_id, i_category_id, sum({p}_quantity * {p}_list_price) AS v, count(*) AS n
            FROM {sold(p)} JOIN d_item ON i_item_sk = {p}_item_sk JOIN k USING (i_brand_id, i_class_id, i_category_id) WHERE (d_year, d_moy) = (2001, 11)
            GROUP BY 2, 3, 4 HAVING sum({p}_quantity * {p}_list_price)::DOUBLE > (SELECT a FROM m)"""
        for n, p in (("store", "ss"), ("catalog", "cs"), ("web", "ws"))
    )
    s["ds_q14"] = check(f"""
        WITH k AS ({kinds}), m AS (SELECT {avg('v')} AS a FROM ({allq})), y AS ({months})
        SELECT channel, i_brand_id, i_class_id, i_category_id, {total('v', 'total_sales')}, sum(n)::BIGINT AS total_number_sales FROM y
        GROUP BY ROLLUP (channel, i_brand_id, i_class_id, i_category_id) ORDER BY 1 NULLS LAST, 2 NULLS LAST, 3 NULLS LAST, 4 NULLS LAST LIMIT 100""")
    sums = lambda p, o: f"count(DISTINCT {p}_{o}) AS order_count, {total(f'{p}_ext_ship_cost', 'total_shipping_cost')}, {total(f'{p}_net_profit', 'total_net_profit')}"
    s["ds_q16"] = check(f"""
        SELECT {sums('cs', 'order_number')} FROM d_catalog_sales a JOIN d_date_dim ON d_date_sk = cs_ship_date_sk JOIN d_customer_address ON ca_address_sk = cs_ship_addr_sk
          JOIN d_call_center ON cc_call_center_sk = cs_call_center_sk
        WHERE d_date BETWEEN DATE '2002-02-01' AND DATE '2002-04-02' AND ca_state = 'GA' AND cc_county = 'Williamson County'
          AND EXISTS (FROM d_catalog_sales b WHERE b.cs_order_number = a.cs_order_number AND b.cs_warehouse_sk <> a.cs_warehouse_sk)
          AND cs_order_number NOT IN (SELECT cr_order_number FROM d_catalog_returns)""")
    web = """d_web_sales a JOIN d_date_dim ON d_date_sk = ws_ship_date_sk JOIN d_customer_address ON ca_address_sk = ws_ship_addr_sk JOIN d_web_site ON web_site_sk = ws_web_site_sk
        WHERE d_date BETWEEN DATE '2000-02-01' AND DATE '2000-04-01' AND ca_state = 'IL' AND web_company_name = 'pri'"""
    s["ds_q94"] = check(f"""
        SELECT {sums('ws', 'order_number')} FROM {web} AND EXISTS (FROM d_web_sales b WHERE b.ws_order_number = a.ws_order_number AND b.ws_warehouse_sk <> a.ws_warehouse_sk)
          AND NOT EXISTS (FROM d_web_returns WHERE wr_order_number = a.ws_order_number)""")
    s["ds_q95"] = check(f"""
        WITH w AS (SELECT x.ws_order_number AS o FROM d_web_sales x JOIN d_web_sales y USING (ws_order_number) WHERE x.ws_warehouse_sk <> y.ws_warehouse_sk)
        SELECT {sums('ws', 'order_number')} FROM {web} AND ws_order_number IN (SELECT o FROM w)
          AND ws_order_number NOT IN (SELECT wr_order_number FROM d_web_returns JOIN w ON o = wr_order_number)""")
    q23 = " UNION ALL ".join(
        f"SELECT {p}_quantity * {p}_list_price AS v FROM {sold(p)} WHERE (d_year, d_moy) = (2000, 2) AND {p}_item_sk IN (SELECT ss_item_sk FROM f) AND {CH[p][2]} IN (SELECT who FROM b)" for p in ("cs", "ws")
    )
    s["ds_q23"] = check(f"""
        WITH f AS (SELECT left(i_item_desc, 30) AS d, ss_item_sk, d_date FROM {sold('ss')} JOIN d_item ON i_item_sk = ss_item_sk WHERE d_year BETWEEN 2000 AND 2003 GROUP BY ALL HAVING count(*) > 4),
          c AS (SELECT ss_customer_sk AS who, sum(ss_quantity * ss_sales_price) AS v FROM {sold('ss')} JOIN d_customer ON c_customer_sk = ss_customer_sk WHERE d_year BETWEEN 2000 AND 2003 GROUP BY 1),
          b AS (SELECT ss_customer_sk AS who FROM d_store_sales JOIN d_customer ON c_customer_sk = ss_customer_sk GROUP BY 1
            HAVING sum(ss_quantity * ss_sales_price)::DOUBLE > 0.1::DOUBLE * (SELECT max(v) FROM c)::DOUBLE)
        SELECT {total('v', 'total_sales')} FROM ({q23})""")
    s["ds_q24"] = check(f"""
        WITH g AS (SELECT c_last_name, c_first_name, s_store_name, ca_state, s_state, i_color, i_current_price, i_manager_id, i_units, i_size, sum(ss_net_paid) AS v
          FROM d_store_sales {returned('ss', 'INNER')} JOIN d_store ON s_store_sk = ss_store_sk JOIN d_item ON i_item_sk = ss_item_sk JOIN d_customer ON c_customer_sk = ss_customer_sk
            JOIN d_customer_address ON ca_address_sk = c_current_addr_sk AND ca_zip = s_zip WHERE s_market_id = 8 AND upper(ca_country) <> c_birth_country GROUP BY ALL)
        SELECT c_last_name, c_first_name, s_store_name, {total('v', 'paid')} FROM g WHERE i_color = 'pale' GROUP BY 1, 2, 3
        HAVING sum(v)::DOUBLE > 0.05::DOUBLE * (SELECT {avg('v')} FROM g)""")
    bands = ((0, 5, 11, 460, 14), (6, 10, 91, 1430, 32), (11, 15, 66, 920, 4), (16, 20, 142, 3054, 80), (21, 25, 135, 14180, 38), (26, 30, 28, 6415, 42))
    q28 = ", ".join(
        f"""(SELECT {avg('ss_list_price')} AS b{i}_lp, count(ss_list_price) AS b{i}_cnt, count(DISTINCT ss_list_price) AS b{i}_cntd FROM d_store_sales WHERE ss_quantity BETWEEN {a} AND {b}
            AND (ss_list_price BETWEEN {lp} AND {lp + 10} OR ss_coupon_amt BETWEEN {c} AND {c + 1000} OR ss_wholesale_cost BETWEEN {w} AND {w + 20}))"""
        for i, (a, b, lp, c, w) in enumerate(bands, 1)
    )
    s["ds_q28"] = check(f"SELECT * FROM {q28}")

    def three(key, item_cond, ym):
        return " UNION ALL ".join(
            f"""SELECT {key}, sum({p}_ext_sales_price) AS v FROM {sold(p)} JOIN d_item ON i_item_sk = {p}_item_sk JOIN d_customer_address ON ca_address_sk = {CH[p][3]}
                WHERE {item_cond} AND (d_year, d_moy) = {ym} AND ca_gmt_offset = -5 GROUP BY 1"""
            for p in CH
        )

    for name, key, cond, ym, order in (
        ("ds_q33", "i_manufact_id", "i_manufact_id IN (SELECT i_manufact_id FROM d_item WHERE i_category = 'Electronics')", "(1998, 5)", "2 DESC, 1"),
        ("ds_q56", "i_item_id", "i_color IN ('blanched', 'burnished', 'slate')", "(2001, 2)", "2 DESC, 1"),
        ("ds_q60", "i_item_id", "i_item_id IN (SELECT i_item_id FROM d_item WHERE i_category = 'Music')", "(1998, 9)", "1, 2 DESC"),
    ):
        s[name] = check(f"SELECT {key}, {total('v', 'total_sales')} FROM ({three(key, cond, ym)}) GROUP BY 1 ORDER BY {order} LIMIT 100")
    who = {p: f"(SELECT DISTINCT c_last_name, c_first_name, d_date FROM {sold(p)} JOIN d_customer ON c_customer_sk = {CH[p][2]} WHERE d_month_seq BETWEEN 1200 AND 1211)" for p in CH}
    s["ds_q38"] = check(f"SELECT count(*) AS cnt FROM ({who['ss']} INTERSECT {who['cs']} INTERSECT {who['ws']})")
    s["ds_q87"] = check(f"SELECT count(*) AS cnt FROM (({who['ss']} EXCEPT {who['cs']}) EXCEPT {who['ws']})")
    women = "(i_color IN ('powder','khaki') AND i_units IN ('Ounce','Oz') AND i_size IN ('medium','extra large')) OR (i_color IN ('brown','honeydew') AND i_units IN ('Bunch','Ton') AND i_size IN ('N/A','small')) OR (i_color IN ('midnight','snow') AND i_units IN ('Pallet','Gross') AND i_size IN ('medium','extra large')) OR (i_color IN ('cyan','papaya') AND i_units IN ('Cup','Dram') AND i_size IN ('N/A','small'))"
    men = "(i_color IN ('floral','deep') AND i_units IN ('N/A','Dozen') AND i_size IN ('petite','large')) OR (i_color IN ('light','cornflower') AND i_units IN ('Box','Pound') AND i_size IN ('medium','extra large')) OR (i_color IN ('orange','frosted') AND i_units IN ('Each','Tbl') AND i_size IN ('petite','large')) OR (i_color IN ('forest','ghost') AND i_units IN ('Lb','Bundle') AND i_size IN ('medium','extra large'))"
    s["ds_q41"] = check(f"""
        SELECT DISTINCT i_product_name FROM d_item a WHERE i_manufact_id BETWEEN 738 AND 778 AND (SELECT count(*) FROM d_item b WHERE b.i_manufact = a.i_manufact
          AND CASE b.i_category WHEN 'Women' THEN {women} WHEN 'Men' THEN {men} ELSE false END) > 1 ORDER BY 1 LIMIT 100""")
    s["ds_q45"] = check(f"""
        SELECT ca_zip, ca_county, {total('ws_sales_price', 'sum_sales_price')} FROM {sold('ws')} JOIN d_customer ON c_customer_sk = ws_bill_customer_sk
          JOIN d_customer_address ON ca_address_sk = c_current_addr_sk JOIN d_item ON i_item_sk = ws_item_sk
        WHERE (d_year, d_qoy) = (2001, 2) AND (left(ca_zip, 5) IN ('80348', '81792', '83405', '85392', '85460', '85669', '86197', '86475', '88274')
          OR i_item_id IN (SELECT i_item_id FROM d_item WHERE i_item_sk IN (2, 3, 5, 7, 11, 13, 17, 19, 23, 29)))
        GROUP BY 1, 2 ORDER BY 1, 2 LIMIT 100""")
    q54 = " UNION ALL ".join(f"SELECT {CH[p][2]} AS who FROM {sold(p)} JOIN d_item ON i_item_sk = {p}_item_sk WHERE (d_year, d_moy) = (1999, 1) AND (i_category, i_class) = ('Women', 'accessories')" for p in ("cs", "ws"))
    s["ds_q54"] = check(f"""
        WITH m AS (SELECT DISTINCT c_customer_sk, c_current_addr_sk FROM ({q54}) JOIN d_customer ON c_customer_sk = who),
          r AS (SELECT c_customer_sk, sum(ss_ext_sales_price) AS v FROM m JOIN d_store_sales ON ss_customer_sk = c_customer_sk JOIN d_date_dim ON d_date_sk = ss_sold_date_sk
            JOIN d_customer_address ON ca_address_sk = c_current_addr_sk JOIN d_store ON (s_county, s_state) = (ca_county, ca_state) WHERE d_month_seq BETWEEN 1188 AND 1191 GROUP BY 1)
        SELECT round(v / 50)::INT AS segment, count(*) AS num_customers, segment * 50 AS segment_base FROM r GROUP BY 1 ORDER BY 1, 2 LIMIT 100""")
    revs = ", ".join(f"{p} AS (SELECT i_item_id AS id, sum({p}_ext_sales_price) AS {p}_v FROM {sold(p)} JOIN d_item ON i_item_sk = {p}_item_sk WHERE d_date BETWEEN DATE '2000-01-03' AND DATE '2000-02-02' GROUP BY 1)" for p in CH)
    near = " AND ".join(f"{a}_v BETWEEN 0.9 * {b}_v AND 1.1 * {b}_v" for a in CH for b in CH if a != b)
    s["ds_q58"] = check(f"""
        WITH {revs} SELECT id AS item_id, ss_v::DOUBLE AS ss_item_rev, ss_v::DOUBLE / (ss_v + cs_v + ws_v)::DOUBLE / 3 AS ratio, cs_v::DOUBLE AS cs_item_rev,
          cs_v::DOUBLE / (ss_v + cs_v + ws_v)::DOUBLE / 3 AS ratio2, ws_v::DOUBLE AS ws_item_rev, ws_v::DOUBLE / (ss_v + cs_v + ws_v)::DOUBLE / 3 AS ratio3
        FROM ss JOIN cs USING (id) JOIN ws USING (id) WHERE {near} ORDER BY 1 LIMIT 100""")
    qty = ", ".join(
        f"""{CH[p][5]} AS (SELECT i_item_id AS id, sum({CH[p][5]}_return_quantity)::BIGINT AS {CH[p][5]}_item_qty FROM {CH[p][1]} JOIN d_item ON i_item_sk = {CH[p][5]}_item_sk
            JOIN d_date_dim ON d_date_sk = {CH[p][5]}_returned_date_sk WHERE d_week_seq IN (SELECT d_week_seq FROM d_date_dim WHERE d_date IN (DATE '2000-06-30', DATE '2000-09-27', DATE '2000-11-17')) GROUP BY 1)"""
        for p in CH
    )
    s["ds_q83"] = check(f"""
        WITH {qty} SELECT id AS item_id, sr_item_qty, (sr_item_qty // (sr_item_qty + cr_item_qty + wr_item_qty)) * 100 AS sr_dev, cr_item_qty,
          (cr_item_qty // (sr_item_qty + cr_item_qty + wr_item_qty)) * 100 AS cr_dev, wr_item_qty, (wr_item_qty // (sr_item_qty + cr_item_qty + wr_item_qty)) * 100 AS wr_dev,
          sr_item_qty + cr_item_qty + wr_item_qty AS total_qty FROM sr JOIN cr USING (id) JOIN wr USING (id) ORDER BY 1, 2 LIMIT 100""")
    pairs = {p: f"(SELECT DISTINCT {CH[p][2]} AS c, {p}_item_sk AS i FROM {sold(p)} WHERE d_month_seq BETWEEN 1200 AND 1211)" for p in ("ss", "cs")}
    s["ds_q97"] = check(f"""
        SELECT count(*) FILTER (WHERE a.c IS NOT NULL AND b.c IS NULL) AS store_only, count(*) FILTER (WHERE a.c IS NULL AND b.c IS NOT NULL) AS catalog_only,
          count(*) FILTER (WHERE a.c IS NOT NULL AND b.c IS NOT NULL) AS store_and_catalog FROM {pairs['ss']} a FULL JOIN {pairs['cs']} b ON (a.c, a.i) = (b.c, b.i)""")
    kept = ", ".join(
        f"""{p} AS (SELECT d_year AS y, {p}_item_sk AS i, {CH[p][2]} AS c, sum({p}_quantity)::BIGINT AS {p}_q, sum({p}_wholesale_cost) AS wc, sum({p}_sales_price) AS sp
            FROM {sold(p)} {returned(p)} WHERE {CH[p][5]}_{CH[p][4]} IS NULL GROUP BY 1, 2, 3)"""
        for p in CH
    )
    s["ds_q78"] = check(f"""
        WITH {kept} SELECT ss.y AS ss_sold_year, ss.i AS ss_item_sk, ss.c AS ss_customer_sk, ss_q // (ss_q + ifnull(ws_q, 0) + ifnull(cs_q, 0)) AS store_pct, ss_q AS store_qty,
          ss.wc::DOUBLE AS store_wholesale_cost, ss.sp::DOUBLE AS store_sales_price
        FROM ss LEFT JOIN ws ON (ws.y, ws.i, ws.c) = (ss.y, ss.i, ss.c) LEFT JOIN cs ON (cs.y, cs.i, cs.c) = (ss.y, ss.i, ss.c)
        WHERE ss.y = 2001 AND ss_q + ifnull(ws_q, 0) + ifnull(cs_q, 0) > 0 ORDER BY 1, 2 , 3 NULLS LAST, 4, 5, 6, 7 LIMIT 100""")
    detail = " UNION ".join(
        f"""SELECT d_year, i_brand_id, i_class_id, i_category_id, i_manufact_id, {p}_quantity - ifnull({CH[p][5]}_return_quantity, 0) AS n, {p}_ext_sales_price - ifnull({CH[p][6]}, 0) AS a
            FROM {sold(p)} JOIN d_item ON i_item_sk = {p}_item_sk {returned(p)} WHERE i_category = 'Books'"""
        for p in CH
    )
    s["ds_q75"] = check(f"""
        WITH y AS (SELECT d_year, i_brand_id, i_class_id, i_category_id, i_manufact_id, sum(n)::BIGINT AS n, sum(a) AS a FROM ({detail}) GROUP BY 1, 2, 3, 4, 5)
        SELECT q.d_year AS prev_year, p.d_year AS curr_year, i_brand_id, i_class_id, i_category_id, i_manufact_id, q.n AS prev_yr_cnt, p.n AS curr_yr_cnt,
          p.n - q.n AS sales_cnt_diff, (p.a - q.a)::DOUBLE AS sales_amt_diff
        FROM y p JOIN y q USING (i_brand_id, i_class_id, i_category_id, i_manufact_id) WHERE p.d_year = 2002 AND q.d_year = 2001 AND p.n::DOUBLE / q.n::DOUBLE < 0.9::DOUBLE
        ORDER BY 9, p.a - q.a, 3, 4, 5, 6 LIMIT 100""")
    side = "JOIN d_customer_demographics c{n} ON c{n}.cd_demo_sk = s{n}.ss_cdemo_sk JOIN d_household_demographics h{n} ON h{n}.hd_demo_sk = s{n}.ss_hdemo_sk JOIN d_customer_address a{n} ON a{n}.ca_address_sk = s{n}.ss_addr_sk JOIN d_income_band b{n} ON b{n}.ib_income_band_sk = h{n}.hd_income_band_sk JOIN d_item i{n} ON i{n}.i_item_sk = s{n}.ss_item_sk JOIN d_date_dim t{n} ON t{n}.d_date_sk = s{n}.ss_sold_date_sk"
    s["ds_q64"] = check(f"""
        SELECT c_last_name, c_first_name, c_customer_id
        FROM d_store_sales s1 {side.format(n=1)} JOIN d_store ON s_store_sk = s1.ss_store_sk
          JOIN d_store_sales s2 ON (s2.ss_customer_sk, s2.ss_ticket_number) = (s1.ss_customer_sk, s1.ss_ticket_number) {side.format(n=2)}
          JOIN d_store_returns ON (sr_item_sk, sr_ticket_number) = (s2.ss_item_sk, s2.ss_ticket_number) JOIN d_date_dim r ON r.d_date_sk = sr_returned_date_sk
          JOIN d_customer ON c_customer_sk = sr_customer_sk
        WHERE s_market_id BETWEEN 7 AND 7 AND i1.i_color IN ('burnished', 'dim', 'maroon') AND i2.i_color IN ('burnished', 'dim', 'maroon') AND i1.i_category = 'Women' AND i2.i_category = 'Women'
          AND i1.i_manufact_id = i2.i_manufact_id AND (c1.cd_marital_status, c1.cd_education_status) = (c2.cd_marital_status, c2.cd_education_status)
          AND a1.ca_country = a2.ca_country AND a1.ca_country = 'United States'
          AND b1.ib_lower_bound = b2.ib_lower_bound AND b1.ib_lower_bound >= 0 AND t1.d_year = 1999 AND t2.d_year = 1999 AND r.d_year = 2000
        ORDER BY 1 NULLS LAST, 2, 3 LIMIT 100""")
    return s
