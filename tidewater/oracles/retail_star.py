"""Check queries for the retail star joins."""

from __future__ import annotations

from tidewater.oracles.retail import CH, avg, check, returned, sold, total

_ITEM = "JOIN d_item ON {p}_item_sk = i_item_sk"
_DAYS = ("Sunday", "Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday")
_MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()


def _lags(days: str) -> str:
    edges = (("d30", f"{days} <= 30"), ("d31_60", f"{days} > 30 AND {days} <= 60"), ("d61_90", f"{days} > 60 AND {days} <= 90"),
             ("d91_120", f"{days} > 90 AND {days} <= 120"), ("gt120", f"{days} > 120"))
    return ", ".join(f"count(*) FILTER (WHERE {c}) AS {n}" for n, c in edges)


def sqls() -> dict[str, str]:
    s: dict[str, str] = {}
    ss_item = f"{sold('ss')} JOIN d_item ON ss_item_sk = i_item_sk"
    s["ds_q03"] = check(f"""
        SELECT d_year, i_brand_id AS brand_id, i_brand AS brand, {total('ss_ext_sales_price', 'sum_agg')} FROM {ss_item}
        WHERE i_manufact_id = 128 AND d_moy = 11 GROUP BY ALL ORDER BY d_year, sum_agg DESC, brand_id, brand LIMIT 100""")
    s["ds_q42"] = check(f"""
        SELECT d_year, i_category_id, i_category, {total('ss_ext_sales_price', 'sum_sales')} FROM {ss_item}
        WHERE i_manager_id = 1 AND (d_year, d_moy) = (2000, 11) GROUP BY ALL ORDER BY sum_sales DESC, 1, 2, 3 LIMIT 100""")
    s["ds_q52"] = check(f"""
        SELECT d_year, i_brand_id AS brand_id, i_brand AS brand, {total('ss_ext_sales_price', 'ext_price')} FROM {ss_item}
        WHERE i_manager_id = 1 AND (d_year, d_moy) = (2000, 11) GROUP BY ALL ORDER BY 1, 4 DESC, 2, 3 LIMIT 100""")
    s["ds_q55"] = check(f"""
        SELECT i_brand_id AS brand_id, i_brand AS brand, {total('ss_ext_sales_price', 'ext_price')} FROM {ss_item}
        WHERE i_manager_id = 36 AND (d_year, d_moy) = (2001, 12) GROUP BY ALL ORDER BY 3 DESC, 1, 2 LIMIT 100""")
    s["ds_q19"] = check(f"""
        SELECT i_brand_id AS brand_id, i_brand AS brand, i_manufact_id, i_manufact, {total('ss_ext_sales_price', 'ext_price')}
        FROM {ss_item} JOIN d_customer ON c_customer_sk = ss_customer_sk JOIN d_customer_address ON ca_address_sk = c_current_addr_sk
          JOIN d_store ON s_store_sk = ss_store_sk
        WHERE i_manager_id = 7 AND (d_year, d_moy) = (1999, 11) AND left(ca_zip, 5) <> left(s_zip, 5)
        GROUP BY ALL ORDER BY 5 DESC, 2, 1, 3, 4 LIMIT 100""")
    for key, p, cdemo in (("ds_q07", "ss", "ss_cdemo_sk"), ("ds_q26", "cs", "cs_bill_cdemo_sk")):
        s[key] = check(f"""
            SELECT i_item_id, {avg(f'{p}_quantity')} AS agg1, {avg(f'{p}_list_price')} AS agg2, {avg(f'{p}_coupon_amt')} AS agg3, {avg(f'{p}_sales_price')} AS agg4
            FROM {sold(p)} {_ITEM.format(p=p)} JOIN d_customer_demographics ON cd_demo_sk = {cdemo} JOIN d_promotion ON p_promo_sk = {p}_promo_sk
            WHERE (cd_gender, cd_marital_status, cd_education_status) = ('M', 'S', 'College') AND 'N' IN (p_channel_email, p_channel_event) AND d_year = 2000
            GROUP BY 1 ORDER BY 1 LIMIT 100""")
    for key, p in (("ds_q12", "ws"), ("ds_q20", "cs"), ("ds_q98", "ss")):
        s[key] = check(f"""
            WITH g AS (SELECT i_item_id, i_item_desc, i_category, i_class, i_current_price AS price, sum({p}_ext_sales_price) AS rev
              FROM {sold(p)} {_ITEM.format(p=p)}
              WHERE i_category IN ('Home', 'Sports', 'Books') AND d_date BETWEEN DATE '1999-02-22' AND DATE '1999-03-24' GROUP BY ALL)
            SELECT i_item_id, i_item_desc, i_category, i_class, price::DOUBLE AS i_current_price, rev::DOUBLE AS itemrevenue,
              rev::DOUBLE * 100 / (sum(rev) OVER (PARTITION BY i_class))::DOUBLE AS revenueratio
            FROM g ORDER BY i_category, i_class, i_item_id, i_item_desc, revenueratio LIMIT 100""")
    s["ds_q13"] = check(f"""
        SELECT {avg('ss_quantity')} AS avg_quantity, {avg('ss_ext_sales_price')} AS avg_ext_sales_price, {avg('ss_ext_wholesale_cost')} AS avg_ext_wholesale_cost,
          {total('ss_ext_wholesale_cost', 'sum_ext_wholesale_cost')}
        FROM {sold('ss')} JOIN d_store ON ss_store_sk = s_store_sk JOIN d_household_demographics ON ss_hdemo_sk = hd_demo_sk
          JOIN d_customer_demographics ON ss_cdemo_sk = cd_demo_sk JOIN d_customer_address ON ss_addr_sk = ca_address_sk
        WHERE d_year = 2001 AND ca_country = 'United States' AND CASE (cd_marital_status || cd_education_status)
            WHEN 'MAdvanced Degree' THEN ss_sales_price BETWEEN 100 AND 150
            WHEN 'SCollege' THEN ss_sales_price BETWEEN 50 AND 100
            WHEN 'W2 yr Degree' THEN ss_sales_price BETWEEN 150 AND 200 ELSE false END
          AND ((ca_state IN ('TX', 'OH')) OR (ca_state IN ('OR', 'NM', 'KY'))
            OR (ca_state IN ('VA', 'TX', 'MS')))""")
    s["ds_q48"] = check(f"""
        SELECT sum(ss_quantity)::BIGINT AS total_quantity
        FROM {sold('ss')} JOIN d_store ON ss_store_sk = s_store_sk JOIN d_customer_demographics ON ss_cdemo_sk = cd_demo_sk
          JOIN d_customer_address ON ss_addr_sk = ca_address_sk
        WHERE d_year = 2000 AND ca_country = 'United States' AND CASE (cd_marital_status || cd_education_status)
            WHEN 'M4 yr Degree' THEN ss_sales_price BETWEEN 100 AND 150 WHEN 'D2 yr Degree' THEN ss_sales_price BETWEEN 50 AND 100
            WHEN 'SCollege' THEN ss_sales_price BETWEEN 150 AND 200 ELSE false END
          AND ((ca_state IN ('CO', 'OH', 'TX') AND ss_net_profit BETWEEN 0 AND 2000) OR (ca_state IN ('OR', 'MN', 'KY') AND ss_net_profit BETWEEN 150 AND 300)
            OR (ca_state IN ('VA', 'CA', 'MS') AND ss_net_profit BETWEEN 50 AND 250))""")
    s["ds_q85"] = check(f"""
        SELECT left(r_reason_desc, 20) AS reason, {avg('ws_quantity')} AS avg_qty, {avg('wr_refunded_cash')} AS avg_refunded_cash, {avg('wr_fee')} AS avg_fee
        FROM {sold('ws')} {returned('ws', 'INNER')} JOIN d_web_page ON ws_web_page_sk = wp_web_page_sk
          JOIN d_customer_demographics a ON a.cd_demo_sk = wr_refunded_cdemo_sk JOIN d_customer_demographics b ON b.cd_demo_sk = wr_returning_cdemo_sk
          JOIN d_customer_address ON ca_address_sk = wr_refunded_addr_sk JOIN d_reason ON r_reason_sk = wr_reason_sk
        WHERE d_year = 2000 AND (a.cd_marital_status, a.cd_education_status) = (b.cd_marital_status, b.cd_education_status)
          AND ca_country = 'United States' AND CASE (a.cd_marital_status || a.cd_education_status)
            WHEN 'MAdvanced Degree' THEN ws_sales_price BETWEEN 100 AND 150 WHEN 'SCollege' THEN ws_sales_price BETWEEN 50 AND 100
            WHEN 'W2 yr Degree' THEN ws_sales_price BETWEEN 150 AND 200 ELSE false END
          AND ((ca_state IN ('IN', 'OH', 'NJ')) OR (ca_state IN ('WI', 'CT', 'KY'))
            OR (ca_state IN ('LA', 'IA', 'AR')))
        GROUP BY r_reason_desc ORDER BY 1, 2, 3, 4 LIMIT 100""")
    zips = "('80348', '81792', '83405', '85392', '85460', '85669', '86197', '86475', '88274')"
    s["ds_q15"] = check(f"""
        SELECT ca_zip, {total('cs_sales_price', 'sum_sales_price')} FROM {sold('cs')} JOIN d_customer ON cs_bill_customer_sk = c_customer_sk
          JOIN d_customer_address ON c_current_addr_sk = ca_address_sk
        WHERE (d_year, d_qoy) = (2001, 2) AND (left(ca_zip, 5) IN {zips} OR ca_state IN ('GA', 'WA', 'CA') OR cs_sales_price > 500)
        GROUP BY 1 ORDER BY 1 LIMIT 100""")

    def chain(sold_cond, back_cond, again_cond):
        return f"""d_store_sales JOIN d_date_dim d1 ON d1.d_date_sk = ss_sold_date_sk AND {sold_cond}
          JOIN d_store_returns ON (sr_customer_sk, sr_item_sk, sr_ticket_number) = (ss_customer_sk, ss_item_sk, ss_ticket_number)
          JOIN d_date_dim d2 ON d2.d_date_sk = sr_returned_date_sk AND {back_cond}
          JOIN d_catalog_sales ON (cs_bill_customer_sk, cs_item_sk) = (sr_customer_sk, sr_item_sk)
          JOIN d_date_dim d3 ON d3.d_date_sk = cs_sold_date_sk AND {again_cond}
          JOIN d_store ON s_store_sk = ss_store_sk JOIN d_item ON i_item_sk = ss_item_sk"""

    q17 = ", ".join(
        f"count({x}) AS {n}_quantitycount, avg({x}) AS {n}_quantityave, "
        + (f"round(stddev_samp({x}) / avg({x}), 6)" if n == "catalog_sales" else f"round(stddev_samp({x}), 6)")
        + f" AS {n}_quantitystdev, round(stddev_samp({x}) / avg({x}), 6) AS {n}_quantitycov"
        for n, x in (("store_sales", "ss_quantity"), ("store_returns", "sr_return_quantity"), ("catalog_sales", "cs_quantity"))
    )
    quarters = "d_quarter_name IN ('2001Q1', '2001Q2', '2001Q3')"
    s["ds_q17"] = check(f"""
        SELECT i_item_id, i_item_desc, s_state, {q17} FROM {chain("d1.d_quarter_name = '2001Q1'", 'd2.' + quarters, 'd3.' + quarters)}
        GROUP BY 1, 2, 3 ORDER BY 1, 2, 3 LIMIT 100""")
    s["ds_q25"] = check(f"""
        SELECT i_item_id, i_item_desc, s_store_id, s_store_name, {total('ss_net_profit', 'store_sales_profit')}, {total('sr_net_loss', 'store_returns_loss')},
          {total('cs_net_profit', 'catalog_sales_profit')}
        FROM {chain('d1.d_moy = 4 AND d1.d_year = 2001', 'd2.d_year = 2001 AND d2.d_moy BETWEEN 4 AND 10', 'd3.d_year = 2001 AND d3.d_moy BETWEEN 4 AND 10')}
        GROUP BY 1, 2, 3, 4 ORDER BY 1, 2, 3, 4 LIMIT 100""")
    s["ds_q29"] = check(f"""
        SELECT i_item_id, i_item_desc, s_store_id, s_store_name, sum(ss_quantity)::BIGINT AS store_sales_quantity,
          sum(sr_return_quantity)::BIGINT AS store_returns_quantity, sum(cs_quantity)::BIGINT AS catalog_sales_quantity
        FROM {chain('d1.d_moy = 9 AND d1.d_year = 1999', 'd2.d_year = 1999 AND d2.d_moy >= 9', 'd3.d_year BETWEEN 1999 AND 2001')}
        GROUP BY 1, 2, 3, 4 ORDER BY 1 DESC, 2 DESC, 3 DESC, 4 DESC LIMIT 100""")
    for key, p, net in (("ds_q22", "ws", "ws_net_paid"), ("ds_q66", "cs", "cs_net_paid_inc_ship")):
        cols = ", ".join(f"coalesce(sum({v} * {p}_quantity) FILTER (WHERE d_moy = {i}), 0)::DOUBLE AS {m}_{n}" for n, v in (("sales", f"{p}_sales_price"), ("net", net)) for i, m in enumerate(_MONTHS, 1))
        s[key] = check(f"""
            SELECT w_warehouse_name, w_warehouse_sq_ft, w_city, w_county, w_state, w_country, 'DHL,BARIAN' AS ship_carriers, d_year AS year1, {cols}
            FROM {sold(p)} JOIN d_time_dim ON t_time_sk = {p}_sold_time_sk JOIN d_ship_mode ON sm_ship_mode_sk = {p}_ship_mode_sk
              JOIN d_warehouse ON w_warehouse_sk = {p}_warehouse_sk
            WHERE d_year = 2001 AND t_time >= 30838 AND t_time <= 59638 AND sm_carrier IN ('BARIAN', 'DHL') GROUP BY 1, 2, 3, 4, 5, 6, 8 ORDER BY 1 LIMIT 100""")
    for key, p, maker in (("ds_q32", "cs", 977), ("ds_q92", "ws", 350)):
        s[key] = check(f"""
            WITH w AS (SELECT {p}_item_sk AS k, {p}_ext_discount_amt AS x FROM {sold(p)} WHERE d_date BETWEEN DATE '2000-01-27' AND DATE '2000-04-26')
            SELECT sum(x)::DOUBLE AS excess_discount_amount FROM w JOIN d_item ON i_item_sk = k
            WHERE i_manufact_id = {maker} AND x::DOUBLE > (SELECT 1.3::DOUBLE * ({avg('y.x')}) FROM w y WHERE y.k = w.k)""")
    for key, fact, k, lo, hi, a, b, makers in (
        ("ds_q37", "d_catalog_sales", "cs_item_sk", 68, 98, "2000-02-01", "2000-04-01", "677, 940, 694, 808"),
        ("ds_q82", "d_store_sales", "ss_item_sk", 62, 92, "2000-05-25", "2000-07-24", "129, 270, 821, 423"),
    ):
        s[key] = check(f"""
            SELECT DISTINCT i_item_id, i_item_desc, i_current_price::DOUBLE AS i_current_price
            FROM d_item JOIN d_inventory ON inv_item_sk = i_item_sk JOIN d_date_dim ON d_date_sk = inv_date_sk JOIN {fact} ON {k} = i_item_sk
            WHERE i_current_price BETWEEN {lo} AND {hi} AND i_manufact_id IN ({makers}) AND inv_quantity_on_hand BETWEEN 100 AND 500
              AND d_date BETWEEN DATE '{a}' AND DATE '{b}' ORDER BY i_item_id LIMIT 100""")
    s["ds_q40"] = check(f"""
        WITH x AS (SELECT w_state, i_item_id, d_date, cs_sales_price - coalesce(cr_refunded_cash, 0) AS net
          FROM {sold('cs')} {returned('cs')} JOIN d_warehouse ON w_warehouse_sk = cs_warehouse_sk JOIN d_item ON i_item_sk = cs_item_sk
          WHERE i_current_price BETWEEN 0.99 AND 1.49 AND d_date BETWEEN DATE '2000-02-10' AND DATE '2000-04-10')
        SELECT w_state, i_item_id, coalesce(sum(net) FILTER (WHERE d_date < DATE '2000-03-11'), 0)::DOUBLE AS sales_before,
          coalesce(sum(net) FILTER (WHERE d_date >= DATE '2000-03-11'), 0)::DOUBLE AS sales_after FROM x GROUP BY 1, 2 ORDER BY 1, 2 LIMIT 100""")
    week = ", ".join(f"(sum(ss_sales_price) FILTER (WHERE d_day_name = '{d}'))::DOUBLE AS {d[:3].lower()}_sales" for d in _DAYS)
    s["ds_q43"] = check(f"""
        SELECT s_store_name, s_store_id, {week} FROM {sold('ss')} JOIN d_store ON s_store_sk = ss_store_sk
        WHERE s_gmt_offset = -5 AND d_year = 1998 GROUP BY 1, 2 ORDER BY ALL LIMIT 100""")
    tickets = f"{sold('ss')} JOIN d_store ON s_store_sk = ss_store_sk JOIN d_household_demographics ON hd_demo_sk = ss_hdemo_sk"
    for key, days, sums, outs in (
        ("ds_q46", "d_dow IN (0, 6)", f"{total('ss_coupon_amt', 'amt')}, {total('ss_net_profit', 'profit')}", "amt, profit"),
        ("ds_q68", "d_dom <= 2", f"{total('ss_ext_sales_price', 'extended_price')}, {total('ss_ext_tax', 'extended_tax')}, {total('ss_ext_list_price', 'list_price')}", "extended_price, extended_tax, list_price"),
    ):
        s[key] = check(f"""
            WITH g AS (SELECT ss_ticket_number, ss_customer_sk, ss_addr_sk, ca_city AS bought_city, {sums}
              FROM {tickets} JOIN d_customer_address ON ca_address_sk = ss_addr_sk
              WHERE {days} AND d_year IN (1999, 2000, 2001) AND (hd_dep_count = 4 OR hd_vehicle_count = 3) AND s_city IN ('Fairview', 'Midway') GROUP BY 1, 2, 3, 4)
            SELECT c_last_name, c_first_name, ca_city, bought_city, ss_ticket_number, {outs}
            FROM g JOIN d_customer ON c_customer_sk = ss_customer_sk JOIN d_customer_address ON ca_address_sk = c_current_addr_sk
            WHERE ca_city <> bought_city ORDER BY c_last_name NULLS LAST, ss_ticket_number, c_first_name, ca_city, bought_city, {outs} LIMIT 100""")
    s["ds_q79"] = check(f"""
        WITH g AS (SELECT ss_ticket_number, ss_customer_sk, ss_addr_sk, s_city, {total('ss_coupon_amt', 'amt')}, {total('ss_net_profit', 'profit')}
          FROM {tickets} WHERE d_dow = 1 AND d_year BETWEEN 1999 AND 2001 AND (hd_dep_count = 6 OR hd_vehicle_count > 2)
            AND s_number_employees BETWEEN 200 AND 295 GROUP BY 1, 2, 3, 4)
        SELECT c_last_name, c_first_name, left(g.s_city, 30) AS s_city, ss_ticket_number, amt, profit FROM g JOIN d_customer ON c_customer_sk = ss_customer_sk
        ORDER BY c_last_name NULLS LAST, c_first_name, 3, profit, ss_ticket_number, amt LIMIT 100""")
    for key, doms, years, bar, counties, lo, hi, order in (
        ("ds_q34", "d_dom <= 3", "1999, 2000, 2001", "1.2", "'Williamson County'", 15, 20, "c_last_name NULLS LAST, c_first_name, c_salutation, c_preferred_cust_flag DESC, ss_ticket_number"),
        ("ds_q73", "d_dom <= 2", "2000, 2001, 2002", "1", "'Williamson County', 'Franklin Parish', 'Bronx County', 'Orange County'", 1, 5,
         "cnt DESC, c_last_name NULLS LAST, c_first_name, c_salutation, c_preferred_cust_flag DESC, ss_ticket_number"),
    ):
        s[key] = check(f"""
            WITH g AS (SELECT ss_ticket_number, ss_customer_sk, count(*) AS cnt FROM {tickets}
              WHERE ({doms} OR d_dom BETWEEN 25 AND 28) AND d_year IN ({years}) AND hd_buy_potential IN ('Unknown', '>10000') AND hd_vehicle_count > 0
                AND hd_dep_count // hd_vehicle_count > {bar} AND s_county IN ({counties}) GROUP BY 1, 2)
            SELECT c_last_name, c_first_name, c_salutation, c_preferred_cust_flag, ss_ticket_number, cnt FROM g JOIN d_customer ON c_customer_sk = ss_customer_sk
            WHERE cnt BETWEEN {lo} AND {hi} ORDER BY {order} LIMIT 100""")
    s["ds_q50"] = check(f"""
        SELECT s_store_name, s_company_id, s_street_number, s_street_name, s_street_type, s_suite_number, s_city, s_county, s_state, s_zip,
          {_lags('(sr_returned_date_sk - ss_sold_date_sk)')}
        FROM {sold('ss')} {returned('ss', 'INNER')} AND sr_customer_sk = ss_customer_sk JOIN d_store ON s_store_sk = ss_store_sk
        WHERE d_month_seq BETWEEN 1200 AND 1211 GROUP BY 1, 2, 3, 4, 5, 6, 7, 8, 9, 10 ORDER BY 1, 2, 3, 4, 5, 6, 7, 8, 9, 10 LIMIT 100""")
    for key, p, place, on, name in (
        ("ds_q62", "ws", "d_web_site", "web_site_sk = ws_web_site_sk", "web_name"),
        ("ds_q99", "cs", "d_call_center", "cc_call_center_sk = cs_call_center_sk", "cc_name"),
    ):
        s[key] = check(f"""
            SELECT left(w_warehouse_name, 20) AS warehouse, sm_type, {name}, {_lags(f'({p}_ship_date_sk - {p}_sold_date_sk)')}
            FROM {CH[p][0]} JOIN d_date_dim ON d_date_sk = {p}_ship_date_sk JOIN d_warehouse ON w_warehouse_sk = {p}_warehouse_sk
              JOIN d_ship_mode ON sm_ship_mode_sk = {p}_ship_mode_sk JOIN {place} ON {on}
            WHERE d_month_seq BETWEEN 1200 AND 1211 GROUP BY 1, 2, 3 ORDER BY 1, 2, 3 LIMIT 100""")
    s["ds_q61"] = check(f"""
        WITH x AS (SELECT coalesce(sum(ss_ext_sales_price) FILTER (WHERE p_channel_dmail = 'Y' OR p_channel_email = 'Y' OR p_channel_tv = 'Y'), 0) AS a,
            sum(ss_ext_sales_price) AS b
          FROM {ss_item} JOIN d_store ON s_store_sk = ss_store_sk JOIN d_promotion ON p_promo_sk = ss_promo_sk
            JOIN d_customer ON c_customer_sk = ss_customer_sk JOIN d_customer_address ON ca_address_sk = c_current_addr_sk
          WHERE ca_gmt_offset = -7 AND i_category = 'Jewelry' AND (d_year, d_moy) = (1998, 11))
        SELECT a::DOUBLE AS promotional_sales, b::DOUBLE AS all_sales, a::DOUBLE / b::DOUBLE * 100 AS promo_percent FROM x""")
    s["ds_q65"] = check(f"""
        WITH r AS (SELECT ss_store_sk AS st, ss_item_sk AS it, sum(ss_sales_price) AS rev FROM {sold('ss')} WHERE d_month_seq BETWEEN 1200 AND 1211 GROUP BY 1, 2)
        SELECT s_store_name, i_item_desc, rev::DOUBLE AS revenue, i_current_price::DOUBLE AS i_current_price, i_wholesale_cost::DOUBLE AS i_wholesale_cost, i_brand
        FROM r JOIN d_store ON s_store_sk = st JOIN d_item ON i_item_sk = it
        WHERE rev::DOUBLE <= 0.1::DOUBLE * (SELECT {avg('z.rev')} FROM r z WHERE z.st = r.st) ORDER BY 1, 2, 3, 4, 5, 6 LIMIT 100""")
    q71 = " UNION ALL ".join(f"SELECT {p}_ext_sales_price AS v, {p}_sold_time_sk AS ts, {p}_item_sk AS it FROM {sold(p)} WHERE (d_year, d_moy) = (2001, 11)" for p in CH)
    s["ds_q71"] = check(f"""
        SELECT i_brand_id AS brand_id, i_brand AS brand, t_hour, t_minute, {total('v', 'ext_price')} FROM ({q71}) JOIN d_item ON i_item_sk = it
          JOIN d_time_dim ON t_time_sk = ts WHERE i_manager_id = 1 GROUP BY 1, 2, 3, 4 ORDER BY 5 DESC, 1, 2, 3, 4 LIMIT 100""")
    s["ds_q72"] = check("""
        SELECT i_item_desc, w_warehouse_name, d1.d_week_seq AS d_week_seq, count(*) FILTER (WHERE p_promo_sk IS NULL) AS no_promo, count(p_promo_sk) AS promo,
          count(*) AS total_cnt
        FROM d_catalog_sales JOIN d_date_dim d1 ON d1.d_date_sk = cs_sold_date_sk AND d1.d_year = 2001
          JOIN d_customer_demographics ON cd_demo_sk = cs_bill_cdemo_sk AND cd_marital_status = 'M'
          JOIN d_household_demographics ON hd_demo_sk = cs_bill_hdemo_sk AND hd_buy_potential = '>10000'
          JOIN d_date_dim d3 ON d3.d_date_sk = cs_ship_date_sk AND d3.d_date > d1.d_date + 5 JOIN d_item ON i_item_sk = cs_item_sk AND i_current_price > 1.49
          JOIN d_inventory ON inv_item_sk = cs_item_sk JOIN d_date_dim d2 ON d2.d_date_sk = inv_date_sk AND d2.d_week_seq = d1.d_week_seq
          JOIN d_warehouse ON w_warehouse_sk = inv_warehouse_sk LEFT JOIN d_promotion ON p_promo_sk = cs_promo_sk
        GROUP BY 1, 2, 3 ORDER BY 6 DESC, 1, 2, 3 LIMIT 100""")
    q76 = " UNION ALL ".join(
        f"SELECT '{n}' AS channel, '{p}_promo_sk' AS col_name, d_year, d_qoy, i_category, {p}_ext_sales_price AS v FROM {sold(p)} {_ITEM.format(p=p)} WHERE {p}_promo_sk IS NULL"
        for n, p in (("store", "ss"), ("web", "ws"), ("catalog", "cs"))
    )
    s["ds_q76"] = check(f"SELECT channel, col_name, d_year, d_qoy, i_category, count(*) AS sales_cnt, {total('v', 'sales_amt')} FROM ({q76}) GROUP BY 1, 2, 3, 4, 5 ORDER BY 1, 2, 3, 4, 5 LIMIT 100")
    s["ds_q84"] = check("""
        SELECT c_customer_id AS customer_id, ifnull(c_last_name, '') || ', ' || ifnull(c_first_name, '') AS customername
        FROM d_store_returns JOIN d_customer ON c_current_cdemo_sk = sr_cdemo_sk JOIN d_customer_demographics ON cd_demo_sk = sr_cdemo_sk
          JOIN d_customer_address ON ca_address_sk = c_current_addr_sk AND ca_city = 'Edgewood'
          JOIN d_household_demographics ON hd_demo_sk = c_current_hdemo_sk
          JOIN d_income_band ON ib_income_band_sk = hd_income_band_sk AND ib_lower_bound >= 38128 AND ib_upper_bound <= 88128
        ORDER BY 1, 2 LIMIT 100""")
    slots = ("h8_30_to_9", "h9_to_9_30", "h9_30_to_10", "h10_to_10_30", "h10_30_to_11", "h11_to_11_30", "h11_30_to_12", "h12_to_12_30")
    halves = ", ".join(f"count(*) FILTER (WHERE t_time >= {30600 + 1800 * i} AND t_time < {32400 + 1800 * i}) AS {n}" for i, n in enumerate(slots))
    s["ds_q88"] = check(f"""
        SELECT {halves} FROM d_store_sales JOIN d_time_dim ON t_time_sk = ss_sold_time_sk JOIN d_store ON s_store_sk = ss_store_sk
          JOIN d_household_demographics ON hd_demo_sk = ss_hdemo_sk
        WHERE s_store_name = 'ese' AND hd_vehicle_count <= CASE hd_dep_count WHEN 3 THEN 5 WHEN 0 THEN 2 WHEN 1 THEN 3 END""")
    s["ds_q90"] = check("""
        WITH x AS (SELECT t_hour FROM d_web_sales JOIN d_time_dim ON t_time_sk = ws_sold_time_sk JOIN d_household_demographics ON hd_demo_sk = ws_ship_hdemo_sk
          JOIN d_web_page ON wp_web_page_sk = ws_web_page_sk WHERE hd_dep_count = 0 AND wp_char_count BETWEEN 5000 AND 5200)
        SELECT (SELECT count(*) FROM x WHERE t_hour BETWEEN 8 AND 9)::DOUBLE / (SELECT count(*) FROM x WHERE t_hour BETWEEN 19 AND 20)::DOUBLE AS am_pm_ratio""")
    s["ds_q91"] = check("""
        SELECT cc_call_center_id AS call_center, cc_name AS call_center_name, cc_manager AS manager, sum(cr_net_loss)::DOUBLE AS returns_loss
        FROM d_catalog_returns JOIN d_date_dim ON d_date_sk = cr_returned_date_sk JOIN d_customer ON c_customer_sk = cr_returning_customer_sk
          JOIN d_customer_address ON ca_address_sk = c_current_addr_sk JOIN d_customer_demographics ON cd_demo_sk = c_current_cdemo_sk
          JOIN d_household_demographics ON hd_demo_sk = c_current_hdemo_sk JOIN d_call_center ON cc_call_center_sk = cr_call_center_sk
        WHERE (d_year, d_moy) = (1998, 11) AND ca_gmt_offset = -7 AND cd_marital_status IN ('M', 'U') AND hd_vehicle_count > 0
          AND cd_education_status IN ('Advanced Degree', 'College', '4 yr Degree') AND (starts_with(hd_buy_potential, 'Unknown') OR starts_with(hd_buy_potential, '>10000'))
        GROUP BY 1, 2, 3, cd_marital_status, cd_education_status ORDER BY 4 DESC, 1, 2, 3 LIMIT 100""")
    s["ds_q93"] = check(f"""
        SELECT ss_customer_sk, sum((ss_quantity - coalesce(sr_return_quantity, 0)) * ss_sales_price)::DOUBLE AS sumsales
        FROM d_store_sales {returned('ss')} JOIN d_reason ON r_reason_sk = sr_reason_sk WHERE r_reason_desc = 'Did not like the color'
        GROUP BY 1 ORDER BY 2 NULLS LAST, 1 NULLS LAST LIMIT 100""")
    s["ds_q96"] = check("""
        SELECT count(*) AS cnt FROM d_store_sales JOIN d_time_dim ON t_time_sk = ss_sold_time_sk JOIN d_store ON s_store_sk = ss_store_sk
          JOIN d_household_demographics ON hd_demo_sk = ss_hdemo_sk WHERE s_store_name = 'ese' AND hd_dep_count = 0 AND t_time BETWEEN 30600 AND 32399""")
    return s
