"""Check queries for the retail rollup, rank and year-on-year plans."""

from __future__ import annotations

from tidewater.oracles.retail import CH, avg, check, returned, sold, total

_DAYS = ("Sunday", "Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday")
_ITEM = {p: f"{sold(p)} JOIN d_item ON i_item_sk = {p}_item_sk" for p in CH}


def _week(v: str) -> str:
    return ", ".join(f"sum({v}) FILTER (WHERE d_day_name = '{d}') AS {d[:3].lower()}" for d in _DAYS)


_RATIOS = ", ".join(f"round(a.{d[:3].lower()}::DOUBLE / b.{d[:3].lower()}::DOUBLE, 2) AS {d[:3].lower()}_ratio" for d in _DAYS)


def sqls() -> dict[str, str]:
    s: dict[str, str] = {}
    s["ds_q02"] = check(f"""
        WITH u AS (SELECT ws_sold_date_sk AS k, ws_ext_sales_price AS v FROM d_web_sales UNION ALL SELECT cs_sold_date_sk, cs_ext_sales_price FROM d_catalog_sales),
          w AS (SELECT d_week_seq, {_week('v')} FROM u JOIN d_date_dim ON d_date_sk = k GROUP BY 1)
        SELECT a.d_week_seq AS d_week_seq1, {_RATIOS} FROM w a JOIN d_date_dim x ON x.d_week_seq = a.d_week_seq AND x.d_year = 2001
          JOIN w b ON b.d_week_seq = a.d_week_seq + 53 JOIN d_date_dim y ON y.d_week_seq = b.d_week_seq AND y.d_year = 2002""")
    s["ds_q59"] = check(f"""
        WITH w AS (SELECT d_week_seq, ss_store_sk, {_week('ss_sales_price')} FROM {sold('ss')} GROUP BY 1, 2)
        SELECT s_store_name, s_store_id, a.d_week_seq AS d_week_seq, {_RATIOS} FROM w a JOIN d_store ON s_store_sk = a.ss_store_sk
          JOIN d_date_dim x ON x.d_week_seq = a.d_week_seq AND x.d_month_seq BETWEEN 1195 AND 1206
          JOIN w b ON b.ss_store_sk = a.ss_store_sk AND a.d_week_seq - b.d_week_seq = 52
          JOIN d_date_dim y ON y.d_week_seq = b.d_week_seq AND y.d_month_seq BETWEEN 1207 AND 1218 ORDER BY 1, 2, 3 LIMIT 100""")
    for key, value, outs, person in (
        ("ds_q04", "sum(P_ext_list_price - P_ext_discount_amt)", ("first_name", "last_name", "birth_country"), "c_customer_id, c_first_name, c_last_name, c_preferred_cust_flag, c_birth_country, c_login, c_email_address"),
        ("ds_q11", "sum(P_ext_list_price - P_ext_discount_amt)", ("first_name", "last_name", "preferred_cust_flag"), "c_customer_id, c_first_name, c_last_name, c_preferred_cust_flag, c_birth_country, c_login, c_email_address"),
        ("ds_q74", "max(P_net_paid)", ("first_name", "last_name"), "c_customer_id, c_first_name, c_last_name"),
    ):
        years = " UNION ALL ".join(f"SELECT {person}, d_year AS y, {value.replace('P_', p + '_')} AS v, '{p}' AS ch FROM {sold(p)} JOIN d_customer ON c_customer_sk = {CH[p][2]} GROUP BY {person}, d_year" for p in ("ss", "ws"))
        cols = ", ".join(f"s2.c_{o} AS customer_{o}" for o in outs)
        s[key] = check(f"""
            WITH t AS ({years}) SELECT s2.c_customer_id AS customer_id, {cols}
            FROM t s1 JOIN t s2 USING (c_customer_id) JOIN t w1 USING (c_customer_id) JOIN t w2 USING (c_customer_id)
            WHERE (s1.ch, s1.y, s2.ch, s2.y) = ('ss', 2001, 'ss', 2002) AND (w1.ch, w1.y, w2.ch, w2.y) = ('ws', 2001, 'ws', 2002) AND s1.v > 0 AND w1.v > 0
              AND w2.v::DOUBLE / w1.v::DOUBLE > s2.v::DOUBLE / s1.v::DOUBLE ORDER BY 1, {', '.join(str(i + 2) for i in range(len(outs)))} LIMIT 100""")
    q5 = []
    for label, prefix, p, place, back, dim, pk, name in (
        ("store channel", "store", "ss", "ss_store_sk", "sr_store_sk", "d_store", "s_store_sk", "s_store_id"),
        ("catalog channel", "catalog_page", "cs", "cs_catalog_page_sk", "cr_catalog_page_sk", "d_catalog_page", "cp_catalog_page_sk", "cp_catalog_page_id"),
        ("web channel", "web_site", "ws", "ws_web_site_sk", "wr_web_page_sk", "d_web_site", "web_site_sk", "web_site_id"),
    ):
        r = CH[p][5]
        q5.append(f"""SELECT '{label}' AS channel, '{prefix}' || {name} AS id, sum(a) AS a, sum(b) AS b, sum(c) AS c FROM (
            SELECT {place} AS k, {p}_sold_date_sk AS d, {p}_ext_sales_price AS a, 0 AS b, 0 AS c FROM {CH[p][0]}
            UNION ALL SELECT {back}, {r}_returned_date_sk, 0, {CH[p][6]}, {r}_net_loss FROM {CH[p][1]}) JOIN d_date_dim ON d_date_sk = d JOIN {dim} ON {pk} = k
            WHERE d_date BETWEEN DATE '2000-08-23' AND DATE '2000-09-06' GROUP BY {name}""")
    roll = "GROUP BY ROLLUP (channel, id) ORDER BY channel NULLS LAST, id NULLS LAST LIMIT 100"
    s["ds_q05"] = check(f"SELECT channel, id, {total('a', 'sales')}, {total('b', 'returns')}, {total('c', 'profit')} FROM ({' UNION ALL '.join(q5)}) {roll}")
    period = "d_date BETWEEN DATE '2000-08-23' AND DATE '2000-09-22'"

    def part(p, key, dim, pk):
        return f"(SELECT {pk} AS k, sum({p}_ext_sales_price) AS a, sum({p}_net_profit) AS g FROM {sold(p)} JOIN {dim} ON {pk} = {key} WHERE {period} GROUP BY 1)"

    def back(p, key, dim, pk):
        r = CH[p][5]
        return f"(SELECT {pk} AS k, sum({CH[p][6]}) AS b, sum({r}_net_loss) AS l FROM {CH[p][1]} JOIN d_date_dim ON d_date_sk = {r}_returned_date_sk JOIN {dim} ON {pk} = {key} WHERE {period} GROUP BY 1)"

    s["ds_q77"] = check(f"""
        WITH x AS (SELECT 'store channel' AS channel, k AS id, a, ifnull(b, 0) AS b, g - ifnull(l, 0) AS c FROM {part('ss', 'ss_store_sk', 'd_store', 's_store_sk')} LEFT JOIN {back('ss', 'sr_store_sk', 'd_store', 's_store_sk')} USING (k)
          UNION ALL SELECT 'catalog channel', k, a, b, g - l FROM (SELECT cs_call_center_sk AS k, sum(cs_ext_sales_price) AS a, sum(cs_net_profit) AS g FROM {sold('cs')} WHERE {period} GROUP BY 1),
            (SELECT sum(cr_return_amount) AS b, sum(cr_net_loss) AS l FROM d_catalog_returns JOIN d_date_dim ON d_date_sk = cr_returned_date_sk WHERE {period})
          UNION ALL SELECT 'web channel', k, a, ifnull(b, 0), g - ifnull(l, 0) FROM {part('ws', 'ws_web_page_sk', 'd_web_page', 'wp_web_page_sk')} LEFT JOIN {back('ws', 'wr_web_page_sk', 'd_web_page', 'wp_web_page_sk')} USING (k))
        SELECT channel, id, {total('a', 'sales')}, {total('b', 'returns_')}, {total('c', 'profit')} FROM x {roll}""")
    q80 = " UNION ALL ".join(
        f"""SELECT '{n}' AS channel, {name} AS id, {p}_ext_sales_price AS a, ifnull({CH[p][6]}, 0) AS b, {p}_net_profit - ifnull({CH[p][5]}_net_loss, 0) AS c
            FROM {_ITEM[p]} {returned(p)} JOIN {dim} ON {pk} = {key} JOIN d_promotion ON p_promo_sk = {p}_promo_sk WHERE {period} AND i_current_price > 50 AND p_channel_tv = 'N'"""
        for n, p, dim, pk, key, name in (
            ("store", "ss", "d_store", "s_store_sk", "ss_store_sk", "s_store_id"),
            ("catalog", "cs", "d_catalog_page", "cp_catalog_page_sk", "cs_catalog_page_sk", "cp_catalog_page_id"),
            ("web", "ws", "d_web_site", "web_site_sk", "ws_web_site_sk", "web_site_id"),
        )
    )
    s["ds_q80"] = check(f"SELECT channel, id, {total('a', 'sales')}, {total('b', 'returns_')}, {total('c', 'profit')} FROM ({q80}) {roll}")
    values = ("cs_quantity", "cs_list_price", "cs_coupon_amt", "cs_sales_price", "cs_net_profit", "c_birth_year", "d1.cd_dep_count")
    means = ", ".join(f"{avg(f'{v}::DECIMAL(12,2)')} AS agg{i}" for i, v in enumerate(values, 1))
    s["ds_q18"] = check(f"""
        SELECT i_item_id, ca_country, ca_state, ca_county, {means} FROM {_ITEM['cs']} JOIN d_customer_demographics d1 ON d1.cd_demo_sk = cs_bill_cdemo_sk
          JOIN d_customer ON c_customer_sk = cs_bill_customer_sk JOIN d_customer_demographics d2 ON d2.cd_demo_sk = c_current_cdemo_sk
          JOIN d_customer_address ON ca_address_sk = c_current_addr_sk
        WHERE d1.cd_gender = 'F' AND d1.cd_education_status = 'Unknown' AND c_birth_month IN (1, 2, 6, 8, 9, 12) AND d_year = 1998 AND ca_state IN ('IN', 'MS', 'ND', 'NM', 'OK', 'VA')
        GROUP BY ROLLUP (i_item_id, ca_country, ca_state, ca_county) ORDER BY 2 NULLS LAST, 3 NULLS LAST, 4 NULLS LAST, 1 NULLS LAST LIMIT 100""")
    means = ", ".join(f"{avg(v)} AS agg{i}" for i, v in enumerate(("ss_quantity", "ss_list_price", "ss_coupon_amt", "ss_sales_price"), 1))
    s["ds_q27"] = check(f"""
        SELECT i_item_id, s_state, grouping(s_state)::INT AS g_state, {means} FROM {_ITEM['ss']} JOIN d_store ON s_store_sk = ss_store_sk JOIN d_customer_demographics ON cd_demo_sk = ss_cdemo_sk
        WHERE (cd_gender, cd_marital_status, cd_education_status) = ('F', 'W', 'Primary') AND d_year = 1998 AND s_state = 'TN'
        GROUP BY ROLLUP (i_item_id, s_state) ORDER BY 1 NULLS LAST, 2 NULLS LAST LIMIT 100""")
    for key, source, up, low, measure, name, direction in (
        ("ds_q36", f"{_ITEM['ss']} JOIN d_store ON s_store_sk = ss_store_sk WHERE d_year = 2001 AND s_state = 'TN'", "i_category", "i_class", "sum(ss_net_profit)::DOUBLE / sum(ss_ext_sales_price)::DOUBLE", "gross_margin", "ASC NULLS LAST"),
        ("ds_q70", f"{sold('ss')} JOIN d_store ON s_store_sk = ss_store_sk WHERE d_month_seq BETWEEN 1200 AND 1211", "s_state", "s_county", "sum(ss_net_profit)::DOUBLE", "total_sum", "DESC NULLS FIRST"),
        ("ds_q86", f"{_ITEM['ws']} WHERE d_month_seq BETWEEN 1200 AND 1211", "i_category", "i_class", "sum(ws_net_paid)::DOUBLE", "total_sum", "DESC NULLS FIRST"),
    ):
        s[key] = check(f"""
            WITH g AS (SELECT {measure} AS {name}, {up}, {low}, (grouping({up}) + grouping({low}))::INT AS lochierarchy, grouping({low}) AS gl FROM {source} GROUP BY ROLLUP ({up}, {low}))
            SELECT {name}, {up}, {low}, lochierarchy, rank() OVER (PARTITION BY lochierarchy, CASE WHEN gl = 0 THEN {up} END ORDER BY {name} {direction})::INT AS rank_within_parent
            FROM g ORDER BY lochierarchy DESC, CASE WHEN lochierarchy = 0 THEN {up} END NULLS LAST, rank_within_parent, {up} NULLS LAST, {low} NULLS LAST LIMIT 100""")
    s["ds_q21"] = check("""
        WITH g AS (SELECT w_warehouse_name, i_item_id, coalesce(sum(inv_quantity_on_hand) FILTER (WHERE d_date < DATE '2000-03-11'), 0)::BIGINT AS inv_before,
            coalesce(sum(inv_quantity_on_hand) FILTER (WHERE d_date >= DATE '2000-03-11'), 0)::BIGINT AS inv_after
          FROM d_inventory JOIN d_date_dim ON d_date_sk = inv_date_sk JOIN d_item ON i_item_sk = inv_item_sk JOIN d_warehouse ON w_warehouse_sk = inv_warehouse_sk
          WHERE i_current_price BETWEEN 0.99 AND 1.49 AND d_date BETWEEN DATE '2000-02-10' AND DATE '2000-04-10' GROUP BY 1, 2)
        SELECT * FROM g WHERE inv_before > 0 AND inv_after // inv_before = 1 ORDER BY 1, 2 LIMIT 100""")
    counties = ", ".join(f"{p} AS (SELECT ca_county AS c, d_qoy AS q, sum({p}_ext_sales_price)::DOUBLE AS v FROM {sold(p)} JOIN d_customer_address ON ca_address_sk = {CH[p][3]} WHERE d_year = 2000 GROUP BY 1, 2)" for p in ("ss", "ws"))
    s["ds_q31"] = check(f"""
        WITH {counties} SELECT c AS ca_county, 2000 AS d_year, w2.v / w1.v AS web_q1_q2_increase, s2.v / s1.v AS store_q1_q2_increase, w3.v / w2.v AS web_q2_q3_increase, s3.v / s2.v AS store_q2_q3_increase
        FROM ss s1 JOIN ss s2 USING (c) JOIN ss s3 USING (c) JOIN ws w1 USING (c) JOIN ws w2 USING (c) JOIN ws w3 USING (c)
        WHERE (s1.q, s2.q, s3.q, w1.q, w2.q, w3.q) = (1, 2, 3, 1, 2, 3) AND w1.v > 0 AND s1.v > 0 AND w2.v > 0 AND s2.v > 0 AND w2.v / w1.v > s2.v / s1.v AND w3.v / w2.v > s3.v / s2.v""")
    s["ds_q39"] = check("""
        WITH g AS (SELECT inv_warehouse_sk AS w, inv_item_sk AS i, d_moy AS m, avg(inv_quantity_on_hand) AS mean, stddev_samp(inv_quantity_on_hand) / avg(inv_quantity_on_hand) AS cov
          FROM d_inventory JOIN d_date_dim ON d_date_sk = inv_date_sk JOIN d_item ON i_item_sk = inv_item_sk JOIN d_warehouse ON w_warehouse_sk = inv_warehouse_sk
          WHERE d_year = 2001 GROUP BY 1, 2, 3 HAVING avg(inv_quantity_on_hand) > 0 AND stddev_samp(inv_quantity_on_hand) / avg(inv_quantity_on_hand) > 1)
        SELECT w AS w_warehouse_sk, i AS i_item_sk, 1 AS d_moy1, a.mean AS mean1, round(a.cov, 6) AS cov1, 2 AS d_moy2, b.mean AS mean2, round(b.cov, 6) AS cov2
        FROM g a JOIN g b USING (w, i) WHERE a.m = 1 AND b.m = 2 ORDER BY 1, 2 LIMIT 100""")
    near = "(SELECT ca_address_sk FROM d_customer_address WHERE ca_gmt_offset = -5)"
    s["ds_q44"] = check(f"""
        WITH g AS (SELECT ss_item_sk AS i, {avg('ss_net_profit')} AS v FROM d_store_sales WHERE ss_store_sk = 4 AND ss_addr_sk NOT IN {near} GROUP BY 1
            HAVING {avg('ss_net_profit')} > 0.9::DOUBLE * (SELECT {avg('ss_net_profit')} FROM d_store_sales WHERE ss_store_sk = 4 AND ss_addr_sk IN {near})),
          a AS (SELECT *, rank() OVER (ORDER BY v) AS r FROM g), b AS (SELECT *, rank() OVER (ORDER BY v DESC) AS r FROM g)
        SELECT a.r::INT AS rnk, x.i_product_name AS best_performing, y.i_product_name AS worst_performing FROM a JOIN b ON a.r = b.r
          JOIN d_item x ON x.i_item_sk = a.i JOIN d_item y ON y.i_item_sk = b.i WHERE a.r <= 10 ORDER BY 1, 2, 3 LIMIT 100""")
    for key, p, place, dim, on, last in (
        ("ds_q47", "ss", "s_store_name, s_company_name", "d_store", "s_store_sk = ss_store_sk", "d_moy, i_category, d_year, avg_monthly_sales"),
        ("ds_q57", "cs", "cc_name", "d_call_center", "cc_call_center_sk = cs_call_center_sk", "avg_monthly_sales, i_category, d_year, d_moy"),
    ):
        group = f"i_category, i_brand, {place}"
        same = " AND ".join(f"{{o}}.{k.strip()} = v.{k.strip()}" for k in group.split(","))
        s[key] = check(f"""
            WITH m AS (SELECT {group}, d_year, d_moy, sum({p}_sales_price) AS sm FROM {_ITEM[p]} JOIN {dim} ON {on} WHERE d_year IN (1999, 2000) GROUP BY ALL),
              v AS (SELECT *, (sum(sm) OVER (PARTITION BY {group}, d_year))::DOUBLE / count(sm) OVER (PARTITION BY {group}, d_year) AS avg_monthly_sales,
                rank() OVER (PARTITION BY {group} ORDER BY d_year, d_moy) AS rn FROM m)
            SELECT v.i_category AS i_category, v.d_year AS d_year, v.d_moy AS d_moy, v.avg_monthly_sales AS avg_monthly_sales, v.sm::DOUBLE AS sum_sales, a.sm::DOUBLE AS psum, b.sm::DOUBLE AS nsum
            FROM v JOIN v a ON {same.format(o='a')} AND a.rn = v.rn - 1 JOIN v b ON {same.format(o='b')} AND b.rn = v.rn + 1
            WHERE v.d_year = 1999 AND v.avg_monthly_sales > 0 AND abs(v.sm::DOUBLE - v.avg_monthly_sales) / v.avg_monthly_sales > 0.1::DOUBLE
            ORDER BY v.sm::DOUBLE - v.avg_monthly_sales, {', '.join('v.' + c.strip() for c in last.split(','))}, v.sm, a.sm, b.sm LIMIT 100""")
    first, other = "('personal', 'portable', 'reference', 'self-help')", "('accessories', 'classical', 'fragrances', 'pants')"

    def pack(a, b, c):
        return " OR ".join(f"(i_category IN {cats} AND i_class IN {first if i == 1 else other} AND i_brand_id BETWEEN {i}001001 AND {i}001004)" for i, cats in enumerate((a, b, c), 1))

    quarter = pack("('Books', 'Children', 'Electronics')", "('Clothing', 'Music', 'Shoes')", "('Men', 'Music', 'Women')")
    klass = pack("('Books', 'Electronics', 'Holiday')", "('Men', 'Shoes', 'Women')", "('Children', 'Jewelry', 'Music')")
    for key, days, packs, keys, part_by, name, order, outs in (
        ("ds_q53", "d_month_seq BETWEEN 1200 AND 1211", quarter, "i_manufact_id, d_qoy", "i_manufact_id", "avg_quarterly_sales", "3, 2, 1", "i_manufact_id"),
        ("ds_q63", "d_month_seq BETWEEN 1200 AND 1211", quarter, "i_manager_id, d_moy", "i_manager_id", "avg_monthly_sales", "1, 3, 2", "i_manager_id"),
        ("ds_q89", "d_year = 1999", klass, "i_category, i_class, i_brand, s_store_name, s_company_name, d_moy", "i_category, i_brand, s_store_name, s_company_name", "avg_monthly_sales",
         "sm::DOUBLE - avg_monthly_sales, avg_monthly_sales, i_category, i_class, i_brand, s_store_name, s_company_name, d_moy", "i_category, i_class, i_brand, s_store_name, s_company_name, d_moy"),
    ):
        s[key] = check(f"""
            WITH g AS (SELECT {keys}, sum(ss_sales_price) AS sm FROM {_ITEM['ss']} JOIN d_store ON s_store_sk = ss_store_sk WHERE {days} AND ({packs}) GROUP BY ALL),
              v AS (SELECT *, (sum(sm) OVER (PARTITION BY {part_by}))::DOUBLE / count(sm) OVER (PARTITION BY {part_by}) AS {name} FROM g)
            SELECT {outs}, sm::DOUBLE AS sum_sales, {name} FROM v WHERE {name} > 0 AND abs(sm::DOUBLE - {name}) / {name} > 0.1::DOUBLE ORDER BY {order} LIMIT 100""")
    q49 = " UNION ".join(
        f"""SELECT '{n}' AS channel, item, return_ratio, rr::INT AS return_rank, cr::INT AS currency_rank FROM (SELECT *, rank() OVER (ORDER BY return_ratio) AS rr, rank() OVER (ORDER BY currency_ratio) AS cr FROM (
            SELECT {p}_item_sk AS item, sum({CH[p][5]}_return_quantity)::DOUBLE / sum({p}_quantity)::DOUBLE AS return_ratio, sum({CH[p][6]})::DOUBLE / sum({p}_net_paid)::DOUBLE AS currency_ratio
            FROM {sold(p)} {returned(p)} WHERE {CH[p][6]} > 1000 AND {p}_net_profit > 1 AND {p}_net_paid > 0 AND {p}_quantity > 0 AND (d_year, d_moy) = (2001, 12) GROUP BY 1)) WHERE rr <= 10 OR cr <= 10"""
        for n, p in (("web", "ws"), ("catalog", "cs"), ("store", "ss"))
    )
    s["ds_q49"] = check(f"SELECT * FROM ({q49}) ORDER BY channel, return_rank, currency_rank, item, return_ratio LIMIT 100")
    cum = {p: f"(SELECT {p}_item_sk AS i, d_date AS d, sum(sum({p}_sales_price)) OVER (PARTITION BY {p}_item_sk ORDER BY d_date ROWS UNBOUNDED PRECEDING) AS v FROM {sold(p)} WHERE d_month_seq BETWEEN 1200 AND 1211 GROUP BY 1, 2)" for p in ("ws", "ss")}
    s["ds_q51"] = check(f"""
        WITH x AS (SELECT coalesce(w.i, s.i) AS i, coalesce(w.d, s.d) AS d, w.v AS wv, s.v AS sv FROM {cum['ws']} w FULL JOIN {cum['ss']} s ON (w.i, w.d) = (s.i, s.d)),
          y AS (SELECT *, max(wv) OVER r AS wc, max(sv) OVER r AS sc FROM x WINDOW r AS (PARTITION BY i ORDER BY d ROWS UNBOUNDED PRECEDING))
        SELECT i AS item_sk, d AS d_date, wv::DOUBLE AS web_sales, sv::DOUBLE AS store_sales, wc::DOUBLE AS web_cumulative, sc::DOUBLE AS store_cumulative FROM y WHERE wc > sc ORDER BY 1, 2 LIMIT 100""")
    keys = "i_category, i_class, i_brand, i_product_name, d_year, d_qoy, d_moy, s_store_id"
    s["ds_q67"] = check(f"""
        WITH g AS (SELECT {keys}, sum(coalesce(ss_sales_price * ss_quantity, 0)) AS v FROM {_ITEM['ss']} JOIN d_store ON s_store_sk = ss_store_sk WHERE d_month_seq BETWEEN 1200 AND 1211 GROUP BY ROLLUP ({keys}))
        SELECT {keys}, v::DOUBLE AS sumsales, rank() OVER (PARTITION BY i_category ORDER BY v DESC)::INT AS rk FROM g QUALIFY rk <= 100
        ORDER BY {', '.join(k.strip() + ' NULLS LAST' for k in keys.split(','))}, v, rk LIMIT 100""")
    return s
