"""The 24 retail tables (three sales channels) over the given star schema.

Every fact row comes from one ``lineitem`` row: each channel reads the whole
table and maps keys and days its own way, so the same customer and item can
be followed from a store sale to a return and on to a catalog purchase.
Returns are the lines of one return flag per channel. Dimensions that grow
(item, customer, address, store) come from the given tables; the calendar, the
clock and the small code tables are ranges of fixed size.
"""

from __future__ import annotations

from tidewater.sources.views import Tables, View, idiv, pick

FIRST_SK = 2450815  # date key of 1998-01-01, a Thursday

# Words the queries ask for.
CATEGORIES = "Sports,Books,Home,Electronics,Music,Women,Men,Jewelry,Children,Shoes,Clothing,Holiday"
CLASSES = "personal,accessories,portable,classical,reference,fragrances,self-help,pants"
BRAND_IDS = "1001001,2001001,3001001,1001002,2001002,3001002"
MANUFACTURERS = "128,977,350,677,940,694,808,129,270,821,423,738,745,760,770,778"
MANAGERS = "1,7,36,2,8,3,4,5"
VARIANT_COLORS = "powder,khaki,brown,floral,light,midnight,cyan,orange,forest,honeydew"
VARIANT_UNITS = "Ounce,Oz,Bunch,Dozen,Box,Pallet,Cup,Each,Lb,Ton"
VARIANT_SIZES = "medium,extra large,small,petite,medium,medium,N/A,petite,medium,N/A"
PLAIN_COLORS = "pale,slate,blanched,burnished,maroon,dim"
LAST_NAMES = "Abbott,Brown,Chavez,Dunn,Ellis,Ford,Gray,Hayes,Ingram,Jones"
FIRST_NAMES = "Ada,Ben,Cleo,Drew,Eve,Finn,Gil,Hana,Ira,Jo"
CITIES = "Fairview,Midway,Edgewood,Oakland,Salem"
CUSTOMER_COUNTIES = (
    "Williamson County,Rush County,Toole County,Jefferson County,Dona Ana County,La Porte County,"
    "Franklin Parish,Bronx County,Orange County"
)
STATES = "TX,OH,OR,NM,KY,VA,MS,GA,CA,WA,IN,ND,OK,IL,TN,CO,MN,NJ,WI,CT,LA,IA,AR"
ZIPS = "24128,76232,85669,86197,65084,87816,88274,83405,57678,66455,35709,31904"
MARITAL = "M,S,W,D,U"
EDUCATION = "College,Advanced Degree,2 yr Degree,4 yr Degree,Primary,Secondary,Unknown"
CREDIT = "Good,Low Risk,High Risk,Unknown"
POTENTIAL = ">10000|Unknown|0-500|501-1000|1001-5000|5001-10000"
DAYS = "Sunday,Monday,Tuesday,Wednesday,Thursday,Friday,Saturday"
CARRIERS = "DHL,BARIAN,UPS,FEDEX"


def _money(cents: str, name: str, precision: int = 9) -> str:
    return f"CAST(({cents}) * 0.01 AS DECIMAL({precision},2)) AS {name}"


def _text(prefix: str, key: str) -> str:
    return f"'{prefix}' || CAST({key} AS STRING)"


def _line(day_offset: str, customer: str) -> tuple[str, ...]:
    """Inner projection shared by the facts: short names and integer cents."""
    # Four of ten orders make one large ticket. A third of the tickets fall on
    # every thirtieth day and a seventh of the lines on few items: hot keys, as
    # in any real sales table.
    base = idiv("l_orderkey", 10)
    ticket = f"CASE WHEN l_orderkey % 10 < 4 THEN {base} * 10 ELSE l_orderkey END"
    spread = f"(({ticket}) * 7919 + {idiv(ticket, 2557)} * 13) % 2557"
    day = f"CASE WHEN ({ticket}) % 3 = 1 THEN {idiv(spread, 30)} * 30 ELSE {spread} END"
    lst = "(100 + (l_partkey * 37 + l_orderkey * 11 + l_linenumber * 101) % 19900)"
    return (
        f"{ticket} AS ok",
        "l_partkey AS pk",
        "l_suppkey AS sk",
        "CAST(l_linenumber AS BIGINT) AS ln",
        f"CAST({FIRST_SK} + {day} + {day_offset} AS INT) AS dn",
        f"{customer.replace('BASE', base)} AS cust",
        "CASE WHEN l_linenumber = 1 THEN l_partkey % 16 ELSE l_partkey END AS item",
        "CAST(CAST(l_quantity * 2 AS INT) - l_linenumber % 2 AS INT) AS q",
        f"{lst} AS lc",
        idiv(f"{lst} * (100 - (l_suppkey * 3 + l_linenumber) % 60)", 100) + " AS sc",
        idiv(f"{lst} * (20 + (l_partkey + l_orderkey) % 60)", 100) + " AS wc",
        f"CAST(1 + (l_orderkey + l_partkey) % CAST(l_quantity AS INT) AS INT) AS rq",
        "CASE WHEN (l_orderkey + l_linenumber) % 5 = 0 THEN 30 ELSE 0 END AS cp",
    )


def _sales(p: str, channel: tuple[str, ...], ship: bool) -> tuple[str, ...]:
    ext = "sc * q"
    coupon = idiv(f"{ext} * cp", 100)
    tax = idiv(f"{ext} * (ok % 9)", 100)
    freight = idiv("lc * q * (1 + pk % 20)", 100)
    cols = [
        f"item AS {p}_item_sk",
        f"CASE WHEN (ok + ln) % 20 = 0 THEN NULL ELSE (ok + pk) % 30 END AS {p}_promo_sk",
        f"q AS {p}_quantity",
        _money("wc", f"{p}_wholesale_cost", 7),
        _money("lc", f"{p}_list_price", 7),
        _money("sc", f"{p}_sales_price", 7),
        _money("(lc - sc) * q", f"{p}_ext_discount_amt"),
        _money(ext, f"{p}_ext_sales_price"),
        _money("wc * q", f"{p}_ext_wholesale_cost"),
        _money("lc * q", f"{p}_ext_list_price"),
        _money(tax, f"{p}_ext_tax"),
        _money(coupon, f"{p}_coupon_amt"),
        _money(f"{ext} - {coupon}", f"{p}_net_paid"),
        _money(f"{ext} - {coupon} + {tax}", f"{p}_net_paid_inc_tax"),
        _money(f"{ext} - {coupon} - wc * q", f"{p}_net_profit"),
    ]
    if ship:
        cols += [
            _money(freight, f"{p}_ext_ship_cost"),
            _money(f"{ext} - {coupon} + {freight}", f"{p}_net_paid_inc_ship"),
            _money(f"{ext} - {coupon} + {freight} + {tax}", f"{p}_net_paid_inc_ship_tax"),
            f"CAST(dn + 2 + (pk + ok) % 130 AS INT) AS {p}_ship_date_sk",
            f"(ok + ln) % 5 AS {p}_warehouse_sk",
            f"(ok + pk) % 20 AS {p}_ship_mode_sk",
        ]
    return tuple(cols) + channel


def _returns(p: str, amount: str, channel: tuple[str, ...], credit: str = "store_credit") -> tuple[str, ...]:
    amt = "sc * rq"
    tax = idiv(f"{amt} * (ok % 9)", 100)
    cash = idiv(f"{amt} * (30 + pk % 60)", 100)
    return (
        f"CAST(dn + 1 + (ok * 13 + ln * 7) % 150 AS INT) AS {p}_returned_date_sk",
        f"item AS {p}_item_sk",
        f"rq AS {p}_return_quantity",
        _money(amt, f"{p}_{amount}"),
        _money(tax, f"{p}_return_tax"),
        _money(f"{amt} + {tax}", f"{p}_return_amt_inc_tax"),
        _money("50 + pk % 9950", f"{p}_fee", 7),
        _money(cash, f"{p}_refunded_cash"),
        _money(f"{amt} - {cash}", f"{p}_{credit}"),
        _money(f"{idiv(amt, 2)} + 100", f"{p}_net_loss"),
        f"1 + (ok + ln) % 35 AS {p}_reason_sk",
    ) + channel


STORE_CUSTOMER = "CASE WHEN l_orderkey % 50 = 7 THEN NULL ELSE BASE END"
CATALOG_CUSTOMER = "CASE WHEN l_linenumber <= 4 THEN BASE ELSE BASE + 3 END"
WEB_CUSTOMER = "CASE WHEN l_linenumber <= 3 THEN BASE ELSE BASE + 1 END"
CATALOG_DAYS = "20 + l_orderkey % 60"
WEB_DAYS = "l_orderkey % 40"


CDEMO = f"(ok * 3 + {idiv('ok', 10)}) % 280"


def build() -> dict[str, View]:
    date = f"DATE '1998-01-01' + CAST(i AS INT)"
    v: dict[str, View] = {}
    store = _line("0", STORE_CUSTOMER)
    catalog = _line(CATALOG_DAYS, CATALOG_CUSTOMER)
    web = _line(WEB_DAYS, WEB_CUSTOMER)
    clock = "CAST(28800 + (ok * 37 + ln * 1009) % 50400 AS INT)"
    v["store_sales"] = View("lineitem", _sales("ss", (
        "dn AS ss_sold_date_sk", f"{clock} AS ss_sold_time_sk", "cust AS ss_customer_sk", f"{CDEMO} AS ss_cdemo_sk",
        "(ok * 7) % 7200 AS ss_hdemo_sk", f"CASE WHEN ok % 40 = 3 THEN NULL ELSE {idiv('ok', 10)} + ok % 3 END AS ss_addr_sk",
        f"{idiv('ok', 150)} AS ss_store_sk", "ok AS ss_ticket_number"), False), store)
    v["store_returns"] = View("lineitem", _returns("sr", "return_amt", (
        "cust AS sr_customer_sk", f"{CDEMO} AS sr_cdemo_sk", "(ok * 7) % 7200 AS sr_hdemo_sk", f"{idiv('ok', 10)} AS sr_addr_sk",
        f"{idiv('ok', 150)} AS sr_store_sk", "ok AS sr_ticket_number")), store, "l_returnflag = 'R'")
    v["catalog_sales"] = View("lineitem", _sales("cs", (
        "dn AS cs_sold_date_sk", f"{clock} AS cs_sold_time_sk", "cust AS cs_bill_customer_sk", f"{CDEMO} AS cs_bill_cdemo_sk",
        "(ok * 7) % 7200 AS cs_bill_hdemo_sk", "cust AS cs_bill_addr_sk", "cust AS cs_ship_customer_sk",
        f"{idiv('ok', 10)} + 1 AS cs_ship_addr_sk", "ok % 6 AS cs_call_center_sk", "pk % 120 AS cs_catalog_page_sk",
        "ok AS cs_order_number"), True), catalog)
    v["catalog_returns"] = View("lineitem", _returns("cr", "return_amount", (
        "cust AS cr_refunded_customer_sk", "cust AS cr_returning_customer_sk", "cust AS cr_returning_addr_sk",
        "ok % 6 AS cr_call_center_sk", "pk % 120 AS cr_catalog_page_sk", "ok AS cr_order_number")), catalog, "l_returnflag = 'A'")
    v["web_sales"] = View("lineitem", _sales("ws", (
        "dn AS ws_sold_date_sk", f"{clock} AS ws_sold_time_sk", "cust AS ws_bill_customer_sk", "cust AS ws_bill_addr_sk",
        "(ok * 11) % 7200 AS ws_ship_hdemo_sk", f"{idiv('ok', 10)} + 2 AS ws_ship_addr_sk", "pk % 60 AS ws_web_page_sk",
        "ok % 30 AS ws_web_site_sk", "ok AS ws_order_number"), True), web)
    v["web_returns"] = View("lineitem", _returns("wr", "return_amt", (
        "cust AS wr_refunded_customer_sk", f"{CDEMO} AS wr_refunded_cdemo_sk", f"{idiv('ok', 10)} AS wr_refunded_addr_sk",
        "cust AS wr_returning_customer_sk", f"({CDEMO} + 10 * (ln % 2)) % 280 AS wr_returning_cdemo_sk", "cust AS wr_returning_addr_sk",
        "pk % 60 AS wr_web_page_sk", "ok AS wr_order_number"), "account_credit"), web, "l_returnflag = 'N'")
    v["inventory"] = View("lineitem", (
        "dn AS inv_date_sk", "CASE WHEN ln <= 3 THEN pk % 16 ELSE pk END AS inv_item_sk", "sk % 5 AS inv_warehouse_sk",
        "CAST(CASE WHEN (ok + ln) % 4 = 0 THEN 100 + (ok * 7 + ln * 13) % 900 ELSE (ok * 7 + ln * 13) % 60 END AS INT) AS inv_quantity_on_hand",
    ), store)
    variant = f"({idiv('p_partkey', 7)} + 10) % 14"
    styled = f"{variant} < 10"
    v["item"] = View("part", (
        "p_partkey AS i_item_sk", _text("ITEM", "p_partkey") + " AS i_item_id", "p_name || ' no ' || CAST(p_partkey AS STRING) AS i_item_desc",
        _money("CASE WHEN p_partkey % 4 = 1 THEN 99 + p_partkey % 50 ELSE 100 + (p_partkey * 37) % 9900 END", "i_current_price", 7),
        _money("60 + (p_partkey * 29) % 6000", "i_wholesale_cost", 7),
        f"CAST({pick(BRAND_IDS, idiv('p_partkey', 96))} AS INT) AS i_brand_id", "p_brand AS i_brand",
        f"CAST(1 + {idiv('p_partkey', 12)} % 8 AS INT) AS i_class_id", f"{pick(CLASSES, idiv('p_partkey', 12))} AS i_class",
        "CAST(1 + p_partkey % 12 AS INT) AS i_category_id", f"{pick(CATEGORIES, 'p_partkey')} AS i_category",
        f"CAST({pick(MANUFACTURERS, idiv('p_partkey', 5))} AS INT) AS i_manufact_id",
        f"'maker ' || {pick(MANUFACTURERS, idiv('p_partkey', 5))} AS i_manufact",
        f"CASE WHEN {styled} THEN {pick(VARIANT_SIZES, variant)} ELSE 'N/A' END AS i_size",
        f"CASE WHEN {styled} THEN {pick(VARIANT_COLORS, variant)} ELSE {pick(PLAIN_COLORS, 'p_partkey')} END AS i_color",
        f"CASE WHEN {styled} THEN {pick(VARIANT_UNITS, variant)} ELSE 'Case' END AS i_units", "'Unknown' AS i_container",
        f"CAST({pick(MANAGERS, 'p_partkey')} AS INT) AS i_manager_id", "p_name || ' ' || CAST(p_partkey AS STRING) AS i_product_name",
    ))
    v["customer"] = View("customer", (
        "c_custkey AS c_customer_sk", _text("CUST", "c_custkey") + " AS c_customer_id", "c_custkey % 280 AS c_current_cdemo_sk",
        "(c_custkey * 13) % 7200 AS c_current_hdemo_sk", "c_custkey AS c_current_addr_sk",
        f"{pick('Dr.,Mr.,Ms.,Mx.', 'c_custkey')} AS c_salutation", f"{pick(FIRST_NAMES, idiv('c_custkey', 10))} AS c_first_name",
        f"CASE WHEN c_custkey % 37 = 5 THEN NULL ELSE {pick(LAST_NAMES, 'c_custkey')} END AS c_last_name",
        "CASE WHEN c_custkey % 3 = 0 THEN 'Y' ELSE 'N' END AS c_preferred_cust_flag", "CAST(1 + c_custkey % 28 AS INT) AS c_birth_day",
        "CAST(1 + c_custkey % 12 AS INT) AS c_birth_month", "CAST(1930 + c_custkey % 60 AS INT) AS c_birth_year",
        f"{pick('UNITED STATES,CANADA,CHILE,FRANCE', idiv('c_custkey', 3))} AS c_birth_country", _text("login", "c_custkey") + " AS c_login",
        _text("mail", "c_custkey") + " || '@example.org' AS c_email_address",
    ))
    v["customer_address"] = View("customer", (
        "c_custkey AS ca_address_sk", _text("ADDR", "c_custkey") + " AS ca_address_id", "CAST(1 + c_custkey % 999 AS STRING) AS ca_street_number",
        f"{pick('Oak,Elm,Pine,First', 'c_custkey')} AS ca_street_name", f"{pick('St,Ave,Blvd', 'c_custkey')} AS ca_street_type",
        _text("Suite ", "c_custkey % 50") + " AS ca_suite_number", f"{pick(CITIES, 'c_custkey')} AS ca_city",
        f"CASE WHEN c_custkey % 3 = 0 THEN 'Williamson County' ELSE {pick(CUSTOMER_COUNTIES, idiv('c_custkey', 2))} END AS ca_county",
        f"CASE WHEN c_custkey % 3 = 0 THEN 'TN' WHEN c_custkey % 7 = 1 THEN 'GA' ELSE {pick(STATES, 'c_custkey')} END AS ca_state",
        f"{pick(ZIPS, idiv('c_custkey', 15) + ' + CASE WHEN c_custkey % 3 = 0 THEN 5 ELSE 0 END')} AS ca_zip", "'United States' AS ca_country",
        "CAST(-5 - c_custkey % 3 AS DECIMAL(5,2)) AS ca_gmt_offset", f"{pick('condo,apartment,single family', 'c_custkey')} AS ca_location_type",
    ))
    v["store"] = View("supplier", (
        "s_suppkey AS s_store_sk", _text("STORE", "s_suppkey") + " AS s_store_id", f"{pick('ese,able,ought,bar', 's_suppkey')} AS s_store_name",
        "CAST(200 + s_suppkey % 120 AS INT) AS s_number_employees", "CAST(5 + s_suppkey % 5 AS INT) AS s_market_id",
        "1 AS s_company_id", "'Unknown' AS s_company_name", "CAST(10 + s_suppkey % 90 AS STRING) AS s_street_number",
        f"{pick('Main,Lake,Hill', 's_suppkey')} AS s_street_name", "'Way' AS s_street_type", _text("Suite ", "s_suppkey % 9") + " AS s_suite_number",
        f"{pick('Fairview,Midway,Oakland', 's_suppkey')} AS s_city",
        f"{pick('Williamson County,Franklin Parish,Bronx County,Orange County,Williamson County', 's_suppkey')} AS s_county",
        f"CASE WHEN s_suppkey % 2 = 0 THEN 'TN' ELSE {pick(STATES, 's_suppkey')} END AS s_state", f"{pick(ZIPS, 's_suppkey')} AS s_zip",
        "CAST(-5 - s_suppkey % 2 AS DECIMAL(5,2)) AS s_gmt_offset",
    ))
    v["date_dim"] = View("range:3000", (
        f"CAST({FIRST_SK} + i AS BIGINT) AS d_date_sk", "dt AS d_date", "CAST((year(dt) - 1900) * 12 + month(dt) - 1 AS INT) AS d_month_seq",
        f"CAST(5113 + {idiv('i + 4', 7)} AS INT) AS d_week_seq", "CAST(year(dt) AS INT) AS d_year", "CAST((i + 4) % 7 AS INT) AS d_dow",
        "CAST(month(dt) AS INT) AS d_moy", "CAST(day(dt) AS INT) AS d_dom", "CAST(quarter(dt) AS INT) AS d_qoy",
        f"{pick(DAYS, 'i + 4')} AS d_day_name", "CAST(year(dt) AS STRING) || 'Q' || CAST(quarter(dt) AS STRING) AS d_quarter_name",
    ), ("i", f"{date} AS dt"))
    v["time_dim"] = View("range:86400", (
        "i AS t_time_sk", "CAST(i AS INT) AS t_time", f"CAST({idiv('i', 3600)} AS INT) AS t_hour", f"CAST({idiv('i', 60)} % 60 AS INT) AS t_minute",
    ))
    v["customer_demographics"] = View("range:280", (
        "i AS cd_demo_sk", f"{pick('M,F', 'i')} AS cd_gender", f"{pick(MARITAL, idiv('i', 2))} AS cd_marital_status",
        f"{pick(EDUCATION, idiv('i', 10))} AS cd_education_status", "CAST(500 * (1 + i % 4) AS INT) AS cd_purchase_estimate",
        f"{pick(CREDIT, idiv('i', 70))} AS cd_credit_rating", "CAST(i % 3 AS INT) AS cd_dep_count", "CAST(i % 5 AS INT) AS cd_dep_employed_count",
        "CAST(i % 2 AS INT) AS cd_dep_college_count",
    ))
    v["household_demographics"] = View("range:7200", (
        "i AS hd_demo_sk", "1 + i % 20 AS hd_income_band_sk", f"{pick(POTENTIAL, idiv('i', 20), '|')} AS hd_buy_potential",
        f"CAST({idiv('i', 120)} % 10 AS INT) AS hd_dep_count", f"CAST({idiv('i', 1200)} % 6 - 1 AS INT) AS hd_vehicle_count",
    ))
    v["income_band"] = View("range:20", ("i + 1 AS ib_income_band_sk", "CAST(i * 10000 + 1 AS INT) AS ib_lower_bound", "CAST((i + 1) * 10000 AS INT) AS ib_upper_bound"))
    v["promotion"] = View("range:30", (
        "i AS p_promo_sk", _text("PROMO", "i") + " AS p_promo_id", "CASE WHEN i % 2 = 0 THEN 'Y' ELSE 'N' END AS p_channel_dmail",
        "CASE WHEN i % 3 = 0 THEN 'Y' ELSE 'N' END AS p_channel_email", "CASE WHEN i % 5 = 0 THEN 'Y' ELSE 'N' END AS p_channel_tv",
        "CASE WHEN i % 7 = 0 THEN 'Y' ELSE 'N' END AS p_channel_event",
    ))
    v["reason"] = View("range:36", ("i AS r_reason_sk", "CASE WHEN i % 7 = 2 THEN 'Did not like the color' ELSE 'Reason number with long text ' || CAST(i AS STRING) END AS r_reason_desc"))
    v["ship_mode"] = View("range:20", ("i AS sm_ship_mode_sk", f"{pick('EXPRESS,NEXT DAY,OVERNIGHT,REGULAR', 'i')} AS sm_type", f"{pick(CARRIERS, idiv('i', 5))} AS sm_carrier"))
    v["warehouse"] = View("range:5", (
        "i AS w_warehouse_sk", "'Conventional childr warehouse ' || CAST(i AS STRING) AS w_warehouse_name", "CAST(50000 + i * 1000 AS INT) AS w_warehouse_sq_ft",
        f"{pick(CITIES, 'i')} AS w_city", f"{pick(CUSTOMER_COUNTIES, 'i')} AS w_county", f"{pick(STATES, 'i')} AS w_state", "'United States' AS w_country",
    ))
    v["call_center"] = View("range:6", (
        "i AS cc_call_center_sk", _text("CC", "i") + " AS cc_call_center_id", _text("center ", "i") + " AS cc_name", _text("manager ", "i % 4") + " AS cc_manager",
        f"{pick('Williamson County,Orange County', 'i')} AS cc_county",
    ))
    v["catalog_page"] = View("range:120", ("i AS cp_catalog_page_sk", _text("PAGE", "i") + " AS cp_catalog_page_id"))
    v["web_site"] = View("range:30", ("i AS web_site_sk", _text("SITE", "i") + " AS web_site_id", _text("site_", f"{idiv('i', 6)}") + " AS web_name", f"{pick('pri,able,ought', 'i')} AS web_company_name"))
    v["web_page"] = View("range:60", ("i AS wp_web_page_sk", "CAST(4900 + (i * 37) % 400 AS INT) AS wp_char_count"))
    return v


SPARK_VIEWS = build()
CHECK_VIEWS = {f"d_{name}": view for name, view in SPARK_VIEWS.items()}


def tables(spark, folder: str) -> Tables:
    return Tables(spark, folder, SPARK_VIEWS)
