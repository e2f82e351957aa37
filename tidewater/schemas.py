"""Declared schemas of the two suites, for loading their delimited files."""

from __future__ import annotations

from pyspark.sql import types as T

LONG, INT, TEXT, DATE = T.LongType(), T.IntegerType(), T.StringType(), T.DateType()
MONEY, OFFSET, AMOUNT = T.DecimalType(7, 2), T.DecimalType(5, 2), T.DecimalType(15, 2)
KEY = False  # a required column


def _table(*columns: tuple) -> T.StructType:
    """Columns in file order, as (name, type) or (name, type, KEY)."""
    return T.StructType([T.StructField(*column) for column in columns])


# The columns of the retail tables and, below, of the order-to-cash tables.
TPCDS: dict[str, T.StructType] = {
    "call_center": _table(
        ("cc_call_center_sk", LONG, KEY), ("cc_call_center_id", TEXT, KEY), ("cc_rec_start_date", DATE), ("cc_rec_end_date", DATE), ("cc_closed_date_sk", INT),
        ("cc_open_date_sk", INT), ("cc_name", TEXT), ("cc_class", TEXT), ("cc_employees", INT), ("cc_sq_ft", INT), ("cc_hours", TEXT), ("cc_manager", TEXT),
        ("cc_mkt_id", INT), ("cc_mkt_class", TEXT), ("cc_mkt_desc", TEXT), ("cc_market_manager", TEXT), ("cc_division", INT), ("cc_division_name", TEXT),
        ("cc_company", INT), ("cc_company_name", TEXT), ("cc_street_number", TEXT), ("cc_street_name", TEXT), ("cc_street_type", TEXT), ("cc_suite_number", TEXT),
        ("cc_city", TEXT), ("cc_county", TEXT), ("cc_state", TEXT), ("cc_zip", TEXT), ("cc_country", TEXT), ("cc_gmt_offset", OFFSET), ("cc_tax_percentage", OFFSET),
    ),
    "catalog_page": _table(
        ("cp_catalog_page_sk", LONG, KEY), ("cp_catalog_page_id", TEXT, KEY), ("cp_start_date_sk", INT), ("cp_end_date_sk", INT), ("cp_department", TEXT),
        ("cp_catalog_number", INT), ("cp_catalog_page_number", INT), ("cp_description", TEXT), ("cp_type", TEXT),
    ),
    "catalog_returns": _table(
        ("cr_returned_date_sk", INT), ("cr_returned_time_sk", INT), ("cr_item_sk", LONG, KEY), ("cr_refunded_customer_sk", LONG), ("cr_refunded_cdemo_sk", LONG),
        ("cr_refunded_hdemo_sk", LONG), ("cr_refunded_addr_sk", LONG), ("cr_returning_customer_sk", LONG), ("cr_returning_cdemo_sk", LONG),
        ("cr_returning_hdemo_sk", LONG), ("cr_returning_addr_sk", LONG), ("cr_call_center_sk", LONG), ("cr_catalog_page_sk", LONG), ("cr_ship_mode_sk", LONG),
        ("cr_warehouse_sk", LONG), ("cr_reason_sk", LONG), ("cr_order_number", LONG, KEY), ("cr_return_quantity", INT), ("cr_return_amount", MONEY),
        ("cr_return_tax", MONEY), ("cr_return_amt_inc_tax", MONEY), ("cr_fee", MONEY), ("cr_return_ship_cost", MONEY), ("cr_refunded_cash", MONEY),
        ("cr_reversed_charge", MONEY), ("cr_store_credit", MONEY), ("cr_net_loss", MONEY),
    ),
    "catalog_sales": _table(
        ("cs_sold_date_sk", INT), ("cs_sold_time_sk", INT), ("cs_ship_date_sk", INT), ("cs_bill_customer_sk", LONG), ("cs_bill_cdemo_sk", LONG),
        ("cs_bill_hdemo_sk", LONG), ("cs_bill_addr_sk", LONG), ("cs_ship_customer_sk", LONG), ("cs_ship_cdemo_sk", LONG), ("cs_ship_hdemo_sk", LONG),
        ("cs_ship_addr_sk", LONG), ("cs_call_center_sk", LONG), ("cs_catalog_page_sk", LONG), ("cs_ship_mode_sk", LONG), ("cs_warehouse_sk", LONG),
        ("cs_item_sk", LONG, KEY), ("cs_promo_sk", LONG), ("cs_order_number", LONG, KEY), ("cs_quantity", INT), ("cs_wholesale_cost", MONEY), ("cs_list_price", MONEY),
        ("cs_sales_price", MONEY), ("cs_ext_discount_amt", MONEY), ("cs_ext_sales_price", MONEY), ("cs_ext_wholesale_cost", MONEY), ("cs_ext_list_price", MONEY),
        ("cs_ext_tax", MONEY), ("cs_coupon_amt", MONEY), ("cs_ext_ship_cost", MONEY), ("cs_net_paid", MONEY), ("cs_net_paid_inc_tax", MONEY),
        ("cs_net_paid_inc_ship", MONEY), ("cs_net_paid_inc_ship_tax", MONEY), ("cs_net_profit", MONEY),
    ),
    "customer": _table(
        ("c_customer_sk", LONG, KEY), ("c_customer_id", TEXT, KEY), ("c_current_cdemo_sk", LONG), ("c_current_hdemo_sk", LONG), ("c_current_addr_sk", LONG),
        ("c_first_shipto_date_sk", INT), ("c_first_sales_date_sk", INT), ("c_salutation", TEXT), ("c_first_name", TEXT), ("c_last_name", TEXT),
        ("c_preferred_cust_flag", TEXT), ("c_birth_day", INT), ("c_birth_month", INT), ("c_birth_year", INT), ("c_birth_country", TEXT), ("c_login", TEXT),
        ("c_email_address", TEXT), ("c_last_review_date_sk", INT),
    ),
    "customer_address": _table(
        ("ca_address_sk", LONG, KEY), ("ca_address_id", TEXT, KEY), ("ca_street_number", TEXT), ("ca_street_name", TEXT), ("ca_street_type", TEXT),
        ("ca_suite_number", TEXT), ("ca_city", TEXT), ("ca_county", TEXT), ("ca_state", TEXT), ("ca_zip", TEXT), ("ca_country", TEXT), ("ca_gmt_offset", OFFSET),
        ("ca_location_type", TEXT),
    ),
    "customer_demographics": _table(
        ("cd_demo_sk", LONG, KEY), ("cd_gender", TEXT), ("cd_marital_status", TEXT), ("cd_education_status", TEXT), ("cd_purchase_estimate", INT),
        ("cd_credit_rating", TEXT), ("cd_dep_count", INT), ("cd_dep_employed_count", INT), ("cd_dep_college_count", INT),
    ),
    "date_dim": _table(
        ("d_date_sk", LONG, KEY), ("d_date_id", TEXT, KEY), ("d_date", DATE), ("d_month_seq", INT), ("d_week_seq", INT), ("d_quarter_seq", INT), ("d_year", INT),
        ("d_dow", INT), ("d_moy", INT), ("d_dom", INT), ("d_qoy", INT), ("d_fy_year", INT), ("d_fy_quarter_seq", INT), ("d_fy_week_seq", INT), ("d_day_name", TEXT),
        ("d_quarter_name", TEXT), ("d_holiday", TEXT), ("d_weekend", TEXT), ("d_following_holiday", TEXT), ("d_first_dom", INT), ("d_last_dom", INT),
        ("d_same_day_ly", INT), ("d_same_day_lq", INT), ("d_current_day", TEXT), ("d_current_week", TEXT), ("d_current_month", TEXT), ("d_current_quarter", TEXT),
        ("d_current_year", TEXT),
    ),
    "household_demographics": _table(
        ("hd_demo_sk", LONG, KEY), ("hd_income_band_sk", LONG), ("hd_buy_potential", TEXT), ("hd_dep_count", INT), ("hd_vehicle_count", INT),
    ),
    "income_band": _table(
        ("ib_income_band_sk", LONG, KEY), ("ib_lower_bound", INT), ("ib_upper_bound", INT),
    ),
    "inventory": _table(
        ("inv_date_sk", INT, KEY), ("inv_item_sk", LONG, KEY), ("inv_warehouse_sk", LONG, KEY), ("inv_quantity_on_hand", INT),
    ),
    "item": _table(
        ("i_item_sk", LONG, KEY), ("i_item_id", TEXT, KEY), ("i_rec_start_date", DATE), ("i_rec_end_date", DATE), ("i_item_desc", TEXT), ("i_current_price", MONEY),
        ("i_wholesale_cost", MONEY), ("i_brand_id", INT), ("i_brand", TEXT), ("i_class_id", INT), ("i_class", TEXT), ("i_category_id", INT), ("i_category", TEXT),
        ("i_manufact_id", INT), ("i_manufact", TEXT), ("i_size", TEXT), ("i_formulation", TEXT), ("i_color", TEXT), ("i_units", TEXT), ("i_container", TEXT),
        ("i_manager_id", INT), ("i_product_name", TEXT),
    ),
    "promotion": _table(
        ("p_promo_sk", LONG, KEY), ("p_promo_id", TEXT, KEY), ("p_start_date_sk", INT), ("p_end_date_sk", INT), ("p_item_sk", LONG), ("p_cost", AMOUNT),
        ("p_response_target", INT), ("p_promo_name", TEXT), ("p_channel_dmail", TEXT), ("p_channel_email", TEXT), ("p_channel_catalog", TEXT), ("p_channel_tv", TEXT),
        ("p_channel_radio", TEXT), ("p_channel_press", TEXT), ("p_channel_event", TEXT), ("p_channel_demo", TEXT), ("p_channel_details", TEXT), ("p_purpose", TEXT),
        ("p_discount_active", TEXT),
    ),
    "reason": _table(
        ("r_reason_sk", LONG, KEY), ("r_reason_id", TEXT, KEY), ("r_reason_desc", TEXT),
    ),
    "ship_mode": _table(
        ("sm_ship_mode_sk", LONG, KEY), ("sm_ship_mode_id", TEXT, KEY), ("sm_type", TEXT), ("sm_code", TEXT), ("sm_carrier", TEXT), ("sm_contract", TEXT),
    ),
    "store": _table(
        ("s_store_sk", LONG, KEY), ("s_store_id", TEXT, KEY), ("s_rec_start_date", DATE), ("s_rec_end_date", DATE), ("s_closed_date_sk", INT), ("s_store_name", TEXT),
        ("s_number_employees", INT), ("s_floor_space", INT), ("s_hours", TEXT), ("s_manager", TEXT), ("s_market_id", INT), ("s_geography_class", TEXT),
        ("s_market_desc", TEXT), ("s_market_manager", TEXT), ("s_division_id", INT), ("s_division_name", TEXT), ("s_company_id", INT), ("s_company_name", TEXT),
        ("s_street_number", TEXT), ("s_street_name", TEXT), ("s_street_type", TEXT), ("s_suite_number", TEXT), ("s_city", TEXT), ("s_county", TEXT), ("s_state", TEXT),
        ("s_zip", TEXT), ("s_country", TEXT), ("s_gmt_offset", OFFSET), ("s_tax_percentage", OFFSET),
    ),
    "store_returns": _table(
        ("sr_returned_date_sk", INT), ("sr_return_time_sk", INT), ("sr_item_sk", LONG, KEY), ("sr_customer_sk", LONG), ("sr_cdemo_sk", LONG), ("sr_hdemo_sk", LONG),
        ("sr_addr_sk", LONG), ("sr_store_sk", LONG), ("sr_reason_sk", LONG), ("sr_ticket_number", LONG, KEY), ("sr_return_quantity", INT), ("sr_return_amt", MONEY),
        ("sr_return_tax", MONEY), ("sr_return_amt_inc_tax", MONEY), ("sr_fee", MONEY), ("sr_return_ship_cost", MONEY), ("sr_refunded_cash", MONEY),
        ("sr_reversed_charge", MONEY), ("sr_store_credit", MONEY), ("sr_net_loss", MONEY),
    ),
    "store_sales": _table(
        ("ss_sold_date_sk", INT), ("ss_sold_time_sk", INT), ("ss_item_sk", LONG, KEY), ("ss_customer_sk", LONG), ("ss_cdemo_sk", LONG), ("ss_hdemo_sk", LONG),
        ("ss_addr_sk", LONG), ("ss_store_sk", LONG), ("ss_promo_sk", LONG), ("ss_ticket_number", LONG, KEY), ("ss_quantity", INT), ("ss_wholesale_cost", MONEY),
        ("ss_list_price", MONEY), ("ss_sales_price", MONEY), ("ss_ext_discount_amt", MONEY), ("ss_ext_sales_price", MONEY), ("ss_ext_wholesale_cost", MONEY),
        ("ss_ext_list_price", MONEY), ("ss_ext_tax", MONEY), ("ss_coupon_amt", MONEY), ("ss_net_paid", MONEY), ("ss_net_paid_inc_tax", MONEY), ("ss_net_profit", MONEY),
    ),
    "time_dim": _table(
        ("t_time_sk", LONG, KEY), ("t_time_id", TEXT, KEY), ("t_time", INT), ("t_hour", INT), ("t_minute", INT), ("t_second", INT), ("t_am_pm", TEXT), ("t_shift", TEXT),
        ("t_sub_shift", TEXT), ("t_meal_time", TEXT),
    ),
    "warehouse": _table(
        ("w_warehouse_sk", LONG, KEY), ("w_warehouse_id", TEXT, KEY), ("w_warehouse_name", TEXT), ("w_warehouse_sq_ft", INT), ("w_street_number", TEXT),
        ("w_street_name", TEXT), ("w_street_type", TEXT), ("w_suite_number", TEXT), ("w_city", TEXT), ("w_county", TEXT), ("w_state", TEXT), ("w_zip", TEXT),
        ("w_country", TEXT), ("w_gmt_offset", OFFSET),
    ),
    "web_page": _table(
        ("wp_web_page_sk", LONG, KEY), ("wp_web_page_id", TEXT, KEY), ("wp_rec_start_date", DATE), ("wp_rec_end_date", DATE), ("wp_creation_date_sk", INT),
        ("wp_access_date_sk", INT), ("wp_autogen_flag", TEXT), ("wp_customer_sk", LONG), ("wp_url", TEXT), ("wp_type", TEXT), ("wp_char_count", INT),
        ("wp_link_count", INT), ("wp_image_count", INT), ("wp_max_ad_count", INT),
    ),
    "web_returns": _table(
        ("wr_returned_date_sk", INT), ("wr_returned_time_sk", INT), ("wr_item_sk", LONG, KEY), ("wr_refunded_customer_sk", LONG), ("wr_refunded_cdemo_sk", LONG),
        ("wr_refunded_hdemo_sk", LONG), ("wr_refunded_addr_sk", LONG), ("wr_returning_customer_sk", LONG), ("wr_returning_cdemo_sk", LONG),
        ("wr_returning_hdemo_sk", LONG), ("wr_returning_addr_sk", LONG), ("wr_web_page_sk", LONG), ("wr_reason_sk", LONG), ("wr_order_number", LONG, KEY),
        ("wr_return_quantity", INT), ("wr_return_amt", MONEY), ("wr_return_tax", MONEY), ("wr_return_amt_inc_tax", MONEY), ("wr_fee", MONEY),
        ("wr_return_ship_cost", MONEY), ("wr_refunded_cash", MONEY), ("wr_reversed_charge", MONEY), ("wr_account_credit", MONEY), ("wr_net_loss", MONEY),
    ),
    "web_sales": _table(
        ("ws_sold_date_sk", INT), ("ws_sold_time_sk", INT), ("ws_ship_date_sk", INT), ("ws_item_sk", LONG, KEY), ("ws_bill_customer_sk", LONG),
        ("ws_bill_cdemo_sk", LONG), ("ws_bill_hdemo_sk", LONG), ("ws_bill_addr_sk", LONG), ("ws_ship_customer_sk", LONG), ("ws_ship_cdemo_sk", LONG),
        ("ws_ship_hdemo_sk", LONG), ("ws_ship_addr_sk", LONG), ("ws_web_page_sk", LONG), ("ws_web_site_sk", LONG), ("ws_ship_mode_sk", LONG), ("ws_warehouse_sk", LONG),
        ("ws_promo_sk", LONG), ("ws_order_number", LONG, KEY), ("ws_quantity", INT), ("ws_wholesale_cost", MONEY), ("ws_list_price", MONEY), ("ws_sales_price", MONEY),
        ("ws_ext_discount_amt", MONEY), ("ws_ext_sales_price", MONEY), ("ws_ext_wholesale_cost", MONEY), ("ws_ext_list_price", MONEY), ("ws_ext_tax", MONEY),
        ("ws_coupon_amt", MONEY), ("ws_ext_ship_cost", MONEY), ("ws_net_paid", MONEY), ("ws_net_paid_inc_tax", MONEY), ("ws_net_paid_inc_ship", MONEY),
        ("ws_net_paid_inc_ship_tax", MONEY), ("ws_net_profit", MONEY),
    ),
    "web_site": _table(
        ("web_site_sk", LONG, KEY), ("web_site_id", TEXT, KEY), ("web_rec_start_date", DATE), ("web_rec_end_date", DATE), ("web_name", TEXT), ("web_open_date_sk", INT),
        ("web_close_date_sk", INT), ("web_class", TEXT), ("web_manager", TEXT), ("web_mkt_id", INT), ("web_mkt_class", TEXT), ("web_mkt_desc", TEXT),
        ("web_market_manager", TEXT), ("web_company_id", INT), ("web_company_name", TEXT), ("web_street_number", TEXT), ("web_street_name", TEXT),
        ("web_street_type", TEXT), ("web_suite_number", TEXT), ("web_city", TEXT), ("web_county", TEXT), ("web_state", TEXT), ("web_zip", TEXT), ("web_country", TEXT),
        ("web_gmt_offset", OFFSET), ("web_tax_percentage", OFFSET),
    ),
}

TPCH: dict[str, T.StructType] = {
    "region": _table(
        ("r_regionkey", INT, KEY), ("r_name", TEXT), ("r_comment", TEXT),
    ),
    "nation": _table(
        ("n_nationkey", INT, KEY), ("n_name", TEXT), ("n_regionkey", INT), ("n_comment", TEXT),
    ),
    "supplier": _table(
        ("s_suppkey", LONG, KEY), ("s_name", TEXT), ("s_address", TEXT), ("s_nationkey", INT), ("s_phone", TEXT), ("s_acctbal", AMOUNT), ("s_comment", TEXT),
    ),
    "customer": _table(
        ("c_custkey", LONG, KEY), ("c_name", TEXT), ("c_address", TEXT), ("c_nationkey", INT), ("c_phone", TEXT), ("c_acctbal", AMOUNT), ("c_mktsegment", TEXT),
        ("c_comment", TEXT),
    ),
    "part": _table(
        ("p_partkey", LONG, KEY), ("p_name", TEXT), ("p_mfgr", TEXT), ("p_brand", TEXT), ("p_type", TEXT), ("p_size", INT), ("p_container", TEXT),
        ("p_retailprice", AMOUNT), ("p_comment", TEXT),
    ),
    "partsupp": _table(
        ("ps_partkey", LONG, KEY), ("ps_suppkey", LONG, KEY), ("ps_availqty", INT), ("ps_supplycost", AMOUNT), ("ps_comment", TEXT),
    ),
    "orders": _table(
        ("o_orderkey", LONG, KEY), ("o_custkey", LONG), ("o_orderstatus", TEXT), ("o_totalprice", AMOUNT), ("o_orderdate", DATE), ("o_orderpriority", TEXT),
        ("o_clerk", TEXT), ("o_shippriority", INT), ("o_comment", TEXT),
    ),
    "lineitem": _table(
        ("l_orderkey", LONG, KEY), ("l_partkey", LONG), ("l_suppkey", LONG), ("l_linenumber", INT, KEY), ("l_quantity", AMOUNT), ("l_extendedprice", AMOUNT),
        ("l_discount", AMOUNT), ("l_tax", AMOUNT), ("l_returnflag", TEXT), ("l_linestatus", TEXT), ("l_shipdate", DATE), ("l_commitdate", DATE), ("l_receiptdate", DATE),
        ("l_shipinstruct", TEXT), ("l_shipmode", TEXT), ("l_comment", TEXT),
    ),
}

# Primary keys of the retail tables with more than one key column.
COMPOSITE_KEYS = {
    "catalog_returns": ["cr_item_sk", "cr_order_number"], "catalog_sales": ["cs_item_sk", "cs_order_number"], "store_returns": ["sr_item_sk", "sr_ticket_number"],
    "store_sales": ["ss_item_sk", "ss_ticket_number"], "web_returns": ["wr_item_sk", "wr_order_number"], "web_sales": ["ws_item_sk", "ws_order_number"],
    "inventory": ["inv_date_sk", "inv_item_sk", "inv_warehouse_sk"],
}


def primary_key(table: str) -> list[str]:
    return COMPOSITE_KEYS.get(table) or [TPCDS[table].fields[0].name]
