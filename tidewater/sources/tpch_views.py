"""The eight order-to-cash tables over the given star schema.

Columns the given tables lack are filled by integer arithmetic on their keys.
Dates stay as stored (so range filters reach the scan); the data lies three
years later than the queries' own literals, hence ``YEAR_SHIFT``.
"""

from __future__ import annotations

from tidewater.sources.views import Tables, View, idiv, pick

YEAR_SHIFT = 3

# Nation names in key order.
NATIONS = (
    "ALGERIA,ARGENTINA,BRAZIL,CANADA,EGYPT,ETHIOPIA,FRANCE,GERMANY,INDIA,INDONESIA,IRAN,IRAQ,JAPAN,"
    "JORDAN,KENYA,MOROCCO,MOZAMBIQUE,PERU,CHINA,ROMANIA,SAUDI ARABIA,VIETNAM,RUSSIA,UNITED KINGDOM,UNITED STATES"
)
FINISHES = "ANODIZED,BURNISHED,PLATED,POLISHED,BRUSHED"
METALS = "STEEL,BRASS,TIN,NICKEL,COPPER"
CONTAINERS = "SM CASE,SM BOX,SM PACK,SM PKG,MED BAG,MED BOX,MED PKG,MED PACK,LG CASE,LG BOX,LG PACK,LG PKG"
SHADES = "green,forest,almond,navy,khaki"


def _key_text(prefix: str, key: str) -> str:
    return f"'{prefix}' || CAST({key} AS STRING)"


def build() -> dict[str, View]:
    ship = "CAST(l_shipdate AS DATE)"
    return {
        "region": View("region", ("r_regionkey", "r_name")),
        "nation": View("nation", ("n_nationkey", f"{pick(NATIONS, 'n_nationkey')} AS n_name", "n_regionkey")),
        "supplier": View(
            "supplier",
            (
                "s_suppkey",
                "s_name",
                f"{_key_text('Dock ', 's_suppkey % 97')} AS s_address",
                "s_nationkey",
                f"CAST(10 + s_nationkey AS STRING) || '-' || CAST(100 + s_suppkey % 900 AS STRING) AS s_phone",
                "CAST(s_acctbal AS DECIMAL(12,2)) AS s_acctbal",
                "CASE WHEN s_suppkey % 11 = 4 THEN 'slow Customer desk, many Complaints' ELSE 'on time' END AS s_comment",
            ),
        ),
        "customer": View(
            "customer",
            (
                "c_custkey",
                "c_name",
                f"{_key_text('Lane ', 'c_custkey % 997')} AS c_address",
                "c_nationkey",
                "CAST(10 + c_nationkey AS STRING) || '-' || CAST(100 + c_custkey % 900 AS STRING) AS c_phone",
                "CAST(c_acctbal AS DECIMAL(12,2)) AS c_acctbal",
                "c_mktsegment",
                f"{_key_text('note ', 'c_custkey % 13')} AS c_comment",
            ),
        ),
        "part": View(
            "part",
            (
                "p_partkey",
                f"CASE WHEN p_partkey % 3 = 0 THEN {pick(SHADES, idiv('p_partkey', 3))} || ' ' || p_name "
                f"ELSE p_name || ' ' || {pick(SHADES, 'p_partkey')} END AS p_name",
                _key_text("Maker ", "1 + p_partkey % 5") + " AS p_mfgr",
                "CASE WHEN p_brand = 'Brand#9' THEN 'Brand#34' ELSE p_brand END AS p_brand",
                f"p_type || ' ' || {pick(FINISHES, 'p_partkey')} || ' ' || {pick(METALS, idiv('p_partkey', 5))} AS p_type",
                "p_size",
                f"{pick(CONTAINERS, idiv('p_partkey', 2))} AS p_container",
                "CAST(p_retailprice AS DECIMAL(12,2)) AS p_retailprice",
            ),
        ),
        "partsupp": View(
            "lineitem",
            (
                "l_partkey AS ps_partkey",
                "l_suppkey AS ps_suppkey",
                "CAST(1 + (l_partkey * 7 + l_suppkey * 13) % 999 AS INT) AS ps_availqty",
                "CAST((100 + (l_partkey * 31 + l_suppkey * 17) % 99900) * 0.01 AS DECIMAL(12,2)) AS ps_supplycost",
            ),
            group="l_partkey, l_suppkey",
        ),
        "orders": View(
            "orders",
            (
                "o_orderkey",
                # every third customer never orders, as in the published generator
                "CASE WHEN o_custkey % 3 = 0 THEN o_custkey + 1 ELSE o_custkey END AS o_custkey",
                "o_orderstatus",
                "CAST(o_totalprice AS DECIMAL(12,2)) AS o_totalprice",
                "CAST(o_orderdate AS DATE) AS o_orderdate",
                "o_orderpriority",
                "0 AS o_shippriority",
                "CASE WHEN o_orderkey % 7 = 3 THEN 'pack special goods per requests' ELSE 'regular order' END AS o_comment",
            ),
        ),
        "lineitem": View(
            "lineitem",
            (
                "l_orderkey",
                "l_partkey",
                "l_suppkey",
                "l_linenumber",
                "CAST(l_quantity AS DECIMAL(12,2)) AS l_quantity",
                "CAST(l_extendedprice AS DECIMAL(12,2)) AS l_extendedprice",
                "CAST(l_discount AS DECIMAL(4,2)) AS l_discount",
                "CAST(l_tax AS DECIMAL(4,2)) AS l_tax",
                "l_returnflag",
                "l_linestatus",
                f"{ship} AS l_shipdate",
                f"{ship} + CAST(l_partkey % 61 - 30 AS INT) AS l_commitdate",
                f"{ship} + CAST(1 + (l_suppkey * 7 + l_linenumber) % 30 AS INT) AS l_receiptdate",
                f"{pick('DELIVER IN PERSON,COLLECT COD,NONE,TAKE BACK RETURN', 'l_partkey')} AS l_shipinstruct",
                f"{pick('AIR,AIR REG,RAIL,SHIP,TRUCK,MAIL,FOB', 'l_orderkey + l_linenumber')} AS l_shipmode",
            ),
        ),
    }


SPARK_VIEWS = build()
CHECK_VIEWS = {f"h_{name}": view for name, view in SPARK_VIEWS.items()}


def tables(spark, folder: str) -> Tables:
    return Tables(spark, folder, SPARK_VIEWS, YEAR_SHIFT)
