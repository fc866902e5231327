"""Query records and the inputs all queries share."""

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Query:
    name: str
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# The given tables are clean, so dirty inputs are derived from them by SQL both engines run.
D_CUSTOMER = """
SELECT c_custkey,
  CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_acctbal END AS acctbal,
  CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE CAST(c_nationkey AS BIGINT) END AS nation_id,
  CASE WHEN c_custkey % 6 = 0 THEN NULL WHEN c_custkey % 6 = 1 THEN lower(c_mktsegment)
       WHEN c_custkey % 6 = 2 THEN concat('  ', c_mktsegment) WHEN c_custkey % 6 = 3 THEN concat(c_mktsegment, ' ')
       ELSE c_mktsegment END AS segment,
  CASE WHEN c_custkey % 5 = 0 THEN concat('  josé   garcía-', CAST(c_nationkey AS STRING))
       WHEN c_custkey % 5 = 1 THEN concat('JOSÉ GARCÍA-', CAST(c_nationkey AS STRING))
       WHEN c_custkey % 5 = 2 THEN concat('o''brien anne-marie ', CAST(c_nationkey AS STRING))
       ELSE concat('Müller  ', CAST(c_nationkey AS STRING)) END AS full_name,
  CAST(NULL AS DOUBLE) AS all_null
FROM customer
"""

D_ORDERS = """
SELECT o_orderkey, iso_date, dmy_date,
  CASE WHEN o_orderkey % 10 = 0 THEN 'n/a' WHEN o_orderkey % 10 = 1 THEN dmy_date
       WHEN o_orderkey % 10 = 2 THEN NULL ELSE iso_date END AS mixed_date,
  concat('$ ', CAST(th AS STRING), ',', lpad(CAST(whole - th * 1000 AS STRING), 3, '0'), '.',
         lpad(CAST(cents - whole * 100 AS STRING), 2, '0')) AS us_price,
  concat(CAST(th AS STRING), '.', lpad(CAST(whole - th * 1000 AS STRING), 3, '0'), ',',
         lpad(CAST(cents - whole * 100 AS STRING), 2, '0')) AS eu_price
FROM (SELECT *, CAST(floor(whole / 1000) AS BIGINT) AS th
      FROM (SELECT *, CAST(floor(cents / 100) AS BIGINT) AS whole
            FROM (SELECT o_orderkey, substr(CAST(o_orderdate AS STRING), 1, 10) AS iso_date,
                    concat(substr(CAST(o_orderdate AS STRING), 9, 2), '/', substr(CAST(o_orderdate AS STRING), 6, 2),
                           '/', substr(CAST(o_orderdate AS STRING), 1, 4)) AS dmy_date,
                    CAST(round(o_totalprice * 100) AS BIGINT) AS cents
                  FROM orders) a) b) d
"""

D_PART = """
SELECT p_partkey, concat(CAST(p_size AS STRING), '%') AS pct,
  CASE WHEN p_partkey % 9 = 0 THEN concat(CAST(p_size AS STRING), ' EUR') WHEN p_partkey % 9 = 1 THEN 'unknown'
       ELSE CAST(p_size AS STRING) END AS amount,
  concat('1,', lpad(CAST(p_size AS STRING), 3, '0')) AS comma_only
FROM part
"""


def derived(spark: SparkSession, sf_dir: str, sql: str, source: str) -> DataFrame:
    text = sql.replace("{", "{{").replace("}", "}}").replace(f"FROM {source}", "FROM {source}")
    return spark.sql(text, source=table(spark, sf_dir, source))


def d_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, D_CUSTOMER, "customer")


def d_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, D_ORDERS, "orders")


def d_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, D_PART, "part")


WITH_CUSTOMER = f"WITH d AS ({D_CUSTOMER}) "
WITH_ORDERS = f"WITH d AS ({D_ORDERS}) "
WITH_PART = f"WITH d AS ({D_PART}) "

# Unicode white space in the two notations DuckDB wants: a set of characters, a regular expression.
WS_CHARS = "".join(map(chr, [9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B)])) + "".join(
    map(chr, [0x2028, 0x2029, 0x202F, 0x205F, 0x3000])
)
WS = r"[\t\n\x{0B}\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
NOT_WS = "[^" + WS[1:]


def sql_clean(c: str) -> str:
    """Trim and collapse in DuckDB."""
    return f"regexp_replace(trim({c}, '{WS_CHARS}'), '{WS}+', ' ', 'g')"


def sql_title(c: str) -> str:
    words = f"regexp_extract_all(lower({c}), '[\\p{{L}}\\p{{N}}]+|[^\\p{{L}}\\p{{N}}]+')"
    # DuckDB turns a leading sharp s into one capital letter where Spark writes SS.
    first = "CASE WHEN w[1] = 'ß' THEN 'SS' ELSE upper(w[1]) END"
    return f"array_to_string(list_transform({words}, lambda w: {first} || w[2:]), '')"


def sql_number(c: str, decimal: str) -> str:
    kept = f"regexp_replace({c}, '[^0-9eE+\\-.,]', '', 'g')"
    plain = f"replace(replace({kept}, '.', ''), ',', '.')" if decimal == "," else f"replace({kept}, ',', '')"
    return f"TRY_CAST({plain} AS DOUBLE)"
