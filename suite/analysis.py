"""Keys, distributions, outliers and correlations of the given tables."""

from itertools import combinations

from pyspark.sql import functions as F

from suite.base import WITH_CUSTOMER, WITH_ORDERS, Query, d_customer, d_orders, table
from tablewright.operators.distribution import correlations, distribution, outliers
from tablewright.operators.keys import key_report
from tablewright.operators.sample import bounded_sample, sampled_profile
from tablewright.plans.recipe import column_signals, inspection_order, run_recipe, suggest_recipe

_LINE_KEYS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag", "l_linestatus", "l_shipdate"]
_NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def key_columns(spark, sf):
    """The smallest combinations that identify a line of an order, found without being told."""
    keys = key_report(table(spark, sf, "lineitem"), columns=_LINE_KEYS)
    return keys.select(F.array_join("columns", "+").alias("key_columns"), "rows", "distinct_count")


def _keys_sql(columns, source):
    each = [((a,), a) for a in columns] + [(c, f"({', '.join(c)})") for size in (2, 3) for c in combinations(columns, size)]
    counted = " UNION ALL ".join(
        f"SELECT '{'+'.join(c)}' AS key_columns, {len(c)} AS size, count(*) AS rows, count(DISTINCT {e}) AS distinct_count FROM {source}" for c, e in each
    )
    return f"""WITH c AS ({counted}), k AS (SELECT * FROM c WHERE distinct_count = rows)
SELECT key_columns, rows, distinct_count FROM k WHERE size = (SELECT min(size) FROM k)"""


def customer_keys(spark, sf):
    """Keys of customers with gaps, at all levels up to two columns."""
    keys = key_report(table(spark, sf, "customer"), columns=["c_custkey", "c_name", "c_nationkey", "c_mktsegment"], max_size=2, all_levels=True)
    return keys.select(F.array_join("columns", "+").alias("key_columns"), "rows", "distinct_count")


def planned_dedupe(spark, sf):
    """Orders of which a twentieth stands twice: the planner finds what to deduplicate by."""
    orders = d_orders(spark, sf).select("o_orderkey", "mixed_date")
    twice = orders.unionByName(orders.where("o_orderkey % 20 = 0"))
    steps = suggest_recipe(twice, key_columns="find")
    frame = run_recipe(twice, [s for s in steps if s["op"] in ("dedupe", "parse_dates")]).frame
    return frame.select("o_orderkey", F.date_format("mixed_date", "yyyy-MM-dd").alias("mixed_date"))


def planned_drop(spark, sf):
    """Customers with more than half of their cells null are dropped by plan, before what is left is filled."""
    people = d_customer(spark, sf).select("c_custkey", "acctbal", "nation_id", "segment")
    hollow = people.withColumn("acctbal", F.expr("CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE acctbal END"))
    steps = suggest_recipe(hollow, columns=["c_custkey", "acctbal", "nation_id", "segment"])
    drop = [s for s in steps if s["args"].get("strategy") == "drop_row"]
    return run_recipe(hollow, drop).frame.select("c_custkey", "acctbal", "nation_id", "segment")


def planned_inspection(spark, sf):
    """Which columns to look at first."""
    signals = column_signals(d_customer(spark, sf).drop("all_null"), ["c_custkey", "acctbal", "nation_id"])
    order = inspection_order(signals)
    return spark.createDataFrame(list(enumerate(order)), "place int, `column` string")


def _rounded(df, digits=4):
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def distributions(spark, sf):
    return _rounded(distribution(table(spark, sf, "lineitem"), _NUMBERS)).drop("position")


def distributions_nulls(spark, sf):
    return _rounded(distribution(d_customer(spark, sf), ["acctbal", "nation_id"])).drop("position")


def _distribution_sql(columns, source, prefix=""):
    each = []
    for c in columns:
        q = f"(SELECT quantile_cont({c}::DOUBLE, {{}}) FROM {source})"
        a, z = q.format(0.25), q.format(0.75)
        each.append(
            f"""SELECT '{c}' AS name, count(*) AS row_count, count(*) - count({c}) AS null_count, round(avg({c}), 4) AS mean,
  round(stddev_samp({c}), 4) AS stddev, round(avg(pow({c} - m, 3)) / pow(stddev_pop({c}), 3), 4) AS skewness, round(min({c})::DOUBLE, 4) AS "min", round(any_value(a), 4) AS q1,
  round(quantile_cont({c}::DOUBLE, 0.5), 4) AS median, round(any_value(z), 4) AS q3, round(max({c})::DOUBLE, 4) AS "max",
  round(any_value(a - 1.5 * (z - a)), 4) AS low_fence, round(any_value(z + 1.5 * (z - a)), 4) AS high_fence,
  count(CASE WHEN {c} < a - 1.5 * (z - a) THEN 1 END) AS below, count(CASE WHEN {c} > z + 1.5 * (z - a) THEN 1 END) AS above
FROM {source}, (SELECT {a} AS a, {z} AS z, (SELECT avg({c}) FROM {source}) AS m)"""
        )
    return prefix + " UNION ALL ".join(each)


def outlying_rows(spark, sf):
    """Orders whose price lies outside the fences of a narrow factor."""
    rows = outliers(table(spark, sf, "orders"), ["o_totalprice"], factor=0.25)
    return rows.select("o_orderkey", "o_totalprice", F.array_join("outlier_columns", "+").alias("outlier_columns"))


_OUTLIERS_SQL = """WITH q AS (SELECT quantile_cont(o_totalprice::DOUBLE, 0.25) AS a, quantile_cont(o_totalprice::DOUBLE, 0.75) AS z FROM orders)
SELECT o_orderkey, o_totalprice, 'o_totalprice' AS outlier_columns FROM orders, q
WHERE o_totalprice < a - 0.25 * (z - a) OR o_totalprice > z + 0.25 * (z - a)"""


def correlated(spark, sf):
    return _rounded(correlations(table(spark, sf, "lineitem"), _NUMBERS), 6)


def correlated_nulls(spark, sf):
    """Pairs over the rows that have both."""
    return _rounded(correlations(d_customer(spark, sf), ["c_custkey", "acctbal", "nation_id"]), 6)


def _correlations_sql(columns, source, prefix=""):
    each = []
    for a, b in combinations(columns, 2):
        each.append(
            f"""SELECT '{a}' AS first, '{b}' AS second, count(*) AS n, round(corr(x, y), 6) AS pearson, round(corr(rx, ry), 6) AS spearman
FROM (SELECT x, y, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS rx,
    rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS ry
  FROM (SELECT {a}::DOUBLE AS x, {b}::DOUBLE AS y FROM {source} WHERE {a} IS NOT NULL AND {b} IS NOT NULL))"""
        )
    return prefix + " UNION ALL ".join(each)


def sampled_orders(spark, sf):
    """A thousand orders, the same in every run."""
    return bounded_sample(table(spark, sf, "orders"), 1000, ["o_orderkey"]).select("o_orderkey", "o_totalprice")


def sampled_nulls(spark, sf):
    """Profile lines of a sample of customers with gaps."""
    lines = sampled_profile(d_customer(spark, sf).select("c_custkey", "acctbal", "segment"), 100, ["c_custkey"])
    return lines.select("name", "row_count", "null_count", "distinct_count")


_SAMPLED_SQL = f"{WITH_CUSTOMER}, s AS (SELECT * FROM d ORDER BY md5(c_custkey::VARCHAR) LIMIT 100) " + " UNION ALL ".join(
    f"""SELECT '{c}' AS name, count(*) AS row_count, count(*) - count({c}) AS null_count,
  count(DISTINCT {c}) + (count(*) > count({c}))::BIGINT AS distinct_count FROM s"""
    for c in ("c_custkey", "acctbal", "segment")
)

_DROP = WITH_CUSTOMER.replace("WITH d AS", "WITH d0 AS") + (
    ", d AS (SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE acctbal END AS acctbal, nation_id, segment FROM d0) "
)

QUERIES = [
    Query("key_columns", key_columns, _keys_sql(_LINE_KEYS, "lineitem")),
    Query(
        "customer_keys",
        customer_keys,
        """SELECT 'c_custkey' AS key_columns, count(*) AS rows, count(DISTINCT c_custkey) AS distinct_count FROM customer
UNION ALL SELECT 'c_name', count(*), count(DISTINCT c_name) FROM customer""",
    ),
    Query(
        "planned_dedupe",
        planned_dedupe,
        f"{WITH_ORDERS} SELECT o_orderkey, strftime(try_strptime(mixed_date, '%Y-%m-%d'), '%Y-%m-%d') AS mixed_date FROM d",
    ),
    Query(
        "planned_drop",
        planned_drop,
        f"{_DROP} SELECT * FROM d WHERE (acctbal IS NULL)::INT + (nation_id IS NULL)::INT + (segment IS NULL)::INT <= 2",
    ),
    Query(
        "planned_inspection",
        planned_inspection,
        f"""{WITH_CUSTOMER}, n AS (SELECT 'acctbal' AS c, count(*) - count(acctbal) AS n, 0 AS i FROM d
  UNION ALL SELECT 'nation_id', count(*) - count(nation_id), 1 FROM d)
SELECT (row_number() OVER (ORDER BY n DESC, i) - 1)::INT AS place, c AS "column" FROM n""",
    ),
    Query("distributions", distributions, _distribution_sql(_NUMBERS, "lineitem")),
    Query("distributions_nulls", distributions_nulls, _distribution_sql(["acctbal", "nation_id"], "d", WITH_CUSTOMER)),
    Query("outlying_rows", outlying_rows, _OUTLIERS_SQL),
    Query("sampled_orders", sampled_orders, "SELECT o_orderkey, o_totalprice FROM orders ORDER BY md5(o_orderkey::VARCHAR) LIMIT 1000"),
    Query("sampled_nulls", sampled_nulls, _SAMPLED_SQL),
    Query("correlated", correlated, _correlations_sql(_NUMBERS, "lineitem")),
    Query("correlated_nulls", correlated_nulls, _correlations_sql(["c_custkey", "acctbal", "nation_id"], "d", WITH_CUSTOMER)),
]
