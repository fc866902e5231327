"""Profiles and inspections."""

import uuid

from pyspark.sql import functions as F

from suite.base import WITH_CUSTOMER, Query, d_customer, derived, table
from tablewright.operators import inspect as look
from tablewright.operators.dedupe import duplicate_examples, duplicate_groups, duplicate_totals
from tablewright.operators.profile import profile, quality_brief
from tablewright.plans.profile_runs import latest_per_group, latest_runs, read_back, run_profile
from tablewright.scratch import shared_dir

_CUSTOMER = {
    "c_custkey": "bigint",
    "acctbal": "double",
    "nation_id": "bigint",
    "segment": "string",
    "full_name": "string",
    "all_null": "double",
}
_LINEITEM = {
    "l_orderkey": "bigint",
    "l_partkey": "bigint",
    "l_linenumber": "int",
    "l_quantity": "double",
    "l_extendedprice": "double",
    "l_returnflag": "string",
    "l_shipdate": "timestamp_ntz",
}


def _top_text():
    return F.array_join(F.transform("top_values", lambda v: F.concat_ws(":", v["count"].cast("string"), v["value"])), "|")


def _lines_of(profiled):
    """The lines of a profile, with its top values as one text."""
    return profiled.withColumn("top_values", _top_text()).drop("position")


def profile_table(spark, sf):
    return _lines_of(profile(d_customer(spark, sf)))


def profile_lineitem(spark, sf):
    return _lines_of(profile(table(spark, sf, "lineitem"), list(_LINEITEM)))


def profile_documents(spark, sf):
    return _lines_of(profile(table(spark, sf, "documents"), ["text", "lang", "source", "n_chars"]))


def _profile_sql(columns, source):
    return " UNION ALL ".join(
        f"""SELECT '{c}' AS name, '{dtype}' AS dtype, count(*) AS row_count, count(*) - count({c}) AS null_count,
  round((count(*) - count({c})) / count(*)::DOUBLE, 4) AS null_pct,
  count(DISTINCT {c}) + CAST(count(*) > count({c}) AS BIGINT) AS distinct_count,
  CAST(min({c}) AS VARCHAR) AS "min", CAST(max({c}) AS VARCHAR) AS "max",
  (SELECT string_agg(k || ':' || v, '|' ORDER BY r) FROM (
    SELECT count(*) AS k, coalesce(CAST({c} AS VARCHAR), '') AS v, row_number() OVER (ORDER BY count(*) DESC, {c} ASC NULLS FIRST) AS r
    FROM {source} GROUP BY {c} QUALIFY r <= 5)) AS top_values FROM {source}"""
        for c, dtype in columns.items()
    )


def profile_top_values(spark, sf):
    lines = profile(d_customer(spark, sf))
    return lines.select("name", F.posexplode("top_values").alias("at", "top")).select(
        "name", (F.col("at") + 1).cast("bigint").alias("rank"), "top.value", "top.count"
    )


_TOP_SQL = WITH_CUSTOMER + " UNION ALL ".join(
    f"""(SELECT '{c}' AS name, row_number() OVER (ORDER BY count(*) DESC, {c} ASC NULLS FIRST) AS rank,
  coalesce(CAST({c} AS VARCHAR), '') AS value, count(*) AS count FROM d GROUP BY {c} QUALIFY rank <= 5)"""
    for c in _CUSTOMER
)


def profile_latest_run(spark, sf):
    runs = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", "o_orderdate")
    latest = latest_per_group(runs, ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")])
    return latest.select("o_custkey", "o_orderkey", "o_orderstatus")


def profile_run(spark, sf):
    """Two tables profiled, and the last state of their runs."""
    root = f"{shared_dir(spark)}/runs/{uuid.uuid4().hex}"
    for name in ("customer", "orders"):
        run_profile(spark, root, name, lambda name=name: table(spark, sf, name))
    return latest_runs(spark.read.parquet(f"{root}/profile_runs")).select("dataset_id", "status", "row_count", "error")


def brief(spark, sf):
    return quality_brief(profile(d_customer(spark, sf))).withColumn(
        "columns_with_many_nulls", F.col("columns_with_many_nulls").cast("bigint")
    )


def _share(c):
    return f"(count(*) - count({c})) / count(*)::DOUBLE >= 0.2"


_SCHEMA = "\n".join(f"{c} ({t})" for c, t in _CUSTOMER.items())
_BRIEF_SQL = f"""{WITH_CUSTOMER}
SELECT row_count, CAST(len(flagged) AS BIGINT) AS columns_with_many_nulls,
  array_to_string(flagged[1:5], ', ') AS first_names, '{_SCHEMA}' AS "schema"
FROM (SELECT count(*) AS row_count, list_filter([{', '.join(f"CASE WHEN {_share(c)} THEN '{c}' END" for c in _CUSTOMER)}],
  lambda x: x IS NOT NULL) AS flagged FROM d) t"""


def inspect_numeric(spark, sf):
    line = look.inspect_column(table(spark, sf, "lineitem"), "l_extendedprice").report
    return line.select(
        "total_rows", "null_count", *[F.round(c, 4).alias(c) for c in ("min", "max", "mean", "median")]
    )


def inspect_numeric_nulls(spark, sf):
    line = look.inspect_column(d_customer(spark, sf), "acctbal").report
    return line.select(
        "total_rows", "null_count", *[F.round(c, 4).alias(c) for c in ("min", "max", "mean", "median")]
    )


def _numeric_sql(c, source):
    return f"""SELECT count(*) AS total_rows, count(*) - count({c}) AS null_count, round(min({c}), 4) AS "min",
  round(max({c}), 4) AS "max", round(avg({c}), 4) AS mean, round(median({c}), 4) AS median FROM {source}"""


def histogram(spark, sf):
    bins = look.histogram(table(spark, sf, "lineitem"), "l_quantity")
    return bins.select("bin", F.round("upper_edge", 4).alias("upper_edge"), "count")


_HISTOGRAM_SQL = """
WITH r AS (SELECT min(l_quantity) AS lo, (max(l_quantity) - min(l_quantity)) / 20 AS w FROM lineitem),
b AS (SELECT least(20, greatest(1, CAST(ceil((l_quantity - lo) / w) AS INT))) AS bin, count(*) AS n
      FROM lineitem, r GROUP BY 1)
SELECT CAST(i AS INT) AS bin, round(lo + i * w, 4) AS upper_edge, coalesce(n, 0) AS count
FROM range(1, 21) t(i) CROSS JOIN r LEFT JOIN b ON b.bin = i"""


def inspect_categorical(spark, sf):
    return look.value_counts(table(spark, sf, "part"), "p_type")


def inspect_days(spark, sf):
    return look.value_counts(table(spark, sf, "lineitem"), "l_shipdate")


def _counts_sql(c, source):
    return f"""SELECT CAST({c} AS VARCHAR) AS value, count(*) AS count FROM {source} WHERE {c} IS NOT NULL
GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 10"""


def inspect_distinct(spark, sf):
    return look.inspect_column(d_customer(spark, sf), "segment").report


def sample_head(spark, sf):
    rows = look.head(table(spark, sf, "orders"), ["o_orderkey"], 25)
    return rows.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority")


_TYPED = """
SELECT event_id, ts, event_type, CASE WHEN event_id % 5 = 0 THEN CAST('NaN' AS DOUBLE) ELSE value END AS value,
  CAST(ts AS DATE) AS day, CASE WHEN event_id % 3 > 0 THEN CAST(event_type AS BINARY) END AS raw FROM events"""


def json_cells(spark, sf):
    return look.json_cells(derived(spark, sf, _TYPED, "events"))


def stable_rows(spark, sf):
    rows = table(spark, sf, "customer").select("c_nationkey", "c_name", "c_mktsegment", "c_custkey")
    return look.stable_json(rows)


_STABLE = """concat('{"c_custkey":', c_custkey, ',"c_mktsegment":"', c_mktsegment, '","c_name":"', c_name,
  '","c_nationkey":', c_nationkey, '}')"""

# One stored result per order, with the second column's counts left out.
_STORED = """
SELECT o_orderkey, concat('{"row_count":', CAST(o_custkey AS STRING), ',"columns":[{"name":"a","dtype":"',
  o_orderstatus, '","null_count":', CAST(o_orderkey % 5 AS STRING), ',"null_pct":0.5,"distinct_count":3,"min":"',
  o_orderpriority, '","top_values":[{"value":"', o_orderstatus, '","count":', CAST(o_custkey AS STRING),
  '},{"value":"","count":1}]},{"name":"b","max":"z"}]}') AS result FROM orders"""


def stored_profiles(spark, sf):
    stored = derived(spark, sf, _STORED, "orders")
    return read_back(stored).select(
        "o_orderkey", "row_count", "name", "dtype", "null_count", "null_pct", "distinct_count", "min", "max", _top_text().alias("top_values")
    )


_STORED_SQL = """
SELECT o_orderkey, o_custkey AS row_count, 'a' AS name, o_orderstatus AS dtype, o_orderkey % 5 AS null_count,
  0.5::DOUBLE AS null_pct, 3::BIGINT AS distinct_count, o_orderpriority AS "min", CAST(NULL AS VARCHAR) AS "max",
  concat(o_custkey, ':', o_orderstatus, '|1:') AS top_values FROM orders
UNION ALL SELECT o_orderkey, o_custkey, 'b', '', 0, 0.0, NULL, NULL, 'z', '' FROM orders"""


def _groups(spark, sf):
    return duplicate_groups(table(spark, sf, "orders"), ["o_custkey", "o_orderstatus"])


_GROUPS_SQL = "SELECT o_custkey, o_orderstatus, count(*) AS count FROM orders GROUP BY ALL HAVING count(*) > 1"

QUERIES = [
    Query("profile_table", profile_table, WITH_CUSTOMER + _profile_sql(_CUSTOMER, "d")),
    Query("profile_lineitem", profile_lineitem, _profile_sql(_LINEITEM, "lineitem")),
    Query(
        "profile_documents",
        profile_documents,
        _profile_sql({"text": "string", "lang": "string", "source": "string", "n_chars": "bigint"}, "documents"),
    ),
    Query("profile_top_values", profile_top_values, _TOP_SQL),
    Query(
        "profile_latest_run",
        profile_latest_run,
        """SELECT o_custkey, o_orderkey, o_orderstatus FROM orders
QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1""",
    ),
    Query(
        "profile_run",
        profile_run,
        " UNION ALL ".join(
            f"SELECT '{name}' AS dataset_id, 'completed' AS status, count(*) AS row_count, CAST(NULL AS VARCHAR) AS error FROM {name}"
            for name in ("customer", "orders")
        ),
    ),
    Query("quality_brief", brief, _BRIEF_SQL),
    Query("stored_profiles", stored_profiles, _STORED_SQL),
    Query("inspect_numeric", inspect_numeric, _numeric_sql("l_extendedprice", "lineitem")),
    Query("inspect_numeric_nulls", inspect_numeric_nulls, WITH_CUSTOMER + _numeric_sql("acctbal", "d")),
    Query("histogram", histogram, _HISTOGRAM_SQL),
    Query("inspect_categorical", inspect_categorical, _counts_sql("p_type", "part")),
    Query("inspect_days", inspect_days, _counts_sql("l_shipdate", "lineitem")),
    Query(
        "inspect_distinct",
        inspect_distinct,
        f"""{WITH_CUSTOMER} SELECT count(*) AS total_rows, count(*) - count(segment) AS null_count,
  count(DISTINCT segment) + CAST(count(*) > count(segment) AS BIGINT) AS distinct_count FROM d""",
    ),
    Query(
        "null_share",
        lambda spark, sf: look.null_report(d_customer(spark, sf)),
        WITH_CUSTOMER
        + " UNION ALL ".join(
            f"""SELECT '{c}' AS "column", count(*) - count({c}) AS null_count, count(*) AS total,
  (count(*) - count({c})) / count(*)::DOUBLE AS null_pct FROM d HAVING count(*) > count({c})"""
            for c in _CUSTOMER
        ),
    ),
    Query(
        "sample_head",
        sample_head,
        """SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders
ORDER BY o_orderkey LIMIT 25""",
    ),
    Query(
        "json_cells",
        json_cells,
        """SELECT event_id, CASE WHEN microsecond(ts) % 1000000 = 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S')
  ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') END AS ts, event_type,
  CASE WHEN event_id % 5 > 0 THEN value END AS value, CAST(CAST(ts AS DATE) AS VARCHAR) AS day,
  CASE WHEN event_id % 3 > 0 THEN base64(encode(event_type)) END AS raw FROM events""",
    ),
    Query("stable_rows", stable_rows, f"SELECT {_STABLE} AS json, sha256({_STABLE}) AS fingerprint FROM customer"),
    Query(
        "preview_duplicates",
        lambda spark, sf: duplicate_examples(_groups(spark, sf)),
        f"{_GROUPS_SQL} ORDER BY count DESC, o_custkey, o_orderstatus LIMIT 8",
    ),
    Query(
        "preview_duplicates_totals",
        lambda spark, sf: duplicate_totals(_groups(spark, sf)),
        f"""SELECT count(*) AS duplicate_groups, CAST(coalesce(sum(count - 1), 0) AS BIGINT) AS total_duplicates
FROM ({_GROUPS_SQL}) g""",
    ),
]
