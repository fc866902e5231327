"""Cleaning operators on whole tables."""

from pyspark.sql import functions as F

from suite.base import (
    WITH_CUSTOMER,
    WITH_ORDERS,
    WITH_PART,
    WS,
    WS_CHARS,
    Query,
    d_customer,
    d_orders,
    d_part,
    sql_clean,
    sql_number,
    sql_title,
    table,
)
from tablewright.operators.dates import parse_dates
from tablewright.operators.dedupe import dedupe
from tablewright.operators.fill import fillna
from tablewright.operators.numbers import normalize_numeric
from tablewright.operators.text import normalize_text

# -- duplicates ------------------------------------------------------------------

_LINE = "l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_returnflag, l_linestatus"

_LINE_ORDER = ["l_linenumber", "l_partkey", "l_extendedprice", "l_quantity", "l_shipdate"]


def _lines(keep):
    def run(spark, sf):
        lines = table(spark, sf, "lineitem").select(
            *_LINE.split(", "), F.date_format("l_shipdate", "yyyy-MM-dd").alias("l_shipdate")
        )
        return dedupe(lines, ["l_orderkey", "l_suppkey"], keep=keep, order_by=_LINE_ORDER).frame

    return run


def _lines_sql(direction):
    return f"""
SELECT {_LINE}, l_shipdate FROM (
  SELECT {_LINE}, strftime(l_shipdate, '%Y-%m-%d') AS l_shipdate, row_number() OVER (
    PARTITION BY l_orderkey, l_suppkey ORDER BY {", ".join(f"{c} {direction}" for c in _LINE_ORDER)}) AS rn
  FROM lineitem) t WHERE rn = 1"""


def dedupe_normalized(spark, sf):
    documents = table(spark, sf, "documents").select("doc_id", "text", "lang")
    return dedupe(documents, ["text"], keep="first", normalize_text=True, order_by=["doc_id"]).frame


_KEY = f"lower(trim(text, '{WS_CHARS}'))"
_DEDUPE_NORMALIZED = f"""
SELECT doc_id, text, lang FROM (
  SELECT doc_id, text, lang, row_number() OVER (PARTITION BY {_KEY} ORDER BY doc_id) AS rn FROM documents) t
WHERE rn = 1"""


def dedupe_null_keys(spark, sf):
    frame = dedupe(d_customer(spark, sf), ["segment"], order_by=["c_custkey"]).frame
    return frame.select("c_custkey", "segment", "full_name")


def dedupe_summary(spark, sf):
    return dedupe(table(spark, sf, "documents"), ["text"], normalize_text=True, order_by=["doc_id"]).report


# -- missing values ----------------------------------------------------------------

_FILLED = ["c_custkey", "acctbal", "nation_id", "segment", "full_name", "all_null"]


def _fill(round_=("acctbal", "nation_id"), **args):
    def run(spark, sf):
        frame = fillna(d_customer(spark, sf), **args).frame
        return frame.select(*[F.round(c, 4).alias(c) if c in round_ else c for c in _FILLED])

    return run


def _mode(c):
    return f"(SELECT {c} FROM d WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1)"


def _fill_sql(acctbal="acctbal", nation="nation_id", segment="segment", all_null="all_null", where=""):
    return f"""{WITH_CUSTOMER}
SELECT c_custkey, {acctbal} AS acctbal, {nation} AS nation_id, {segment} AS segment, full_name, {all_null} AS all_null
FROM d {where}"""


def _by(aggregate, c):
    return f"round(coalesce({c}, (SELECT {aggregate}({c}) FROM d)), 4)"


def fillna_report(spark, sf):
    report = fillna(d_customer(spark, sf)).report
    return report.select("column", "strategy", "filled_count", F.round(F.expr("try_cast(value AS double)"), 4).alias("number"))


_NULLS = "CAST(acctbal IS NULL AS INT) + CAST(nation_id IS NULL AS INT) + CAST(segment IS NULL AS INT) + 1"


# -- text --------------------------------------------------------------------------


def _documents(**args):
    def run(spark, sf):
        documents = table(spark, sf, "documents").select("doc_id", "text")
        return normalize_text(documents, ["text"], **args).frame

    return run


def normalize_customers(spark, sf):
    frame = normalize_text(d_customer(spark, sf), ["segment", "full_name", "acctbal"], remove_accents=True).frame
    return frame.select("c_custkey", "segment", "full_name")


def normalize_report(spark, sf):
    return normalize_text(d_customer(spark, sf), ["segment", "full_name"]).report


def _variants(c):
    values = f"count(DISTINCT {{0}}) + max(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END)"
    before, after = values.format(c), values.format(sql_title(sql_clean(c)))
    return f"""SELECT '{c}' AS "column", CAST({before} AS BIGINT) AS distinct_before,
  CAST({after} AS BIGINT) AS distinct_after, CAST(({before}) - ({after}) AS BIGINT) AS collapsed_variants FROM d"""


# -- dates -------------------------------------------------------------------------


def _dates(column, **args):
    def run(spark, sf):
        frame = parse_dates(d_orders(spark, sf), [column], **args).frame
        return frame.select("o_orderkey", F.date_format(column, "yyyy-MM-dd HH:mm:ss").alias("parsed"))

    return run


def parse_dates_report(spark, sf):
    return parse_dates(d_orders(spark, sf), ["iso_date", "dmy_date", "mixed_date", "us_price", "o_orderkey"]).report


def _date_counts(c):
    formats = [
        "%Y-%m-%d",
        "%Y-%m-%dT%H:%M:%S",
        "%Y-%m-%d %H:%M:%S",
        "%d/%m/%Y",
        "%d-%m-%Y",
        "%m/%d/%Y",
        "%d/%m/%Y %H:%M",
        "%d-%m-%Y %H:%M:%S",
    ]
    per_format = " UNION ALL ".join(
        f"SELECT {i} AS pos, '{f}' AS fmt, count(try_strptime({c}, '{f}')) AS n, count({c}) AS total FROM d"
        for i, f in enumerate(formats)
    )
    return f"""(SELECT '{c}' AS "column", CASE WHEN n > 0 THEN fmt END AS matched_format, n AS parsed_count,
  total - n AS failed_count, false AS skipped FROM ({per_format}) f ORDER BY n DESC, pos LIMIT 1)"""


_PARSE_REPORT = (
    WITH_ORDERS
    + " UNION ALL ".join(_date_counts(c) for c in ("iso_date", "dmy_date", "mixed_date", "us_price"))
    + " UNION ALL SELECT 'o_orderkey', 'bigint', count(o_orderkey), 0, true FROM d"
)


# -- numbers -----------------------------------------------------------------------


def _numbers(column, **args):
    def run(spark, sf):
        frame = normalize_numeric(d_orders(spark, sf), [column], **args).frame
        return frame.select("o_orderkey", F.round(column, 2).alias("price"))

    return run


def numeric_parts(spark, sf):
    return normalize_numeric(d_part(spark, sf), ["pct", "amount", "comma_only"]).frame.select(
        "p_partkey", "pct", "amount", F.round("comma_only", 4).alias("comma_only")
    )


def numeric_report(spark, sf):
    return normalize_numeric(d_part(spark, sf), ["pct", "amount", "comma_only", "p_partkey"]).report


def _number_counts(c):
    commas = f"coalesce(sum(length({c}) - length(replace({c}, ',', ''))), 0)"
    dots = f"coalesce(sum(length({c}) - length(replace({c}, '.', ''))), 0)"
    return f"""SELECT '{c}' AS "column", mark AS "decimal", CASE WHEN mark = '.' THEN us ELSE eu END AS converted_count,
  total - CASE WHEN mark = '.' THEN us ELSE eu END AS failed_count, false AS skipped, CAST(NULL AS VARCHAR) AS reason
FROM (SELECT CASE WHEN {commas} = 0 THEN '.' WHEN {dots} = 0 THEN ',' WHEN {dots} <= {commas} THEN '.' ELSE ',' END AS mark,
        count({sql_number(c, '.')}) AS us, count({sql_number(c, ',')}) AS eu, count({c}) AS total FROM d) t"""


_NUMERIC_REPORT = (
    WITH_PART
    + " UNION ALL ".join(_number_counts(c) for c in ("pct", "amount", "comma_only"))
    + " UNION ALL SELECT 'p_partkey', NULL, 0, 0, true, 'already numeric'"
)

QUERIES = [
    Query("dedupe_first", _lines("first"), _lines_sql("ASC")),
    Query("dedupe_last", _lines("last"), _lines_sql("DESC")),
    Query("dedupe_normalized", dedupe_normalized, _DEDUPE_NORMALIZED),
    Query(
        "dedupe_null_keys",
        dedupe_null_keys,
        f"""{WITH_CUSTOMER} SELECT c_custkey, segment, full_name FROM (
  SELECT *, row_number() OVER (PARTITION BY segment ORDER BY c_custkey) AS rn FROM d) t WHERE rn = 1""",
    ),
    Query(
        "dedupe_summary",
        dedupe_summary,
        f"""SELECT count(*) AS rows_before, count(DISTINCT {_KEY}) AS rows_after,
  count(*) - count(DISTINCT {_KEY}) AS removed FROM documents""",
    ),
    Query(
        "fillna_auto",
        _fill(),
        _fill_sql(_by("median", "acctbal"), _by("median", "nation_id"), f"coalesce(segment, {_mode('segment')})"),
    ),
    Query(
        "fillna_median",
        _fill(columns=["acctbal", "nation_id"], strategy="median"),
        _fill_sql(_by("median", "acctbal"), _by("median", "nation_id")),
    ),
    Query(
        "fillna_mean",
        _fill(columns=["acctbal", "segment"], strategy="mean", round_=("acctbal",)),
        _fill_sql(_by("avg", "acctbal"), segment=f"coalesce(segment, {_mode('segment')})"),
    ),
    Query(
        "fillna_mode",
        _fill(columns=["nation_id", "segment", "all_null"], strategy="mode", round_=()),
        _fill_sql(nation=f"coalesce(nation_id, {_mode('nation_id')})", segment=f"coalesce(segment, {_mode('segment')})"),
    ),
    Query(
        "fillna_constant",
        _fill(columns=["acctbal", "all_null"], strategy="constant", constant=-1.5, round_=()),
        _fill_sql("coalesce(acctbal, -1.5::DOUBLE)", all_null="coalesce(all_null, -1.5::DOUBLE)"),
    ),
    Query("fillna_drop_row", _fill(strategy="drop_row", round_=()), _fill_sql(where=f"WHERE {_NULLS} < 2")),
    Query(
        "fillna_report",
        fillna_report,
        f"""{WITH_CUSTOMER}
SELECT 'acctbal' AS "column", 'median' AS strategy, count(*) - count(acctbal) AS filled_count,
  round(median(acctbal), 4) AS number FROM d
UNION ALL SELECT 'nation_id', 'median', count(*) - count(nation_id), round(median(nation_id), 4) FROM d
UNION ALL SELECT 'segment', 'mode', count(*) - count(segment), CAST(NULL AS DOUBLE) FROM d""",
    ),
    Query("normalize_lower", _documents(case="lower"), f"SELECT doc_id, lower({sql_clean('text')}) AS text FROM documents"),
    # DuckDB keeps a capital sharp s where Spark writes SS.
    Query(
        "normalize_upper",
        _documents(case="upper"),
        f"SELECT doc_id, upper(replace({sql_clean('text')}, 'ß', 'ss')) AS text FROM documents",
    ),
    Query("normalize_title", _documents(), f"SELECT doc_id, {sql_title(sql_clean('text'))} AS text FROM documents"),
    Query("normalize_preserve", _documents(case="preserve"), f"SELECT doc_id, {sql_clean('text')} AS text FROM documents"),
    Query(
        "strip_ws",
        _documents(case="preserve", collapse_spaces=False),
        f"SELECT doc_id, trim(text, '{WS_CHARS}') AS text FROM documents",
    ),
    Query(
        "collapse_ws",
        _documents(case="preserve", strip=False),
        f"SELECT doc_id, regexp_replace(text, '{WS}+', ' ', 'g') AS text FROM documents",
    ),
    Query(
        "remove_accents",
        _documents(case="preserve", strip=False, collapse_spaces=False, remove_accents=True),
        "SELECT doc_id, strip_accents(text) AS text FROM documents",
    ),
    Query(
        "normalize_customers",
        normalize_customers,
        f"""{WITH_CUSTOMER} SELECT c_custkey, strip_accents({sql_title(sql_clean('segment'))}) AS segment,
  strip_accents({sql_title(sql_clean('full_name'))}) AS full_name FROM d""",
    ),
    Query("normalize_report", normalize_report, WITH_CUSTOMER + _variants("segment") + " UNION ALL " + _variants("full_name")),
    Query(
        "parse_dates_iso",
        _dates("iso_date", formats=["%Y-%m-%d"]),
        f"""{WITH_ORDERS} SELECT o_orderkey, strftime(try_strptime(iso_date, '%Y-%m-%d'), '%Y-%m-%d %H:%M:%S') AS parsed
FROM d""",
    ),
    Query(
        "parse_dates_best",
        _dates("mixed_date"),
        f"""{WITH_ORDERS} SELECT o_orderkey, strftime(try_strptime(mixed_date, '%Y-%m-%d'), '%Y-%m-%d %H:%M:%S') AS parsed
FROM d""",
    ),
    Query(
        "parse_dates_day_first",
        _dates("dmy_date"),
        f"""{WITH_ORDERS} SELECT o_orderkey, strftime(try_strptime(dmy_date, '%d/%m/%Y'), '%Y-%m-%d %H:%M:%S') AS parsed
FROM d""",
    ),
    Query("parse_dates_report", parse_dates_report, _PARSE_REPORT),
    Query(
        "numeric_us",
        _numbers("us_price", decimal="."),
        f"{WITH_ORDERS} SELECT o_orderkey, round({sql_number('us_price', '.')}, 2) AS price FROM d",
    ),
    Query(
        "numeric_eu",
        _numbers("eu_price", decimal=","),
        f"{WITH_ORDERS} SELECT o_orderkey, round({sql_number('eu_price', ',')}, 2) AS price FROM d",
    ),
    # As many dots as commas: the tie goes to the dot.
    Query(
        "numeric_auto",
        _numbers("us_price"),
        f"{WITH_ORDERS} SELECT o_orderkey, round({sql_number('us_price', '.')}, 2) AS price FROM d",
    ),
    Query(
        "numeric_parts",
        numeric_parts,
        f"""{WITH_PART} SELECT p_partkey, {sql_number('pct', '.')} AS pct, {sql_number('amount', '.')} AS amount,
  round({sql_number('comma_only', ',')}, 4) AS comma_only FROM d""",
    ),
    Query("numeric_report", numeric_report, _NUMERIC_REPORT),
]
