"""Recipes, journals and working copies."""

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from suite.base import (
    WITH_CUSTOMER,
    WITH_ORDERS,
    Query,
    d_customer,
    d_orders,
    sql_clean,
    sql_number,
    sql_title,
    table,
)
from tablewright.operators.result import OpResult
from tablewright.plans import journal
from tablewright.plans.recipe import column_signals, replay, run_recipe, suggest_recipe
from tablewright.plans.registry import register_op
from tablewright.scratch import shared_dir
from tablewright.plans.workcopy import WorkingCopy
from tablewright.sources.registry import read_dataset

_CUSTOMER_STEPS = [
    {"op": "inspect_column", "args": {"column": "acctbal"}},
    {"op": "normalize_text", "args": {"columns": ["segment", "full_name"]}},
    {"op": "dedupe", "args": {"columns": ["segment", "full_name"], "order_by": ["c_custkey"]}},
    {"op": "no_such_step", "args": {}},
    {"op": "fillna", "args": {"strategy": "auto"}},
]


def _cleaned(frame):
    return frame.select("c_custkey", F.round("acctbal", 4).alias("acctbal"), "nation_id", "segment", "full_name")


def clean_recipe(spark, sf):
    return _cleaned(run_recipe(d_customer(spark, sf), _CUSTOMER_STEPS).frame)


_CLEAN_WITH = f"""{WITH_CUSTOMER},
t AS (SELECT c_custkey, acctbal, nation_id, {sql_title(sql_clean('segment'))} AS segment,
        {sql_title(sql_clean('full_name'))} AS full_name FROM d),
u AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY segment, full_name ORDER BY c_custkey) = 1) """

_CLEAN_SQL = f"""{_CLEAN_WITH}
SELECT c_custkey, round(coalesce(acctbal, (SELECT median(acctbal) FROM u)), 4) AS acctbal,
  coalesce(CAST(nation_id AS DOUBLE), (SELECT median(nation_id) FROM u)) AS nation_id,
  coalesce(segment, (SELECT segment FROM u WHERE segment IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) AS segment,
  full_name FROM u"""


def recipe_log(spark, sf):
    """What became of each step, and the rows there were after it."""
    frame = d_customer(spark, sf)
    done = run_recipe(frame, _CUSTOMER_STEPS)
    counts = []
    for step, result in enumerate(done.results, 1):
        if result is not None and result.frame is not None:
            frame = result.frame
        counts.append(frame.agg(F.count(F.lit(1)).alias("rows")).withColumn("step", F.lit(step)))
    log = done.log_table().select("step", "op", F.col("error").isNull().alias("done"))
    return log.join(reduce(DataFrame.unionByName, counts), "step")


_LOG_SQL = _CLEAN_WITH + " UNION ALL ".join(
    f"""SELECT {i} AS step, '{step["op"]}' AS op, {step["op"] != "no_such_step"} AS done, count(*) AS rows FROM {"d" if i < 3 else "u"}"""
    for i, step in enumerate(_CUSTOMER_STEPS, 1)
)


def planned_recipe(spark, sf):
    """The steps the data calls for, and then the cleaned table."""
    orders = d_orders(spark, sf).select("o_orderkey", "mixed_date", "us_price")
    frame = run_recipe(orders, suggest_recipe(orders)).frame
    return frame.select(
        "o_orderkey", F.date_format("mixed_date", "yyyy-MM-dd").alias("mixed_date"), F.round("us_price", 2).alias("us_price")
    )


_PLANNED_SQL = f"""{WITH_ORDERS}, p AS (
  SELECT o_orderkey, try_strptime(mixed_date, '%Y-%m-%d') AS day, {sql_number('us_price', '.')} AS price FROM d)
SELECT o_orderkey, strftime(coalesce(day,
    (SELECT day FROM p WHERE day IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)), '%Y-%m-%d') AS mixed_date,
  round(price, 2) AS us_price FROM p"""


_STATUS = "CASE WHEN o_orderkey % 3 = 0 THEN 'open ' WHEN o_orderkey % 3 = 1 THEN 'Open' ELSE 'closed' END"


def recipe_signals(spark, sf):
    columns = ["iso_date", "mixed_date", "us_price", "eu_price", "status"]
    signals = column_signals(d_orders(spark, sf).withColumn("status", F.expr(_STATUS)), columns)
    rows = [
        (s["column"], s["rows"], s["nulls"], round(s["date_share"], 4), round(s["number_share"], 4), s["collapsed_variants"])
        for s in signals
    ]
    return spark.createDataFrame(
        rows,
        "`column` string, `rows` bigint, nulls bigint, date_share double, number_share double, variants bigint",
    )


def _signal(c, date_format, decimal, text=False):
    date = f"count(try_strptime({c}, '{date_format}'))" if date_format else "0"
    some = f"count({c})::DOUBLE"
    return f"""SELECT '{c}' AS "column", count(*) AS rows, count(*) - count({c}) AS nulls,
  round({date} / {some}, 4) AS date_share, round(count(CASE WHEN NOT regexp_matches({c}, '\\p{{L}}') THEN {sql_number(c, decimal)} END) / {some}, 4) AS number_share,
  {f"count(DISTINCT {c}) - count(DISTINCT {sql_title(sql_clean(c))})" if text else "0"} AS variants FROM d"""


_SIGNALS_SQL = WITH_ORDERS.replace("WITH d AS", "WITH d0 AS") + f", d AS (SELECT *, {_STATUS} AS status FROM d0) " + " UNION ALL ".join(
    [
        _signal("iso_date", "%Y-%m-%d", "."),
        _signal("mixed_date", "%Y-%m-%d", "."),
        _signal("us_price", None, "."),
        _signal("eu_price", None, "."),
        _signal("status", None, ".", text=True),
    ]
)

# -- journals: every order is an operation on its customer's copy, every third one undone -------------


def _events(spark, sf):
    orders = table(spark, sf, "orders")
    key = F.col("o_orderkey")
    applied = orders.select(
        F.col("o_custkey").cast("string").alias("copy_id"),
        key.alias("seq"),
        F.lit("applied").alias("event"),
        key.cast("string").alias("op_id"),
        "o_orderstatus",
        F.concat(F.lit("v"), key.cast("string")).alias("after_path"),
        (key * 2).alias("rows_before"),
        (key * 2 - key % 7).alias("rows_after"),
    ).withColumnRenamed("o_orderstatus", "op")
    undone = applied.filter(F.col("seq") % 3 == 0)
    undone = undone.withColumn("event", F.lit("undone")).withColumn("seq", F.col("seq") + 10_000_000_000)
    return applied.unionAll(undone)


_ACTIVE = "SELECT * FROM orders WHERE o_orderkey % 3 <> 0"


def journal_history(spark, sf):
    return journal.history(_events(spark, sf)).select("copy_id", "seq", "op_id", "op", "undone", "delta")


def journal_active(spark, sf):
    return journal.active(_events(spark, sf)).select("copy_id", "seq", "op_id", "op")


def journal_current(spark, sf):
    copies = table(spark, sf, "customer").select(
        F.col("c_custkey").cast("string").alias("copy_id"), F.lit("v0").alias("v0_path"), F.lit(0).cast("bigint").alias("v0_rows")
    )
    return journal.current_versions(_events(spark, sf), copies)


def journal_undo(spark, sf):
    """Undo, in each copy, the lowest active operation that is a multiple of five."""
    events = _events(spark, sf)
    fives = journal.active(events).filter(F.col("seq") % 5 == 0)
    targets = fives.groupBy("copy_id").agg(F.min_by("op_id", "seq").alias("op_id"))
    return journal.undo(events, targets).select("copy_id", "seq", "op_id")


def journal_replay(spark, sf):
    """Replay the steps of a history in which one was taken back."""
    steps = [
        (1, "normalize_text", '{"columns": ["full_name"], "case": "upper"}', False),
        (2, "dedupe", '{"columns": ["segment"], "order_by": ["c_custkey"]}', True),
        (3, "fillna", '{"columns": ["segment"], "strategy": "mode"}', False),
    ]
    lines = [("c", seq, "applied", str(seq), op, args) for seq, op, args, _ in steps]
    lines += [("c", 10 + seq, "undone", str(seq), op, args) for seq, op, args, undone in steps if undone]
    events = spark.createDataFrame(
        lines, "copy_id string, seq bigint, event string, op_id string, op string, args string"
    )
    frame = replay(journal.active(events), d_customer(spark, sf)).frame
    return frame.select("c_custkey", "segment", "full_name")


def working_copy(spark, sf):
    """Create a copy, clean it in two steps, take the second back, go on, and read the result."""
    copy = WorkingCopy.create(d_customer(spark, sf), f"{shared_dir(spark)}/copies", uuid.uuid4().hex)
    copy.run("normalize_text", {"columns": ["full_name"], "case": "lower"})
    copy.run("dedupe", {"columns": ["segment"], "order_by": ["c_custkey"]})
    copy.undo(copy.active().orderBy(F.desc("seq")).first()["op_id"])
    copy.run("fillna", {"columns": ["segment"], "strategy": "constant", "constant": "none"})
    return copy.frame().select("c_custkey", "segment", "full_name")


def promote_copy(spark, sf):
    """A cleaned copy made a dataset of its own, opened through its catalogue line."""
    root = shared_dir(spark)
    copy = WorkingCopy.create(d_customer(spark, sf).drop("all_null"), f"{root}/copies", uuid.uuid4().hex)
    copy.run("normalize_text", {"columns": ["full_name"], "case": "upper"})
    line = copy.promote(f"{root}/datasets/{uuid.uuid4().hex}", "customers").first()
    return read_dataset(spark, line["kind"], line["locator"]).select("c_custkey", "segment", "full_name")


def _keep_above(df, column, value):
    kept = df.where(F.col(column) > value)
    return OpResult(kept, kept.agg(F.count(F.lit(1)).alias("rows_after")), lambda known: {"op": "keep_above"})


def own_operation(spark, sf):
    """An operation of the user's own between two others."""
    register_op("keep_above", _keep_above)
    steps = [
        {"op": "normalize_text", "args": {"columns": ["segment"], "case": "lower"}},
        {"op": "keep_above", "args": {"column": "acctbal", "value": 0}},
        {"op": "dedupe", "args": {"columns": ["segment", "nation_id"], "order_by": ["c_custkey"]}},
    ]
    return run_recipe(d_customer(spark, sf), steps, on_error="raise").frame.select("c_custkey", "segment", "nation_id")


QUERIES = [
    Query(
        "promote_copy",
        promote_copy,
        f"{WITH_CUSTOMER} SELECT c_custkey, segment, upper({sql_clean('full_name')}) AS full_name FROM d",
    ),
    Query(
        "own_operation",
        own_operation,
        f"""{WITH_CUSTOMER} SELECT c_custkey, lower({sql_clean('segment')}) AS segment, nation_id FROM d WHERE acctbal > 0
QUALIFY row_number() OVER (PARTITION BY lower({sql_clean('segment')}), nation_id ORDER BY c_custkey) = 1""",
    ),
    Query("clean_recipe", clean_recipe, _CLEAN_SQL),
    Query("recipe_log", recipe_log, _LOG_SQL),
    Query("planned_recipe", planned_recipe, _PLANNED_SQL),
    Query("recipe_signals", recipe_signals, _SIGNALS_SQL),
    Query(
        "journal_history",
        journal_history,
        """SELECT CAST(o_custkey AS VARCHAR) AS copy_id, o_orderkey AS seq, CAST(o_orderkey AS VARCHAR) AS op_id,
  o_orderstatus AS op, o_orderkey % 3 = 0 AS undone, -(o_orderkey % 7) AS delta FROM orders""",
    ),
    Query(
        "journal_active",
        journal_active,
        f"""SELECT CAST(o_custkey AS VARCHAR) AS copy_id, o_orderkey AS seq, CAST(o_orderkey AS VARCHAR) AS op_id,
  o_orderstatus AS op FROM ({_ACTIVE}) a""",
    ),
    Query(
        "journal_current",
        journal_current,
        f"""SELECT CAST(c_custkey AS VARCHAR) AS copy_id, coalesce('v' || last, 'v0') AS path,
  coalesce(last * 2 - last % 7, 0) AS rows, coalesce(n, 0) AS active_ops
FROM customer LEFT JOIN (SELECT o_custkey, max(o_orderkey) AS last, count(*) AS n FROM ({_ACTIVE}) a GROUP BY 1) l
  ON o_custkey = c_custkey""",
    ),
    Query(
        "journal_undo",
        journal_undo,
        f"""SELECT CAST(o_custkey AS VARCHAR) AS copy_id, o_orderkey AS seq, CAST(o_orderkey AS VARCHAR) AS op_id
FROM ({_ACTIVE}) a JOIN (SELECT o_custkey AS c, min(o_orderkey) AS since FROM ({_ACTIVE}) b WHERE o_orderkey % 5 = 0 GROUP BY 1) t
  ON o_custkey = c AND o_orderkey >= since""",
    ),
    Query(
        "journal_reset",
        lambda spark, sf: journal.reset(_events(spark, sf)).groupBy("copy_id").agg(F.count(F.lit(1)).alias("taken_back")),
        f"SELECT CAST(o_custkey AS VARCHAR) AS copy_id, count(*) AS taken_back FROM ({_ACTIVE}) a GROUP BY 1",
    ),
    Query(
        "journal_replay",
        journal_replay,
        f"""{WITH_CUSTOMER} SELECT c_custkey, coalesce(segment, (SELECT segment FROM d WHERE segment IS NOT NULL
  GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) AS segment, upper({sql_clean('full_name')}) AS full_name FROM d""",
    ),
    Query(
        "working_copy",
        working_copy,
        f"""{WITH_CUSTOMER} SELECT c_custkey, coalesce(segment, 'none') AS segment,
  lower({sql_clean('full_name')}) AS full_name FROM d""",
    ),
]
