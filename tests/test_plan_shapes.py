"""Physical plans: what is read, what is shuffled, and that nothing grows where it must not."""

import pytest
from pyspark.sql import functions as F

from __spark_entry__ import queries
from suite.base import table
from tablewright.operators import catalog, events, inspect
from tablewright.operators.dedupe import dedupe, duplicate_groups
from tablewright.operators.frequency import frequencies
from tablewright.operators.text import normalize_text
from tablewright.plans.profile_runs import latest_per_group
from tablewright.session import MB, sized_settings


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def no_broadcast(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_only_needed_columns_are_read(spark, sf):
    text = plan(inspect.value_counts(table(spark, sf, "lineitem"), "l_returnflag"))
    assert "ReadSchema: struct<l_returnflag:string>" in text
    text = plan(duplicate_groups(table(spark, sf, "orders"), ["o_custkey", "o_orderstatus"]))
    assert "ReadSchema: struct<o_custkey:bigint,o_orderstatus:string>" in text and text.count("Exchange ") == 1


def test_counting_starts_before_the_shuffle(spark, sf):
    text = plan(frequencies(table(spark, sf, "lineitem"), ["l_returnflag", "l_tax"]).table)
    assert "partial_count" in text and text.count("Exchange ") == 1 and "cast(l_tax" not in text


def test_ranking_keeps_one_row_per_task_and_key(spark, sf):
    latest = latest_per_group(table(spark, sf, "orders"), ["o_custkey"], [F.desc("o_orderdate")])
    for df in (latest, dedupe(table(spark, sf, "documents"), ["text"], order_by=["doc_id"]).frame):
        text = plan(df)
        assert text.count("WindowGroupLimit") == 2 and text.count("Exchange ") == 1


def test_long_keys_travel_as_digests(spark, sf):
    text = plan(dedupe(table(spark, sf, "documents"), ["text"], normalize_text=True, order_by=["doc_id"]).frame)
    assert "sha2" in text


def test_text_cleaning_does_not_shuffle_or_leave_the_jvm(spark, sf):
    text = plan(normalize_text(table(spark, sf, "documents"), ["text"]).frame)
    assert "Exchange" not in text and "Python" not in text


def test_head_takes_ordered(spark, sf):
    assert "TakeOrderedAndProject" in plan(inspect.head(table(spark, sf, "orders"), ["o_orderkey"], 25))


def test_filters_reach_the_scan(spark, sf):
    orders = table(spark, sf, "orders").withColumnRenamed("o_custkey", "source_id").withColumnRenamed("o_orderkey", "id")
    sources = table(spark, sf, "customer").withColumnRenamed("c_custkey", "id")
    assert "EqualTo(o_orderkey,42)" in plan(catalog.dataset_detail(orders, sources, 42))
    active = events.active_rows(
        table(spark, sf, "orders").withColumnRenamed("o_orderdate", "expires_at").withColumn("revoked_at", F.lit(None)),
        F.lit("1998-01-01").cast("timestamp_ntz"),
    )
    assert "GreaterThan(o_orderdate" in plan(active)


def test_large_sides_are_joined_by_key(spark, sf, no_broadcast):
    for query in ("visible_rows", "tiered_access", "inherited_visibility", "catalog_join", "journal_undo", "unique_slugs"):
        text = plan(queries()[query](spark, sf))
        assert "SortMergeJoin" in text and "NestedLoop" not in text and "Cartesian" not in text, query


def test_sized_settings():
    big = sized_settings(100 * 1024**4)
    assert int(big["spark.sql.shuffle.partitions"]) == 409_600
    assert sized_settings(MB)["spark.sql.shuffle.partitions"] == "200"
