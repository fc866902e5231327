"""Cleaning operators on small tables, with nulls, ties and odd types."""

import datetime

import pytest
from pyspark.sql import functions as F

from tablewright.errors import OperationError
from tablewright.operators.dates import parse_dates
from tablewright.operators.dedupe import dedupe, preview_duplicates
from tablewright.operators.fill import drop_threshold, fillna
from tablewright.operators.numbers import normalize_numeric
from tablewright.operators.text import normalize_text

NAN = float("nan")


def rows(df, by="id"):
    return [tuple(r) for r in df.orderBy(by).collect()]


# -- dedupe ------------------------------------------------------------------------


@pytest.fixture(scope="module")
def people(spark):
    data = [(1, "k1@shed.example", "larch"), (2, " K1@SHED.example ", "Larch"), (3, None, "m"), (4, None, "m"), (5, "k2@shed.example", None)]
    return spark.createDataFrame(data, "id int, email string, country string")


def test_dedupe_keeps_first_and_last(people):
    assert [r[0] for r in rows(dedupe(people, ["email"], order_by=["id"]).frame)] == [1, 2, 3, 5]
    assert [r[0] for r in rows(dedupe(people, ["email"], keep="last", order_by=["id"]).frame)] == [1, 2, 4, 5]


def test_dedupe_normalized_keeps_spelling(people):
    result = dedupe(people, ["email"], keep="last", normalize_text=True, order_by=["id"])
    assert rows(result.frame) == [(2, " K1@SHED.example ", "Larch"), (4, None, "m"), (5, "k2@shed.example", None)]
    assert result.summary["rows_before"] == 5 and result.summary["removed"] == 2
    assert result.charts == [
        {"kind": "before_after", "label": "rows", "before": 5, "after": 3, "delta_label": "-2", "tone": "positive"}
    ]


def test_dedupe_many_columns_and_nan(spark):
    df = spark.createDataFrame([(1, 1.0, None), (2, 1.0, None), (3, NAN, "x"), (4, NAN, "x")], "id int, a double, b string")
    assert [r[0] for r in rows(dedupe(df, ["a", "b"], order_by=["id"]).frame)] == [1, 3]


def test_dedupe_without_order_uses_reading_order(spark):
    df = spark.range(0, 100, 1, 1).select("id", (F.col("id") % 3).alias("k"))
    assert [r[0] for r in rows(dedupe(df, ["k"]).frame)] == [0, 1, 2]
    assert [r[0] for r in rows(dedupe(df, ["k"], keep="last").frame)] == [97, 98, 99]


def test_dedupe_is_idempotent_and_partition_invariant(people):
    once = dedupe(people.repartition(8), ["country"], order_by=["id"]).frame
    assert rows(once) == rows(dedupe(once, ["country"], order_by=["id"]).frame)
    assert rows(once) == rows(dedupe(people.coalesce(1), ["country"], order_by=["id"]).frame)


def test_dedupe_hot_key_leaves_one_row_per_task_before_the_shuffle(spark):
    df = spark.range(10_000).select("id", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"))
    result = dedupe(df, ["k"], order_by=["id"])
    plan = result.frame._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan
    assert result.frame.count() == 1 + 6666


@pytest.mark.parametrize("args", [{"columns": []}, {"columns": ["zz"]}, {"columns": "id"}, {"columns": ["id"], "keep": "any"}])
def test_dedupe_arguments(people, args):
    with pytest.raises(OperationError):
        dedupe(people, **args)


def test_preview_agrees_with_dedupe(spark):
    data = [(i, k) for i, k in enumerate(["a"] * 5 + ["b"] * 2 + ["c"] + [None] * 3 + list("defghijk") * 2)]
    df = spark.createDataFrame(data, "id int, k string")
    s = preview_duplicates(df, ["k"]).summary
    assert s["duplicate_groups"] == 11 and s["total_rows"] == 27
    assert s["total_duplicates"] == dedupe(df, ["k"]).summary["removed"]
    assert len(s["example_groups"]) == 8
    assert s["example_groups"][0] == {"key": {"k": "a"}, "count": 5}
    assert s["example_groups"][1] == {"key": {"k": None}, "count": 3}


def test_preview_normalized_only_on_request(people):
    assert preview_duplicates(people, ["email"]).summary["total_duplicates"] == 1
    assert preview_duplicates(people, ["email"], normalize_text=True).summary["total_duplicates"] == 2
    assert preview_duplicates(people, ["id"]).charts == []


# -- fillna ------------------------------------------------------------------------


@pytest.fixture(scope="module")
def gaps(spark):
    data = [(1, 10, 1.0, "x", True), (2, 20, NAN, "y", None), (3, None, None, None, False), (4, 30, 3.0, "y", False), (5, 41, 5.0, "x", None)]
    return spark.createDataFrame(data, "id int, n bigint, d double, s string, b boolean").withColumn(
        "void", F.lit(None).cast("double")
    )


def test_fill_auto(gaps):
    result = fillna(gaps)
    third = rows(result.frame)[2]
    assert third[:2] == (3, 25.0) and third[2] == 4.0 and third[3] == "x" and third[5] is None
    assert result.frame.schema["n"].dataType.simpleString() == "double"
    assert [r[4] for r in rows(result.frame)] == [True, False, False, False, False]
    nan = rows(result.frame)[1][2]
    assert nan != nan
    assert {f["column"]: (f["strategy"], f["value"], f["filled_count"]) for f in result.summary["filled"]} == {
        "n": ("median", "25.0", 1),
        "d": ("median", "4.0", 1),
        "s": ("mode", "x", 1),
        "b": ("mode", "false", 2),
    }
    assert result.summary["total_filled"] == 5 and result.charts[0]["total_filled"] == 5


def test_fill_mean_falls_back_to_mode(gaps):
    third = rows(fillna(gaps, ["n", "s"], "mean").frame)[2]
    assert third[1] == 25.25 and third[3] == "x"


def test_fill_mode_keeps_the_type(gaps):
    frame = fillna(gaps, ["n"], "mode").frame
    assert frame.schema["n"].dataType.simpleString() == "bigint" and rows(frame)[2][1] == 10


def test_fill_constant(gaps):
    assert [r[5] for r in rows(fillna(gaps, ["void"], "constant", constant=0.5).frame)] == [0.5] * 5
    assert rows(fillna(gaps, ["s"], "constant", constant=7).frame)[2][3] == "7"
    assert fillna(gaps, ["s"], "constant").summary["filled"] == []
    with pytest.raises(OperationError):
        fillna(gaps, ["n"], "constant", constant="x")


def test_fill_dates_with_mode(spark):
    day = datetime.date(2024, 3, 10)
    at = datetime.datetime(2024, 3, 10, 2, 30)
    df = spark.createDataFrame([(1, day, at), (2, day, at), (3, None, None)], "id int, d date, t timestamp_ntz")
    assert rows(fillna(df).frame)[2] == (3, day, at)


def test_drop_rows(spark):
    data = [(1, None, None, None, 1, 1), (2, None, None, 1, 1, 1), (3, None, 1, 1, 1, 1), (4, 1, 1, 1, None, None)]
    df = spark.createDataFrame(data, "id int, a int, b int, c int, d int, e int")
    assert drop_threshold(0.5, 5) == 2 and drop_threshold(0.1, 2) == 1
    result = fillna(df, strategy="drop_row")
    assert [r[0] for r in rows(result.frame)] == [3]
    assert result.summary["removed"] == 3 and result.charts[0]["tone"] == "warning"


def test_fill_nothing_to_do_and_arguments(spark, gaps):
    full = spark.createDataFrame([(1,)], "id int")
    assert fillna(full).summary["filled"] == []
    for args in ({"columns": []}, {"columns": ["zz"]}, {"strategy": "magic"}):
        with pytest.raises(OperationError):
            fillna(gaps, **args)


# -- text --------------------------------------------------------------------------


def test_normalize_text_report(spark):
    df = spark.createDataFrame([(1, "España", 5), (2, "españa ", 5), (3, None, 5), (4, "ESPAÑA", 6)], "id int, c string, n int")
    result = normalize_text(df, ["n", "c"])
    assert [r[1] for r in rows(result.frame)] == ["España", "España", None, "España"]
    assert result.summary["applied"] == [
        {
            "column": "c",
            "case": "title",
            "strip": True,
            "collapse_spaces": True,
            "remove_accents": False,
            "distinct_before": 4,
            "distinct_after": 2,
            "collapsed_variants": 2,
        }
    ]
    assert result.frame.columns == df.columns
    with pytest.raises(OperationError):
        normalize_text(df, ["c"], case="camel")


def test_columns_with_dots_and_quotes(spark):
    df = spark.createDataFrame([(1, " a", None), (2, "A ", "2")], "id int, `x.y` string, `q``z` string")
    df = normalize_text(df, ["x.y"]).frame
    df = normalize_numeric(df, ["q`z"]).frame
    df = fillna(df, ["q`z"]).frame
    df = dedupe(df, ["x.y"], order_by=["id"]).frame
    assert rows(df) == [(1, "A", 2.0)]


# -- dates -------------------------------------------------------------------------


def test_parse_dates(spark):
    data = [(1, "2024-01-05", "x", "05/03/2024"), (2, "13/02/2024", "y", "06/03/2024"), (3, "2024-02-30", None, None), (4, "2023-7-9", "z", "07/03/2024")]
    df = spark.createDataFrame(data, "id int, mixed string, no string, both string")
    result = parse_dates(df, ["mixed", "no", "both", "id"])
    by = {r["column"]: r for r in result.summary["results"]}
    assert by["mixed"] == {"column": "mixed", "matched_format": "%Y-%m-%d", "parsed_count": 2, "failed_count": 2, "skipped": False}
    assert by["no"]["matched_format"] is None and by["no"]["failed_count"] == 3
    assert by["both"]["matched_format"] == "%d/%m/%Y"
    assert by["id"] == {"column": "id", "matched_format": "int", "parsed_count": 4, "failed_count": 0, "skipped": True}
    types = dict(result.frame.dtypes)
    assert types["mixed"] == "timestamp_ntz" and types["no"] == "string"
    assert rows(result.frame)[0][3] == datetime.datetime(2024, 3, 5)
    assert [r[1] is None for r in rows(result.frame)] == [False, True, True, False]


def test_parse_dates_named_formats(spark):
    df = spark.createDataFrame([(1, "05/03/2024")], "id int, c string")
    assert rows(parse_dates(df, ["c"], ["%Q", "%m/%d/%Y"]).frame)[0][1] == datetime.datetime(2024, 5, 3)


# -- numbers -----------------------------------------------------------------------


def test_normalize_numeric(spark):
    data = [(1, "$ 1,200", "1.234.567,89", None, "45%"), (2, "$ 1,300", "9.999,5", None, "x"), (3, None, None, None, "5")]
    df = spark.createDataFrame(data, "id int, us string, eu string, void string, pct string")
    result = normalize_numeric(df, ["us", "eu", "void", "pct", "id"])
    assert rows(result.frame) == [(1, 1.2, 1234567.89, None, 45.0), (2, 1.3, 9999.5, None, None), (3, None, None, None, 5.0)]
    by = {r["column"]: r for r in result.summary["results"]}
    assert by["us"]["decimal"] == "," and by["eu"]["decimal"] == ","
    assert by["void"]["reason"] == "no values" and by["id"]["reason"] == "already numeric"
    assert (by["pct"]["converted_count"], by["pct"]["failed_count"]) == (2, 1)
    assert rows(normalize_numeric(df, ["us"], decimal=".").frame)[0][1] == 1200.0
    assert dict(result.frame.dtypes)["void"] == "string"
    with pytest.raises(OperationError):
        normalize_numeric(df, ["us"], decimal=";")


def test_a_constant_for_no_column_raises_before_any_job(spark):
    df = spark.range(3).select(F.expr("CAST(raise_error('read') AS INT) AS n"))
    with pytest.raises(OperationError, match="fits no column"):
        fillna(df, strategy="constant", constant="many")
