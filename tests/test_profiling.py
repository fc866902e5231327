"""Profiles, medians, histograms and inspections."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from tablewright.errors import OperationError
from tablewright.operators.frequency import frequencies, modes
from tablewright.operators import inspect as look
from tablewright.operators import quantile
from tablewright.operators.profile import approximate_profile, profile, quality_brief
from tablewright.plans.profile_runs import latest_runs, read_back, row_counts, run_profile

NAN = float("nan")


def lines(profiled):
    return {r["name"]: r for r in profiled.collect()}


@pytest.fixture(scope="module")
def mixed(spark):
    data = [(1, 1.0, "a", True, [1]), (2, NAN, "b", None, [1]), (2, None, "a", False, None), (None, -3.5, None, True, [2])]
    return spark.createDataFrame(data, "n int, d double, s string, b boolean, l array<int>")


def test_profile(mixed):
    got = lines(profile(mixed))
    assert {c: (r["row_count"], r["null_count"], r["null_pct"], r["distinct_count"], r["min"], r["max"]) for c, r in got.items()} == {
        "n": (4, 1, 0.25, 3, "1", "2"),
        "d": (4, 1, 0.25, 4, "-3.5", "1.0"),
        "s": (4, 1, 0.25, 3, "a", "b"),
        "b": (4, 1, 0.25, 3, "false", "true"),
        "l": (4, 1, 0.25, 3, "[1]", "[2]"),
    }
    assert [(v["value"], v["count"]) for v in got["s"]["top_values"]] == [("a", 2), ("", 1), ("b", 1)]
    assert got["n"]["top_values"][0]["value"] == "2"


def test_profile_of_nothing_lists_columns(mixed):
    got = lines(profile(mixed.limit(0)))
    assert list(got) == mixed.columns
    assert got["n"]["row_count"] == 0 and got["n"]["null_pct"] == 0.0 and got["n"]["top_values"] == []


def test_profile_shuffles_cells_once(spark, mixed):
    df = profile(mixed)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "ReusedExchange" in plan or plan.count("Expand") == 1


def test_approximate_profile_agrees_where_exact(mixed):
    exact, rough = lines(profile(mixed)), lines(approximate_profile(mixed))
    for c in mixed.columns:
        for k in ("row_count", "null_count", "null_pct", "distinct_count", "min", "max"):
            assert exact[c][k] == rough[c][k], (c, k)


def test_brief(spark):
    df = spark.createDataFrame([(1, None, "a"), (2, None, None), (3, 1.0, "b"), (4, 1.0, "c"), (5, 1.0, "d")], "i int, d double, s string")
    row = quality_brief(profile(df)).first()
    assert (row["row_count"], row["columns_with_many_nulls"], row["first_names"]) == (5, 2, "d, s")
    assert row["schema"] == "i (int)\nd (double)\ns (string)"


@pytest.mark.parametrize("n", [1, 2, 7, 1000, 1001])
def test_median_is_exact(spark, n):
    random.seed(n)
    values = [random.choice([5.0, random.uniform(-1e3, 1e3)]) for _ in range(n)]
    df = spark.createDataFrame([(v, int(v), None) for v in values], "d double, i int, v double").repartition(4)
    got = quantile.medians(df, ["d", "i", "v"])
    assert got["d"] == pytest.approx(statistics.median(values), abs=1e-12)
    assert got["i"] == statistics.median(int(v) for v in values) and got["v"] is None


@pytest.mark.parametrize("zeros, between, ones", [(9_990, 200, 9_990), (10_000, 200, 9_800), (9_800, 201, 10_001), (9_999, 2, 9_999), (10_000, 0, 10_000), (9_000, 200, 12_000)])
def test_median_between_two_hot_values(spark, monkeypatch, zeros, between, ones):
    """What lies between two hot values is narrowed as well before it is ranked in one task."""
    monkeypatch.setattr(quantile, "MAX_VALUES", 50)
    ranked = []

    def counted(df, columns, nulls):
        found = frequencies(df, columns, nulls=nulls)
        ranked.append(found.table.count())
        return found

    monkeypatch.setattr(quantile, "frequencies", counted)
    values = [0.0] * zeros + [(i + 1) / (between + 1) for i in range(between)] + [1.0] * ones
    df = spark.createDataFrame([(v,) for v in values], "v double").repartition(4)
    assert quantile.medians(df, ["v"])["v"] == pytest.approx(statistics.median(values), abs=1e-12)
    assert max(ranked) <= 50 + 4


def test_median_narrows_until_few_values_are_left(spark, monkeypatch):
    monkeypatch.setattr(quantile, "MAX_VALUES", 50)
    df = spark.range(200_000).select(
        (F.hash("id") / 7.0).alias("d"),
        F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id")).alias("hot"),
        (F.col("id") % 2).alias("two"),
    )
    row = df.agg(*[F.median(c) for c in df.columns]).first()
    assert quantile.medians(df, df.columns) == dict(zip(df.columns, row))


def test_median_survives_a_sketch_that_misses(spark, monkeypatch):
    """A bracket far off is noticed by the exact counts and put right."""
    monkeypatch.setattr(quantile, "_near", lambda cell, share, margin: F.array(F.min(cell), F.min(cell) + margin * F.max(cell)))
    monkeypatch.setattr(quantile, "MAX_VALUES", 100)
    df = spark.range(1, 10_002).select("id")
    assert quantile.medians(df, ["id"]) == {"id": 5001.0}


def test_median_with_nan(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (NAN,), (4.0,), (None,)], "x double")
    assert quantile.medians(df, ["x"]) == {"x": 3.0}
    lost = spark.createDataFrame([(1.0,), (NAN,), (NAN,)], "x double")
    value = quantile.medians(lost, ["x"])["x"]
    assert value != value


def test_histogram_edges(spark):
    df = spark.createDataFrame([(float(v),) for v in (0, 1, 1, 2, 20, -0.0)] + [(NAN,), (float("inf"),), (None,)], "x double")
    bars = {r["bin"]: r["count"] for r in look.histogram(df, "x").collect()}
    assert len(bars) == 20 and bars[1] == 4 and bars[2] == 1 and bars[20] == 1 and sum(bars.values()) == 6
    labels = [r["label"] for r in look.histogram(df, "x").orderBy("bin").collect()]
    assert labels[0] == "≤ 1.00" and labels[-1] == "≤ 20.00"


def test_histogram_of_constant_and_nothing(spark):
    same = spark.createDataFrame([(2.0,), (2.0,)], "x double")
    assert [(r["bin"], r["count"]) for r in look.histogram(same, "x").collect()] == [(1, 2)]
    assert look.histogram(same.limit(0), "x").count() == 0


def test_inspect_numeric(spark):
    df = spark.createDataFrame([(-1,), (4,), (None,), (10,)], "x int")
    result = look.inspect_column(df, "x")
    s = result.summary
    assert s["stats"] == {"min": -1.0, "max": 10.0, "mean": pytest.approx(13 / 3), "median": 4.0}
    assert s["null_pct"] == 0.25 and result.frame is None
    assert [c["kind"] for c in result.charts] == ["histogram", "null_pct"]


def test_inspect_all_null_number(spark):
    df = spark.createDataFrame([(None,), (None,)], "x double")
    result = look.inspect_column(df, "x")
    assert "stats" not in result.summary and [c["kind"] for c in result.charts] == ["null_pct"]


def test_inspect_categorical_counts_null_only_as_distinct(spark):
    df = spark.createDataFrame([("a",), ("a",), (None,), (None,), (None,), ("b",)], "x string")
    s = look.inspect_column(df, "x").summary
    assert s["top_values"] == [{"value": "a", "count": 2}, {"value": "b", "count": 1}]
    assert s["distinct_count"] == 3 and s["null_count"] == 3
    with pytest.raises(OperationError):
        look.inspect_column(df, "nope")


def test_null_report_of_empty_table(spark):
    assert look.null_report(spark.createDataFrame([], "x int")).count() == 0


def test_json_cells_and_stable_json(spark):
    df = spark.sql(
        "SELECT timestamp_ntz'2024-01-02 03:04:05' AS t, timestamp_ntz'2024-01-02 03:04:05.5' AS u, double('NaN') AS d, "
        "X'01' AS b, date'2024-01-02' AS day"
    )
    assert tuple(look.json_cells(df).first()) == (
        "2024-01-02T03:04:05",
        "2024-01-02T03:04:05.500000",
        None,
        "AQ==",
        "2024-01-02",
    )
    one = look.stable_json(spark.createDataFrame([(1, None)], "b int, a string")).first()
    two = look.stable_json(spark.createDataFrame([(None, 1)], "a string, b int")).first()
    assert one["json"] == '{"a":null,"b":1}' and one == two


def test_profile_runs(spark, tmp_path, mixed):
    root = str(tmp_path)
    done = run_profile(spark, root, "d1", lambda: mixed)

    def fail():
        raise ValueError("x" * 2000)

    run_profile(spark, root, "d2", fail)
    runs = spark.read.parquet(f"{root}/profile_runs")
    assert runs.count() == 4
    latest = {r["dataset_id"]: r for r in latest_runs(runs).collect()}
    assert latest["d1"]["status"] == "completed" and latest["d1"]["run_id"] == done
    assert latest["d2"]["status"] == "failed" and len(latest["d2"]["error"]) == 2000
    assert [tuple(r) for r in row_counts(runs).collect()] == [("d1", 4)]
    kept = spark.read.parquet(f"{root}/profile_columns").filter(F.col("run_id") == done)
    assert kept.count() == len(mixed.columns)


def test_read_back_defaults(spark):
    df = spark.createDataFrame([(1, '{"row_count": 3, "columns": [{"name": "a", "top_values": [{"value": "x", "count": 2}]}, {}]}')], "id int, result string")
    a, empty = read_back(df).collect()
    assert a["name"] == "a" and a["null_count"] == 0 and a["top_values"][0]["count"] == 2
    assert empty["name"] == "" and empty["distinct_count"] is None and empty["top_values"] == []


def test_long_text_is_counted_by_digest(spark):
    """Same counts, ranges, ties and top values as for the texts themselves, also where many begin alike."""
    same = "x" * 70
    texts = [same + c for c in "dcba"] * 2 + [same] * 2 + [same[:32], "é" * 60, "é" * 61, "", None, None, None]
    texts += [f"{same} {i:04}" for i in range(40)]
    df = spark.createDataFrame([(t, i % 3) for i, t in enumerate(texts)], "t string, n int").repartition(3)
    counted = frequencies(df, ["t", "n"])
    text = counted.table._jdf.queryExecution().executedPlan().toString()
    assert "digest" in text and counted.table.agg(F.max(F.char_length("v0"))).first()[0] <= 64
    got = lines(profile(df, top=7))["t"]
    real = [t for t in texts if t is not None]
    assert (got["row_count"], got["null_count"], got["distinct_count"]) == (len(texts), 3, len(set(texts)))
    assert (got["min"], got["max"]) == (min(real), max(real))
    wanted = sorted(((t or "", texts.count(t)) for t in set(texts)), key=lambda x: (-x[1], x[0]))
    assert [(v["value"], v["count"]) for v in got["top_values"]] == wanted[:7]
    assert modes(df, ["t"]) == {"t": same}


def test_profile_shuffles_no_long_text(spark, sf):
    df = profile(spark.read.parquet(f"{sf}/documents.parquet"), ["text", "lang"])
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(text" not in plan and "sha2" in plan
