"""Key search, distributions, outliers, correlations, and what the planner makes of them."""

import random
import statistics
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from tablewright.errors import OperationError
from tablewright.operators import keys, quantile
from tablewright.operators.distribution import average_ranks, correlations, distribution, outliers
from tablewright.plans.recipe import column_signals, inspection_order, repeated_key, run_recipe, suggest_recipe

NAN = float("nan")


def plain_keys(rows, columns, max_size, min_share):
    found = []
    for size in range(1, max_size + 1):
        for c in combinations(range(len(columns)), size):
            if any(set(f) <= set(c) for f, _ in found):
                continue
            distinct = len({tuple(r[i] for i in c) for r in rows})
            if all(sum(r[i] is None for r in rows) <= (1 - min_share) * len(rows) for i in c) and distinct >= min_share * len(rows):
                found.append((c, distinct))
    return [([columns[i] for i in c], n) for c, n in found]


def test_keys_are_the_minimal_unique_combinations(spark):
    draw = random.Random(1)
    columns = ["a", "b", "c", "d", "e"]
    for width in (4, 9):
        rows = [tuple(draw.randrange(width) if draw.random() < 0.999 else None for _ in columns[:-1]) + (draw.choice("xyz"),) for _ in range(300)]
        frame = spark.createDataFrame(rows, "a int, b int, c int, d int, e string")
        for share in (1.0, 0.7):
            got = keys.find_keys(frame, max_size=5, min_share=share, all_levels=True)
            assert [(k["columns"], k["distinct_count"]) for k in got] == plain_keys(rows, columns, 5, share)
            assert all(k["rows"] == 300 and k["duplicates"] == 300 - k["distinct_count"] for k in got)


def test_key_search_ends_at_the_first_level_and_leaves_out_what_is_no_key(spark):
    rows = [(i, i // 2, i % 2, 0.5 * i, None if i == 3 else str(i), f" Name{i} ") for i in range(50)] + [(50, 25, 0, 1.0, "50", "name1")]
    frame = spark.createDataFrame(rows, "id int, half int, odd int, x double, `gap.s` string, name string")
    assert keys.key_candidates(frame) == ["id", "half", "odd", "gap.s", "name"]
    assert [k["columns"] for k in keys.find_keys(frame)] == [["id"], ["name"]]
    assert [k["columns"] for k in keys.find_keys(frame, normalize_text=True)] == [["id"]]
    assert [k["columns"] for k in keys.find_keys(frame, columns=["half", "odd"])] == [["half", "odd"]]
    assert [k["columns"] for k in keys.find_keys(frame, columns=["gap.s"], min_share=0.9)] == [["gap.s"]]
    assert keys.find_keys(frame, columns=["gap.s"]) == [] == keys.find_keys(frame.limit(0))
    assert keys.key_report(frame, columns=["half"]).count() == 0
    for wrong in ({"columns": ["no"]}, {"max_size": 0}, {"min_share": 0}):
        with pytest.raises(OperationError):
            keys.find_keys(frame, **wrong)


def test_the_lattice_is_pruned_before_data_is_read(spark, monkeypatch):
    asked = []
    real = F.hll_sketch_agg
    monkeypatch.setattr(keys.F, "hll_sketch_agg", lambda c, size: asked.append(c) or real(c, size))
    rows = [(i, i % 3, i % 5, i % 7, i % 2) for i in range(1000)]
    frame = spark.createDataFrame(rows, "id int, a int, b int, c int, d int")
    assert [k["columns"] for k in keys.find_keys(frame, all_levels=True)] == [["id"]]
    assert len(asked) == 5  # products of the others stay far below the rows


def test_larger_combinations_are_tried_on_a_slice_and_only_the_rest_on_all_rows(spark, monkeypatch):
    asked, counted = [], []
    real, real_count = F.hll_sketch_agg, keys._counted
    monkeypatch.setattr(keys.F, "hll_sketch_agg", lambda c, size: asked.append(c) or real(c, size))
    monkeypatch.setattr(keys, "_counted", lambda cells, names, spread=False: counted.append((names, spread)) or real_count(cells, names, spread))
    rows = [(i // 4, i % 4, i // 4 % 50, i * 7 % 300) for i in range(4000)]
    frame = spark.createDataFrame(rows, "a int, b int, c int, d int").repartition(3)
    found = keys.find_keys(frame, max_size=3, all_levels=True)
    assert [(k["columns"], k["distinct_count"]) for k in found] == plain_keys(rows, list("abcd"), 3, 1.0)
    assert len(asked) == 4  # single columns only
    assert sum(len(names) for names, spread in counted if spread) <= len(found) + 1


def test_a_single_repeat_outside_the_slice_is_no_key(spark):
    for last in range(0, 400, 100):  # wherever the repeated value falls
        rows = [(i // 2, i % 2) for i in range(800)] + [(last, 0)]
        assert keys.find_keys(spark.createDataFrame(rows, "a int, b int"), max_size=2) == []


def test_quantiles_are_exact(spark):
    draw = random.Random(2)
    for n in (1, 2, 10, 501):
        rows = [(float(draw.choice([1, 2, 2, 3, draw.random()])), draw.randrange(50), None if draw.random() < 0.3 else draw.random()) for _ in range(n)]
        frame = spark.createDataFrame(rows, "a double, b int, c double").repartition(3)
        shares = [0.0, 0.01, 0.25, 0.5, 0.9, 1.0]
        got = quantile.quantiles(frame, ["a", "b", "c"], shares)
        for i, column in enumerate("abc"):
            held = sorted(r[i] for r in rows if r[i] is not None)
            for share in shares:
                if not held:
                    assert got[column][share] is None
                    continue
                at = (len(held) - 1) * share
                want = held[int(at)] + (held[min(int(at) + 1, len(held) - 1)] - held[int(at)]) * (at - int(at))
                assert got[column][share] == pytest.approx(want, abs=1e-12), (n, column, share)


def test_quantiles_past_the_first_bracket(spark, monkeypatch):
    monkeypatch.setattr(quantile, "MAX_VALUES", 10)
    values = [1.0] * 400 + [5.0] * 400 + [float(i) / 7 for i in range(600)]
    frame = spark.createDataFrame([(v,) for v in values], "x double").repartition(4)
    got = quantile.quantiles(frame, ["x"], [0.1, 0.25, 0.75, 0.99])["x"]
    held = sorted(values)
    for share, value in got.items():
        at = (len(held) - 1) * share
        assert value == pytest.approx(held[int(at)] + (held[int(at) + 1] - held[int(at)]) * (at - int(at)))


def test_distribution(spark):
    x = [float(v) for v in (1, 2, 3, 4, 5, 6, 7, 8, 9, 100, -90)]
    rows = [(v, i, "t", None) for i, v in enumerate(x)] + [(NAN, 11, "t", None), (None, 12, "t", None)]
    frame = spark.createDataFrame(rows, "x double, `y.z` int, s string, e int")
    got = {r["name"]: r for r in distribution(frame).collect()}
    assert list(got) == ["x", "y.z", "e"]
    r = got["x"]
    assert (r["row_count"], r["null_count"], r["below"], r["above"], r["q1"], r["median"], r["q3"]) == (13, 2, 1, 1, 2.5, 5.0, 7.5)
    assert r["mean"] == pytest.approx(statistics.mean(x)) and r["stddev"] == pytest.approx(statistics.stdev(x))
    assert (r["low_fence"], r["high_fence"]) == (-5.0, 15.0)
    assert got["e"]["null_count"] == 13 and got["e"]["q1"] is None and got["e"]["above"] == 0
    assert {(r["x"], tuple(r["outlier_columns"])) for r in outliers(frame, ["x", "e"]).collect()} == {(100.0, ("x",)), (-90.0, ("x",))}
    assert outliers(frame, ["e"]).count() == 0 and distribution(frame.select("s")).count() == 0
    with pytest.raises(OperationError):
        distribution(frame, ["s"])


def _ranks(values):
    return [sum(w < v for w in values) + (sum(w == v for w in values) + 1) / 2 for v in values]


def test_average_ranks(spark):
    values = [3, 1, 1, 2, 3, 3, 9] * 20 + list(range(100))
    frame = spark.createDataFrame([(v,) for v in values], "v int").repartition(5)
    assert {r["value"]: r["rank"] for r in average_ranks(frame, "v").collect()} == dict(zip(values, _ranks(values)))


def test_correlations_over_the_rows_that_have_both(spark):
    draw = random.Random(3)
    rows = []
    for _ in range(200):
        a = draw.randrange(8)
        rows.append((a, a * a + draw.random(), None if draw.random() < 0.4 else float(draw.randrange(5) - a), 7, draw.choice([NAN, None, 1.0])))
    frame = spark.createDataFrame(rows, "a int, b double, c double, k int, n double").repartition(3)
    got = {(r["first"], r["second"]): r for r in correlations(frame).collect()}
    assert list(got) == list(combinations("abckn", 2))
    for (x, y), r in got.items():
        i, j = "abckn".index(x), "abckn".index(y)
        both = [(p[i], p[j]) for p in rows if p[i] is not None and p[j] is not None and p[i] == p[i] and p[j] == p[j]]
        assert r["n"] == len(both)
        one, two = zip(*both)
        if len(set(one)) < 2 or len(set(two)) < 2:
            assert r["pearson"] is None and r["spearman"] is None
        else:
            assert r["pearson"] == pytest.approx(statistics.correlation(one, two))
            assert r["spearman"] == pytest.approx(statistics.correlation(_ranks(one), _ranks(two)))
    assert correlations(frame, ["a", "b"], ranks=False).first()["spearman"] is None
    assert correlations(frame.select("a")).count() == 0 and correlations(frame.limit(0), ["a", "b"]).first()["n"] == 0


def test_no_window_spans_the_table(spark):
    frame = spark.range(100).select((F.col("id") % 7).alias("v"))
    assert "SinglePartition" not in average_ranks(frame, "v")._jdf.queryExecution().executedPlan().toString()


def test_planner_finds_keys_hollow_rows_and_what_to_look_at(spark):
    rows = [(i, f"u{i}@x.org", "a " if i % 2 else "A", None if i % 3 else 1.0, f"2024-01-{i % 28 + 1:02d}") for i in range(60)]
    rows += [(60 + i, f"U{i}@X.org ", None, None, None) for i in range(3)]
    frame = spark.createDataFrame(rows, "n int, email string, kind string, x double, day string")
    assert repeated_key(frame) is None  # n is a key
    people = frame.drop("n")
    assert repeated_key(people) == ["email"] and repeated_key(people, ["kind"]) is None
    steps = suggest_recipe(people, key_columns="find")
    assert steps[0] == {"op": "dedupe", "args": {"columns": ["email"], "keep": "first", "normalize_text": True}}
    drop = [s for s in steps if s["args"].get("strategy") == "drop_row"]
    assert drop and steps.index(drop[0]) < [s["args"].get("strategy") for s in steps].index("auto")
    assert run_recipe(people, drop).frame.count() == 60
    assert not [s for s in suggest_recipe(people.where("day IS NOT NULL")) if s["args"].get("strategy") == "drop_row"]
    assert inspection_order(column_signals(people)) == ["x", "kind", "day"] or inspection_order(column_signals(people))[0] == "x"
