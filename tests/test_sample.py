"""Bounded samples: exact size, and the same rows for any cut of the table."""

import hashlib

import pytest

from tablewright.errors import OperationError
from tablewright.operators.sample import bounded_sample, sampled_profile


def test_sample_does_not_depend_on_the_cut(spark):
    rows = [(i, f"t{i % 7}", None if i % 5 else 1.5, [i]) for i in range(3000)]
    frame = spark.createDataFrame(rows, "id int, `a.b` string, x double, l array<int>")
    one = sorted(map(str, bounded_sample(frame.repartition(7), 100).collect()))
    two = sorted(map(str, bounded_sample(frame.orderBy("x").coalesce(1), 100).collect()))
    assert one == two and len(set(one)) == 100
    by_id = {r["id"] for r in bounded_sample(frame, 50, ["id"]).collect()}
    assert by_id == set(sorted(range(3000), key=lambda i: hashlib.md5(str(i).encode()).hexdigest())[:50])


def test_sample_sizes(spark):
    frame = spark.createDataFrame([(1, None)] * 2000 + [(2, "x")] * 10, "n int, s string").repartition(4)
    assert bounded_sample(frame, 500).count() == 500 and bounded_sample(frame, 5000).count() == 2010
    assert bounded_sample(frame, 0).count() == 0 and bounded_sample(frame.limit(0), 3).count() == 0
    assert {r["name"]: r["row_count"] for r in sampled_profile(frame, 100).collect()} == {"n": 100, "s": 100}
    for wrong in ({"n": -1}, {"columns": ["z"]}):
        with pytest.raises(OperationError):
            bounded_sample(frame, **wrong)


def test_a_broken_first_write_of_a_copy_is_mended_and_csv_keeps_blanks(spark, tmp_path):
    from tablewright.plans.workcopy import WorkingCopy

    (tmp_path / "c" / "v0" / "_temporary" / "0").mkdir(parents=True)
    frame = spark.createDataFrame([(1, " x "), (2, None), (3, 'q"\n ')], "n int, s string")
    copy = WorkingCopy.create(frame, str(tmp_path), "c")
    assert copy.frame().count() == 3
    assert WorkingCopy.create(frame.limit(1), str(tmp_path), "c").frame().count() == 3
    back = spark.read.options(header=True, escape='"', multiLine=True).csv(copy.export(str(tmp_path / "out"), "csv"))
    assert {(r.n, r.s) for r in back.collect()} == {("1", " x "), ("2", None), ("3", 'q"\n ')}
