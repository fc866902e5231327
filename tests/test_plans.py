"""Recipes, journals and working copies."""

import json

import pytest
from pyspark.sql import functions as F

from tablewright import scratch
from tablewright.errors import OperationError, UnknownOperationError, WorkingCopyError
from tablewright.operators.result import ROW_ID, OpResult
from tablewright.plans import journal, recipe, registry
from tablewright.plans.workcopy import WorkingCopy, with_row_id


def rows(df, by="id"):
    return [tuple(r) for r in df.orderBy(by).collect()]


@pytest.fixture(scope="module")
def people(spark):
    data = [(1, "p7@mill.example", " ines", "01/02/2024", "1,5"), (2, "P7@mill.example", "INES", "02/02/2024", "2,5"), (3, "q8@mill.example", "otto", None, None)]
    return spark.createDataFrame(data, "id int, email string, name string, day string, price string").coalesce(1)


STEPS = [
    {"op": "inspect_column", "args": {"column": "price"}},
    {"op": "dedupe", "args": {"columns": ["email"], "normalize_text": True, "order_by": ["id"]}},
    {"op": "normalize_text", "args": {"columns": ["name"]}},
    {"op": "parse_dates", "args": {"columns": ["day"]}},
    {"op": "normalize_numeric", "args": {"columns": ["price"]}},
    {"op": "fillna"},
]


def test_registry(people):
    assert registry.is_mutating("dedupe") and not registry.is_mutating("inspect_column")
    with pytest.raises(UnknownOperationError):
        registry.apply_operation(people, "nope")
    with pytest.raises(OperationError):
        registry.apply_operation(people, "dedupe", {"cols": ["id"]})
    with pytest.raises(OperationError):
        registry.apply_operation(people, "dedupe")


def test_own_operation(people):
    def keep(df, column, value):
        frame = df.filter(F.col(column) == value)
        return OpResult(frame, frame.limit(0), lambda known: {"op": "keep"})

    registry.register_op("keep", keep)
    assert rows(recipe.run_recipe(people, [{"op": "keep", "args": {"column": "id", "value": 3}}]).frame)[0][0] == 3


def test_recipe_equals_step_by_step(people):
    whole = recipe.run_recipe(people, STEPS)
    frame = people
    for step in STEPS[1:]:
        frame = registry.apply_operation(frame, step["op"], step.get("args")).frame
    assert rows(whole.frame) == rows(frame)
    assert [line["error"] for line in whole.log] == [None] * 6
    assert rows(whole.frame)[1][1:3] == ("q8@mill.example", "Otto") and rows(whole.frame)[1][4] == 1.5


def test_recipe_writes_once_before_looking_at_shuffled_data(people, monkeypatch):
    calls = []
    real = scratch.written
    monkeypatch.setattr(recipe, "written", lambda df: calls.append(1) or real(df))
    recipe.run_recipe(people, STEPS)
    assert len(calls) == 1
    recipe.run_recipe(people, STEPS[:3])
    assert len(calls) == 1


def test_recipe_errors(people):
    bad = [{"op": "dedupe", "args": {"columns": ["zz"]}}, {"op": "nope"}, {"op": "normalize_text", "args": {"columns": ["name"]}}]
    result = recipe.run_recipe(people, bad)
    assert rows(result.frame)[0][2] == "Ines"
    assert [line["error"] is None for line in result.log] == [False, False, True]
    assert result.log_table().count() == 3
    with pytest.raises(OperationError):
        recipe.run_recipe(people, bad, on_error="raise")
    with pytest.raises(OperationError):
        recipe.run_recipe(people, [{"op": "fillna"}] * 13, max_steps=12)
    assert len(recipe.run_recipe(people, [{"op": "profile_none"}] * 13).log) == 13


def test_cells_lost_in_parsing_are_filled(spark):
    cells = spark.createDataFrame([("1",), ("2",), ("3",), ("n/a",)], "amount string")
    steps = recipe.suggest_recipe(cells)
    assert [s["op"] for s in steps] == ["normalize_numeric", "fillna"]
    assert recipe.run_recipe(cells, steps).frame.where("amount is null").count() == 0


def test_suggestions_follow_the_data(spark):
    data = [(i, ["A ", "a", "A"][i % 3], f"2024-01-{i + 1:02d}", f"{i},5", f"c{i}", None if i == 3 else i) for i in range(9)]
    df = spark.createDataFrame(data, "id int, label string, day string, price string, code string, gap int")
    steps = recipe.suggest_recipe(df, key_columns=["id"])
    assert [(s["op"], s["args"]["columns"]) for s in steps] == [
        ("dedupe", ["id"]),
        ("normalize_text", ["label"]),
        ("parse_dates", ["day"]),
        ("normalize_numeric", ["price"]),
        ("fillna", ["gap"]),
    ]
    assert steps[2]["args"]["formats"] == ["%Y-%m-%d"]


def test_row_ids_keep_file_order(spark, tmp_path):
    path = str(tmp_path / "p")
    spark.range(0, 1000, 1, 3).select("id").write.parquet(path)
    got = with_row_id(spark.read.parquet(path)).orderBy(ROW_ID)
    assert [r["id"] for r in got.collect()] == list(range(1000))
    csv = str(tmp_path / "c")
    spark.range(0, 100, 1, 2).write.option("header", True).csv(csv)
    read = spark.read.option("header", True).csv(csv)
    assert [int(r["id"]) for r in with_row_id(read).orderBy(ROW_ID).collect()] == list(range(100))


@pytest.fixture
def copy(people, tmp_path):
    return WorkingCopy.create(people, str(tmp_path / "copies"), "c1")


def test_working_copy_keeps_order_and_hides_row_id(copy):
    first = copy.run("dedupe", {"columns": ["email"], "normalize_text": True})
    assert rows(copy.frame())[0][0] == 1 and first.summary["removed"] == 1
    copy.undo(copy.active().first()["op_id"])
    copy.run("dedupe", {"columns": ["email"], "normalize_text": True, "keep": "last"})
    assert [r[0] for r in rows(copy.frame())] == [2, 3]
    assert ROW_ID not in copy.frame().columns and ROW_ID not in copy.sample().columns
    line = copy.history().first()
    assert (line["rows_before"], line["rows_after"], line["delta"], line["columns"]) == (3, 2, -1, 5)
    assert json.loads(line["summary"])["removed"] == 1


def test_creating_again_returns_the_same_copy(copy, people, tmp_path):
    copy.run("normalize_text", {"columns": ["name"]})
    again = WorkingCopy.create(people.limit(0), str(tmp_path / "copies"), "c1")
    assert again.frame().count() == 3 and again.active().count() == 1


def test_inspections_leave_no_trace(copy):
    assert copy.run("preview_duplicates", {"columns": ["email"]}).summary["total_duplicates"] == 0
    assert copy.events().count() == 0 and copy.reset() == 0


def test_undo_and_reset(copy):
    before = rows(copy.frame())
    for op, args in (("normalize_text", {"columns": ["name"]}), ("parse_dates", {"columns": ["day"]}), ("fillna", {})):
        copy.run(op, args)
    ops = {r["op"]: r["op_id"] for r in copy.active().collect()}
    assert copy.undo(ops["parse_dates"]) == 2
    assert [r["op"] for r in copy.active().collect()] == ["normalize_text"]
    assert rows(copy.frame())[0][2] == "Ines"
    with pytest.raises(WorkingCopyError):
        copy.undo(ops["fillna"])
    with pytest.raises(WorkingCopyError):
        copy.undo("missing")
    copy.run("fillna", {"columns": ["price"], "strategy": "constant", "constant": "0"})
    assert copy.reset() == 2 and rows(copy.frame()) == before and copy.reset() == 0
    history = copy.history().collect()
    assert [r["seq"] for r in history] == sorted((r["seq"] for r in history), reverse=True)
    assert all(r["undone"] for r in history) and len(history) == 4


def test_two_writers_cannot_take_the_same_number(copy, monkeypatch):
    copy.run("normalize_text", {"columns": ["name"]})
    stale = copy.spark.createDataFrame([], journal.EVENTS)
    monkeypatch.setattr(copy, "events", lambda: stale)
    with pytest.raises(Exception, match="already exists"):
        copy.run("normalize_text", {"columns": ["email"]})


def test_replay_export_promote(copy, people, spark, tmp_path):
    copy.run("normalize_text", {"columns": ["name"], "case": "upper"})
    copy.run("fillna", {"columns": ["price"], "strategy": "constant", "constant": "0"})
    assert rows(copy.replay_on(people).frame) == rows(copy.frame())
    out = copy.export(str(tmp_path / "out"), "csv")
    back = spark.read.option("header", True).csv(out)
    assert back.columns == people.columns and back.count() == 3
    with pytest.raises(WorkingCopyError):
        copy.export(str(tmp_path / "x"), "xml")
    assert copy.export_as(str(tmp_path), "Café Acmé", "parquet") == f"{tmp_path}/cafe-acme-limpio.parquet"
    assert copy.export_as(str(tmp_path), "!!").endswith("/dataset-limpio.csv")
    line = copy.promote(str(tmp_path / "kept"), "people-clean").first()
    assert line["name"] == "people-clean" and spark.read.parquet(line["locator"]["path"]).count() == 3


def test_journal_queries_on_many_copies(spark):
    data = [("a", s, "applied", f"a{s}", f"p{s}") for s in (1, 2, 3)] + [("b", 1, "applied", "b1", "q1"), ("a", 4, "undone", "a3", None)]
    events = spark.createDataFrame(data, "copy_id string, seq bigint, event string, op_id string, after_path string")
    events = events.withColumn("rows_before", F.lit(1).cast("bigint")).withColumn("rows_after", F.col("seq"))
    copies = spark.createDataFrame([("a", "a0", 9), ("b", "b0", 9), ("c", "c0", 9)], "copy_id string, v0_path string, v0_rows bigint")
    got = {r["copy_id"]: (r["path"], r["active_ops"]) for r in journal.current_versions(events, copies).collect()}
    assert got == {"a": ("p2", 2), "b": ("q1", 1), "c": ("c0", 0)}
    targets = spark.createDataFrame([("a", "a1"), ("b", "b1")], "copy_id string, op_id string")
    assert sorted(r["op_id"] for r in journal.undo(events, targets).collect()) == ["a1", "a2", "b1"]


def test_shared_dir_prefers_the_session(spark, tmp_path):
    assert scratch.shared_dir(spark) == scratch.shared_dir(spark)

    class Conf:
        def get(self, key, default):
            return "/shared" if key == "spark.checkpoint.dir" else default

    class Session:
        conf = Conf()

    assert scratch.shared_dir(Session()) == "/shared"
