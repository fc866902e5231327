"""Streams that append once, whatever is replayed."""

import os

import pytest

from tablewright.errors import OperationError
from tablewright.streaming.ledger import LedgerTable, last_rows

EVENTS = "id long, who string, at int"


def read(spark, folder):
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(folder)


def put(spark, folder, rows):
    spark.createDataFrame(rows, EVENTS).coalesce(1).write.mode("append").parquet(folder)


def drain(writer):
    writer.trigger(availableNow=True).start().awaitTermination()


def ids(table):
    return sorted(r["id"] for r in table.rows().collect())


@pytest.fixture
def table(spark, tmp_path):
    return LedgerTable(spark, str(tmp_path / "table"), spark.createDataFrame([], EVENTS).schema)


def test_batches_count_once(spark, tmp_path, table):
    assert table.rows().count() == 0 and table.ledger().count() == 0
    batch = spark.createDataFrame([(1, "a", 1), (1, "a", 1), (None, None, None)], EVENTS)
    assert table.append(batch, 0, "one")
    assert not table.append(batch, 0, "one")
    assert table.append(batch.limit(0), 1, "one") and table.append(batch.limit(1), 0, "two")
    assert table.rows().count() == 4
    assert sorted((r["stream"], r["batch"], r["rows"]) for r in table.ledger().collect()) == [("one", 0, 3), ("one", 1, 0), ("two", 0, 1)]
    with pytest.raises(OperationError):
        table.append(batch, 0, "a/b")
    with pytest.raises(OperationError):
        LedgerTable(spark, str(tmp_path / "x"), spark.createDataFrame([], "_Batch int").schema)


def test_columns_go_by_name(spark, table):
    table.append(spark.createDataFrame([(7, "x", "b", 1)], "at int, more string, who string, id int"), 0, "s")
    assert [tuple(r) for r in table.rows().collect()] == [(1, "b", 7)]


def test_broken_attempts_leave_no_rows(spark, table):
    batch = spark.createDataFrame([(1, "a", 1)], EVENTS)
    batch.write.parquet(f"{table.path}/rows/_stream=s/_batch=0/_attempt=12")  # rows without a line
    os.makedirs(f"{table.path}/ledger/s/000000000000/_temporary")  # a line that was never finished
    assert table.rows().count() == 0
    assert table.append(batch, 0, "s") and ids(table) == [1]


def test_restarts_and_replays_add_nothing(spark, tmp_path, table):
    folder, check = str(tmp_path / "in"), str(tmp_path / "check")
    for i in range(3):
        put(spark, folder, [(i, "a", i)])
    drain(table.writer(read(spark, folder), "s", check))
    drain(table.writer(read(spark, folder), "s", check))
    assert ids(table) == [0, 1, 2] and table.ledger().count() == 3
    # The batch was appended, but the stream broke off before it could note that.
    commits = f"{check}/commits"
    for name in ("2", ".2.crc"):
        os.replace(f"{commits}/{name}", str(tmp_path / f"lost{name}"))
    drain(table.writer(read(spark, folder), "s", check))
    assert ids(table) == [0, 1, 2]
    put(spark, folder, [(3, "a", 3)])
    drain(table.writer(read(spark, folder), "s", check))
    assert ids(table) == [0, 1, 2, 3]


def test_last_rows_of_a_stream_are_those_of_the_table(spark, tmp_path, table):
    folder, check = str(tmp_path / "in"), str(tmp_path / "check")
    rows = [[(1, "a", 5), (2, "b", None), (3, None, 1)], [(4, "a", 3), (5, "b", 0), (6, None, 1)], [(7, "a", 5), (0, "c", None)]]
    for part in rows[:2]:
        put(spark, folder, part)
    drain(table.writer(last_rows(read(spark, folder), ["who"], ["at"]), "s", check).outputMode("update"))
    put(spark, folder, rows[2])
    drain(table.writer(last_rows(read(spark, folder), ["who"], ["at"]), "s", check).outputMode("update"))
    got = {tuple(r) for r in last_rows(table.rows(), ["who"], ["at"]).collect()}
    assert got == {tuple(r) for r in last_rows(spark.read.parquet(folder), ["who"], ["at"]).collect()}
    assert got == {(7, "a", 5), (5, "b", 0), (6, None, 1), (0, "c", None)}
    with pytest.raises(OperationError):
        last_rows(table.rows(), ["who"], [])
