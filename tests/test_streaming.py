"""The streaming forms give what the batch forms give."""

import pytest
from pyspark.sql import functions as F

from tablewright.errors import OperationError
from tablewright.operators import events as ev
from tablewright.streaming import steps


@pytest.fixture(scope="module")
def feed(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("feed") / "in")
    df = spark.sql(
        "SELECT id, concat(' usER-', id % 5, ' ') AS who, '05/01/2024' AS day, '1.000,5' AS price, "
        "CASE WHEN id % 4 = 0 THEN NULL ELSE id END AS gap, "
        "timestamp_ntz'2024-01-01 10:00:00' + make_dt_interval(0, 0, CAST(id AS int)) AS at FROM range(100)"
    )
    df.repartition(4).write.parquet(path)
    return path


def stream(spark, path):
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)


def drain(df, spark, tmp_path, mode="append"):
    out, check = str(tmp_path / "out"), str(tmp_path / "check")
    df.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", check).trigger(availableNow=True).start(
        out
    ).awaitTermination()
    return spark.read.parquet(out)


def test_row_local_steps(spark, feed, tmp_path):
    df = steps.clean_columns(stream(spark, feed), ["who"], case="lower")
    df = steps.parse_columns(df, {"day": "%d/%m/%Y"})
    df = steps.number_columns(df, {"price": ","})
    df = steps.fill_columns(df, {"gap": -1})
    row = drain(df, spark, tmp_path).orderBy("id").first()
    assert (row["who"], str(row["day"]), row["price"], row["gap"]) == ("user-0", "2024-01-05 00:00:00", 1000.5, -1)


def test_sparse_rows(spark, feed, tmp_path):
    assert drain(steps.drop_sparse_rows(stream(spark, feed), ["gap"]), spark, tmp_path).count() == 75


def test_dedupe_stream(spark, feed, tmp_path):
    df = steps.dedupe_stream(stream(spark, feed), ["who"], "at", "1 day", normalize_text=True)
    assert drain(df, spark, tmp_path).count() == 5
    with pytest.raises(OperationError):
        steps.dedupe_stream(stream(spark, feed), ["who"], "at", "1 day", keep="last")


def test_rate_windows_match_the_batch(spark, feed, tmp_path):
    late = spark.read.parquet(feed)
    wanted = {tuple(r) for r in ev.over_limit(late, "who", "at", 5, "30 minutes").collect()}
    df = steps.over_limit_stream(stream(spark, feed), "who", "at", 5, "30 minutes", "0 seconds")
    got = {tuple(r) for r in drain(df, spark, tmp_path).collect()}
    closed = late.agg(F.max("at")).first()[0]
    assert got == {w for w in wanted if (closed - w[1]).total_seconds() >= 1800} and got


def test_append_stream(spark, feed, tmp_path):
    path = str(tmp_path / "audit")
    lines = stream(spark, feed).select(
        F.lit("tick").alias("event_type"),
        F.col("who").alias("user_id"),
        *[F.lit(None).cast("string").alias(c) for c in ("tenant_id", "ip", "user_agent", "metadata")],
        "at",
    )
    query = steps.append_stream(lines, lambda batch: ev.append_audit(batch, path), str(tmp_path / "check"))
    query.trigger(availableNow=True).start().awaitTermination()
    assert spark.read.parquet(path).count() == 100


def test_unknown_format(spark, feed):
    with pytest.raises(OperationError):
        steps.parse_columns(stream(spark, feed), {"day": "%Q"})
