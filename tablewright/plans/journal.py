"""Histories of working copies as an append-only table of events.

One event per line: ``copy_id, seq, event ('applied' or 'undone'), op_id, op,
args, before_path, after_path, rows_before, rows_after``. Nothing is ever
changed; which operations count, and which version is current, are queries.
All functions work on the events of any number of copies at once.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

EVENTS = T.StructType(
    [
        T.StructField("copy_id", T.StringType()),
        T.StructField("seq", T.LongType()),
        T.StructField("event", T.StringType()),
        T.StructField("op_id", T.StringType()),
        T.StructField("op", T.StringType()),
        T.StructField("args", T.StringType()),
        T.StructField("before_path", T.StringType()),
        T.StructField("after_path", T.StringType()),
        T.StructField("rows_before", T.LongType()),
        T.StructField("rows_after", T.LongType()),
        T.StructField("columns", T.IntegerType()),
        T.StructField("summary", T.StringType()),
        T.StructField("at", T.TimestampNTZType()),
    ]
)


def _applied(events: DataFrame) -> DataFrame:
    return events.filter(F.col("event") == "applied").drop("event")


def _undone(events: DataFrame) -> DataFrame:
    return events.filter(F.col("event") == "undone")


def history(events: DataFrame) -> DataFrame:
    """All operations with ``undone`` and the change in rows; order by ``seq`` descending to list the newest first.

    The join is on the operation, which is unique, so no copy's history piles up in one task.
    """
    gone = _undone(events).select("op_id", F.lit(True).alias("undone"))
    listed = _applied(events).join(gone, "op_id", "left")
    return listed.withColumn("undone", F.coalesce("undone", F.lit(False))).withColumn(
        "delta", F.col("rows_after") - F.col("rows_before")
    )


def active(events: DataFrame) -> DataFrame:
    """Operations that still count."""
    return _applied(events).join(_undone(events).select("op_id"), "op_id", "left_anti")


def current_versions(events: DataFrame, copies: DataFrame) -> DataFrame:
    """Current path and row count of each copy in ``copies(copy_id, v0_path, v0_rows)``."""
    last = active(events).groupBy("copy_id").agg(
        F.max_by(F.struct("after_path", "rows_after"), "seq").alias("last"), F.count(F.lit(1)).alias("active_ops")
    )
    return copies.join(last, "copy_id", "left").select(
        "copy_id",
        F.coalesce("last.after_path", "v0_path").alias("path"),
        F.coalesce("last.rows_after", "v0_rows").alias("rows"),
        F.coalesce("active_ops", F.lit(0)).alias("active_ops"),
    )


def position(events: DataFrame) -> DataFrame:
    """One line about one copy: its last sequence number and the path of its current version, null for version 0."""
    applied = F.col("event") == "applied"
    operations = events.groupBy("op_id").agg(
        F.max("seq").alias("last_seq"),
        F.max(F.when(applied, F.col("seq"))).alias("seq"),
        F.max(F.when(applied, F.col("after_path"))).alias("path"),
        F.bool_or(~applied).alias("undone"),
    )
    live = F.when(~F.col("undone"), F.col("seq"))
    return operations.agg(F.max("last_seq").alias("last_seq"), F.max_by("path", live).alias("path"))


def undo(events: DataFrame, targets: DataFrame) -> DataFrame:
    """Operations that undoing ``targets(copy_id, op_id)`` takes back: the target and all later active ones."""
    live = active(events)
    since = live.join(targets.select("op_id"), "op_id", "left_semi")
    since = since.groupBy("copy_id").agg(F.min("seq").alias("since"))
    return live.join(since, "copy_id").filter(F.col("seq") >= F.col("since")).drop("since")


def reset(events: DataFrame) -> DataFrame:
    """Operations that a reset takes back: all active ones."""
    return active(events)
