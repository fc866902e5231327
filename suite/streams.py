"""Streams that append to tables, restarted and replayed."""

import uuid

from suite.base import Query, table
from tablewright.scratch import shared_dir
from tablewright.streaming.ledger import LedgerTable, last_rows


def _streamed(spark, sf):
    """The events as a stream, and a new folder for what it writes."""
    schema = table(spark, sf, "events").schema
    # A stream takes folders and patterns, not the one file that a table may be.
    return spark.readStream.schema(schema).parquet(f"{sf}/events.parque[t]"), f"{shared_dir(spark)}/streams/{uuid.uuid4().hex}"


def stream_append(spark, sf):
    """A stream run, started again from its checkpoint, and its first batch replayed."""
    source, root = _streamed(spark, sf)
    kept = LedgerTable(spark, f"{root}/table", source.schema)
    for _ in range(2):
        kept.writer(source, "events", f"{root}/check").trigger(availableNow=True).start().awaitTermination()
    kept.append(table(spark, sf, "events"), 0, "events")
    return kept.rows()


def stream_last_rows(spark, sf):
    """The last event of each user, kept up to date by a stream."""
    source, root = _streamed(spark, sf)
    kept = LedgerTable(spark, f"{root}/table", source.schema)
    last = last_rows(source, ["user_id"], ["ts", "event_id"])
    updates = kept.writer(last, "last", f"{root}/check").outputMode("update")
    updates.trigger(availableNow=True).start().awaitTermination()
    return last_rows(kept.rows(), ["user_id"], ["ts", "event_id"])


QUERIES = [
    Query("stream_append", stream_append, "SELECT * FROM events"),
    Query(
        "stream_last_rows",
        stream_last_rows,
        "SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1",
    ),
]
