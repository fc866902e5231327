"""Tables that streams append to, each micro-batch once.

A batch is written into a folder of its own attempt; a line in the ledger, written after it,
makes that attempt count. A batch that the ledger already knows is passed over, so one that is
replayed after a failure adds nothing, and rows of an attempt that broke off are never read.
One query at a time writes under the name of a stream; Spark's checkpoint sees to that.
"""

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter

from tablewright.errors import OperationError
from tablewright.operators.result import quoted, require_columns

LEDGER = T.StructType(
    [
        T.StructField("stream", T.StringType()),
        T.StructField("batch", T.LongType()),
        T.StructField("attempt", T.StringType()),
        T.StructField("rows", T.LongType()),
        T.StructField("at", T.TimestampType()),
    ]
)
_PLACE = ["_stream", "_batch", "_attempt"]  # folders of the rows


class LedgerTable:
    """An append-only table with the given columns, in a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType):
        clash = sorted({f.name.lower() for f in schema.fields} & set(_PLACE))
        if clash:
            raise OperationError(f"these column names are taken: {', '.join(clash)}")
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema

    def ledger(self) -> DataFrame:
        """One line per batch that counts."""
        try:
            return self.spark.read.schema(LEDGER).parquet(f"{self.path}/ledger/*/*")
        except AnalysisException:
            return self.spark.createDataFrame([], LEDGER)

    def rows(self) -> DataFrame:
        """All rows of the batches in the ledger."""
        folders = [T.StructField(name, T.StringType()) for name in _PLACE]
        try:
            found = self.spark.read.schema(T.StructType([*self.schema.fields, *folders])).parquet(f"{self.path}/rows")
        except AnalysisException:
            return self.spark.createDataFrame([], self.schema)
        counted = self.ledger().select("attempt").distinct()
        kept = found.join(counted, found["_attempt"] == counted["attempt"], "left_semi")
        return kept.select(*[quoted(f.name) for f in self.schema.fields])

    def append(self, batch: DataFrame, batch_id: int, stream: str) -> bool:
        """Add a batch of a stream unless it is there; says whether it was added.

        Columns are taken by name and cast; those the table does not have are left out.
        """
        if not stream or not all(c.isalnum() or c in "-_" for c in stream):
            raise OperationError("a stream is named by letters, digits, '-' and '_'")
        place = f"{self.path}/ledger/{stream}/{batch_id:012d}"
        # The place itself is asked for, so the check does not grow with the batches before.
        if self._there(place):
            return False
        seen, attempt = Observation(), uuid.uuid4().hex
        lines = batch.select(*[F.col(quoted(f.name)).cast(f.dataType).alias(f.name) for f in self.schema.fields])
        lines = lines.observe(seen, F.count(F.lit(1)).alias("rows"))
        lines.write.parquet(f"{self.path}/rows/_stream={stream}/_batch={batch_id}/_attempt={attempt}")
        line = self.spark.createDataFrame([(stream, batch_id, attempt, seen.get["rows"], None)], LEDGER)
        # Over what a line that broke off may have left.
        line.withColumn("at", F.current_timestamp()).coalesce(1).write.mode("overwrite").parquet(place)
        return True

    def _there(self, place: str) -> bool:
        try:
            return not self.spark.read.schema(LEDGER).parquet(place).isEmpty()
        except AnalysisException:
            return False

    def writer(self, stream: DataFrame, name: str, checkpoint: str) -> DataStreamWriter:
        """A stream that appends here; ``name`` belongs to its checkpoint and is used for no other."""

        def append(batch: DataFrame, batch_id: int) -> None:
            self.append(batch, batch_id, name)

        return stream.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint)


def last_rows(df: DataFrame, columns: list[str], order_by: list[str]) -> DataFrame:
    """The last row of each key, for tables and streams; null keys are equal, null comes first in the order.

    Rows that agree in ``order_by`` are ordered by their other columns, so the result is the same in
    any order of arrival. On a stream, in update mode, each batch brings the keys whose last row it changed;
    the state is one row a key. As a table of such updates holds older rows too, apply it there once more.
    """
    keys = require_columns(df, columns, "last_rows")
    order = require_columns(df, order_by, "last_rows")
    rest = [c for c in df.columns if c not in keys and c not in order]
    row = F.max(F.struct(*[F.col(quoted(c)) for c in [*order, *rest]])).alias("_row")
    found = df.groupBy(*[F.col(quoted(c)) for c in keys]).agg(row)
    return found.select(*[F.col(quoted(c)) if c in keys else F.col("_row").getField(c).alias(c) for c in df.columns])
