"""Working copies: immutable Parquet versions of a table plus a journal of what led to them."""

import datetime
import json
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.errors import WorkingCopyError
from tablewright.functions.text import slug
from tablewright.operators.inspect import head
from tablewright.operators.result import ROW_ID, OpResult, data_columns
from tablewright.plans import journal
from tablewright.plans.recipe import RecipeResult, replay
from tablewright.plans.registry import apply_operation, is_mutating

SAMPLE_ROWS = 25
EXPORT_FORMATS = ("csv", "parquet")
EXPORT_SUFFIX = "-limpio"  # fixed value


def with_row_id(df: DataFrame) -> DataFrame:
    """Add a row id that keeps the order of the source, so later versions know what came first.

    Files are ordered by path, then block, then row. Only Parquet tells the
    row within a file; elsewhere, and for frames that are not files, the order
    in which Spark reads the rows is taken.
    """
    if ROW_ID in df.columns:
        return df
    here, zero = F.monotonically_increasing_id(), F.lit(0).cast("bigint")
    try:
        file = df.select("*", _row_id(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), here))
    except AnalysisException:
        return df.select("*", _row_id(F.lit(""), zero, here))
    try:
        return df.select("*", _row_id(F.col("_metadata.file_path"), zero, F.col("_metadata.row_index")))
    except AnalysisException:
        return file


def _row_id(file: Column, block: Column, row: Column) -> Column:
    return F.struct(file.alias("file"), block.alias("block"), row.alias("row")).alias(ROW_ID)


class WorkingCopy:
    """One user's draft of one dataset, kept in a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.copy_id = self.path.rsplit("/", 1)[-1]

    @classmethod
    def create(cls, df: DataFrame, root: str, copy_id: str) -> "WorkingCopy":
        """Write version 0, or return the copy that is already there.

        What a write that broke off has left behind is no copy and gives way.
        """
        copy = cls(df.sparkSession, f"{root.rstrip('/')}/{copy_id}")
        if copy._exists(copy._v0):
            return copy
        with_row_id(df).write.mode("overwrite").parquet(copy._v0)
        return copy

    @property
    def _v0(self) -> str:
        return f"{self.path}/v0"

    def _exists(self, path: str) -> bool:
        try:
            self.spark.read.parquet(path)
        except AnalysisException:
            return False
        return True

    # -- reading ---------------------------------------------------------------

    def events(self) -> DataFrame:
        """The journal so far; each append is a folder of its own."""
        folder = f"{self.path}/journal"
        try:
            return self.spark.read.schema(journal.EVENTS).parquet(f"{folder}/*")
        except AnalysisException:
            return self.spark.createDataFrame([], journal.EVENTS)

    def history(self) -> DataFrame:
        """Operations, newest first."""
        return journal.history(self.events()).orderBy(F.desc("seq"))

    def active(self) -> DataFrame:
        return journal.active(self.events())

    def current_path(self) -> str:
        return self._position()[1]

    def _position(self) -> tuple[int, str]:
        """Last sequence number and path of the current version."""
        at = journal.position(self.events()).first()
        return at["last_seq"] or 0, at["path"] or self._v0

    def versioned(self) -> DataFrame:
        """Current version with its row id."""
        return self.spark.read.parquet(self.current_path())

    def frame(self) -> DataFrame:
        """Current version as the user sees it."""
        return self.versioned().drop(ROW_ID)

    def sample(self, n: int = SAMPLE_ROWS) -> DataFrame:
        return head(self.versioned(), [ROW_ID], n).drop(ROW_ID)

    # -- changing --------------------------------------------------------------

    def run(self, op: str, args: dict | None = None) -> OpResult:
        """Apply one operation. Inspections leave no trace; others write a version and a journal line."""
        last, before_path = self._position()
        before = self.spark.read.parquet(before_path)
        if not is_mutating(op):
            return apply_operation(before.drop(ROW_ID), op, args)
        result = apply_operation(before, op, args)
        after_path = f"{self.path}/after_{op}_{uuid.uuid4().hex[:8]}"
        result.frame.write.parquet(after_path)
        after = self.spark.read.schema(result.frame.schema).parquet(after_path)
        # Counts without columns are answered from the Parquet footers.
        rows_before, rows_after = before.count(), after.count()
        line = {
            "event": "applied",
            "op_id": uuid.uuid4().hex,
            "op": op,
            "args": json.dumps(args or {}, sort_keys=True, default=str),
            "before_path": before_path,
            "after_path": after_path,
            "rows_before": rows_before,
            "rows_after": rows_after,
            "columns": len(data_columns(after)),
            "summary": json.dumps(result.summary_of(rows_before, rows_after), sort_keys=True, default=str),
        }
        self._append([line], last)
        return result

    def undo(self, op_id: str) -> int:
        """Take back one operation and all later ones; returns how many."""
        known = self.events().filter(F.col("op_id") == op_id).select("event").collect()
        if not known:
            raise WorkingCopyError(f"operation '{op_id}' is not in the history")
        if any(row["event"] == "undone" for row in known):
            raise WorkingCopyError(f"operation '{op_id}' was already undone")
        target = self.spark.createDataFrame([(self.copy_id, op_id)], "copy_id string, op_id string")
        return self._take_back(journal.undo(self.events(), target))

    def reset(self) -> int:
        """Back to version 0; returns how many operations were taken back."""
        return self._take_back(journal.reset(self.events()))

    def _take_back(self, operations: DataFrame) -> int:
        lines = [
            {"event": "undone", "op_id": row["op_id"], "op": row["op"]}
            for row in operations.select("seq", "op_id", "op").orderBy("seq").collect()
        ]
        if lines:
            self._append(lines, self._position()[0])
        return len(lines)

    def _append(self, lines: list[dict], last: int) -> None:
        """Write events after number ``last``; fails if another writer has already done so."""
        now = datetime.datetime.now(datetime.UTC).replace(tzinfo=None)
        empty = dict.fromkeys(journal.EVENTS.names)
        rows = [
            {**empty, **line, "copy_id": self.copy_id, "seq": last + 1 + i, "at": now} for i, line in enumerate(lines)
        ]
        table = self.spark.createDataFrame(rows, journal.EVENTS).coalesce(1)
        table.write.mode("errorifexists").parquet(f"{self.path}/journal/{last + 1:012d}")

    def replay_on(self, df: DataFrame) -> RecipeResult:
        """The active operations on another source."""
        return replay(self.active(), df)

    # -- handing over ----------------------------------------------------------

    def export(self, path: str, fmt: str = "csv") -> str:
        """Write the current version; one file per task, as many as the data needs."""
        if fmt not in EXPORT_FORMATS:
            raise WorkingCopyError(f"unknown export format '{fmt}', use one of {', '.join(EXPORT_FORMATS)}")
        writer = self.frame().write.mode("errorifexists")
        if fmt == "csv":
            kept = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}  # cells as they are
            writer.options(header=True, escape='"', **kept).csv(path)
        else:
            writer.parquet(path)
        return path

    def export_as(self, folder: str, dataset_name: str, fmt: str = "csv") -> str:
        """Export under a file name made from the name of the dataset."""
        base = self.spark.range(1).select(slug(F.lit(dataset_name))).first()[0] or "dataset"
        return self.export(f"{folder.rstrip('/')}/{base}{EXPORT_SUFFIX}.{fmt}", fmt)

    def promote(self, path: str, name: str) -> DataFrame:
        """Make the current version a dataset of its own; returns its catalogue line."""
        self.export(path, "parquet")
        line = [(uuid.uuid4().hex, name, "parquet", {"path": path}, self.frame().schema.json())]
        return self.spark.createDataFrame(
            line, "dataset_id string, name string, kind string, locator map<string,string>, schema string"
        )
