"""What an operation returns, and the argument checks all operations share."""

from collections.abc import Callable, Iterable
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tablewright.errors import OperationError

# Order column a working copy carries; never shown, profiled or exported.
ROW_ID = "_row_id"


class OpResult:
    """Outcome of one operation.

    ``frame`` is the new table, still lazy, or ``None`` for an inspection.
    ``report`` is a small table about what happened. ``summary`` and
    ``charts`` turn that report into plain dictionaries; they are computed on
    first use, so a caller who only wants the frame runs no extra job.
    """

    def __init__(
        self,
        frame: DataFrame | None,
        report: DataFrame,
        summarise: Callable[[tuple[int, int] | None], dict],
        draw: Callable[[dict], list[dict]] = lambda summary: [],
    ):
        self.frame = frame
        self.report = report
        self._summarise = summarise
        self._draw = draw

    @cached_property
    def summary(self) -> dict:
        return self._summarise(None)

    def summary_of(self, rows_before: int, rows_after: int) -> dict:
        """The summary where both row counts are already known, so they need no job."""
        return self._summarise((rows_before, rows_after))

    @cached_property
    def charts(self) -> list[dict]:
        return self._draw(self.summary)


def data_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c != ROW_ID]


def require_columns(df: DataFrame, columns, op: str) -> list[str]:
    if not isinstance(columns, list) or not columns:
        raise OperationError(f"{op} needs at least one column in 'columns'")
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise OperationError(f"these columns do not exist: {', '.join(map(str, missing))}")
    return list(columns)


def quoted(name: str) -> str:
    """Column reference that survives dots and backticks in ``name``."""
    return "`" + name.replace("`", "``") + "`"


def is_text(df: DataFrame, column: str) -> bool:
    return isinstance(df.schema[column].dataType, T.StringType)


def is_numeric(df: DataFrame, column: str) -> bool:
    return isinstance(df.schema[column].dataType, T.NumericType)


def replace_columns(df: DataFrame, new: dict) -> DataFrame:
    """One projection that swaps the given columns and keeps the order of all."""
    return df.select(*[new[c].alias(c) if c in new else quoted(c) for c in df.columns])


def row_counts(known: tuple[int, int] | None, report: DataFrame | None = None) -> dict:
    """Rows before, after and removed: as known, or as the report counts them."""
    if known is None:
        return report.first().asDict()
    before, after = known
    return {"rows_before": before, "rows_after": after, "removed": before - after}


def same_rows(known: tuple[int, int] | None, df: DataFrame) -> dict:
    """Row counts of an operation that keeps every row."""
    rows = known[0] if known else df.count()
    return {"rows_before": rows, "rows_after": rows}


def before_after(label: str, before: int, after: int, tone: str) -> dict:
    gone = before - after
    return {
        "kind": "before_after",
        "label": label,
        "before": before,
        "after": after,
        "delta_label": f"-{gone}" if gone > 0 else "0",
        "tone": tone,
    }


def rows_of(df: DataFrame, drop: Iterable[str] = ()) -> list[dict]:
    """Rows of a report whose size is bounded by the number of columns or a fixed top-n."""
    return [{k: v for k, v in row.asDict(recursive=True).items() if k not in drop} for row in df.collect()]
