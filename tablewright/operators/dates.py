"""Dates and times written as text."""

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.errors import OperationError
from tablewright.functions.dates import DEFAULT_FORMATS, any_shape, date_format
from tablewright.operators.measure import Measure, measured
from tablewright.operators.result import OpResult, is_text, quoted, replace_columns, require_columns, same_rows

_REPORT = T.StructType(
    [
        T.StructField("column", T.StringType()),
        T.StructField("matched_format", T.StringType()),
        T.StructField("parsed_count", T.LongType()),
        T.StructField("failed_count", T.LongType()),
        T.StructField("skipped", T.BooleanType()),
    ]
)


def format_counts(df: DataFrame, columns: list[str], formats: list[str]) -> Measure:
    """Non-null cells, and cells each format can read, per column.

    One look at its shape settles a cell that no format can read.
    """
    readable = {f: known for f in formats if (known := date_format(f)) is not None}
    cells, wanted = [], []
    for i, column in enumerate(columns):
        c = F.col(quoted(column))
        cells.append(c.isNotNull().alias(f"some{i}"))
        wanted.append(F.count_if(F.col(f"some{i}")))
        if is_text(df, column) and readable:
            cells.append(F.when(c.rlike(any_shape(readable.values())), c).alias(f"dated{i}"))
            wanted += [F.count(known.parse(F.col(f"dated{i}"))) for known in readable.values()]

    def read(answers: Iterator) -> dict[str, dict]:
        out = {}
        for column in columns:
            total = next(answers)
            parsed = {f: next(answers) for f in readable} if is_text(df, column) else {}
            out[column] = {"total": total, "parsed": parsed}
        return out

    return Measure(cells, wanted, read)


def best_format(parsed: dict[str, int]) -> str | None:
    """Format that reads the most cells, the earliest one on a tie; none if no cell is read."""
    best = max(parsed, key=parsed.get, default=None)
    return best if best is not None and parsed[best] > 0 else None


def parse_dates(df: DataFrame, columns: list[str], formats: list[str] | None = None) -> OpResult:
    """Turn text columns into timestamps.

    One format is chosen per column, the one that reads the most cells; cells
    it cannot read become null. A column no format can read stays as it is,
    and so does a column that is not text. A format with a directive Spark
    cannot express is passed over.
    """
    columns = require_columns(df, columns, "parse_dates")
    formats = formats or list(DEFAULT_FORMATS)
    if not isinstance(formats, list):
        raise OperationError("'formats' must be a non-empty list")
    # All columns and formats in one pass, without a shuffle of rows.
    (counts,) = measured(df, format_counts(df, columns, formats))
    results, parsed_columns = [], {}
    for column in columns:
        total, parsed = counts[column]["total"], counts[column]["parsed"]
        if not is_text(df, column):
            dtype = df.schema[column].dataType.simpleString()
            results.append(_line(column, dtype, total, 0, True))
            continue
        best = best_format(parsed)
        read = parsed[best] if best else 0
        results.append(_line(column, best, read, total - read, False))
        if best:
            parsed_columns[column] = date_format(best).parse(F.col(quoted(column)))
    frame = replace_columns(df, parsed_columns)
    report = df.sparkSession.createDataFrame(results, _REPORT)

    def summarise(known) -> dict:
        return {"op": "parse_dates", "results": results, **same_rows(known, df)}

    return OpResult(frame, report, summarise, lambda s: [{"kind": "parse_dates_summary", "results": results}])


def _line(column: str, matched: str | None, parsed: int, failed: int, skipped: bool) -> dict:
    return {
        "column": column,
        "matched_format": matched,
        "parsed_count": parsed,
        "failed_count": failed,
        "skipped": skipped,
    }
