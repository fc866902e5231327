"""Numbers written as text."""

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.errors import OperationError
from tablewright.functions.numbers import count_char, is_number, number_chars, pick_decimal, plain_number, to_number
from tablewright.operators.measure import Measure, measured
from tablewright.operators.result import OpResult, is_numeric, is_text, quoted, replace_columns, require_columns, same_rows

_REPORT = T.StructType(
    [
        T.StructField("column", T.StringType()),
        T.StructField("decimal", T.StringType()),
        T.StructField("converted_count", T.LongType()),
        T.StructField("failed_count", T.LongType()),
        T.StructField("skipped", T.BooleanType()),
        T.StructField("reason", T.StringType()),
    ]
)


def mark_counts(columns: dict[str, Column]) -> Measure:
    """Per text column: non-null cells, commas, dots, and cells that convert under either decimal mark.

    Both outcomes are counted in the pass that also counts the marks, so the
    choice of the mark needs no second scan. Each cell is stripped once, ahead
    of the aggregates that look at it.
    """
    cells, wanted = [], []
    for i, c in enumerate(columns.values()):
        cells.append(number_chars(c).alias(f"kept{i}"))
        kept = F.col(f"kept{i}")
        wanted += [
            F.count(kept),
            F.coalesce(F.sum(count_char(kept, ",")), F.lit(0)),
            F.coalesce(F.sum(count_char(kept, ".")), F.lit(0)),
            F.count_if(is_number(plain_number(kept, "."))),
            F.count_if(is_number(plain_number(kept, ","))),
        ]

    def read(answers: Iterator) -> dict[str, dict]:
        names = ("total", "commas", "dots", ".", ",")
        return {c: {name: next(answers) for name in names} for c in columns}

    return Measure(cells, wanted, read)


def normalize_numeric(df: DataFrame, columns: list[str], decimal: str = "auto") -> OpResult:
    """Turn text columns into doubles; cells that hold no number become null.

    ``auto`` takes the rarer of comma and dot as the decimal mark of a column,
    by counting over all its cells. So a column with commas only, such as
    ``1,200``, reads as 1.2: pass ``decimal="."`` where commas are thousands.
    A percent sign is dropped without dividing. Numeric, other and all-null
    columns are left alone, with the reason in the report.
    """
    columns = require_columns(df, columns, "normalize_numeric")
    if decimal not in ("auto", ".", ","):
        raise OperationError("'decimal' must be 'auto', '.' or ','")
    (counts,) = measured(df, mark_counts({c: F.col(quoted(c)) for c in columns if is_text(df, c)}))
    results, converted = [], {}
    for column in columns:
        found = counts.get(column)
        if found is None or found["total"] == 0:
            dtype = df.schema[column].dataType.simpleString()
            reason = "no values" if found else "already numeric" if is_numeric(df, column) else f"unsupported type ({dtype})"
            results.append(_line(column, None, 0, 0, reason))
            continue
        mark = pick_decimal(found["commas"], found["dots"]) if decimal == "auto" else decimal
        results.append(_line(column, mark, found[mark], found["total"] - found[mark], None))
        converted[column] = to_number(F.col(quoted(column)), mark)
    frame = replace_columns(df, converted)
    report = df.sparkSession.createDataFrame(results, _REPORT)

    def summarise(known) -> dict:
        return {"op": "normalize_numeric", "results": results, **same_rows(known, df)}

    return OpResult(frame, report, summarise, lambda s: [{"kind": "normalize_numeric_summary", "results": results}])


def _line(column: str, mark: str | None, converted: int, failed: int, reason: str | None) -> dict:
    return {
        "column": column,
        "decimal": mark,
        "converted_count": converted,
        "failed_count": failed,
        "skipped": reason is not None,
        "reason": reason,
    }
