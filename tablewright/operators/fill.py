"""Missing values: fill them column by column, or drop rows that are mostly empty."""

import datetime
import decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.errors import OperationError
from tablewright.operators.frequency import modes
from tablewright.operators.quantile import medians
from tablewright.operators.result import (
    OpResult,
    before_after,
    data_columns,
    is_numeric,
    quoted,
    replace_columns,
    require_columns,
    row_counts,
)

STRATEGIES = ("auto", "median", "mean", "mode", "constant", "drop_row")
_REPORT = T.StructType(
    [
        T.StructField("column", T.StringType()),
        T.StructField("strategy", T.StringType()),
        T.StructField("value", T.StringType()),
        T.StructField("filled_count", T.LongType()),
    ]
)


def drop_threshold(min_pct: float, columns: int) -> int:
    """Nulls from which a row goes: the share of the considered columns, half rounded to even, at least 1."""
    return max(1, round(min_pct * columns))


def _counts(df: DataFrame, columns: list[str]) -> tuple[int, dict[str, int]]:
    row = df.agg(
        F.count(F.lit(1)), *[F.count(quoted(c)) for c in columns]
    ).first()
    return row[0], {c: row[0] - row[i + 1] for i, c in enumerate(columns)}


def _literal(value, dtype: T.DataType) -> Column:
    """Typed literal; dates and times go through text, which no time zone can shift."""
    return F.lit(str(value) if isinstance(value, datetime.date) else value).cast(dtype)


def _constant(df: DataFrame, column: str, value) -> Column:
    """Literal for a constant, or an error where the column cannot hold it."""
    dtype = df.schema[column].dataType
    number = isinstance(value, (int, float, decimal.Decimal)) and not isinstance(value, bool)
    if isinstance(dtype, T.StringType):
        return F.lit(value if isinstance(value, str) else str(value))
    if isinstance(dtype, T.NumericType) and number:
        return F.lit(value)
    if isinstance(dtype, T.BooleanType) and isinstance(value, bool):
        return F.lit(value)
    if isinstance(dtype, T.DateType) and type(value) is datetime.date:
        return F.lit(value)
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)) and isinstance(value, (datetime.date, datetime.datetime)):
        return _literal(value, dtype)
    raise OperationError(f"constant {value!r} does not fit column '{column}' ({dtype.simpleString()})")


def fillna(
    df: DataFrame,
    columns: list[str] | None = None,
    strategy: str = "auto",
    constant=None,
    min_pct_to_drop: float = 0.5,
) -> OpResult:
    """Fill nulls with the median, mean, mode or a constant, or drop rows.

    ``auto`` takes the median for numbers and the mode for the rest; median
    and mean fall back to the mode where a column is not numeric. Median and
    mean turn an integer column into doubles. Columns default to those with
    nulls; a column with nothing but nulls is only filled by a constant. NaN
    is a value, not a null.
    """
    if strategy not in STRATEGIES:
        raise OperationError(f"unknown strategy '{strategy}', use one of {', '.join(STRATEGIES)}")
    if columns is not None:
        columns = require_columns(df, columns, "fillna")
        if strategy == "constant" and constant is not None:
            for c in columns:
                _constant(df, c, constant)
    elif strategy == "constant" and constant is not None and not any(_fits(df, c, constant) for c in data_columns(df)):
        raise OperationError(f"the constant {constant!r} fits no column")
    rows, nulls = _counts(df, columns or data_columns(df))
    considered = columns or [c for c, n in nulls.items() if n]
    if not considered:
        return _result(df, df, strategy, rows, [])
    if strategy == "drop_row":
        return _drop_rows(df, considered, float(min_pct_to_drop), rows)

    open_ = [c for c in considered if nulls[c]]
    known = [c for c in open_ if nulls[c] < rows]
    used = {c: strategy for c in open_}
    if strategy == "auto":
        used = {c: "median" if is_numeric(df, c) else "mode" for c in open_}
    values: dict[str, Column] = {}
    shown: dict[str, str] = {}
    if strategy == "constant":
        if constant is not None:
            values = {c: _constant(df, c, constant) for c in open_}
            shown = {c: str(constant) for c in open_}
    else:
        found = {}
        found.update(medians(df, [c for c in known if used[c] == "median" and is_numeric(df, c)]))
        found.update(_means(df, [c for c in known if used[c] == "mean" and is_numeric(df, c)]))
        found.update(modes(df, [c for c in known if c not in found and _plain(df, c)]))
        for c, v in found.items():
            widen = is_numeric(df, c) and used[c] in ("median", "mean")
            values[c], shown[c] = F.lit(v) if widen else _literal(v, df.schema[c].dataType), _shown(v)
    filled = [
        {"column": c, "strategy": used[c], "value": shown[c], "filled_count": nulls[c]} for c in open_ if c in values
    ]
    frame = replace_columns(df, {c: F.coalesce(F.col(quoted(c)), v) for c, v in values.items()})
    return _result(df, frame, strategy, rows, filled)


def _fits(df: DataFrame, column: str, constant) -> bool:
    try:
        _constant(df, column, constant)
    except OperationError:
        return False
    return True


def _plain(df: DataFrame, column: str) -> bool:
    return not isinstance(df.schema[column].dataType, (T.ArrayType, T.StructType, T.MapType, T.VariantType, T.BinaryType))


def _means(df: DataFrame, columns: list[str]) -> dict[str, float]:
    if not columns:
        return {}
    row = df.agg(*[F.avg(quoted(c)).cast("double") for c in columns]).first()
    return dict(zip(columns, row))


def _shown(value) -> str:
    return str(value).lower() if isinstance(value, bool) else str(value)


def _result(df: DataFrame, frame: DataFrame, strategy: str, rows: int, filled: list[dict]) -> OpResult:
    report = df.sparkSession.createDataFrame(filled, _REPORT)
    total = sum(f["filled_count"] for f in filled)
    summary = {
        "op": "fillna",
        "strategy": strategy,
        "filled": filled,
        "total_filled": total,
        "rows_before": rows,
        "rows_after": rows,
    }
    charts = [{"kind": "fillna_summary", "filled": filled, "total_filled": total}] if filled else []
    return OpResult(frame, report, lambda known: summary, lambda s: charts)


def _drop_rows(df: DataFrame, considered: list[str], min_pct: float, rows: int) -> OpResult:
    threshold = drop_threshold(min_pct, len(considered))
    empty = F.lit(0)
    for c in considered:
        empty = empty + F.col(quoted(c)).isNull().cast("int")
    frame = df.filter(empty < threshold)
    report = df.agg(
        F.count(F.lit(1)).alias("rows_before"), F.count_if(empty < threshold).alias("rows_after")
    ).withColumn("removed", F.col("rows_before") - F.col("rows_after"))

    def summarise(known) -> dict:
        return {
            "op": "fillna",
            "strategy": "drop_row",
            "columns_considered": considered,
            "min_pct_to_drop": min_pct,
            **row_counts(known, report),
        }

    def draw(s: dict) -> list[dict]:
        share = s["removed"] / max(s["rows_before"], 1)
        return [before_after("rows", s["rows_before"], s["rows_after"], "warning" if share > 0.1 else "positive")]

    return OpResult(frame, report, summarise, draw)
