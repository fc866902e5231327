"""Closer look at one column."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.errors import OperationError
from tablewright.operators.frequency import frequencies
from tablewright.operators.quantile import medians
from tablewright.operators.result import OpResult, is_numeric, quoted, rows_of

BINS = 20
TOP_VALUES = 10


def numeric_stats(df: DataFrame, column: str) -> DataFrame:
    """One line: rows, nulls, and min, max, mean and exact median over the non-null values."""
    c = F.col(quoted(column))
    median = medians(df, [column])[column]
    return df.agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.count_if(c.isNull()).alias("null_count"),
        F.min(c).cast("double").alias("min"),
        F.max(c).cast("double").alias("max"),
        F.avg(c).cast("double").alias("mean"),
    ).withColumn("median", F.lit(median).cast("double"))


def histogram(df: DataFrame, column: str, bins: int = BINS) -> DataFrame:
    """Counts in equal-width bins, each open on the left and closed on the right.

    The first bin also holds the minimum; a constant column fills one bin.
    Infinite values and NaN have no place on the axis and are left out.
    """
    value = F.col(quoted(column)).cast("double")
    finite = df.select(value.alias("v")).filter(F.abs("v") < F.lit(float("inf")))
    lo, hi = finite.agg(F.min("v"), F.max("v")).first()
    if lo is None:
        return df.sparkSession.createDataFrame([], "bin int, upper_edge double, label string, count bigint")
    width = (hi - lo) / bins
    if width == 0:
        lowest = finite.agg(F.count("v").alias("count")).select(F.lit(1).alias("bin"), "count")
        edges = df.sparkSession.range(1, 2)
    else:
        raw = F.ceil((F.col("v") - F.lit(lo)) / F.lit(width))
        number = F.least(F.lit(bins), F.greatest(F.lit(1), raw)).cast("int")
        lowest = finite.groupBy(number.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
        edges = df.sparkSession.range(1, bins + 1)
    edge = F.lit(lo) + F.col("bin") * F.lit(width)
    axis = edges.select(F.col("id").cast("int").alias("bin"))
    return axis.join(F.broadcast(lowest), "bin", "left").select(  # one row per bin
        "bin",
        edge.alias("upper_edge"),
        F.format_string("≤ %.2f", edge).alias("label"),
        F.coalesce("count", F.lit(0)).alias("count"),
    )


def value_counts(df: DataFrame, column: str, n: int = TOP_VALUES) -> DataFrame:
    """Most frequent non-null values, ties by value."""
    counted = frequencies(df.select(quoted(column)), [column], nulls=False)
    return counted.top(n).orderBy("rank").select(counted.as_text().alias("value"), F.col("n").alias("count"))


def distinct_count(df: DataFrame, column: str) -> DataFrame:
    """One line: rows, nulls, and distinct values with null as one of them."""
    counted = frequencies(df.select(quoted(column)), [column])
    return counted.table.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_rows"),
        F.coalesce(F.sum(F.when(counted.is_null(), F.col("n"))), F.lit(0)).alias("null_count"),
        F.count(F.lit(1)).alias("distinct_count"),
    )


def inspect_column(df: DataFrame, column: str) -> OpResult:
    """Statistics and histogram of a numeric column; top values and distinct count of any other."""
    if not isinstance(column, str) or column not in df.columns:
        raise OperationError(f"column '{column}' does not exist")
    numeric = is_numeric(df, column)
    one = df.select(quoted(column))
    report = numeric_stats(one, column) if numeric else distinct_count(one, column)

    def summarise(known) -> dict:
        line = rows_of(report)[0]
        total, nulls = line["total_rows"], line["null_count"]
        summary = {
            "op": "inspect_column",
            "column": column,
            "dtype": df.schema[column].dataType.simpleString(),
            "total_rows": total,
            "null_count": nulls,
            "null_pct": nulls / total if total else 0.0,
        }
        if not numeric:
            summary["top_values"] = rows_of(value_counts(one, column))
            summary["distinct_count"] = line["distinct_count"]
        elif nulls < total:
            summary["stats"] = {k: line[k] for k in ("min", "max", "mean", "median")}
        return summary

    def draw(s: dict) -> list[dict]:
        charts = []
        if "stats" in s:
            bars = rows_of(histogram(one, column).orderBy("bin"), drop=("bin", "upper_edge"))
            if bars:
                charts.append({"kind": "histogram", "column": column, "bins": bars})
        if "top_values" in s:
            charts.append({"kind": "value_counts", "column": column, "items": s["top_values"]})
        if s["null_pct"] > 0:
            share = {"null_count": s["null_count"], "total": s["total_rows"], "null_pct": s["null_pct"]}
            charts.append({"kind": "null_pct", "column": column, **share})
        return charts

    return OpResult(None, report, summarise, draw)


def null_report(df: DataFrame) -> DataFrame:
    """Null count and share of every column that has nulls; one pass, no shuffle of rows."""
    fields = [
        F.struct(
            F.lit(c).alias("column"),
            F.count_if(F.col(quoted(c)).isNull()).alias("null_count"),
            F.count(F.lit(1)).alias("total"),
        )
        for c in df.columns
    ]
    lines = df.agg(F.array(*fields).alias("lines")).select(F.inline("lines"))
    share = F.coalesce(F.try_divide(F.col("null_count"), F.col("total")), F.lit(0.0))
    return lines.filter("null_count > 0").withColumn("null_pct", share)


def head(df: DataFrame, order_by: list[str], n: int) -> DataFrame:
    """First ``n`` rows in the given order; each task passes on no more than ``n``."""
    return df.orderBy(*[quoted(c) for c in order_by]).limit(n)


def json_cells(df: DataFrame) -> DataFrame:
    """Cells as JSON can carry them: ISO timestamps, bytes as base64 text, NaN as null."""
    out = []
    for f in df.schema.fields:
        c = F.col(quoted(f.name))
        if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            c = F.when(
                F.date_format(c, "SSSSSS") == "000000", F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
            ).otherwise(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))
        elif isinstance(f.dataType, T.DateType):
            c = c.cast("string")
        elif isinstance(f.dataType, T.BinaryType):
            c = F.base64(c)
        elif isinstance(f.dataType, (T.FloatType, T.DoubleType)):
            c = F.when(~F.isnan(c), c)
        out.append(c.alias(f.name))
    return df.select(*out)


def stable_json(df: DataFrame) -> DataFrame:
    """Each row as JSON text with its keys in order, and the digest of that text."""
    row = F.to_json(F.struct(*[F.col(quoted(c)) for c in sorted(df.columns)]), {"ignoreNullFields": "false"})
    return df.select(row.alias("json")).withColumn("fingerprint", F.sha2("json", 256))
