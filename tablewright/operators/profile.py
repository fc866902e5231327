"""Quality profile of a table: one line per column."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.operators.frequency import Frequencies, frequencies
from tablewright.operators.result import data_columns, quoted

TOP_VALUES = 5
MANY_NULLS = 0.2
BRIEF_NAMES = 5

_HEAD = T.StructType(
    [
        T.StructField("position", T.IntegerType()),
        T.StructField("name", T.StringType()),
        T.StructField("dtype", T.StringType()),
    ]
)


def null_share(nulls: Column, rows: Column) -> Column:
    """Share of nulls, 0.0 for an empty table, 4 decimals."""
    return F.round(F.coalesce(F.try_divide(nulls, rows), F.lit(0.0)), 4)


def _head(df: DataFrame, columns: list[str]) -> DataFrame:
    rows = [(i, c, df.schema[c].dataType.simpleString()) for i, c in enumerate(columns)]
    return df.sparkSession.createDataFrame(rows, _HEAD)


def _facts(counted: Frequencies) -> DataFrame:
    return counted.table.groupBy("column").agg(
        F.sum("n").alias("rows"),
        F.coalesce(F.sum(F.when(counted.is_null(), F.col("n"))), F.lit(0)).alias("nulls"),
        F.count(F.lit(1)).alias("distinct"),
        counted.extreme(F.min).alias("lowest"),
        counted.extreme(F.max).alias("highest"),
    )


def _top(counted: Frequencies, n: int) -> DataFrame:
    """At most ``n`` values per column, in one array each."""
    item = F.struct("rank", F.coalesce(counted.as_text(), F.lit("")).alias("value"), F.col("n").alias("count"))
    return counted.top(n).groupBy("column").agg(F.array_sort(F.collect_list(item)).alias("top"))


def profile(df: DataFrame, columns: list[str] | None = None, top: int = TOP_VALUES) -> DataFrame:
    """Rows, nulls, distinct values (null is one), range and most frequent values of each column.

    Everything is derived from one table of value counts, which is shuffled
    once, with long text as digests; only the range of text columns comes from a scan
    of its own. The joins below have one row per column of ``df``, so broadcasting
    them is safe at any row count. An empty table still lists its columns.
    """
    columns = columns or data_columns(df)
    counted = frequencies(df, columns)
    lines = _head(df, columns)
    at = F.col("position").cast("string") == F.col("column")
    lines = lines.join(F.broadcast(_facts(counted)), at, "left").drop("column")
    lines = lines.join(F.broadcast(_top(counted, top)), at, "left").drop("column")
    if counted.text_slot:
        ranges = counted.text_ranges().toDF("column", "first", "last")
        lines = lines.join(F.broadcast(ranges), at, "left").drop("column")
    else:
        lines = lines.withColumns({"first": F.lit(None), "last": F.lit(None)})
    zero = F.lit(0).cast("bigint")
    value = T.ArrayType(T.StructType([T.StructField("value", T.StringType()), T.StructField("count", T.LongType())]))
    return lines.select(
        "position",
        "name",
        "dtype",
        F.coalesce("rows", zero).alias("row_count"),
        F.coalesce("nulls", zero).alias("null_count"),
        null_share(F.coalesce("nulls", zero), F.coalesce("rows", zero)).alias("null_pct"),
        F.coalesce("distinct", zero).alias("distinct_count"),
        F.coalesce("lowest", "first").alias("min"),
        F.coalesce("highest", "last").alias("max"),
        F.coalesce(F.transform("top", lambda t: F.struct(t["value"], t["count"])), F.array().cast(value)).alias(
            "top_values"
        ),
    )


def approximate_profile(df: DataFrame, columns: list[str] | None = None, rsd: float = 0.02) -> DataFrame:
    """As ``profile`` but distinct counts are estimates and top values are left out.

    One pass, no shuffle of values: for a first look at very large tables.
    """
    columns = columns or data_columns(df)
    row = df.agg(F.count(F.lit(1)).alias("rows"), *_estimates(df, columns, rsd))
    fields = [
        F.struct(
            F.lit(i).alias("position"),
            F.lit(c).alias("name"),
            F.lit(df.schema[c].dataType.simpleString()).alias("dtype"),
            F.col("rows").alias("row_count"),
            (F.col("rows") - F.col(f"some{i}")).alias("null_count"),
            null_share(F.col("rows") - F.col(f"some{i}"), F.col("rows")).alias("null_pct"),
            (F.col(f"distinct{i}") + F.when(F.col(f"some{i}") < F.col("rows"), 1).otherwise(0)).alias("distinct_count"),
            F.col(f"min{i}").alias("min"),
            F.col(f"max{i}").alias("max"),
        )
        for i, c in enumerate(columns)
    ]
    return row.select(F.inline(F.array(*fields)))


def _estimates(df: DataFrame, columns: list[str], rsd: float) -> list[Column]:
    out = []
    for i, name in enumerate(columns):
        c, dtype = F.col(quoted(name)), df.schema[name].dataType
        nested = isinstance(dtype, (T.ArrayType, T.StructType, T.MapType, T.VariantType))
        value = F.to_json(c) if nested else c
        ranged = F.when(~F.isnan(value), value) if isinstance(dtype, (T.FloatType, T.DoubleType)) else value
        out += [
            F.count(c).alias(f"some{i}"),
            F.approx_count_distinct(value, rsd).alias(f"distinct{i}"),
            F.min(ranged).cast("string").alias(f"min{i}"),
            F.max(ranged).cast("string").alias(f"max{i}"),
        ]
    return out


def quality_brief(profiled: DataFrame, many_nulls: float = MANY_NULLS) -> DataFrame:
    """One line: row count, columns with many nulls, the first five of their names, all column types."""
    lines = F.array_sort(F.collect_list(F.struct("position", "name", "dtype", "null_pct")))
    flagged = F.filter("lines", lambda c: c["null_pct"] >= many_nulls)
    return profiled.agg(F.max("row_count").alias("row_count"), lines.alias("lines")).select(
        F.coalesce("row_count", F.lit(0)).alias("row_count"),
        F.size(flagged).alias("columns_with_many_nulls"),
        F.array_join(F.transform(F.slice(flagged, 1, BRIEF_NAMES), lambda c: c["name"]), ", ").alias("first_names"),
        F.array_join(F.transform("lines", lambda c: F.format_string("%s (%s)", c["name"], c["dtype"])), "\n").alias(
            "schema"
        ),
    )
