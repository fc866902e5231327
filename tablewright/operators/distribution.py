"""Distributions, outliers and correlations of numeric columns.

Quartiles are exact: one sketch a column and scan brackets all of them, and the values inside the
brackets are counted. Correlations of all pairs are one aggregate over
one scan. Ranks come from value counts that are added up by sorted ranges, so no window goes over the whole table.
"""

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.errors import OperationError
from tablewright.operators.quantile import quantiles
from tablewright.operators.result import data_columns, is_numeric, quoted, require_columns
from tablewright.scratch import written

QUARTILES = (0.25, 0.5, 0.75)
DISTRIBUTION = (
    "position int, name string, row_count long, null_count long, mean double, stddev double, skewness double, min double, q1 double,"
    " median double, q3 double, max double, low_fence double, high_fence double, below long, above long"
)
CORRELATIONS = "first string, second string, n long, pearson double, spearman double"


def _numbers(df: DataFrame, columns: list[str] | None, op: str) -> list[str]:
    if columns is None:
        return [c for c in data_columns(df) if is_numeric(df, c)]
    columns = require_columns(df, columns, op)
    other = [c for c in columns if not is_numeric(df, c)]
    if other:
        raise OperationError(f"{op} needs numeric columns, these are not: {', '.join(other)}")
    return columns


def _value(df: DataFrame, column: str) -> Column:
    """The column with NaN as a gap."""
    c = F.col(quoted(column))
    if isinstance(df.schema[column].dataType, (T.FloatType, T.DoubleType)):
        return F.when(~F.isnan(c), c)
    return c


def _real(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*[_value(df, c).alias(c) for c in columns])


def fences(df: DataFrame, columns: list[str], factor: float = 1.5) -> dict[str, tuple[float, float, dict[float, float]] | None]:
    """Lower and upper fence and the quartiles of each column, ``factor`` interquartile ranges off; none for a column without numbers."""
    found = quantiles(_real(df, columns), columns, list(QUARTILES))
    out = {}
    for c, q in found.items():
        width = None if q[0.25] is None else q[0.75] - q[0.25]
        out[c] = None if width is None else (q[0.25] - factor * width, q[0.75] + factor * width, q)
    return out


def distribution(df: DataFrame, columns: list[str] | None = None, factor: float = 1.5) -> DataFrame:
    """One row a numeric column: moments, exact quartiles, fences, and how many values lie outside them.

    NaN counts as a gap. A column without any number has gaps in all but the counts.
    """
    columns = _numbers(df, columns, "distribution")
    spark = df.sparkSession
    if not columns:
        return spark.createDataFrame([], DISTRIBUTION)
    real = _real(df, columns)
    limits = fences(df, columns, factor)
    wanted = [F.count(F.lit(1))]
    for c in columns:
        x, limit = F.col(quoted(c)), limits[c]
        low, high = (F.lit(limit[0]), F.lit(limit[1])) if limit else (F.lit(None).cast("double"),) * 2
        wanted += [F.count(x), F.avg(x).cast("double"), F.stddev_samp(x), F.skewness(x), F.min(x).cast("double"), F.max(x).cast("double")]
        wanted += [F.count_if(x < low), F.count_if(x > high)]
    rows, *cells = real.agg(*wanted).first()
    out = []
    for i, c in enumerate(columns):
        some, mean, deviation, skew, least, most, below, above = cells[8 * i : 8 * i + 8]
        low, high, q = limits[c] or (None, None, {})
        quartiles = [q.get(s) for s in QUARTILES]
        out.append((i, c, rows, rows - some, mean, deviation, skew, least, *quartiles, most, low, high, below, above))
    return spark.createDataFrame(out, DISTRIBUTION)


def outliers(df: DataFrame, columns: list[str] | None = None, factor: float = 1.5) -> DataFrame:
    """The rows with a value outside the fences of its column, with those columns in ``outlier_columns``."""
    columns = _numbers(df, columns, "outliers")
    outside = []
    for c, limit in fences(df, columns, factor).items():
        if limit:
            x = _value(df, c)
            outside.append(F.when((x < F.lit(limit[0])) | (x > F.lit(limit[1])), F.lit(c)))
    if not outside:
        return df.limit(0).withColumn("outlier_columns", F.array().cast("array<string>"))
    return df.withColumn("outlier_columns", F.array_compact(F.array(*outside))).where(F.size("outlier_columns") > 0)


def _coefficient(x: Column, y: Column) -> Column:
    """Pearson's coefficient of two columns with the same gaps; null where one does not vary."""
    varies = (F.min(x) < F.max(x)) & (F.min(y) < F.max(y))
    return F.when(varies, F.covar_pop(x, y) / F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0)))


def average_ranks(df: DataFrame, column: str) -> DataFrame:
    """(value, rank) of the distinct values of a column without gaps; equal values share the mean of their ranks.

    Values are counted, and the counts added up within sorted ranges; what the ranges before have comes to one row
    a task, which the driver adds up.
    """
    counts = df.groupBy(F.col(quoted(column)).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    ranged = written(counts.repartitionByRange("value").withColumn("part", F.spark_partition_id()))
    before, shift = 0, [(-1, 0)]
    for row in sorted(ranged.groupBy("part").agg(F.sum("n").alias("n")).collect()):
        shift.append((row.part, before))
        before += row.n
    shifts = df.sparkSession.createDataFrame(shift, "part int, shift long")
    upto = F.sum("n").over(W.partitionBy("part").orderBy("value"))
    placed = ranged.withColumn("upto", upto).join(F.broadcast(shifts), "part")
    return placed.select("value", (F.col("shift") + F.col("upto") - (F.col("n") - 1) / 2.0).alias("rank"))


def _ranked(df: DataFrame, columns: list[str]) -> DataFrame:
    """The columns, none of which has gaps, by their ranks."""
    cells = out = df.select(*[F.col(quoted(c)).alias(f"x{i}") for i, c in enumerate(columns)])
    for i in range(len(columns)):
        ranks = average_ranks(cells, f"x{i}").select(F.col("value").alias(f"x{i}"), F.col("rank").alias(f"r{i}"))
        out = out.join(ranks, f"x{i}")
    return out.select(*[f"r{i}" for i in range(len(columns))])


def correlations(df: DataFrame, columns: list[str] | None = None, ranks: bool = True) -> DataFrame:
    """Pearson's and Spearman's coefficient of each pair of numeric columns, over the rows that have both.

    NaN counts as a gap. Where a coefficient has no value (fewer than two rows, a constant
    column), it is null. Columns without gaps share their ranks; a pair with gaps is ranked on its own.
    """
    columns = _numbers(df, columns, "correlations")
    spark, real = df.sparkSession, _real(df, columns)
    pairs = list(combinations(columns, 2))
    if not pairs:
        return spark.createDataFrame([], CORRELATIONS)

    wanted = [F.count(F.lit(1))]
    for a, b in pairs:
        x, y = F.col(quoted(a)).cast("double"), F.col(quoted(b)).cast("double")
        both = x.isNotNull() & y.isNotNull()
        wanted += [F.count_if(both), _coefficient(F.when(both, x), F.when(both, y))]
    rows, *cells = real.agg(*wanted).first()
    known = {p: (cells[2 * i], cells[2 * i + 1]) for i, p in enumerate(pairs)}
    rank: dict[tuple[str, str], float | None] = {}
    if ranks:
        gaps = real.agg(*[F.count(quoted(c)) for c in columns]).first()
        whole = [c for c, n in zip(columns, gaps, strict=True) if n == rows]
        groups = [whole] if len(whole) > 1 else []
        groups += [[a, b] for a, b in pairs if not {a, b} <= set(whole)]
        for group in groups:
            rows_of = real.select(*[quoted(c) for c in group]).dropna()
            own = list(combinations(range(len(group)), 2))
            found = _ranked(rows_of, group).agg(*[_coefficient(F.col(f"r{i}"), F.col(f"r{j}")) for i, j in own]).first()
            rank |= {(group[i], group[j]): v for (i, j), v in zip(own, found, strict=True)}
    out = [(a, b, known[a, b][0], known[a, b][1], rank.get((a, b))) for a, b in pairs]
    return spark.createDataFrame(out, CORRELATIONS)
