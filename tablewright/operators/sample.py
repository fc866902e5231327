"""A sample of exactly n rows that is the same however the table is cut."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.errors import OperationError
from tablewright.operators.profile import profile
from tablewright.operators.result import data_columns, quoted, require_columns

SAMPLE_ROWS = 100_000
_DIGITS = 15  # of the digest that are compared as a number
_SPACE = 16**_DIGITS


def row_digest(columns: list[str]) -> Column:
    """MD5 of the columns as text, each behind its length, so that no two rows run together; of one column, of its text alone."""
    if len(columns) == 1:
        return F.md5(F.coalesce(F.col(quoted(columns[0])).cast("string"), F.lit("")))
    parts = [F.coalesce(F.to_json(F.struct(F.col(quoted(c)).alias("v"))), F.lit("{}")) for c in columns]
    return F.md5(F.concat(*[x for p in parts for x in (F.char_length(p).cast("string"), F.lit(":"), p)]))


def bounded_sample(df: DataFrame, n: int = SAMPLE_ROWS, columns: list[str] | None = None) -> DataFrame:
    """The ``n`` rows with the smallest digests of ``columns`` (by default all), or all rows if there are fewer.

    A retried task, another order of the rows or another number of tasks gives the same rows; rows with equal digests
    are ordered by the columns. Rows are counted first: only those below a bound that leaves little more than ``n`` are sorted, so that no task
    gathers n rows of each other one.
    """
    columns = data_columns(df) if columns is None else require_columns(df, columns, "bounded_sample")
    if n < 0:
        raise OperationError("'n' must not be negative")
    marked = df.withColumn("_digest", row_digest(columns))
    near = F.conv(F.substring("_digest", 1, _DIGITS), 16, 10).cast("bigint")
    rows = df.count()
    few, share = marked, min(1.0, (1.2 * n + 100) / rows) if rows else 1.0
    while share < 1:
        few = marked.where(near < int(share * _SPACE))
        if few.count() >= n:
            break
        few, share = marked, share * 2  # many rows with equal digests
    order = [F.col(quoted(c)) for c in columns if df.schema[c].dataType.typeName() not in ("map", "variant")]
    return few.orderBy("_digest", *order).limit(n).drop("_digest")


def sampled_profile(df: DataFrame, n: int = SAMPLE_ROWS, columns: list[str] | None = None) -> DataFrame:
    """The profile of a bounded sample."""
    return profile(bounded_sample(df, n, columns))
