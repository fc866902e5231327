"""Schema reports: what a source looks like, with a few sample values."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.operators.result import ROW_ID, quoted

SAMPLE_ROWS = 5


def sample(df: DataFrame, n: int = SAMPLE_ROWS, order_by: list[str] | None = None) -> DataFrame:
    """First rows in the given order, or in the order of the source; reads no more than it needs."""
    ordered = df.orderBy(*[quoted(c) for c in order_by]) if order_by else df
    return ordered.limit(n)


def schema_report(df: DataFrame, order_by: list[str] | None = None, nullable: dict[str, bool] | None = None) -> DataFrame:
    """Name, type, nullability and sample values (null as ``""``) of each column.

    Files do not declare nullability, so all rows are asked; a
    database knows it and passes it as ``nullable``.
    """
    columns = [c for c in df.columns if c != ROW_ID]
    rows = sample(df.select(*[quoted(c) for c in columns]) if not order_by else df, SAMPLE_ROWS, order_by)
    numbered = rows.select(*[_as_text(df, c).alias(f"c{i}") for i, c in enumerate(columns)])
    # Five rows at most are gathered here.
    gathered = numbered.agg(F.collect_list(F.struct(*numbered.columns)).alias("rows"))
    asked = [c for c in columns if not nullable or c not in nullable]
    if asked:
        holes = df.agg(F.struct(*[(F.count_if(F.col(quoted(c)).isNull()) > 0).alias(f"n{columns.index(c)}") for c in asked]).alias("holes"))
        gathered = gathered.crossJoin(holes)  # one row each
    fields = []
    for i, c in enumerate(columns):
        cells = F.col("rows").getField(f"c{i}")
        seen = F.col("holes").getField(f"n{i}") if c in asked else None
        fields.append(
            F.struct(
                F.lit(i).alias("position"),
                F.lit(c).alias("name"),
                F.lit(df.schema[c].dataType.simpleString()).alias("dtype"),
                (F.lit(nullable[c]) if seen is None else seen).alias("nullable"),
                F.transform(cells, lambda v: F.coalesce(v, F.lit(""))).alias("sample_values"),
            )
        )
    return gathered.select(F.inline(F.array(*fields)))


def _as_text(df: DataFrame, column: str):
    c = F.col(quoted(column))
    nested = isinstance(df.schema[column].dataType, (T.ArrayType, T.StructType, T.MapType, T.VariantType))
    return F.to_json(c) if nested else c.cast("string")
