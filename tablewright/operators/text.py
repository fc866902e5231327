"""Text normalisation of whole columns."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.errors import OperationError
from tablewright.functions.text import CASES, clean_text, compact_key
from tablewright.operators.result import OpResult, is_text, quoted, replace_columns, require_columns, rows_of, same_rows


def normalize_text(
    df: DataFrame,
    columns: list[str],
    case: str = "title",
    strip: bool = True,
    collapse_spaces: bool = True,
    remove_accents: bool = False,
) -> OpResult:
    """Trim, collapse blanks, set the case and optionally drop accents.

    Columns that are not text are passed over. The report counts distinct
    values (null is one) before and after, and how many spellings fell together.
    """
    columns = require_columns(df, columns, "normalize_text")
    if case not in CASES:
        raise OperationError(f"'case' must be one of {', '.join(CASES)}")
    options = dict(case=case, strip=strip, collapse_spaces=collapse_spaces, remove_accents=remove_accents)
    texts = [c for c in columns if is_text(df, c)]
    frame = replace_columns(df, {c: clean_text(F.col(quoted(c)), **options) for c in texts})
    report = text_report(df, texts, **options)

    def summarise(known) -> dict:
        found = {row["column"]: row for row in rows_of(report)}
        zero = {"distinct_before": 0, "distinct_after": 0, "collapsed_variants": 0}
        applied = [{"column": c, **options, **{k: found.get(c, zero)[k] for k in zero}} for c in texts]
        return {"op": "normalize_text", "applied": applied, **same_rows(known, df)}

    def draw(s: dict) -> list[dict]:
        return [{"kind": "normalize_text_summary", "applied": s["applied"]}] if s["applied"] else []

    return OpResult(frame, report, summarise, draw)


def text_report(df: DataFrame, texts: list[str], **options) -> DataFrame:
    """Distinct values per column before and after.

    Cells are normalised where they are read; only digests of long texts, before and
    after, are shuffled, and both counts come out of the same chain of aggregates.
    """
    if not texts:
        schema = "column string, distinct_before bigint, distinct_after bigint, collapsed_variants bigint"
        return df.sparkSession.createDataFrame([], schema)
    cells = df.select(*[F.col(quoted(c)).cast("string").alias(f"c{i}") for i, c in enumerate(texts)])
    names = F.array(*[F.lit(c) for c in texts])
    cells = cells.unpivot([], cells.columns, "slot", "cell")
    cell = F.col("cell")
    keys = [compact_key(cell).alias("before"), compact_key(clean_text(cell, **options)).alias("after")]
    after = cells.select("slot", *keys).distinct()
    return (
        after.groupBy("slot", "after")
        .agg(F.count(F.lit(1)).alias("spellings"))
        .groupBy("slot")
        .agg(F.sum("spellings").alias("distinct_before"), F.count(F.lit(1)).alias("distinct_after"))
        .select(
            names[F.substr("slot", F.lit(2)).cast("int")].alias("column"),
            "distinct_before",
            "distinct_after",
            F.greatest(F.lit(0).cast("bigint"), F.col("distinct_before") - F.col("distinct_after")).alias(
                "collapsed_variants"
            ),
        )
    )
