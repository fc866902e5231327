"""Duplicate rows: preview and removal."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tablewright.errors import OperationError
from tablewright.functions.text import compact_key, match_key
from tablewright.operators.result import (
    ROW_ID,
    OpResult,
    before_after,
    is_text,
    quoted,
    require_columns,
    row_counts,
    rows_of,
    same_rows,
)

EXAMPLE_GROUPS = 8
_RANK = "_keep_rank"


def row_keys(df: DataFrame, columns: list[str], normalize_text: bool, compact: bool = True) -> list[Column]:
    keys = []
    for name in columns:
        key = F.col(quoted(name))
        if is_text(df, name):
            key = match_key(key) if normalize_text else key
            key = compact_key(key) if compact else key
        keys.append(key)
    return keys


def dedupe(
    df: DataFrame,
    columns: list[str],
    keep: str = "first",
    normalize_text: bool = False,
    order_by: list[str] | None = None,
) -> OpResult:
    """Keep one row per key; null keys are equal to each other.

    ``order_by`` says what "first" means; without it the row order of a
    working copy counts, or else the order in which Spark reads the frame.
    With ``normalize_text`` text keys are compared trimmed and in lower case,
    while the surviving row keeps its spelling.

    Each task drops all but its best row per key before the shuffle, so a key
    that owns a third of the table arrives as one row per task.
    """
    columns = require_columns(df, columns, "dedupe")
    if keep not in ("first", "last"):
        raise OperationError("'keep' must be 'first' or 'last'")
    if order_by is not None:
        require_columns(df, order_by, "order_by")
    elif ROW_ID in df.columns:
        order_by = [ROW_ID]
    keys = row_keys(df, columns, normalize_text)
    order = [F.col(quoted(c)) for c in order_by] if order_by else [F.monotonically_increasing_id()]
    if keep == "last":
        order = [c.desc() for c in order]
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    frame = df.withColumn(_RANK, rank).filter(F.col(_RANK) == 1).drop(_RANK)

    groups = df.select(*[k.alias(f"k{i}") for i, k in enumerate(keys)])
    groups = groups.groupBy(*groups.columns).agg(F.count(F.lit(1)).alias("n"))
    report = groups.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows_before"),
        F.count(F.lit(1)).alias("rows_after"),
    ).withColumn("removed", F.col("rows_before") - F.col("rows_after"))

    def summarise(known) -> dict:
        return {
            "op": "dedupe",
            "columns": columns,
            "keep": keep,
            "normalize_text": normalize_text,
            **row_counts(known, report),
        }

    def draw(s: dict) -> list[dict]:
        return [before_after("rows", s["rows_before"], s["rows_after"], "positive" if s["removed"] > 0 else "neutral")]

    return OpResult(frame, report, summarise, draw)


def duplicate_groups(
    df: DataFrame, columns: list[str], normalize_text: bool = False, compact: bool = False
) -> DataFrame:
    """Keys that occur more than once, with their ``count``; ``compact`` gives long text as digests."""
    keys = [k.alias(c) for k, c in zip(row_keys(df, columns, normalize_text, compact), columns)]
    counted = df.select(*keys).groupBy(*[quoted(c) for c in columns]).agg(F.count(F.lit(1)).alias("_n"))
    return counted.filter("_n > 1").withColumnRenamed("_n", "count")


def duplicate_examples(groups: DataFrame, n: int = EXAMPLE_GROUPS) -> DataFrame:
    """The largest groups, ties by key."""
    keys = [quoted(c) for c in groups.columns[:-1]]
    return groups.orderBy(F.desc("count"), *keys).limit(n)


def duplicate_totals(groups: DataFrame) -> DataFrame:
    """Number of groups, and of rows a dedupe on the same key would remove."""
    return groups.agg(
        F.count(F.lit(1)).alias("duplicate_groups"),
        F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("total_duplicates"),
    )


def preview_duplicates(df: DataFrame, columns: list[str], normalize_text: bool = False) -> OpResult:
    """What a dedupe would find, without removing anything.

    ``normalize_text`` is off unless asked for, so by default the preview
    compares keys as they are written.
    """
    columns = require_columns(df, columns, "preview_duplicates")
    groups = duplicate_groups(df, columns, normalize_text)
    examples = duplicate_examples(groups)
    compact = duplicate_groups(df, columns, normalize_text, compact=True)

    def summarise(known) -> dict:
        found = [
            {"key": {c: None if v is None else str(v) for c, v in zip(columns, row)}, "count": row[-1]}
            for row in examples.collect()
        ]
        totals = rows_of(duplicate_totals(compact))[0]
        return {
            "op": "preview_duplicates",
            "columns": columns,
            "total_rows": same_rows(known, df)["rows_after"],
            **totals,
            "example_groups": found,
        }

    def draw(s: dict) -> list[dict]:
        if not s["duplicate_groups"]:
            return []
        shown = ("columns", "duplicate_groups", "total_duplicates", "example_groups")
        return [{"kind": "duplicate_preview", **{k: s[k] for k in shown}}]

    return OpResult(None, examples, summarise, draw)
