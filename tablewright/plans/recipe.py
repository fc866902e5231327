"""Cleaning recipes: several operations in a row, planned by hand or from the data."""

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.errors import OperationError
from tablewright.functions.dates import DEFAULT_FORMATS
from tablewright.functions.numbers import pick_decimal
from tablewright.operators.dates import best_format, format_counts
from tablewright.operators.keys import find_keys, key_candidates, null_cells
from tablewright.operators.measure import Measure, measured
from tablewright.operators.numbers import mark_counts
from tablewright.operators.result import OpResult, data_columns, is_text, quoted
from tablewright.operators.text import text_report
from tablewright.plans.registry import apply_operation, operation
from tablewright.scratch import written

_LOG = T.StructType(
    [
        T.StructField("step", T.IntegerType()),
        T.StructField("op", T.StringType()),
        T.StructField("args", T.StringType()),
        T.StructField("error", T.StringType()),
    ]
)


@dataclass
class RecipeResult:
    """``frame`` after all steps, one log line per step, and each step's own result."""

    frame: DataFrame
    log: list[dict]
    results: list[OpResult | None]

    def log_table(self) -> DataFrame:
        return self.frame.sparkSession.createDataFrame(self.log, _LOG)


def run_recipe(df: DataFrame, steps: list[dict], on_error: str = "continue", max_steps: int | None = None) -> RecipeResult:
    """Run ``[{"op": ..., "args": {...}}, ...]`` on ``df``.

    Steps are composed into one lazy plan. Only when a step has to look at
    data that an earlier step shuffled is that data written once, so that
    looking does not repeat the shuffle. A failing step leaves a log line and
    the next one goes on, unless ``on_error="raise"``.
    """
    if on_error not in ("continue", "raise"):
        raise OperationError("'on_error' must be 'continue' or 'raise'")
    if max_steps is not None and len(steps) > max_steps:
        raise OperationError(f"a recipe has at most {max_steps} steps")
    frame, shuffled, log, results = df, False, [], []
    for number, step in enumerate(steps, 1):
        name, args = step["op"], step.get("args") or {}
        line = {"step": number, "op": name, "args": json.dumps(args, sort_keys=True, default=str), "error": None}
        result = None
        try:
            found = operation(name)
            if found.scans and shuffled:
                frame, shuffled = written(frame), False
            result = apply_operation(frame, name, args)
            if result.frame is not None:
                frame, shuffled = result.frame, shuffled or found.shuffles
        except OperationError as e:
            if on_error == "raise":
                raise
            line["error"] = str(e)
        log.append(line)
        results.append(result)
    return RecipeResult(frame, log, results)


def replay(journal: DataFrame, df: DataFrame, on_error: str = "continue", max_steps: int | None = None) -> RecipeResult:
    """Run the active operations of one working copy on another source, in their order.

    ``journal`` holds ``seq, op, args`` (JSON). A copy's history is what its
    user did by hand, so it is small enough to be read by the driver.
    """
    steps = [
        {"op": row["op"], "args": json.loads(row["args"] or "{}")}
        for row in journal.select("seq", "op", "args").orderBy("seq").collect()
    ]
    return run_recipe(df, steps, on_error, max_steps)


def column_signals(
    df: DataFrame, columns: list[str] | None = None, date_share: float = 0.5, number_share: float = 0.5
) -> list[dict]:
    """What the planner looks at, per column: nulls, date and number share of text, spellings.

    Shares refer to non-null cells, ``hollow_rows`` are the rows of which more than half is null. Text that mostly reads as dates or numbers
    is taken as such, and spellings are only counted for the rest. One scan answers
    all but the spellings, which take a second one.
    """
    columns = columns or data_columns(df)
    texts = [c for c in columns if is_text(df, c)]
    # "c12" would convert to 12; only cells without letters speak for a column of numbers.
    bare = {c: F.when(~F.col(quoted(c)).rlike(r"\p{L}"), F.col(quoted(c))) for c in texts}
    rows = Measure([], [F.count(F.lit(1))], next)
    hollow = Measure([(null_cells(df, columns) > len(columns) // 2).alias("_hollow")], [F.count_if("_hollow")], next)
    total, hollow_rows, dates, numbers = measured(df, rows, hollow, format_counts(df, columns, list(DEFAULT_FORMATS)), mark_counts(bare))
    out = []
    for c in columns:
        some = dates[c]["total"]
        best = best_format(dates[c]["parsed"])
        parsed = dates[c]["parsed"]
        n = numbers.get(c)
        as_number = n[pick_decimal(n["commas"], n["dots"])] if n else 0
        out.append(
            {
                "column": c,
                "rows": total,
                "nulls": total - some,
                "hollow_rows": hollow_rows,
                "format": best,
                "date_share": parsed[best] / some if best and some else 0.0,
                "number_share": as_number / some if some else 0.0,
                "collapsed_variants": 0,
            }
        )
    for s in out:
        s["kind"] = "other"
        if s["column"] in texts:
            dated, numbered = s["date_share"] >= date_share, s["number_share"] >= number_share
            s["kind"] = "dates" if dated else "numbers" if numbered else "text"
    plain = [s["column"] for s in out if s["kind"] == "text"]
    variants = {row["column"]: row["collapsed_variants"] for row in text_report(df, plain).collect()} if plain else {}
    return [{**s, "collapsed_variants": variants.get(s["column"], 0)} for s in out]


def inspection_order(signals: list[dict]) -> list[str]:
    """Columns worth a look, the most suspicious first.

    Those with nulls, with text that reads as dates or numbers, or with several spellings of one value; by the
    share of null or unread cells, then by spellings, then in the order of the table.
    """
    def doubt(s: dict) -> tuple[float, int]:
        read = {"dates": s["date_share"], "numbers": s["number_share"]}.get(s["kind"], 1.0)
        gaps = s["nulls"] / s["rows"] if s["rows"] else 0.0
        return gaps + (1 - gaps) * (1 - read), s["collapsed_variants"]

    odd = [s for s in signals if s["nulls"] or s["kind"] in ("dates", "numbers") or s["collapsed_variants"]]
    return [s["column"] for s in sorted(odd, key=lambda s: tuple(-x for x in doubt(s)))]


def repeated_key(df: DataFrame, columns: list[str] | None = None, min_share: float = 0.9) -> list[str] | None:
    """The columns that identify most rows but repeat in some: what a dedupe should go by. None if the rows have a real key."""
    candidates = [c for c in key_candidates(df) if columns is None or c in columns]
    found = find_keys(df, candidates, max_size=2, min_share=min_share, normalize_text=True) if candidates else []
    if any(not k["duplicates"] for k in found):
        return None
    return max(found, key=lambda k: k["distinct_count"])["columns"] if found else None


def suggest_recipe(
    df: DataFrame,
    key_columns: list[str] | str | None = None,
    columns: list[str] | None = None,
    date_share: float = 0.5,
    number_share: float = 0.5,
    order_by: list[str] | None = None,
    key_share: float = 0.9,
) -> list[dict]:
    """Steps the data calls for, in the fixed order dedupe, text, dates, numbers, drop, fill.

    Keys are deduplicated on their normalised form if they are named, or, with ``key_columns="find"``, if
    the search finds a combination of columns whose values are distinct in a share of ``key_share`` of the rows but not in all.
    Rows of which more than half of the cells are null are dropped. Text that
    mostly reads as dates or numbers is converted; other text with several
    spellings of one value is normalised; nulls, also those that parsing leaves, are filled with
    median or mode.
    """
    signals = column_signals(df, columns, date_share, number_share)
    dates = [s["column"] for s in signals if s["kind"] == "dates"]
    numbers = [s["column"] for s in signals if s["kind"] == "numbers"]
    texts = [s["column"] for s in signals if s["kind"] == "text" and s["collapsed_variants"] > 0]
    formats = [f for f in DEFAULT_FORMATS if f in {s["format"] for s in signals if s["kind"] == "dates"}]
    # Cells that parsing cannot read become null, so they are gaps as well.
    lost = {s["column"] for s in signals if (s["kind"] == "dates" and s["date_share"] < 1) or (s["kind"] == "numbers" and s["number_share"] < 1)}
    gaps = [s["column"] for s in signals if s["nulls"] < s["rows"] and (s["nulls"] or s["column"] in lost)]
    steps = []
    if key_columns == "find":
        key_columns = repeated_key(df, columns, key_share)
    if key_columns:
        args = {"columns": key_columns, "keep": "first", "normalize_text": True}
        steps.append({"op": "dedupe", "args": {**args, **({"order_by": order_by} if order_by else {})}})
    if texts:
        steps.append({"op": "normalize_text", "args": {"columns": texts}})
    if dates:  # the other formats have already lost
        steps.append({"op": "parse_dates", "args": {"columns": dates, "formats": formats}})
    if numbers:
        steps.append({"op": "normalize_numeric", "args": {"columns": numbers}})
    considered = [s["column"] for s in signals]
    half = len(considered) // 2 + 1
    if len(considered) > 1 and signals[0]["hollow_rows"]:
        args = {"columns": considered, "strategy": "drop_row", "min_pct_to_drop": half / len(considered)}
        steps.append({"op": "fillna", "args": args})
    if gaps:
        steps.append({"op": "fillna", "args": {"columns": gaps, "strategy": "auto"}})
    return steps
