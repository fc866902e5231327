"""The part of the library that also runs on streams.

Row-local steps need no state: with the choice passed in (a date format, a
decimal mark, a fill value) they are the batch expressions unchanged. Counting
and deduplicating keep state that a watermark bounds.
"""

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from tablewright.errors import OperationError
from tablewright.functions.dates import date_format
from tablewright.functions.numbers import to_number
from tablewright.functions.text import clean_text, match_key
from tablewright.operators.events import over_limit
from tablewright.operators.fill import drop_threshold
from tablewright.operators.result import is_text, quoted, replace_columns, require_columns


def clean_columns(stream: DataFrame, columns: list[str], **options) -> DataFrame:
    """Text normalisation; columns that are not text are passed over."""
    texts = [c for c in require_columns(stream, columns, "clean_columns") if is_text(stream, c)]
    return replace_columns(stream, {c: clean_text(F.col(quoted(c)), **options) for c in texts})


def parse_columns(stream: DataFrame, formats: dict[str, str]) -> DataFrame:
    """Dates by a known strftime format per column."""
    known = {c: date_format(f) for c, f in formats.items()}
    unknown = [formats[c] for c, f in known.items() if f is None]
    if unknown:
        raise OperationError(f"formats without a counterpart: {', '.join(unknown)}")
    return replace_columns(stream, {c: f.parse(F.col(quoted(c))) for c, f in known.items()})


def number_columns(stream: DataFrame, decimals: dict[str, str]) -> DataFrame:
    """Numbers by a known decimal mark per column."""
    return replace_columns(stream, {c: to_number(F.col(quoted(c)), mark) for c, mark in decimals.items()})


def fill_columns(stream: DataFrame, values: dict) -> DataFrame:
    """Nulls by a known value per column."""
    return replace_columns(stream, {c: F.coalesce(F.col(quoted(c)), F.lit(v)) for c, v in values.items()})


def drop_sparse_rows(stream: DataFrame, columns: list[str], min_pct: float = 0.5) -> DataFrame:
    """Drop rows with too many nulls among ``columns``."""
    empty = F.lit(0)
    for c in require_columns(stream, columns, "drop_sparse_rows"):
        empty = empty + F.col(quoted(c)).isNull().cast("int")
    return stream.filter(empty < drop_threshold(min_pct, len(columns)))


def _watermarked(stream: DataFrame, at: str, delay: str) -> DataFrame:
    """Watermarks ask for a timestamp with zone; one without is read in the session's zone."""
    return stream.withColumn(at, F.col(quoted(at)).cast("timestamp")).withWatermark(at, delay)


def dedupe_stream(
    stream: DataFrame, columns: list[str], at: str, delay: str, keep: str = "first", normalize_text: bool = False
) -> DataFrame:
    """First row per key within the watermark's delay; the last row of an endless stream never comes."""
    columns = require_columns(stream, columns, "dedupe_stream")
    if keep != "first":
        raise OperationError("a stream can only keep the first row of a key")
    keyed, keys = stream, []
    for i, c in enumerate(columns):
        key = F.col(quoted(c))
        keyed = keyed.withColumn(f"_key{i}", match_key(key) if normalize_text and is_text(stream, c) else key)
        keys.append(f"_key{i}")
    kept = _watermarked(keyed, at, delay).dropDuplicatesWithinWatermark(keys).drop(*keys)
    return kept.withColumn(at, F.col(quoted(at)).cast(stream.schema[at].dataType))


def over_limit_stream(stream: DataFrame, client: str, at: str, limit: int, window: str, delay: str) -> DataFrame:
    """Clients over their limit, window by window, once the watermark has closed it."""
    return over_limit(_watermarked(stream, at, delay), client, at, limit, window)


def append_stream(stream: DataFrame, append: Callable[[DataFrame], None], checkpoint: str) -> DataStreamWriter:
    """Hand each micro-batch to an appending sink, such as the audit log."""
    return stream.writeStream.foreachBatch(lambda batch, _: append(batch)).option("checkpointLocation", checkpoint)
