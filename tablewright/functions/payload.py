"""JSON payloads carried by text columns."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from tablewright.functions.text import PY_WHITE_SPACE

_SUGGESTIONS = r"(?sU)SUGGESTIONS:[\s\x1C-\x1F]*(\[[^\n]*\])[\s\x1C-\x1F]*$"


def _is_string(v: Column) -> Column:
    return F.schema_of_variant(v) == "STRING"


def suggestions(c: Column) -> Column:
    """Strings of a trailing ``SUGGESTIONS:[...]`` line; null unless a non-empty list of strings."""
    raw = F.nullif(F.regexp_extract(c, _SUGGESTIONS, 1), F.lit(""))
    items = F.try_variant_get(F.try_parse_json(raw), "$", "array<variant>")
    valid = (F.size(items) > 0) & F.forall(items, lambda v: F.coalesce(_is_string(v), F.lit(False)))
    return F.when(valid, F.transform(items, lambda v: F.try_variant_get(v, "$", "string")))


def without_suggestions(c: Column) -> Column:
    """Text in front of a valid suggestions line (or the whole text), right-trimmed."""
    body = F.when(suggestions(c).isNotNull(), F.regexp_replace(c, _SUGGESTIONS, "")).otherwise(c)
    return F.rtrim(body, F.lit(PY_WHITE_SPACE))


def tool_names(payload: Column) -> Column:
    """Names in ``tool_calls`` of a JSON payload; entries without a text name are left out."""
    calls = F.try_variant_get(F.try_parse_json(payload), "$.tool_calls", "array<variant>")
    names = F.transform(calls, lambda v: F.try_variant_get(v, "$.name", "variant"))
    texts = F.filter(names, lambda v: F.coalesce(_is_string(v), F.lit(False)))
    return F.coalesce(
        F.transform(texts, lambda v: F.try_variant_get(v, "$", "string")),
        F.array().cast("array<string>"),
    )


def usage_total(payload: Column, prompt: str = "$.prompt", completion: str = "$.completion") -> Column:
    """Prompt plus completion tokens of a JSON usage record; a missing count is zero."""
    usage = F.try_parse_json(payload)
    counts = [F.coalesce(F.try_variant_get(usage, path, "bigint"), F.lit(0)) for path in (prompt, completion)]
    return F.when(usage.isNotNull(), counts[0] + counts[1])
