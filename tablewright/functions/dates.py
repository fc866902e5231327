"""Date and time text: candidate formats and parsing."""

import re
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# Formats tried when the caller names none, in order of preference.
DEFAULT_FORMATS = (
    "%Y-%m-%d",
    "%Y-%m-%dT%H:%M:%S",
    "%Y-%m-%d %H:%M:%S",
    "%d/%m/%Y",
    "%d-%m-%Y",
    "%m/%d/%Y",
    "%d/%m/%Y %H:%M",
    "%d-%m-%Y %H:%M:%S",
)

# strftime letter -> Spark datetime pattern (single letters take padded and unpadded input)
# and the cells it can read. A cell of another shape is not parsed at all: failing there
# costs far more than the comparison.
_DIRECTIVES = {
    "Y": ("yyyy", r"\d{4}"),
    "y": ("yy", r"\d{2}"),
    "m": ("M", r"(?:0?[1-9]|1[0-2])"),
    "d": ("d", r"(?:0?[1-9]|[12]\d|3[01])"),
    "e": ("d", r"(?:0?[1-9]|[12]\d|3[01])"),
    "H": ("H", r"(?:[01]?\d|2[0-3])"),
    "I": ("h", r"(?:0?[1-9]|1[0-2])"),
    "M": ("m", r"[0-5]?\d"),
    "S": ("s", r"[0-5]?\d"),
    "f": ("SSSSSSSSS", r"\d{1,9}"),
    "3f": ("SSS", r"\d{3}"),
    "6f": ("SSSSSS", r"\d{6}"),
    "9f": ("SSSSSSSSS", r"\d{9}"),
    ".f": ("[.SSSSSSSSS]", r"(?:\.\d{1,9})?"),
    ".3f": (".SSS", r"\.\d{3}"),
    ".6f": (".SSSSSS", r"\.\d{6}"),
    ".9f": (".SSSSSSSSS", r"\.\d{9}"),
    "p": ("a", "[AaPp][Mm]"),
    "b": ("MMM", r"\p{L}+\.?"),
    "B": ("MMMM", r"\p{L}+"),
    "j": ("D", r"\d{1,3}"),
    "z": ("xx", r"[+-]\d{4}"),
    "%": ("%", "%"),
}
_SHORTHANDS = {"%F": "%Y-%m-%d", "%T": "%H:%M:%S", "%R": "%H:%M", "%D": "%m/%d/%y"}


@dataclass(frozen=True)
class DateFormat:
    """A strftime format as Spark's pattern and as the shape of the cells it reads."""

    pattern: str
    shape: str
    short_year: bool = False  # two digits: 69 to 99 belong to the last century

    def looks_right(self, c: Column) -> Column:
        return c.rlike(rf"\A(?:{self.shape})\z")

    def parse(self, c: Column) -> Column:
        """Timestamp without zone, or null where the whole cell does not follow the format."""
        fitting = F.when(self.looks_right(c), F.try_to_timestamp(c, F.lit(self.pattern))).cast("timestamp_ntz")
        if not self.short_year:
            return fitting
        earlier = fitting - F.make_ym_interval(F.lit(100))
        return F.when(F.year(fitting) > 2068, earlier).otherwise(fitting)


def date_format(strftime: str) -> DateFormat | None:
    """Spark's view of a strftime format; ``None`` if a directive has no counterpart."""
    for short, long in _SHORTHANDS.items():
        strftime = strftime.replace(short, long)
    pattern, shape, literal, at = "", "", "", 0
    while at < len(strftime):
        if strftime[at] != "%":
            literal += strftime[at]
            at += 1
            continue
        directive = re.match(r"%(\.?[369]?f|.?)", strftime[at:], re.DOTALL)[1]
        at += 1 + len(directive)
        found = _DIRECTIVES.get(directive)
        if found is None:
            return None
        pattern += _quote(literal) + found[0]
        shape += re.escape(literal) + found[1]
        literal = ""
    return DateFormat(pattern + _quote(literal), shape + re.escape(literal), "%y" in strftime.replace("%%", ""))


def any_shape(formats: Iterable[DateFormat]) -> str:
    """Pattern of the cells that at least one of the formats can read."""
    return r"\A(?:" + "|".join(f.shape for f in formats) + r")\z"


def _quote(literal: str) -> str:
    if not any(ch.isalpha() or ch in "'[]{}#" for ch in literal):
        return literal
    return "'" + literal.replace("'", "''") + "'"
