"""Column expressions for text: trimming, case, accents, slugs, titles.

Everything stays on the JVM except accent removal, which has no built-in
counterpart; there only cells with non-ASCII characters are sent to Python.
"""

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The Unicode White_Space code points.
WHITE_SPACE = (
    "\u0009\u000a\u000b\u000c\u000d\u0020\u0085\u00a0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
# Python's str.split/strip also treat the four separators 1C-1F as blanks.
PY_WHITE_SPACE = WHITE_SPACE + "\u001c\u001d\u001e\u001f"

CASES = ("lower", "upper", "title", "preserve")
SLUG_LENGTH = 60
TITLE_LENGTH = 80


def strip_ws(c: Column) -> Column:
    """Trim Unicode white space at both ends (``trim`` alone knows only U+0020)."""
    return F.btrim(c, F.lit(WHITE_SPACE))


def collapse_ws(c: Column) -> Column:
    """Replace every run of Unicode white space by one blank."""
    return F.regexp_replace(c, r"(?U)\s+", " ")


_WORD_START = r"(?<=[^\p{IsAlphabetic}\p{N}])(?=[\p{IsAlphabetic}\p{N}])"


def title_case(c: Column) -> Column:
    """Upper-case each letter that follows a non-alphanumeric, lower-case the rest."""
    words = F.split(F.lower(c), _WORD_START)
    capital = F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substr(w, F.lit(2))))
    return F.array_join(capital, "")


class _Unaccented(dict):
    """Code point -> its NFKD form without combining marks, worked out when first met."""

    def __missing__(self, cp: int) -> str:
        parts = unicodedata.normalize("NFKD", chr(cp))
        self[cp] = plain = "".join(ch for ch in parts if not unicodedata.combining(ch))
        return plain


_UNACCENTED = _Unaccented()


@F.pandas_udf(T.StringType())
def _fold(cells: pd.Series) -> pd.Series:
    return cells.map(lambda v: v.translate(_UNACCENTED), na_action="ignore")


def _non_ascii(c: Column) -> Column:
    return F.octet_length(c) != F.char_length(c)


def strip_accents(c: Column) -> Column:
    """NFKD without combining marks: ``México ﬁ`` becomes ``Mexico fi``."""
    return F.when(_non_ascii(c), _fold(F.when(_non_ascii(c), c))).otherwise(c)


def clean_text(
    c: Column,
    case: str = "title",
    strip: bool = True,
    collapse_spaces: bool = True,
    remove_accents: bool = False,
) -> Column:
    """The whole text normalisation as one expression, in its fixed order."""
    if strip:
        c = strip_ws(c)
    if collapse_spaces:
        c = collapse_ws(c)
    if case == "lower":
        c = F.lower(c)
    elif case == "upper":
        c = F.upper(c)
    elif case == "title":
        c = title_case(c)
    return strip_accents(c) if remove_accents else c


def compact_key(c: Column) -> Column:
    """Stand-in for text that is only compared: itself, or its SHA-256 if it is longer than that.

    Keys made of whole documents would otherwise travel and be sorted twice.
    Only long text becomes 65 bytes, so it cannot meet a short one.
    """
    return F.when(F.octet_length(c) <= 64, c).otherwise(F.concat(F.lit("#"), F.sha2(c, 256)))


def match_key(c: Column) -> Column:
    """Form under which two spellings count as the same key."""
    return F.lower(strip_ws(c))


def slug(c: Column) -> Column:
    """ASCII, lower case, hyphenated, at most 60 characters; may be empty."""
    ascii_only = F.regexp_replace(strip_accents(c), r"[^\x00-\x7F]", "")
    hyphenated = F.regexp_replace(F.lower(ascii_only), "[^a-z0-9]+", "-")
    return F.substring(F.btrim(hyphenated, F.lit("-")), 1, SLUG_LENGTH)


def slug_with_suffix(base: Column, unique: Column) -> Column:
    """Append two hyphens and ``unique`` in a form that no other id has, at most 60 characters for integers.

    Plain slugs never hold two hyphens in a row, so neither they nor other
    suffixed ones can be equal to it, and a retried task writes the same slug again.
    """
    text = unique.cast("string")
    suffix = F.when(text.rlike(r"^-?(0|[1-9]\d{0,17})$"), F.lower(F.conv(text, 10, 36))).otherwise(
        F.concat(F.lit("z"), F.lower(F.hex(text)), F.lit("z"))
    )
    head = F.substr(base, F.lit(1), F.greatest(F.lit(1), SLUG_LENGTH - 2 - F.char_length(suffix)))
    return F.concat(F.when(head == "", F.lit("row")).otherwise(head), F.lit("--"), suffix)


def one_line_title(c: Column) -> Column:
    """All blanks collapsed, first 80 characters."""
    runs = F.regexp_replace(F.btrim(c, F.lit(PY_WHITE_SPACE)), r"(?U)[\s\x1C-\x1F]+", " ")
    return F.substring(runs, 1, TITLE_LENGTH)
