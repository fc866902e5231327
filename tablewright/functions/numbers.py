"""Column expressions for numbers written as text."""

from pyspark.sql import Column
from pyspark.sql import functions as F

_NUMBER = r"\A[+-]?+(?:\d++\.?+\d*+|\.\d++)(?:[eE][+-]?+\d++)?+\z"


def count_char(c: Column, char: str) -> Column:
    """How often ``char`` occurs in a cell."""
    return F.char_length(c) - F.char_length(F.replace(c, F.lit(char), F.lit("")))


def pick_decimal(commas: int, dots: int) -> str:
    """Decimal mark of a column from the number of commas and dots in all its cells.

    The rarer mark is the decimal one; on a tie it is the dot. A column that
    holds only commas therefore reads ``1,200`` as 1.2.
    """
    if commas == 0:
        return "."
    if dots == 0:
        return ","
    return "." if dots <= commas else ","


def number_chars(c: Column) -> Column:
    """What is left of a cell without all but digits, signs, marks and ``e``."""
    return F.regexp_replace(c, r"[^0-9eE+\-.,]", "")


def plain_number(kept: Column, decimal: str) -> Column:
    """``number_chars`` without thousands marks and with a dot as decimal mark."""
    if decimal == ",":
        return F.translate(kept, ",.", ".")
    return F.replace(kept, F.lit(","), F.lit(""))


def is_number(plain: Column) -> Column:
    """Whether ``plain_number`` text converts; far cheaper than a cast that fails."""
    return plain.rlike(_NUMBER)


def to_number(c: Column, decimal: str) -> Column:
    """Double from text; null if the characters that count form no number."""
    return plain_number(number_chars(c), decimal).try_cast("double")
