"""Exact medians and other quantiles without gathering a column in one place.

``percentile_approx``, one sketch a column, brackets each quantile between two values close to it. All
values outside the bracket are then replaced by the column's extremes, which
leaves the quantile where it was, and the few distinct values that remain are
counted and ranked. A bracket that may hold more than ``MAX_VALUES`` values is
narrowed first; if its ends are hot values that no sketch gets past, they are
counted and the search goes on between them. Every bracket is checked against exact counts, so the result
does not rest on the quality of the sketch.
"""

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.operators.frequency import frequencies
from tablewright.operators.result import quoted

# Every task sends one sketch of about this many entries to the merging task.
ACCURACY = 1_000
MARGIN = 2.0 / ACCURACY
MAX_VALUES = 1_000_000


@dataclass
class _Bracket:
    """Values ``lo..hi`` that hold the ranks ``first`` and ``second`` of the real (non-NaN) values."""

    rows: int  # with NaN
    real: int
    first: int
    second: int
    smallest: object
    largest: object
    lo: object
    hi: object
    below: int = 0
    inside: int = 0
    margin: float = MARGIN

    def reset(self) -> None:
        self.lo, self.hi, self.below, self.inside = self.smallest, self.largest, 0, self.real


def _real(df: DataFrame, column: str) -> Column:
    c = F.col(quoted(column))
    if isinstance(df.schema[column].dataType, (T.FloatType, T.DoubleType)):
        return F.when(~F.isnan(c), c)
    return c


def _near(cell: Column, share: float, margin: float) -> Column:
    return F.percentile_approx(cell, [max(0.0, share - margin), min(1.0, share + margin)], ACCURACY)


def _brackets(df: DataFrame, wanted: dict[str, tuple[str, float]]) -> dict[str, _Bracket]:
    """A bracket for each (column, share), by name; each column has one sketch."""
    shares: dict[str, list[float]] = {}
    for column, share in wanted.values():
        shares.setdefault(column, []).append(share)
    asked = []
    for i, (column, own) in enumerate(shares.items()):
        real = _real(df, column)
        points = [p for share in own for p in (max(0.0, share - MARGIN), min(1.0, share + MARGIN))]
        asked += [
            F.count(quoted(column)).alias(f"n{i}"),
            F.count(real).alias(f"real{i}"),
            F.min(real).alias(f"min{i}"),
            F.max(real).alias(f"max{i}"),
            F.percentile_approx(real, points, ACCURACY).alias(f"near{i}"),
        ]
    row = df.agg(*asked).first()
    place = {column: i for i, column in enumerate(shares)}
    out = {}
    for name, (column, share) in wanted.items():
        i, at = place[column], 2 * shares[column].index(share)
        n, smallest, largest = row[f"n{i}"], row[f"min{i}"], row[f"max{i}"]
        lo, hi = (row[f"near{i}"] or [None] * (at + 2))[at : at + 2]
        first, second = (math.floor((n - 1) * share), math.ceil((n - 1) * share)) if n else (-1, 0)
        out[name] = _Bracket(n, row[f"real{i}"], first, second, smallest, largest, lo, hi)
    return out


def _open(df: DataFrame, brackets: dict[str, _Bracket], columns: list[str]) -> list[str]:
    """Count both hot ends exactly and go on between them; returns the columns that are done.

    Those are held by at most two values now. Ends that hold next to nothing
    come from a sketch that broke its bound; there all that is left is ranked.
    """
    wanted = []
    for column in columns:
        b, real = brackets[column], _real(df, column)
        between = F.when((real > F.lit(b.lo)) & (real < F.lit(b.hi)), real)
        wanted += [F.count_if(real == F.lit(b.lo)), F.count_if(real == F.lit(b.hi)), F.min(between), F.max(between)]
    row = list(df.agg(*wanted).first())
    settled = []
    for i, column in enumerate(columns):
        b, (at_lo, at_hi, inner_lo, inner_hi) = brackets[column], row[4 * i : 4 * i + 4]
        start, end = b.below + at_lo, b.below + b.inside - at_hi  # ranks of the values between the ends
        if inner_lo is not None and start <= b.first and b.second < end:
            if at_lo + at_hi < MARGIN / 2 * b.inside:
                settled.append(column)
                continue
            b.lo, b.hi, b.below, b.inside, b.margin = inner_lo, inner_hi, start, end - start, MARGIN
            continue
        settled.append(column)
        if b.second < start:
            b.hi = b.lo
        elif b.first >= end:
            b.lo = b.hi
        elif inner_lo is not None:
            b.lo, b.hi = (b.lo, inner_lo) if b.first < start else (inner_hi, b.hi)
    return settled


def _narrow(df: DataFrame, brackets: dict[str, _Bracket]) -> None:
    """Shrink each bracket from the whole range until few values are left in it."""
    todo = list(brackets)
    for b in brackets.values():
        b.reset()
    while todo := [c for c in todo if brackets[c].inside > MAX_VALUES and brackets[c].lo != brackets[c].hi]:
        near, counts = [], []
        for column in todo:
            b, real = brackets[column], _real(df, column)
            cell = F.when(real.between(F.lit(b.lo), F.lit(b.hi)), real)
            near.append(_near(cell, (b.second - b.below) / b.inside, b.margin))
        proposed = df.agg(*near).first()
        for column, (lo, hi) in zip(todo, proposed):
            real = _real(df, column)
            counts += [F.count_if(real < F.lit(lo)), F.count_if(real.between(F.lit(lo), F.lit(hi)))]
        exact = list(df.agg(*counts).first())
        hot = []
        for i, (column, (lo, hi)) in enumerate(zip(todo, proposed)):
            b, below, inside = brackets[column], exact[2 * i], exact[2 * i + 1]
            if not below <= b.first <= b.second < below + inside:
                b.margin *= 4  # the sketch missed: ask for a wider bracket
            else:
                if inside == b.inside:
                    hot.append(column)  # the ends are hot values, so no quantile lies between them
                b.lo, b.hi, b.below, b.inside = lo, hi, below, inside
        hot = [c for c in hot if brackets[c].lo != brackets[c].hi]
        settled = _open(df, brackets, hot) if hot else []
        todo = [c for c in todo if c not in settled]


def _select(df: DataFrame, brackets: dict[str, _Bracket]) -> dict[str, tuple]:
    """The two middle values per column, ranked among the values left after clipping."""
    columns, clipped = list(brackets), []
    for column, b in brackets.items():
        real = _real(df, column)
        cell = F.when(real < F.lit(b.lo), F.lit(b.smallest)).when(real > F.lit(b.hi), F.lit(b.largest))
        clipped.append(cell.otherwise(real).cast(df.schema[column].dataType).alias(column))
    counted = frequencies(df.select(*clipped), columns, nulls=False)
    upto = W.partitionBy("column").orderBy(*counted.slots)
    after = F.sum("n").over(upto)
    wanted = F.lit(False)
    for i, b in enumerate(brackets.values()):
        for rank in {b.first, b.second}:
            here = (F.col("after") - F.col("n") <= rank) & (F.col("after") > rank)
            wanted = wanted | ((F.col("column") == str(i)) & here)
    hits = counted.table.withColumn("after", after).filter(wanted).orderBy("column", "after").collect()
    found: dict[str, tuple] = {}
    for row in hits:
        i = int(row["column"])
        value = row[f"v{counted.slot_of[i]}"]
        found[columns[i]] = (found.get(columns[i], (value,))[0], value)
    return found


def medians(df: DataFrame, columns: list[str]) -> dict[str, float | None]:
    """Exact, interpolated median per numeric column over its non-null values (NaN sorts last)."""
    return _exact(df, {c: (c, 0.5) for c in columns})


def quantiles(df: DataFrame, columns: list[str], shares: list[float]) -> dict[str, dict[float, float | None]]:
    """Exact quantiles of each numeric column, interpolated between the two values next to (n - 1) x share."""
    names = {f"q{i}_{j}": (c, share) for i, c in enumerate(columns) for j, share in enumerate(shares)}
    found = _exact(df, names)
    return {c: {share: found[f"q{i}_{j}"] for j, share in enumerate(shares)} for i, c in enumerate(columns)}


def _exact(df: DataFrame, wanted: dict[str, tuple[str, float]]) -> dict[str, float | None]:
    if not wanted:
        return {}
    out: dict[str, float | None] = {}
    live, wide = {}, {}
    for name, b in _brackets(df, wanted).items():
        if not b.rows:
            out[name] = None
        elif b.second >= b.real:
            out[name] = float("nan")
        else:
            live[name] = b
            # NaN shifts the ranks, and a large column keeps many values in its first bracket.
            if b.rows != b.real or b.real * 2 * MARGIN > MAX_VALUES:
                wide[name] = b
    if not live:
        return out
    if any(name != column for name, (column, _) in wanted.items()):  # one column stands under several names
        df = df.select(*[F.col(quoted(wanted[name][0])).alias(name) for name in live])
    _narrow(df, wide)
    found = _select(df, live)
    missed = {c: live[c] for c, (a, z) in found.items() if not live[c].lo <= a <= z <= live[c].hi}
    if missed:
        _narrow(df, missed)
        found.update(_select(df, missed))
    for name, (a, z) in found.items():
        share = wanted[name][1]
        part = (live[name].rows - 1) * share - live[name].first
        out[name] = (float(a) + float(z)) / 2 if part == 0.5 else float(a) + (float(z) - float(a)) * part
    return out
