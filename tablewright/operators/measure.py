"""Several questions about a table, answered by one aggregate over one scan."""

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame


@dataclass(frozen=True)
class Measure:
    """``cells`` are computed once per row, ``wanted`` aggregates them, ``read`` takes its part of the answer."""

    cells: list[Column]
    wanted: list[Column]
    read: Callable[[Iterator], Any]


def measured(df: DataFrame, *measures: Measure) -> list:
    cells = [c for m in measures for c in m.cells]
    wanted = [w for m in measures for w in m.wanted]
    answers = iter(df.select(*cells).agg(*wanted).first() if wanted else ())
    return [m.read(answers) for m in measures]
