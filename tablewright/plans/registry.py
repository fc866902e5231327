"""Operations by name. Anyone can add one: a function from (DataFrame, options) to OpResult."""

import inspect
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame

from tablewright.errors import OperationError, UnknownOperationError
from tablewright.operators.dates import parse_dates
from tablewright.operators.dedupe import dedupe, preview_duplicates
from tablewright.operators.fill import fillna
from tablewright.operators.inspect import inspect_column
from tablewright.operators.numbers import normalize_numeric
from tablewright.operators.result import OpResult
from tablewright.operators.text import normalize_text


@dataclass(frozen=True)
class Operation:
    """``mutating``: returns a new table. ``scans``: looks at the data before it can build its plan.
    ``shuffles``: its plan moves rows between tasks, so computing it twice is costly."""

    name: str
    run: Callable[..., OpResult]
    mutating: bool = True
    scans: bool = False
    shuffles: bool = False


_OPERATIONS: dict[str, Operation] = {}


def register_op(
    name: str, run: Callable[..., OpResult], mutating: bool = True, scans: bool = False, shuffles: bool = False
) -> None:
    _OPERATIONS[name] = Operation(name, run, mutating, scans, shuffles)


def operation(name: str) -> Operation:
    if name not in _OPERATIONS:
        raise UnknownOperationError(f"unknown operation '{name}', use one of {', '.join(sorted(_OPERATIONS))}")
    return _OPERATIONS[name]


def is_mutating(name: str) -> bool:
    return name in _OPERATIONS and _OPERATIONS[name].mutating


def apply_operation(df: DataFrame, name: str, args: dict | None = None) -> OpResult:
    """Run one operation; unknown names and unfitting arguments raise before any job."""
    found = operation(name)
    try:
        bound = inspect.signature(found.run).bind(df, **(args or {}))
    except TypeError as e:
        raise OperationError(f"{name}: {e}") from e
    return found.run(*bound.args, **bound.kwargs)


register_op("dedupe", dedupe, shuffles=True)
register_op("fillna", fillna, scans=True)
register_op("normalize_text", normalize_text)
register_op("parse_dates", parse_dates, scans=True)
register_op("normalize_numeric", normalize_numeric, scans=True)
register_op("inspect_column", inspect_column, mutating=False, scans=True)
register_op("preview_duplicates", preview_duplicates, mutating=False, scans=True)
