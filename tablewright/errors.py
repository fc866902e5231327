"""Errors raised while arguments are checked, before any Spark job starts."""


class OperationError(Exception):
    """An operation was given arguments it cannot work with."""


class UnknownOperationError(OperationError):
    """No operation is registered under that name."""


class SourceError(Exception):
    """A source could not be described or opened."""


class WorkingCopyError(Exception):
    """A working copy, its history or its export was used in a wrong way."""
