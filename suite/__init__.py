"""Registered queries: each one names its Spark form and the SQL that must give the same rows."""

from suite import analysis, catalog, cleaning, events, plans, profiling, sources, streams
from suite.base import Query

ALL: list[Query] = [
    q for module in (cleaning, profiling, analysis, plans, catalog, events, sources, streams) for q in module.QUERIES
]
