"""Datasets by kind, and the import of many tables at once."""

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.errors import SourceError
from tablewright.operators.catalog import unique_violations
from tablewright.sources.files import read_csv, read_parquet
from tablewright.sources.jdbc import read_table
from tablewright.sources.workbook import read_workbook

CATALOG = "dataset_id string, name string, kind string, locator map<string,string>, schema string"


def _table(kind: str) -> Callable[[SparkSession, dict], DataFrame]:
    def read(spark: SparkSession, locator: dict) -> DataFrame:
        split = {k: locator[k] for k in ("limit", "partition_column", "bounds", "partitions") if k in locator}
        return read_table(spark, kind, locator["config"], locator["schema"], locator["table"], **split)

    return read


_READERS: dict[str, Callable[[SparkSession, dict], DataFrame]] = {
    "csv": lambda spark, at: read_csv(spark, at["path"]),
    "parquet": lambda spark, at: read_parquet(spark, at["path"]),
    "xlsx": lambda spark, at: read_workbook(spark, at["path"], at.get("sheet")),
    "query": lambda spark, at: spark.sql(at["sql"]),
    "postgres": _table("postgres"),
    "mssql": _table("mssql"),
    "mssql_azure": _table("mssql_azure"),
}


def read_dataset(spark: SparkSession, kind: str, locator: dict) -> DataFrame:
    """Open a dataset by its kind; files are located by ``path``, tables by ``config, schema, table``,
    and a ``query`` is a SELECT over the views of the session.
    """
    if kind not in _READERS:
        raise SourceError(f"unknown source kind '{kind}', use one of {', '.join(sorted(_READERS))}")
    return _READERS[kind](spark, locator)


def import_tables(
    spark: SparkSession,
    catalog: DataFrame,
    requests: list[tuple[str, str, str | None]],
    open_table: Callable[[str, str], DataFrame],
    kind: str = "table",
    max_tables: int | None = None,
) -> DataFrame:
    """Catalogue lines for tables ``(schema, table, name)``, at most ``max_tables`` if given; all or nothing.

    Names default to ``schema.table``. Every table is opened and every name
    checked, also against the catalogue, before anything is returned.
    """
    if not requests:
        raise SourceError("no tables to import")
    if max_tables is not None and len(requests) > max_tables:
        raise SourceError(f"at most {max_tables} tables can be imported at once")
    lines = []
    for schema, table, name in requests:
        described = open_table(schema, table).schema.json()
        at = {"schema": schema, "table": table}
        lines.append((uuid.uuid4().hex, name or f"{schema}.{table}", kind, at, described))
    new = spark.createDataFrame(lines, CATALOG)
    taken = catalog.select("name").join(new.select("name").distinct(), "name", "left_semi")
    clash = unique_violations(new, ["name"]).select("name").unionAll(taken).first()
    if clash is not None:
        raise SourceError(f"a dataset named '{clash['name']}' already exists")
    return new
