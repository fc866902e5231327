"""Database tables over JDBC. Credentials are the caller's; nothing is stored."""

from pyspark.sql import DataFrame, SparkSession

from tablewright.errors import SourceError
from tablewright.sources.schema import schema_report

CONNECT_TIMEOUT_SECONDS = 8
FETCH_ROWS = 10_000

_DRIVERS = {
    "postgres": "org.postgresql.Driver",
    "mssql": "com.microsoft.sqlserver.jdbc.SQLServerDriver",
    "mssql_azure": "com.microsoft.sqlserver.jdbc.SQLServerDriver",
}
_PORTS = {"postgres": 5432, "mssql": 1433, "mssql_azure": 1433}
_TLS_MODES = ("require", "verify-ca", "verify-full")


def quoted_table(kind: str, schema: str, table: str) -> str:
    """``schema.table`` in the quotes of the database."""
    if kind == "postgres":
        parts = ['"' + p.replace('"', '""') + '"' for p in (schema, table)]
    else:
        parts = ["[" + p.replace("]", "]]") + "]" for p in (schema, table)]
    return ".".join(parts)


def jdbc_url(kind: str, config: dict) -> str:
    """Connection URL. Azure always encrypts; only a ``verify`` mode checks the server's certificate."""
    if kind not in _DRIVERS:
        raise SourceError(f"not a database kind: '{kind}'")
    host, port, database = config["host"], config.get("port", _PORTS[kind]), config["database"]
    if kind == "postgres":
        mode = config.get("sslmode", "prefer")
        return f"jdbc:postgresql://{host}:{port}/{database}?sslmode={mode}&connectTimeout={CONNECT_TIMEOUT_SECONDS}"
    azure = kind == "mssql_azure"
    mode = config.get("sslmode", "require" if azure else "disable")
    encrypt = azure or mode in _TLS_MODES
    options = [f"databaseName={{{database.replace('}', '}}')}}}", f"encrypt={str(encrypt).lower()}"]
    if encrypt:
        options.append(f"trustServerCertificate={str(mode == 'require').lower()}")
    options.append(f"loginTimeout={CONNECT_TIMEOUT_SECONDS}")
    return f"jdbc:sqlserver://{host}:{port};" + ";".join(options)


def jdbc_options(
    kind: str,
    config: dict,
    schema: str,
    table: str,
    partition_column: str | None = None,
    bounds: tuple | None = None,
    partitions: int | None = None,
) -> dict[str, str]:
    """Reader options; with a partition column the table is read by many tasks instead of one."""
    options = {
        "url": jdbc_url(kind, config),
        "driver": _DRIVERS[kind],
        "dbtable": quoted_table(kind, schema, table),
        "user": config["user"],
        "password": config.get("password", ""),
        "fetchsize": str(FETCH_ROWS),
        "pushDownLimit": "true",
    }
    if partition_column is not None:
        if bounds is None or not partitions:
            raise SourceError("a partition column needs 'bounds' and 'partitions'")
        options |= {
            "partitionColumn": partition_column,
            "lowerBound": str(bounds[0]),
            "upperBound": str(bounds[1]),
            "numPartitions": str(partitions),
        }
    return options


def read_table(
    spark: SparkSession, kind: str, config: dict, schema: str, table: str, limit: int | None = None, **split
) -> DataFrame:
    """A table; ``limit`` is pushed down as ``LIMIT`` or ``TOP``.

    A profile of a table needs no limit here; give one for a quick look.
    """
    df = spark.read.format("jdbc").options(**jdbc_options(kind, config, schema, table, **split)).load()
    return df.limit(limit) if limit is not None else df


def table_report(df: DataFrame) -> DataFrame:
    """Schema report of a table, with the nullability its database declares."""
    return schema_report(df, nullable={f.name: f.nullable for f in df.schema.fields})
