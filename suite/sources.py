"""Scans, schema reports, manifests and exports over the given files."""

import uuid

from pyspark.sql import functions as F

from suite.base import WITH_CUSTOMER, Query, d_customer, table
from tablewright.scratch import shared_dir
from tablewright.plans.workcopy import WorkingCopy
from tablewright.sources.files import file_manifest
from tablewright.sources.registry import read_dataset
from tablewright.sources.schema import schema_report

_ORDERS = "o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority"


def parquet_scan(spark, sf):
    return read_dataset(spark, "parquet", {"path": f"{sf}/orders.parquet"}).select(*_ORDERS.split(", "))


def csv_scan(spark, sf):
    """Orders written as CSV and read back: types are inferred, dates stay text."""
    path = f"{shared_dir(spark)}/csv/{uuid.uuid4().hex}"
    orders = table(spark, sf, "orders").withColumn("day", F.date_format("o_orderdate", "yyyy-MM-dd")).drop("o_orderdate")
    orders.write.option("header", True).option("escape", '"').csv(path)
    return read_dataset(spark, "csv", {"path": path})


def csv_orders(spark, sf):
    """Orders as CSV in two files whose headers have another order."""
    path = f"{shared_dir(spark)}/csv/{uuid.uuid4().hex}"
    orders = table(spark, sf, "orders").select(*_ORDERS.split(", "))
    for part, columns in enumerate((orders.columns, orders.columns[::-1])):
        rows = orders.where(F.col("o_orderkey") % 2 == part).select(*columns)
        rows.write.mode("append").option("header", True).option("escape", '"').csv(path)
    return read_dataset(spark, "csv", {"path": path})


def csv_schema_report(spark, sf):
    """Nullability and types of customers with gaps, read back from CSV."""
    path = f"{shared_dir(spark)}/csv/{uuid.uuid4().hex}"
    d_customer(spark, sf).select("c_custkey", "acctbal", "segment").write.option("header", True).option("escape", '"').csv(path)
    return schema_report(read_dataset(spark, "csv", {"path": path}), order_by=["c_custkey"]).select("name", "dtype", "nullable")


def csv_text(spark, sf):
    """Texts with quotes and line breaks through CSV."""
    path = f"{shared_dir(spark)}/csv/{uuid.uuid4().hex}"
    documents = table(spark, sf, "documents").select("doc_id", F.concat(F.lit("x"), "text", F.lit('"x')).alias("text"))
    documents.write.option("header", True).option("escape", '"').csv(path)
    return read_dataset(spark, "csv", {"path": path})


def export_copy(spark, sf):
    """A working copy exported and opened again."""
    root = shared_dir(spark)
    copy = WorkingCopy.create(d_customer(spark, sf).drop("full_name"), f"{root}/copies", uuid.uuid4().hex)
    path = copy.export(f"{root}/exports/{uuid.uuid4().hex}", "parquet")
    return read_dataset(spark, "parquet", {"path": path})


def export_csv(spark, sf):
    """A working copy exported as CSV and opened again: types are found anew, empty cells are nulls."""
    root = shared_dir(spark)
    copy = WorkingCopy.create(d_customer(spark, sf).drop("full_name", "all_null"), f"{root}/copies", uuid.uuid4().hex)
    path = copy.export(f"{root}/exports/{uuid.uuid4().hex}", "csv")
    return read_dataset(spark, "csv", {"path": path})


def _report(spark, sf):
    orders = table(spark, sf, "orders").select(*_ORDERS.split(", "))
    report = schema_report(orders, order_by=["o_orderkey"])
    return report.withColumn("sample_values", F.array_join("sample_values", "|")).drop("position")


_TYPES = {
    "o_orderkey": "bigint",
    "o_custkey": "bigint",
    "o_orderstatus": "string",
    "o_totalprice": "double",
    "o_orderpriority": "string",
}
_REPORT_SQL = "WITH s AS (SELECT * FROM orders ORDER BY o_orderkey LIMIT 5) " + " UNION ALL ".join(
    f"""SELECT '{c}' AS name, '{t}' AS dtype, (SELECT count({c}) < count(*) FROM orders) AS nullable,
  string_agg(CAST({c} AS VARCHAR), '|' ORDER BY o_orderkey) AS sample_values FROM s"""
    for c, t in _TYPES.items()
)


def manifest(spark, sf):
    return file_manifest(spark, sf).drop("path")


QUERIES = [
    Query("parquet_scan", parquet_scan, f"SELECT {_ORDERS} FROM orders"),
    Query("csv_scan", csv_scan, f"SELECT {_ORDERS}, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders"),
    Query("csv_orders", csv_orders, f"SELECT {_ORDERS} FROM orders"),
    Query(
        "csv_schema_report",
        csv_schema_report,
        """SELECT 'c_custkey' AS name, 'bigint' AS dtype, false AS nullable UNION ALL
  SELECT 'acctbal', 'double', count(CASE WHEN c_custkey % 7 = 0 THEN 1 END) > 0 FROM customer UNION ALL
  SELECT 'segment', 'string', count(CASE WHEN c_custkey % 6 = 0 THEN 1 END) > 0 FROM customer""",
    ),
    Query("csv_text", csv_text, """SELECT doc_id, concat('x', text, '"x') AS text FROM documents"""),
    Query(
        "export_copy",
        export_copy,
        f"{WITH_CUSTOMER} SELECT c_custkey, acctbal, nation_id, segment, all_null FROM d",
    ),
    Query("export_csv", export_csv, f"{WITH_CUSTOMER} SELECT c_custkey, acctbal, nation_id, segment FROM d"),
    Query("schema_report", _report, _REPORT_SQL),
    Query("file_manifest", manifest),
]
