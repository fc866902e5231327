"""Profile runs: an append-only table of run states and one of per-column results."""

import datetime
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.operators.profile import profile

RUNS = T.StructType(
    [
        T.StructField("run_id", T.StringType()),
        T.StructField("dataset_id", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("at", T.TimestampNTZType()),
        T.StructField("row_count", T.LongType()),
        T.StructField("error", T.StringType()),
    ]
)


def _note(spark: SparkSession, root: str, run_id: str, dataset_id: str, status: str, rows=None, error=None) -> None:
    now = datetime.datetime.now(datetime.UTC).replace(tzinfo=None)
    line = [(run_id, dataset_id, status, now, rows, error)]
    spark.createDataFrame(line, RUNS).coalesce(1).write.mode("append").parquet(f"{root}/profile_runs")


def run_profile(spark: SparkSession, root: str, dataset_id: str, load: Callable[[], DataFrame]) -> str:
    """Note the start, profile ``load()``, keep the result and note the end; returns the run id.

    A failure is noted with its message instead of being raised, as later
    readers look for it in the run table.
    """
    run_id = uuid.uuid4().hex
    _note(spark, root, run_id, dataset_id, "running")
    try:
        lines = profile(load()).withColumn("run_id", F.lit(run_id))
        lines.coalesce(1).write.mode("append").parquet(f"{root}/profile_columns")
        kept = spark.read.parquet(f"{root}/profile_columns").filter(F.col("run_id") == run_id)
        _note(spark, root, run_id, dataset_id, "completed", kept.agg(F.max("row_count")).first()[0] or 0)
    except Exception as e:  # noqa: BLE001 - whatever went wrong belongs into the run table
        _note(spark, root, run_id, dataset_id, "failed", error=str(e))
    return run_id


def latest_per_group(df: DataFrame, group: list[str], newest_first: list) -> DataFrame:
    """One row per group: the newest. Each task keeps one row per group before the shuffle."""
    rank = F.row_number().over(W.partitionBy(*group).orderBy(*newest_first))
    return df.withColumn("_rank", rank).filter("_rank = 1").drop("_rank")


def latest_runs(runs: DataFrame) -> DataFrame:
    """Last noted state of the last run of each dataset."""
    order = [F.desc("at"), F.when(F.col("status") == "running", 1).otherwise(0), F.desc("run_id")]
    return latest_per_group(runs, ["dataset_id"], order)


def row_counts(runs: DataFrame) -> DataFrame:
    """Row count of each dataset as its last completed run found it."""
    done = runs.filter(F.col("status") == "completed")
    return latest_per_group(done, ["dataset_id"], [F.desc("at"), F.desc("run_id")]).select("dataset_id", "row_count")


def read_back(results: DataFrame, column: str = "result") -> DataFrame:
    """Typed lines from profile results stored as JSON text; absent counts read as zero, absent names as ``""``."""
    item = (
        "struct<name:string,dtype:string,null_count:bigint,null_pct:double,distinct_count:bigint,"
        "min:string,max:string,top_values:array<struct<value:string,count:bigint>>>"
    )
    parsed = F.from_json(column, f"row_count bigint, columns array<{item}>")
    keys = [c for c in results.columns if c != column]
    lines = results.select(*keys, parsed.alias("r")).select(*keys, "r.row_count", F.explode("r.columns").alias("c"))
    zero = F.lit(0).cast("bigint")
    return lines.select(
        *keys,
        "row_count",
        F.coalesce("c.name", F.lit("")).alias("name"),
        F.coalesce("c.dtype", F.lit("")).alias("dtype"),
        F.coalesce("c.null_count", zero).alias("null_count"),
        F.coalesce("c.null_pct", F.lit(0.0)).alias("null_pct"),
        F.col("c.distinct_count").alias("distinct_count"),
        F.col("c.min").alias("min"),
        F.col("c.max").alias("max"),
        F.coalesce("c.top_values", F.array().cast("array<struct<value:string,count:bigint>>")).alias("top_values"),
    )
