"""Intermediate tables in the folder all executors share."""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from tablewright.errors import WorkingCopyError

_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder; a temporary one only on a local master that names none."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise WorkingCopyError("set spark.checkpoint.dir to a folder that all executors share")
    if context.applicationId not in _LOCAL:
        _LOCAL[context.applicationId] = tempfile.mkdtemp(prefix="tablewright-")
    return _LOCAL[context.applicationId]


def written(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet and read it back.

    Later scans start from the file, whatever it took to compute it, survive
    the loss of executors, and read only the columns they need.
    """
    path = f"{shared_dir(df.sparkSession)}/tablewright/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)
