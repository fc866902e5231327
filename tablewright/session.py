"""Session settings the operators rely on, and a local session for tests and the bench."""

from pyspark.sql import SparkSession

# Zone-free timestamps are parsed through the session zone, so it must have no clock changes.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


MB = 1024 * 1024


def sized_settings(input_bytes: int, partition_bytes: int = 256 * MB) -> dict[str, str]:
    """Settings that keep scan and shuffle partitions at a size an executor core sorts in memory.

    Adaptive execution merges partitions that turn out smaller and splits
    skewed ones, so the count follows the largest shuffle to expect: the whole
    input once.
    """
    return {
        "spark.sql.files.maxPartitionBytes": str(partition_bytes),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(partition_bytes),
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(2 * partition_bytes),
        "spark.sql.shuffle.partitions": str(max(200, -(-input_bytes // partition_bytes))),
    }


def local_session(name: str, cores: int | str = "*", partitions: int = 8, **extra: str) -> SparkSession:
    builder = SparkSession.builder.master(f"local[{cores}]").appName(name)
    builder = builder.config("spark.sql.shuffle.partitions", str(partitions)).config("spark.driver.memory", "8g")
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return session
