"""Session settings this library expects."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Timestamps are zone-free, so the session runs in UTC: casts to instants are then exact.
# AQE sizes shuffle partitions from the bytes it sees and splits skewed joins.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    # Plans are built from many Column calls; recording the call site of each costs more
    # than planning.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


PARTITION_BYTES = 128 << 20


def cluster_settings(shuffled_bytes: int, cores: int) -> dict[str, str]:
    """Settings for a job that shuffles about this many bytes on this many cores.

    Partitions of about 128 MB, and at least two per core; AQE merges those that turn out
    small.  100 TB gives about 800,000 partitions.
    """
    partitions = max(2 * cores, -(-shuffled_bytes // PARTITION_BYTES))
    return {**SETTINGS, "spark.sql.shuffle.partitions": str(partitions)}


def local_session(cpus: int | str = "*", **conf: str) -> SparkSession:
    """A single-machine session for tests and benchmarks."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("stepwise")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", "8" if cpus == "*" else str(cpus))
    )
    for key, value in {**SETTINGS, **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
