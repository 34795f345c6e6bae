"""Intermediate tables in the folder that all executors and the driver share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``.  A local folder is set only where the session names none and
    everything runs in one process on one machine, as in tests."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="stepwise-shared-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def new_folder(spark: SparkSession) -> str:
    """The name of a folder that is not there yet, under the shared one."""
    return f"{shared_root(spark)}/stepwise-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """The rows written to a Parquet table in the shared folder and read back."""
    folder = new_folder(df.sparkSession)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def materialised(df: DataFrame) -> DataFrame:
    """The table read back from the shared folder, so that iterations and lost executors do not
    recompute its source."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_root(df.sparkSession))
    return df.checkpoint()
