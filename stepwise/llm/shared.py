"""Tables kept between jobs, in the folder that all executors and the driver share."""

from __future__ import annotations

import ctypes
import functools
import shutil
import tempfile
import uuid
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """A new folder name under ``spark.checkpoint.dir``.

    Where the session names no folder, as in tests on one machine, one is made and set.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="stepwise-shared-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/llm-{uuid.uuid4().hex}"


def saved(df: DataFrame) -> DataFrame:
    """The rows written as Parquet to the shared folder and read back.

    Later jobs read the files, so neither a lost executor nor a second use computes the rows
    again.
    """
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def give_back() -> None:
    """Memory that Arrow and numpy have freed goes back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def lean(run):
    """A generator over batches, for a task, that gives its memory back when it ends.

    Spark keeps a task's Python process for later ones.  An executor has more such processes than
    cores; each would hold as much as its largest task took, while others work.
    """

    @functools.wraps(run)
    def task(*args):
        try:
            yield from run(*args)
        finally:
            give_back()

    return task


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once per application, wherever the driver found it."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    top = Path(__file__).resolve().parents[1]
    into = f"{tempfile.mkdtemp(prefix='stepwise-package-')}/{top.name}"
    context.addPyFile(shutil.make_archive(into, "zip", top.parent, top.name))
    _shipped.add(context.applicationId)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
