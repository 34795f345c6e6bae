"""Event readers: CSV, Parquet, warehouse query, event dictionary; result writer."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stepwise.functions.texts import text_literal
from stepwise.model import EVENT_SCHEMA, REQUIRED_COLUMNS

# Text forms of missing user ids.
INVALID_USERS = ("", "nan", "None")
DICTIONARY_SCHEMA = "name string, category string, description string, frequency string"
WRITE_FORMATS = ("parquet", "csv", "json", "orc")


def canonical(df: DataFrame, mapping: Mapping[str, Column | str] | None = None) -> DataFrame:
    """Cast to the event schema: user id and complex columns to text, time zone-free.

    ``mapping`` gives expressions for the canonical columns of a differently named table.
    Columns outside the schema are carried through.  ``ord`` is the position in input
    order; operators that follow data order refuse to run without it.
    """
    if mapping:
        df = df.select(*[(F.col(c) if isinstance(c, str) else c).alias(n)
                         for n, c in mapping.items()])
    missing = [c for c in REQUIRED_COLUMNS if c not in df.columns]
    if missing:
        raise ValueError(f"event table lacks columns: {', '.join(missing)}")
    wanted = {f.name: f.dataType for f in EVENT_SCHEMA}
    columns = []
    for field in df.schema.fields:
        column, target = F.col(field.name), wanted.get(field.name)
        nested = isinstance(field.dataType, (T.StructType, T.ArrayType, T.MapType))
        if nested:
            column = F.to_json(column)
        elif field.name == "timestamp" and isinstance(field.dataType, T.StringType):
            column = F.try_to_timestamp(column).cast("timestamp_ntz")
        elif target is not None and field.dataType != target:
            column = column.cast(target)
        columns.append(column.alias(field.name))
    return df.select(*columns)


def in_file_order(df: DataFrame) -> DataFrame:
    """A table just read from files, with ``ord``: the place of each row in the data.

    Files follow each other by path and a file's blocks by their start; the blocks, a row for
    each in a table of metadata, are numbered, and a row adds its place in its task.  Numbers
    grow along the data but leave gaps.
    """
    block = (F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_block_start").alias("_start"))
    numbers = df.select(*block).distinct().withColumn(
        "_block", F.row_number().over(Window.orderBy("_path", "_start")).cast("bigint") - 1
    )
    # The lower 33 bits of the number that grows within a task.
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    placed = df.select("*", *block, place.alias("_place"))
    return (
        placed.join(numbers, ["_path", "_start"])
        .withColumn("ord", F.shiftleft("_block", 33).bitwiseOR(F.col("_place")))
        .select(*df.columns, "ord")
    )


def read_csv(
    spark: SparkSession,
    path: str,
    schema: str | T.StructType | None = None,
    *,
    with_order: bool = True,
) -> DataFrame:
    """CSV with header; unreadable rows are skipped, unreadable times become null.

    The default schema reads every column named in the header as text, so that no
    inference pass over the data is needed.  Rows are numbered in ``ord``, in data order, unless
    the file has such a column.
    """
    # Without pruning, a row of the wrong width is dropped whichever columns are asked for.
    reader = spark.read.options(
        header=True, mode="DROPMALFORMED", escape='"', columnPruning=False
    )
    if schema is not None:
        reader = reader.schema(schema)
    df = reader.csv(path)
    if with_order and "ord" not in df.columns:
        df = in_file_order(df)
    return canonical(df)


def read_parquet(spark: SparkSession, path: str, *, with_order: bool = False) -> DataFrame:
    """Parquet; ``with_order`` numbers the rows in ``ord``, in data order over all files."""
    df = spark.read.parquet(path)
    if with_order and "ord" not in df.columns:
        df = in_file_order(df)
    return canonical(df)


def read_events(spark: SparkSession, path: str, **options) -> DataFrame:
    """Reader chosen by file extension."""
    lowered = path.rstrip("/").lower()
    if lowered.endswith(".csv") or lowered.endswith(".csv.gz"):
        return read_csv(spark, path, **options)
    if lowered.endswith(".parquet"):
        return read_parquet(spark, path, **options)
    raise ValueError(f"unsupported event file, expected .csv or .parquet: {path!r}")


def warehouse_options(
    *,
    host: str,
    query: str,
    port: int = 8123,
    user: str = "default",
    password: str = "",
    database: str = "default",
    partition_column: str | None = None,
    lower_bound: str | None = None,
    upper_bound: str | None = None,
    num_partitions: int | None = None,
    fetch_size: int = 10_000,
) -> dict[str, str]:
    """JDBC options for a query on a ClickHouse server.

    With a partition column the query runs as ``num_partitions`` ranged reads; without one
    it is a single task, which suits small results only.
    """
    options = {
        "url": f"jdbc:clickhouse://{host}:{port}/{database}",
        "driver": "com.clickhouse.jdbc.ClickHouseDriver",
        "user": user,
        "password": password,
        "fetchsize": str(fetch_size),
    }
    if partition_column is None:
        return {**options, "query": query}
    bounds = (lower_bound, upper_bound, num_partitions)
    if any(b is None for b in bounds):
        raise ValueError("a partitioned read needs lower_bound, upper_bound and num_partitions")
    # Spark does not accept "query" together with a partition column.
    return {
        **options,
        "dbtable": f"({query}) AS q",
        "partitionColumn": partition_column,
        "lowerBound": str(lower_bound),
        "upperBound": str(upper_bound),
        "numPartitions": str(num_partitions),
    }


def read_warehouse(spark: SparkSession, **settings) -> DataFrame:
    return canonical(spark.read.format("jdbc").options(**warehouse_options(**settings)).load())


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """Event dictionary CSV: name, category, description, frequency."""
    return spark.read.option("header", True).schema(DICTIONARY_SCHEMA).csv(path)


def write_result(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists") -> None:
    if fmt not in WRITE_FORMATS:
        raise ValueError(f"unsupported output format: {fmt!r}")
    writer = df.write.mode(mode).format(fmt)
    if fmt == "csv":
        writer = writer.options(
            header=True, escape='"', timestampNTZFormat="yyyy-MM-dd'T'HH:mm:ss.SSSSSS"
        )
    writer.save(path)


def valid_users(df: DataFrame) -> DataFrame:
    """Drop rows without a usable user id."""
    invalid = ", ".join(text_literal(u) for u in INVALID_USERS)
    return df.filter(f"user_id IS NOT NULL AND user_id NOT IN ({invalid})")
