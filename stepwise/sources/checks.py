"""Validation and profiling of event tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stepwise.model import REQUIRED_COLUMNS

VALID = "valid event table"
BAD_TIMES = "timestamp column does not hold times"
TIME_TYPES = (T.TimestampType, T.TimestampNTZType, T.DateType, T.StringType)


def validate_schema(df: DataFrame) -> tuple[bool, str]:
    """Check columns and types from the schema alone; no job runs."""
    missing = [c for c in REQUIRED_COLUMNS if c not in df.columns]
    if missing:
        return False, f"event table lacks columns: {', '.join(missing)}"
    if not isinstance(df.schema["timestamp"].dataType, TIME_TYPES):
        return False, BAD_TIMES
    return True, VALID


def validate_events(df: DataFrame) -> tuple[bool, str]:
    """Schema check, then: is there a row, and does every non-null time parse?"""
    ok, message = validate_schema(df)
    if not ok:
        return ok, message
    if df.select("user_id").isEmpty():
        return False, "event table is empty"
    if isinstance(df.schema["timestamp"].dataType, T.StringType):
        bad = df.filter(F.col("timestamp").isNotNull() & F.try_to_timestamp("timestamp").isNull())
        if not bad.isEmpty():
            return False, BAD_TIMES
    return True, VALID


def quality_counts(df: DataFrame) -> DataFrame:
    """One row: rows, missing required values, times that do not parse."""
    text_time = F.col("timestamp").cast("string")
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in REQUIRED_COLUMNS],
        F.count_if(text_time.isNotNull() & F.try_to_timestamp(text_time).isNull()).alias(
            "bad_timestamps"
        ),
    )


def profile(df: DataFrame) -> DataFrame:
    """Per column: type, rows, nulls and null percentage, from one aggregate."""
    counts = df.agg(
        F.count(F.lit(1)).alias("_rows"),
        *[F.count_if(F.col(f.name).isNull()).alias(f.name) for f in df.schema.fields],
    )
    entries = [
        F.struct(
            F.lit(f.name).alias("column_name"),
            F.lit(f.dataType.simpleString()).alias("dtype"),
            F.col("_rows").alias("row_count"),
            F.col(f.name).alias("nulls"),
            F.when(F.col("_rows") > 0, F.col(f.name) / F.col("_rows") * 100)
            .otherwise(0.0)
            .alias("null_pct"),
        )
        for f in df.schema.fields
    ]
    return counts.select(F.inline(F.array(*entries)))
