"""Preparing funnel events: step filter, clean users, segments, property expansion."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stepwise.functions.props import property_is, property_map, property_value, split_segment_name
from stepwise.functions.times import micros
from stepwise.model import FunnelConfig
from stepwise.sources.readers import valid_users

COMMON_SHARE = 0.1


def step_events(events: DataFrame, steps: Sequence[str]) -> DataFrame:
    """Rows of the funnel steps; the filter reaches the Parquet scan."""
    return events.filter(F.col("event_name").isin(*steps))


def timed(events: DataFrame) -> DataFrame:
    """Valid users' rows with ``us`` and, where the input has it, ``ord``."""
    return valid_users(events).withColumn("us", micros("timestamp"))


def require_order(events: DataFrame) -> None:
    if "ord" not in events.columns:
        raise ValueError("this operator follows data order and needs an 'ord' column")


def preprocess(events: DataFrame, steps: Sequence[str]) -> DataFrame:
    """Step rows of valid users with common JSON properties expanded into columns."""
    rows = valid_users(step_events(events, steps))
    for column in ("event_properties", "user_properties"):
        if column in rows.columns:
            rows = expand_properties(rows, column, common_properties(rows, column))
    return rows


def property_counts(events: DataFrame, column: str) -> DataFrame:
    """Rows holding each top-level key."""
    return _counted_keys(events, column).filter(F.col("key").isNotNull())


def _counted_keys(events: DataFrame, column: str) -> DataFrame:
    """Rows holding each top-level key and, under a null key, all rows that are not null.

    JSON repeats a few sets of keys in very many rows, so sets are counted before they are
    exploded.
    """
    sets = (
        events.filter(F.col(column).isNotNull())
        .groupBy(F.json_object_keys(column).alias("keys"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    every = F.array(F.lit(None).cast("string"))
    keys = F.concat(every, F.coalesce("keys", F.array().cast("array<string>")))
    return sets.select(F.explode(keys).alias("key"), "n").groupBy("key").agg(F.sum("n").alias("n"))


def common_property_table(events: DataFrame, column: str, share: float = COMMON_SHARE) -> DataFrame:
    """Keys present in at least ``share`` of the non-null rows."""
    # One row per key name; the number of rows is the null key's.
    total = F.max(F.when(F.col("key").isNull(), F.col("n"))).over(Window.partitionBy())
    counted = _counted_keys(events, column).withColumn("total", total)
    return counted.filter("key IS NOT NULL").filter(F.col("n") >= F.col("total") * share).drop("total")


def common_properties(events: DataFrame, column: str, share: float = COMMON_SHARE) -> list[str]:
    """The common keys as a list, to build columns from.

    Each JSON row contributes its own keys and every key listed here covers at least
    ``share`` of the rows, so the list is as long as a row is wide, not as the data.
    """
    table = common_property_table(events, column, share)
    return sorted(r["key"] for r in table.select("key").collect())


def expand_properties(events: DataFrame, column: str, keys: Sequence[str]) -> DataFrame:
    """Add ``{column}_{key}`` text columns; the JSON is parsed once per row."""
    if not keys:
        return events
    return (
        events.withColumn("_map", property_map(column))
        .withColumns(
            {f"{column}_{k}": F.try_element_at("_map", F.lit(k)) for k in keys}
        )
        .drop("_map")
    )


def property_inventory(events: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Distinct keys per JSON column."""
    columns = columns or [
        c for c in ("event_properties", "user_properties") if c in events.columns
    ]
    pairs = [F.struct(F.lit(c).alias("prop_type"), F.json_object_keys(c).alias("keys"))
             for c in columns]
    return (
        events.select(F.inline(F.array(*pairs)))
        .select("prop_type", F.explode("keys").alias("key"))
        .distinct()
        .orderBy("prop_type", "key")
    )


def property_values(events: DataFrame, key: str, column: str = "event_properties") -> DataFrame:
    """Sorted distinct values of one key as text."""
    return (
        events.select(property_value(column, key).alias("value"))
        .dropna()
        .distinct()
        .orderBy("value")
    )


def filter_by_property(events: DataFrame, column: str, key: str, value: str) -> DataFrame:
    return events.filter(property_is(column, key, value))


def _segment_value(cfg: FunnelConfig) -> Column:
    return property_value(*split_segment_name(cfg.segment_by))


def in_segment(cfg: FunnelConfig) -> Column:
    """True for events whose segment property has one of the wanted values."""
    return F.coalesce(_segment_value(cfg).isin(*cfg.segment_values), F.lit(False))


def segment_names(cfg: FunnelConfig) -> list[str]:
    _, key = split_segment_name(cfg.segment_by)
    return [f"{key}={v}" for v in cfg.segment_values]


def segment_events(events: DataFrame, cfg: FunnelConfig) -> DataFrame:
    """Add ``segment`` (``key=value``) and keep the wanted ones; a no-op without segmentation.

    Segments are per event, not per user.  One pass labels the rows of all segments.
    """
    if not cfg.segmented:
        return events
    _, key = split_segment_name(cfg.segment_by)
    # Filtering on the bare value first spares the other rows a second JSON parse.
    return (
        events.withColumn("_value", _segment_value(cfg))
        .filter(F.col("_value").isin(*cfg.segment_values))
        .withColumn("segment", F.concat(F.lit(f"{key}="), "_value"))
        .drop("_value")
    )
