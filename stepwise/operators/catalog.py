"""Event catalogue: overview, per-event statistics, metadata and filters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stepwise.functions.labels import bands, event_category

STATISTIC_LEVELS = ((10, "high"), (1, "medium"))
DICTIONARY_LEVELS = ((10, "high"), (5, "medium"))
POPULARITY = ((50, "popular"), (20, "moderate"))


def _pairs_rolled(events: DataFrame) -> DataFrame:
    """One row per user (``whole_user``) and one per event name, from one pass: the rows are
    counted per user and name first, so neither a user nor a name gathers them in one task."""
    pairs = events.groupBy("user_id", "event_name").agg(
        F.count(F.lit(1)).alias("n"),
        F.min("timestamp").alias("lo"),
        F.max("timestamp").alias("hi"),
        F.count("user_id").alias("named"),
    )
    return pairs.groupingSets([["user_id"], ["event_name"]], "user_id", "event_name").agg(
        (F.grouping("event_name") == 1).alias("whole_user"),
        F.sum("n").alias("n"),
        F.min("lo").alias("lo"),
        F.max("hi").alias("hi"),
        F.count_if(F.col("named") > 0).alias("users"),
    )


def overview(events: DataFrame) -> DataFrame:
    """Events, users, event types and whole days covered."""
    whole = F.col("whole_user")
    first, last = (F.unix_micros(c.cast("timestamp")) for c in (F.min("lo"), F.max("hi")))
    return _pairs_rolled(events).agg(
        F.coalesce(F.sum(F.when(whole, F.col("n"))), F.lit(0)).alias("events"),
        F.count(F.when(whole, F.col("user_id"))).alias("users"),
        F.count(F.when(~whole, F.col("event_name"))).alias("event_types"),
        F.call_function("div", last - first, F.lit(86_400_000_000)).alias("days"),
    )


def event_statistics(events: DataFrame) -> DataFrame:
    """Counts, users, shares, frequency level and events per user."""
    whole = F.col("whole_user")
    # All users become one row beside one for each event name.
    by_name = _pairs_rolled(events).groupBy("whole_user", "event_name").agg(
        F.sum("n").alias("count"),
        F.sum("users").alias("unique_users"),
        F.count("user_id").alias("all_users"),
    )
    # The table of event names, which is what the caller gets: small beside the events.
    everything = Window.partitionBy()
    counts = by_name.withColumns(
        {
            "total": F.max(F.when(whole, F.col("count"))).over(everything),
            "users": F.max(F.when(whole, F.col("all_users"))).over(everything),
        }
    ).filter(~whole)
    share = F.col("count") / F.col("total") * 100
    coverage = F.when(F.col("users") > 0, F.col("unique_users") / F.col("users") * 100)
    return counts.select(
        "event_name",
        "count",
        "unique_users",
        share.alias("percentage_of_events"),
        coverage.alias("user_coverage"),
        bands(share, STATISTIC_LEVELS, "low").alias("frequency_level"),
        F.when(F.col("unique_users") > 0, F.col("count") / F.col("unique_users"))
        .otherwise(0.0)
        .alias("avg_per_user"),
    )


def _described(stats: DataFrame, levels) -> DataFrame:
    return stats.select(
        F.col("event_name").alias("name"),
        event_category("event_name").alias("category"),
        F.concat(F.lit("Event: "), "event_name").alias("description"),
        bands("percentage_of_events", levels, "low").alias("frequency"),
        F.col("count").alias("total_occurrences"),
        "unique_users",
        F.col("percentage_of_events").alias("event_percentage"),
        F.col("user_coverage").alias("user_penetration"),
        F.col("avg_per_user").alias("avg_events_per_user"),
    )


def basic_metadata(events: DataFrame) -> DataFrame:
    """Metadata from names and statistics alone."""
    return _described(event_statistics(events), STATISTIC_LEVELS)


def event_metadata(events: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Statistics joined with an event dictionary.

    Dictionary entries keep their category, description and frequency and get zeros when
    the data lacks them; other events are labelled by name and share.  Both sides have one
    row per event name.
    """
    derived = _described(event_statistics(events), DICTIONARY_LEVELS)
    entries = dictionary.select(
        "name",
        F.lit(True).alias("listed"),
        *[F.col(c).alias(f"d_{c}") for c in ("category", "description", "frequency")],
    )
    joined = derived.join(entries, "name", "full")

    def described(name: str) -> Column:
        return F.when(F.col("listed"), F.col(f"d_{name}")).otherwise(F.col(name)).alias(name)

    return joined.select(
        "name",
        *[described(c) for c in ("category", "description", "frequency")],
        *[F.coalesce(c, F.lit(0)).alias(c) for c in ("total_occurrences", "unique_users")],
        *[
            F.coalesce(c, F.lit(0.0)).alias(c)
            for c in ("event_percentage", "user_penetration", "avg_events_per_user")
        ],
    )


def filter_catalogue(
    metadata: DataFrame,
    search: str = "",
    categories: Sequence[str] = (),
    frequencies: Sequence[str] = (),
) -> DataFrame:
    """Entries matching the text in name or description, the categories and the levels."""
    if search:
        needle = search.lower()
        metadata = metadata.filter(
            F.lower("name").contains(needle) | F.lower("description").contains(needle)
        )
    if categories:
        metadata = metadata.filter(F.col("category").isin(*categories))
    if frequencies:
        metadata = metadata.filter(F.col("frequency").isin(*frequencies))
    return metadata


def event_names(events: DataFrame) -> DataFrame:
    return events.select("event_name").distinct().orderBy("event_name")


def popularity(stats: DataFrame) -> DataFrame:
    """Popularity band of each event by user coverage."""
    return stats.select(
        "event_name",
        "user_coverage",
        bands("user_coverage", POPULARITY, "rare").alias("popularity"),
    )
