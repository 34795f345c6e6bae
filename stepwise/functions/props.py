"""JSON property access; malformed JSON reads as null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EVENT_PREFIX = "event_properties_"
USER_PREFIX = "user_properties_"


def property_value(column: Column | str, key: str) -> Column:
    """Text of one top-level property; nested values come back as JSON text."""
    column = F.col(column) if isinstance(column, str) else column
    return F.try_element_at(property_map(column), F.lit(key))


def property_map(column: Column | str) -> Column:
    """All top-level properties as a string map."""
    column = F.col(column) if isinstance(column, str) else column
    return F.from_json(column, "map<string,string>")


def property_is(column: Column | str, key: str, value: str) -> Column:
    """True where the property equals the value as text; missing counts as false."""
    return F.coalesce(property_value(column, key) == F.lit(value), F.lit(False))


def split_segment_name(segment_by: str) -> tuple[str, str]:
    """(property column, key) for a segment setting such as ``event_properties_platform``."""
    if segment_by.startswith(EVENT_PREFIX):
        return "event_properties", segment_by[len(EVENT_PREFIX) :]
    if segment_by.startswith(USER_PREFIX):
        return "user_properties", segment_by[len(USER_PREFIX) :]
    column = "event_properties" if segment_by.startswith("event_") else "user_properties"
    return column, segment_by
