"""Keyword and threshold labels as Column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Keyword lists and thresholds that decide the labels.
EVENT_CATEGORIES = (
    ("Authentication", ("sign", "login", "register", "auth")),
    ("Onboarding", ("onboard", "tutorial", "setup", "profile")),
    ("E-commerce", ("purchase", "buy", "payment", "checkout", "cart")),
    ("Engagement", ("view", "click", "search", "browse")),
    ("Social", ("share", "invite", "social")),
    ("Mobile", ("mobile", "app", "notification")),
)
ACTIVITY_TYPES = (
    ("entry", ("login", "signup", "register", "start")),
    ("conversion", ("purchase", "checkout", "complete", "finish")),
    ("error", ("error", "fail", "timeout")),
    ("navigation", ("view", "page", "screen")),
)
DESTINATION_CATEGORIES = (
    ("exit", ("exit", "close", "end", "quit", "leave", "abandon", "cancel")),
    ("error", ("error", "fail", "exception", "timeout", "crash", "bug")),
    ("view", ("view", "page", "screen", "visit", "navigate", "load")),
    ("interaction", ("click", "tap", "press", "select", "choose", "button")),
    ("search", ("search", "query", "find", "filter", "sort")),
    ("form", ("input", "form", "submit", "enter", "type", "fill")),
    ("purchase", ("purchase", "buy", "order", "payment", "checkout", "convert")),
    ("social", ("share", "like", "comment", "follow", "social")),
)
DROPOFF_KINDS = (
    ("exit", ("exit", "end", "quit", "close", "leave")),
    ("error", ("error", "fail", "exception", "timeout")),
)
BETWEEN_CATEGORIES = (
    ("search", ("search",)),
    ("view", ("view",)),
    ("click", ("click",)),
    ("error", ("error",)),
)
SUCCESS_WORDS = ("purchase", "conversion", "complete", "finish", "success", "checkout")
JOURNEY_SUCCESS_WORDS = ("purchase", "complete", "success", "finish", "convert", "checkout")
LOOP_NEGATIVE_WORDS = ("error", "fail", "timeout")
CYCLE_NEGATIVE_WORDS = ("error", "fail")
LEGACY_NEGATIVE_WORDS = ("error", "fail", "retry", "repeat")
UNKNOWN_EVENT = "Unknown Event"


def contains_any(name: Column | str, words: Sequence[str]) -> Column:
    """True when the lower-cased text contains one of the words (plain letters only)."""
    text = F.col(name) if isinstance(name, str) else name
    return F.lower(text).rlike("|".join(words))


def first_match(name: Column | str, table, default: str | Column) -> Column:
    chain = F
    for label, words in table:
        chain = chain.when(contains_any(name, words), label)
    return chain.otherwise(default)


def bands(value: Column | str, limits: Sequence[tuple[float, str]], default: str) -> Column:
    """Label of the first limit the value exceeds."""
    value = F.col(value) if isinstance(value, str) else value
    chain = F
    for limit, label in limits:
        chain = chain.when(value > limit, label)
    return chain.otherwise(default)


def event_category(name: Column | str) -> Column:
    return first_match(name, EVENT_CATEGORIES, "Other")


def activity_type(name: Column | str, starts: Column, ends: Column) -> Column:
    by_position = F.when(starts > 0, "entry").when(ends > 0, "exit").otherwise("process")
    return first_match(name, ACTIVITY_TYPES, by_position)


def transition_type(source: Column, target: Column, frequency: Column) -> Column:
    return (
        F.when(source == target, "loop")
        .when(contains_any(target, ("error",)), "error_transition")
        .when(frequency > 100, "main_flow")
        .otherwise("alternative_flow")
    )


def variant_type(success_rate: Column | str) -> Column:
    limits = ((80, "high_success"), (50, "medium_success"), (20, "low_success"))
    return bands(success_rate, limits, "problematic")


def destination_label(name: Column | str) -> Column:
    """Event name without outer white space, 27 characters plus dots when over 30."""
    raw = F.col(name) if isinstance(name, str) else name
    text = F.regexp_replace(raw, r"^\s+|\s+$", "")
    short = F.concat(F.substring(text, 1, 27), F.lit("..."))
    return F.when(raw.isNull() | (raw == ""), UNKNOWN_EVENT).otherwise(
        F.when(F.length(text) > 30, short).otherwise(text)
    )


def destination_category(name: Column | str) -> Column:
    """Category of the whole name, not of its shortened label."""
    raw = F.col(name) if isinstance(name, str) else name
    return F.when(raw.isNull() | (raw == ""), "other").otherwise(
        first_match(raw, DESTINATION_CATEGORIES, "other")
    )


def between_category(name: Column | str) -> Column:
    return first_match(name, BETWEEN_CATEGORIES, "other")


def impact_level(n: Column | str) -> Column:
    return bands(n, ((100, "High"), (10, "Medium")), "Low")


def is_success(name: Column | str) -> Column:
    return contains_any(name, SUCCESS_WORDS)


def is_journey_success(name: Column | str) -> Column:
    return contains_any(name, JOURNEY_SUCCESS_WORDS)


def impact(text: Column, words: Sequence[str]) -> Column:
    return F.when(contains_any(text, words), "negative").otherwise("positive")
