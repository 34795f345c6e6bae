"""Process mining: journeys and the activity, transition, variant and cycle tables.

Journeys are the only ordered step.  Everything else aggregates them, first per user (or
user and activity), which keeps the later group keys small and any single key harmless.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stepwise.functions.labels import (
    CYCLE_NEGATIVE_WORDS,
    LEGACY_NEGATIVE_WORDS,
    LOOP_NEGATIVE_WORDS,
    activity_type,
    contains_any,
    impact,
    is_journey_success,
    is_success,
    transition_type,
    variant_type,
)
from stepwise.functions.times import from_micros, seconds_as_hours, whole_hours
from stepwise.model import HOUR_US
from stepwise.operators.events import require_order, timed
from stepwise.plans.lineage import materialised
from stepwise.plans.ordered import sequence
from stepwise.plans.skew import cut, resolve

MIN_FREQUENCY = 10
TOP_VARIANTS = 20
TOP_TWO_STEP = 5
TOP_THREE_STEP = 3
TOP_CYCLES = 10
MAX_CYCLE = 5
START_END_SHARE = 0.05
ARROW = " → "


def event_log(
    events: DataFrame,
    *,
    time_window_hours: float | None = None,
    as_of: datetime | None = None,
    filter_events: Sequence[str] | None = None,
) -> DataFrame:
    """Rows of the log: named events, optionally the last hours before ``as_of`` (default:
    the newest event) and a subset of the names."""
    rows = timed(events).filter(F.col("event_name").isNotNull())
    if time_window_hours is not None:
        span = round(time_window_hours * HOUR_US)
        if as_of is None:
            newest = rows.agg(F.max("us").alias("m")).scalar()
        else:
            newest = F.unix_micros(F.lit(as_of).cast("timestamp"))
        rows = rows.filter(F.col("us").between(newest - span, newest))
    if filter_events is not None:
        rows = rows.filter(F.col("event_name").isin(*filter_events))
    return rows


def journeys(log: DataFrame, *, slices="auto") -> DataFrame:
    """Each event with its position, successor and hours to the successor."""
    require_order(log)
    rows = log.select("user_id", "event_name", "us", "ord")
    slices = resolve(rows, slices)
    return sequence(cut(rows, slices), slices=slices).withColumn(
        "duration_to_next", seconds_as_hours(F.col("next_us") - F.col("us"))
    )


def journey_table(log: DataFrame, *, slices="auto") -> DataFrame:
    """Journeys with readable times, for export."""
    return journeys(log, slices=slices).select(
        "user_id",
        "event_name",
        from_micros("us").alias("timestamp"),
        F.col("pos").alias("event_order"),
        "duration_to_next",
        "is_start",
        "is_end",
    )


def _percent(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole * 100).otherwise(0.0)


def activities(walks: DataFrame) -> DataFrame:
    """Frequency, users, durations, type and success rate per activity.

    Success rate: share of the activity's users with a success event at any time.
    """
    per_user = walks.groupBy("user_id", "event_name").agg(
        F.count(F.lit(1)).alias("n"),
        F.min("us").alias("first_us"),
        F.max("us").alias("last_us"),
        F.sum("duration_to_next").alias("hours"),
        F.count("duration_to_next").alias("gaps"),
        F.count_if("is_start").alias("starts"),
        F.count_if("is_end").alias("ends"),
    )
    # One row per user and activity: a user's partition is as small as the activity list.
    flagged = per_user.withColumn(
        "succeeded", F.max(is_success("event_name")).over(Window.partitionBy("user_id"))
    )
    users = F.count(F.lit(1))
    starts, ends = F.sum("starts"), F.sum("ends")
    return flagged.groupBy("event_name").agg(
        F.sum("n").alias("frequency"),
        users.alias("unique_users"),
        F.when(F.sum("gaps") > 0, F.sum("hours") / F.sum("gaps"))
        .otherwise(0.0)
        .alias("avg_duration"),
        (starts > 0).alias("is_start"),
        (ends > 0).alias("is_end"),
        activity_type(F.col("event_name"), starts, ends).alias("activity_type"),
        (F.count_if("succeeded") / users * 100).alias("success_rate"),
        from_micros(F.min("first_us")).alias("first_occurrence"),
        from_micros(F.max("last_us")).alias("last_occurrence"),
    )


def continuation_rates(walks: DataFrame) -> DataFrame:
    """Share of an activity's occurrences that are followed by another event."""
    return walks.groupBy("event_name").agg(
        (F.count_if(~F.col("is_end")) / F.count(F.lit(1)) * 100).alias("continuation_rate")
    )


def _edges(walks: DataFrame, *, skip_zero: bool) -> DataFrame:
    hours = F.col("duration_to_next")
    counted = F.when(hours > 0, hours) if skip_zero else hours
    per_user = (
        walks.filter(~F.col("is_end"))
        .groupBy("user_id", F.col("event_name").alias("source"), F.col("next_event").alias("target"))
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.sum(counted).alias("hours"),
            F.count(counted).alias("gaps"),
        )
    )
    return per_user.groupBy("source", "target").agg(
        F.sum("n").alias("frequency"),
        F.count(F.lit(1)).alias("unique_users"),
        F.when(F.sum("gaps") > 0, F.sum("hours") / F.sum("gaps"))
        .otherwise(0.0)
        .alias("avg_duration"),
    )


def _finish_edges(edges: DataFrame, total: Column) -> DataFrame:
    return edges.withColumns(
        {
            "probability": F.col("frequency") / total * 100,
            "transition_type": transition_type(
                F.col("source"), F.col("target"), F.col("frequency")
            ),
        }
    )


def transitions(walks: DataFrame, min_frequency: int = MIN_FREQUENCY) -> DataFrame:
    """Directly-follows pairs; probability is among the pairs that pass the threshold."""
    kept = _edges(walks, skip_zero=False).filter(F.col("frequency") >= min_frequency)
    return _finish_edges(kept, kept.agg(F.sum("frequency").alias("t")).scalar())


def transitions_of_all(walks: DataFrame, min_frequency: int = MIN_FREQUENCY) -> DataFrame:
    """Variant: probability among all pairs, durations of zero left out of the mean."""
    edges = _edges(walks, skip_zero=True)
    total = edges.agg(F.sum("frequency").alias("t")).scalar()
    return _finish_edges(edges.filter(F.col("frequency") >= min_frequency), total)


def top_transitions(edges: DataFrame, limit: int = 10) -> DataFrame:
    return edges.orderBy(F.col("frequency").desc(), "source", "target").limit(limit)


def frequent_transitions(edges: DataFrame, min_frequency: int) -> DataFrame:
    return edges.filter(F.col("frequency") >= min_frequency)


def _signatures(walks: DataFrame) -> DataFrame:
    """One row per user: length and a 128-bit order-sensitive fingerprint of the path.

    The fingerprint combines hashes of (position, name), so it needs no list of the path
    and a user's rows may be spread over many tasks.
    """
    place = (F.col("pos"), F.col("event_name"))
    return walks.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("length"),
        F.bit_xor(F.xxhash64(*place)).alias("sig_a"),
        F.bit_xor(F.xxhash64(F.lit("second"), *place)).alias("sig_b"),
        F.coalesce(F.sum("duration_to_next"), F.lit(0.0)).alias("hours"),
        F.bool_or(is_success("event_name")).alias("any_success"),
        F.bool_or(F.col("is_end") & is_success("event_name")).alias("completed"),
    )


def _variant_groups(walks: DataFrame) -> DataFrame:
    """Surviving variants with their measures and one user that followed each."""
    groups = (
        _signatures(walks)
        .groupBy("length", "sig_a", "sig_b")
        .agg(
            F.count(F.lit(1)).alias("frequency"),
            F.avg("hours").alias("avg_duration"),
            (F.avg(F.col("any_success").cast("int")) * 100).alias("success_rate"),
            F.min("user_id").alias("user_id"),
        )
    )
    users = groups.agg(F.sum("frequency").alias("u")).scalar()
    threshold = F.greatest(F.lit(1), F.call_function("div", users, F.lit(10)))
    return groups.filter(F.col("frequency") >= threshold).drop("sig_a", "sig_b")


def variant_steps(walks: DataFrame) -> DataFrame:
    """The variants in long form, one row per position of the path; ``example_user`` names
    the variant.  No path is gathered into a row, however long it is."""
    # A tenth of the users each: fewer than twenty variants to broadcast.
    kept = F.broadcast(_variant_groups(walks).select("user_id", "frequency"))
    return (
        walks.select("user_id", "pos", "event_name")
        .join(kept, "user_id")
        .select(
            F.col("user_id").alias("example_user"),
            "frequency",
            F.col("pos").alias("position"),
            "event_name",
        )
    )


def variants(walks: DataFrame, limit: int | None = TOP_VARIANTS) -> DataFrame:
    """Paths followed by at least a tenth of the users (at least one), the most frequent first.

    Only the surviving paths, fewer than twenty, are spelled out, each from one user that
    followed it.  ``variant_steps`` gives them in long form, for journeys too long for a text.
    """
    kept = _variant_groups(walks)
    # A tenth of the users each: fewer than twenty variants to broadcast.
    spelled = (
        walks.select("user_id", "pos", "event_name")
        .join(F.broadcast(kept.select("user_id")), "user_id")
        .groupBy("user_id")
        .agg(F.array_sort(F.collect_list(F.struct("pos", "event_name"))).alias("steps"))
        .select(
            "user_id",
            F.array_join(F.transform("steps", lambda s: s["event_name"]), ARROW).alias("path"),
        )
    )
    ranked = (
        kept.join(spelled, "user_id", "left")
        .select(
            "path",
            "frequency",
            "success_rate",
            "avg_duration",
            variant_type("success_rate").alias("variant_type"),
            F.col("user_id").alias("example_user"),
        )
        .orderBy(F.col("frequency").desc(), "path")
    )
    return ranked if limit is None else ranked.limit(limit)


def journey_success(walks: DataFrame) -> DataFrame:
    """Per user: does the last event name a success?"""
    return walks.filter("is_end").select(
        "user_id", is_journey_success("event_name").alias("succeeded")
    )


def endpoints(walks: DataFrame) -> DataFrame:
    """Activities that start or end at least 5 % of the journeys (at least one)."""
    counts = (
        walks.filter(F.col("is_start") | F.col("is_end"))
        .groupBy("event_name")
        .agg(F.count_if("is_start").alias("starts"), F.count_if("is_end").alias("ends"))
    )
    # Every journey has exactly one start.
    total = counts.agg(F.sum("starts").alias("t")).scalar()
    ends = F.array(
        *[
            F.struct(F.lit(kind).alias("kind"), F.col(column).alias("n"))
            for kind, column in (("start", "starts"), ("end", "ends"))
        ]
    )
    threshold = F.greatest(F.lit(1.0), total * F.lit(START_END_SHARE))
    return counts.select("event_name", F.inline(ends)).filter(
        (F.col("n") > 0) & (F.col("n") >= threshold)
    )


def self_loops(edges: DataFrame) -> DataFrame:
    loops = edges.filter(F.col("source") == F.col("target"))
    return loops.select(
        F.array("source").alias("path"),
        "frequency",
        F.lit("loop").alias("type"),
        impact(F.col("source"), LOOP_NEGATIVE_WORDS).alias("impact"),
    )


def _cycle_row(path: Column, frequency: Column) -> list[Column]:
    return [
        path.alias("path"),
        frequency.alias("frequency"),
        F.lit("cycle").alias("type"),
        impact(F.array_join(path, " "), CYCLE_NEGATIVE_WORDS).alias("impact"),
    ]


def two_step_cycles(
    edges: DataFrame, limit: int | None = TOP_TWO_STEP, *, dedupe: bool = False
) -> DataFrame:
    """A → B → A; both rotations are listed unless ``dedupe``."""
    out = edges.select(F.col("source").alias("a"), F.col("target").alias("b"),
                       F.col("frequency").alias("f1"))
    back = edges.select(F.col("source").alias("b"), F.col("target").alias("a"),
                        F.col("frequency").alias("f2"))
    found = out.join(back, ["a", "b"]).filter(
        F.col("a") < F.col("b") if dedupe else F.col("a") != F.col("b")
    )
    cycles = found.select(*_cycle_row(F.array("a", "b"), F.least("f1", "f2")))
    return cycles if limit is None else _top(cycles, limit)


def _top(cycles: DataFrame, limit: int) -> DataFrame:
    return cycles.orderBy(F.col("frequency").desc(), F.array_join("path", ARROW)).limit(limit)


def three_step_cycles(
    edges: DataFrame, limit: int | None = TOP_THREE_STEP, *, max_edges: int | None = None
) -> DataFrame:
    """A → B → C → A, all different.

    ``max_edges`` leaves graphs of as many transitions or more without three-step cycles.
    """
    small = edges.filter(F.col("source") != F.col("target"))
    if max_edges is not None:
        small = small.filter(edges.agg(F.count(F.lit(1)).alias("n")).scalar() < max_edges)

    def named(a: str, b: str, f: str) -> DataFrame:
        return small.select(
            F.col("source").alias(a), F.col("target").alias(b), F.col("frequency").alias(f)
        )

    found = named("a", "b", "f1").join(named("b", "c", "f2"), "b").join(
        named("c", "a", "f3"), ["c", "a"]
    )
    cycles = found.select(*_cycle_row(F.array("a", "b", "c"), F.least("f1", "f2", "f3")))
    return cycles if limit is None else _top(cycles, limit)


def _returns(log: DataFrame, slices) -> DataFrame:
    """Per user and event: first and last time, and the sum and number of the whole hours
    above zero from one occurrence to the next.

    Unless a user is hot, rows move by user, as the journeys' do, so that a plan with both
    orders the log in one shuffle; hot users are cut for each of their events.
    """
    require_order(log)
    rows = log.select("user_id", "event_name", "us", "ord")
    keys = ("user_id", "event_name")
    if slices == "auto" and resolve(rows, slices) is None:
        slices = None
    else:
        slices = resolve(rows, slices, keys)
    if slices is None:
        following = Window.partitionBy(*keys).orderBy("pos")
        rows = sequence(rows).withColumn("again_us", F.lead("us").over(following))
    else:
        rows = sequence(cut(rows, slices), slices=slices, keys=keys)
        rows = rows.withColumn("again_us", F.col("next_us"))
    hours = whole_hours(F.col("again_us") - F.col("us"))
    return rows.withColumn("hours", F.when(hours > 0, hours)).groupBy(*keys).agg(
        F.min("us").alias("lo"),
        F.max("us").alias("hi"),
        F.sum("hours").alias("hours"),
        F.count("hours").alias("gaps"),
    )


def recurrence_hours(log: DataFrame, *, slices="auto") -> DataFrame:
    """Mean whole hours between consecutive occurrences of an event by a user, zeros out."""
    return (
        _returns(log, slices)
        .groupBy("event_name")
        .agg((F.sum("hours") / F.nullif(F.sum("gaps"), F.lit(0))).alias("avg_cycle_time"))
        .filter("avg_cycle_time IS NOT NULL")
    )


def _cycle_hours(log: DataFrame, cycles: DataFrame, slices) -> DataFrame:
    """Mean time of cycles of one activity, the hours until it comes again, and of two: the
    mean over users of the whole hours between the first and the last of both activities."""
    ends = cycles.select("cycle", "length", F.explode("path").alias("event_name"))
    per_user = (
        _returns(log, slices)
        .join(ends, "event_name")
        .groupBy("cycle", "length", "user_id")
        .agg(
            F.min("lo").alias("lo"),
            F.max("hi").alias("hi"),
            F.sum("hours").alias("hours"),
            F.sum("gaps").alias("gaps"),
        )
    )
    span = F.when(F.col("lo") != F.col("hi"), whole_hours(F.col("hi") - F.col("lo")))
    return per_user.groupBy("cycle").agg(
        F.when(F.max("length") > 1, F.avg(span))
        .otherwise(F.sum("hours") / F.nullif(F.sum("gaps"), F.lit(0)))
        .alias("time")
    )


def cycles(
    log: DataFrame,
    edges: DataFrame,
    *,
    slices="auto",
    limit: int | None = TOP_CYCLES,
    two_step: int | None = TOP_TWO_STEP,
    three_step: int | None = TOP_THREE_STEP,
) -> DataFrame:
    """Self-loops, two-step and three-step cycles by frequency, with their mean time.

    Of each kind the most frequent are ranked together; no limit means all.  Three-step cycles
    carry a time of zero.
    """
    loops = self_loops(edges)
    twos = two_step_cycles(edges, two_step)
    threes = three_step_cycles(edges, three_step)
    ranked = loops.unionByName(twos).unionByName(threes).withColumn(
        "cycle", F.array_join("path", ARROW)
    )
    if limit is not None:
        ranked = ranked.orderBy(F.col("frequency").desc(), "cycle").limit(limit)
    timed = loops.unionByName(twos).select(
        F.array_join("path", ARROW).alias("cycle"), F.size("path").alias("length"), "path"
    )
    time = _cycle_hours(log, timed, slices)
    return ranked.join(time, "cycle", "left").select(
        "cycle",
        F.size("path").cast("bigint").alias("length"),
        "frequency",
        "type",
        "impact",
        F.coalesce("time", F.lit(0.0)).alias("avg_cycle_time"),
    )


def cyclic_hops(edges: DataFrame, max_length: int = MAX_CYCLE) -> DataFrame:
    """The transitions, as (hop_from, hop_to), whose target leads back to their source, so that
    the way round is not (much) longer than max_length.

    Which activities reach which is found by doubling the number of steps; the tables hold
    pairs of activities and are written before each round.
    """
    hops = materialised(
        edges.select(F.col("source").alias("hop_from"), F.col("target").alias("hop_to"))
    )
    within, steps = hops.distinct(), 1
    while steps < max_length - 1:
        onward = within.select(F.col("hop_from").alias("hop_to"), F.col("hop_to").alias("_far"))
        further = within.join(onward, "hop_to").select("hop_from", F.col("_far").alias("hop_to"))
        within, steps = materialised(within.union(further).distinct()), steps * 2
    home = within.select(F.col("hop_from").alias("hop_to"), F.col("hop_to").alias("hop_from"))
    return hops.join(home, ["hop_from", "hop_to"], "left_semi")


def simple_cycles(edges: DataFrame, max_length: int = MAX_CYCLE) -> DataFrame:
    """Simple cycles of the transition graph up to a length, beginning at their
    alphabetically first activity; one join per length.

    Transitions that lie on no cycle are dropped before paths grow; a graph without cycles has
    no paths at all.
    """
    hops = materialised(cyclic_hops(edges, max_length))
    paths = hops.select(F.array("hop_from").alias("path")).distinct()
    closed = None
    for length in range(1, max_length + 1):
        end = F.element_at("path", -1)
        back = hops.select(F.col("hop_from").alias("_end"), F.col("hop_to").alias("_first"))
        found = (
            paths.withColumns({"_end": end, "_first": F.col("path")[0]})
            .join(back, ["_end", "_first"], "left_semi")
            .select("path")
        )
        closed = found if closed is None else closed.unionByName(found)
        if length < max_length:
            paths = (
                paths.withColumn("hop_from", end)
                .join(hops, "hop_from")
                .filter(F.col("hop_to") > F.col("path")[0])
                .filter(~F.array_contains("path", F.col("hop_to")))
                .select(F.array_append("path", F.col("hop_to")).alias("path"))
            )
    return closed


def graph_cycles(
    walks: DataFrame,
    edges: DataFrame,
    *,
    max_length: int = MAX_CYCLE,
    limit: int | None = TOP_CYCLES,
) -> DataFrame:
    """Simple cycles with how often, and how fast, their path occurs in the journeys."""
    found = materialised(
        simple_cycles(edges, max_length).withColumn("cycle", F.array_join("path", ARROW))
    )
    # Only at events that can begin a listed cycle are sequences, of its length, spelled out.
    lengths = found.groupBy(F.col("path")[0].alias("_first")).agg(
        F.collect_set(F.size("path")).alias("_lengths")
    )
    ahead = _following(walks, max_length).withColumn("_first", F.col("names")[0])
    ahead = ahead.join(lengths, "_first")
    grams = [
        F.when(
            (F.size("names") >= k) & F.array_contains("_lengths", k),
            F.struct(
                F.array_join(F.slice("names", 1, k), ARROW).alias("cycle"),
                (
                    F.aggregate(F.slice("gaps", 1, k - 1), F.lit(0.0), lambda acc, x: acc + x)
                    if k > 1
                    else F.lit(0.0)
                ).alias("hours"),
            ),
        )
        for k in range(1, max_length + 1)
    ]
    occurrences = (
        ahead.select(F.explode(F.array_compact(F.array(*grams))).alias("g"))
        .select("g.*")
        .groupBy("cycle")
        .agg(F.count(F.lit(1)).alias("frequency"), F.avg("hours").alias("avg_cycle_time"))
    )
    result = found.join(occurrences, "cycle", "left").select(
        "cycle",
        F.coalesce("frequency", F.lit(0)).alias("frequency"),
        F.when(F.size("path") == 1, "loop").otherwise("cycle").alias("type"),
        F.when(
            contains_any(F.col("cycle"), LEGACY_NEGATIVE_WORDS), "negative"
        ).otherwise("positive").alias("impact"),
        F.coalesce("avg_cycle_time", F.lit(0.0)).alias("avg_cycle_time"),
    )
    if limit is None:
        return result
    return result.orderBy(F.col("frequency").desc(), "cycle").limit(limit)


def _following(walks: DataFrame, n: int) -> DataFrame:
    """Each event with the names of itself and its next n-1 events, and the hours between.

    Events are grouped in blocks of positions, each block with a copy of the first n-1
    events after it, so that a long journey is many small groups.
    """
    block = 100_000
    at = F.col("pos") % block
    home = F.call_function("div", F.col("pos"), F.lit(block))
    copies = F.when((at < n - 1) & (home > 0), F.array(home, home - 1)).otherwise(F.array(home))
    spread = walks.select(
        "user_id", "pos", "event_name", "duration_to_next", F.explode(copies).alias("_block")
    )
    order = Window.partitionBy("user_id", "_block").orderBy("pos")
    leads = {
        f"_e{k}": F.lead("event_name", k).over(order) for k in range(1, n)
    } | {f"_h{k}": F.lead("duration_to_next", k).over(order) for k in range(1, n - 1)}
    wide = spread.withColumns(leads).filter(
        F.col("_block") == F.call_function("div", F.col("pos"), F.lit(block))
    )
    return wide.select(
        F.array_compact(F.array("event_name", *[f"_e{k}" for k in range(1, n)])).alias("names"),
        F.array("duration_to_next", *[f"_h{k}" for k in range(1, n - 1)]).alias("gaps"),
    )


def statistics(walks: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: cases, mean duration, completion, distinct paths, activities, transitions."""
    users = _signatures(walks)
    by_path = users.groupBy("length", "sig_a", "sig_b").agg(
        F.count(F.lit(1)).alias("cases"),
        F.sum("hours").alias("hours"),
        F.count_if("completed").alias("completed"),
    )
    names = walks.agg(F.count_distinct("event_name").alias("n")).scalar()
    links = edges.agg(F.count(F.lit(1)).alias("n")).scalar()
    cases = F.coalesce(F.sum("cases"), F.lit(0))
    return by_path.agg(
        cases.alias("total_cases"),
        F.when(cases > 0, F.sum("hours") / cases).otherwise(0.0).alias("avg_duration"),
        _percent(F.sum("completed"), cases).alias("completion_rate"),
        F.count(F.lit(1)).alias("unique_paths"),
    ).select("*", names.alias("total_activities"), links.alias("total_transitions"))


def insights(
    acts: DataFrame, found_cycles: DataFrame | None, found_variants: DataFrame, stats: DataFrame
) -> DataFrame:
    """Rules that fire, as (rule, subject, value); wording is left to the reader."""

    def rule(df: DataFrame, name: str, subject: Column, value: Column) -> DataFrame:
        return df.select(
            F.lit(name).alias("rule"),
            subject.cast("string").alias("subject"),
            value.cast("double").alias("value"),
        )

    completion = F.col("completion_rate")
    nothing = F.lit(None)
    slow = acts.filter(F.col("avg_duration") > 24).orderBy(
        F.col("avg_duration").desc(), "event_name"
    )
    popular = found_variants.orderBy(F.col("frequency").desc(), "path")
    parts = [
        rule(
            stats.filter(F.col("unique_paths") > F.col("total_cases") * 0.8),
            "high_variability", nothing, F.col("unique_paths"),
        ),
        rule(slow.limit(1), "bottleneck", F.col("event_name"), F.col("avg_duration")),
        rule(popular.limit(1), "most_common_path", F.col("path"), F.col("frequency")),
        rule(stats.filter(completion < 30), "low_completion", nothing, completion),
        rule(stats.filter(completion > 70), "high_completion", nothing, completion),
    ]
    if found_cycles is not None:
        negative = found_cycles.filter(F.col("impact") == "negative").orderBy(
            F.col("frequency").desc(), "cycle"
        )
        parts.append(
            rule(negative.limit(1), "negative_cycle", F.col("cycle"), F.col("frequency"))
        )
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def main_path(acts: DataFrame, edges: DataFrame) -> DataFrame:
    """The path from the start activity along the most frequent transitions.

    Start: a source without incoming transitions, else the most frequent activity; ties go
    to the alphabetically first name.  The walk ends at a repeat, so it has one row per
    activity at most.  Every activity has one best successor; a round doubles the distance that
    is looked ahead, so a path of n activities takes log2(n) rounds.
    """
    jump = materialised(
        edges.groupBy(F.col("source").alias("node")).agg(
            F.min(F.struct(-F.col("frequency"), F.col("target")))["target"].alias("next_node")
        )
    )
    sources = edges.select(F.col("source").alias("node")).distinct()
    targets = edges.select(F.col("target").alias("node")).distinct()
    entry = sources.join(targets, "node", "left_anti").agg(F.min("node").alias("node")).scalar()
    busiest = acts.agg(
        F.min(F.struct(-F.col("frequency"), F.col("event_name")))["event_name"].alias("node")
    )
    reached = materialised(
        busiest.select(F.coalesce(entry, F.col("node")).alias("node"), F.lit(0).alias("position"))
        .filter(F.col("node").isNotNull())
    )
    activities, distance = jump.count() + 1, 1
    while distance < activities:
        ahead = reached.join(jump, "node").select(
            F.col("next_node").alias("node"), (F.col("position") + distance).alias("position")
        )
        # The first visit counts.
        reached = materialised(
            reached.union(ahead).groupBy("node").agg(F.min("position").alias("position"))
        )
        distance *= 2
        if distance < activities:
            further = jump.select(
                F.col("node").alias("next_node"), F.col("next_node").alias("_further")
            )
            jump = materialised(
                jump.join(further, "next_node").select("node", F.col("_further").alias("next_node"))
            )
    return reached.select("position", F.col("node").alias("activity"))


def main_path_dropout(path: DataFrame, acts: DataFrame) -> DataFrame:
    """Users per activity on the main path and the loss against the one before."""
    users = path.join(acts.select(F.col("event_name").alias("activity"), "unique_users"), "activity")
    before = F.lag("unique_users").over(Window.partitionBy().orderBy("position"))
    return users.select(
        "position",
        "activity",
        "unique_users",
        F.when(before > 0, (before - F.col("unique_users")) / before * 100)
        .otherwise(0.0)
        .alias("dropout_rate"),
    )
