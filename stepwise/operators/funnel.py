"""Conversion funnels and the tables derived from them.

A funnel is one row of step counts per segment, computed by per-user flags chained as
booleans; the long result table is unfolded from that row.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stepwise.functions.labels import bands
from stepwise.functions.texts import text_literal
from stepwise.model import ALL_USERS, CountingMethod, FunnelConfig, check_steps
from stepwise.operators.events import (
    require_order,
    segment_events,
    segment_names,
    step_events,
    timed,
)
from stepwise.plans.ordered import running, totals
from stepwise.plans.skew import cut, resolve

FUNNEL_SCHEMA = (
    "segment string, step_idx int, step string, users bigint, conversion_rate double, "
    "drop_off bigint, drop_off_rate double, step_rate double"
)


def _keys(cfg: FunnelConfig) -> list[str]:
    return ["segment", "user_id"] if cfg.segmented else ["user_id"]


def _rows(events: DataFrame, steps: Sequence[str], cfg: FunnelConfig) -> DataFrame:
    """Step rows with the step's number: what travels through the shuffle is narrow."""
    rows = segment_events(timed(step_events(events, steps)), cfg)
    cases = " ".join(f"WHEN {text_literal(s)} THEN {i}" for i, s in enumerate(steps))
    number = F.expr(f"CASE event_name {cases} END").alias("step_no")
    order = ["ord"] if "ord" in rows.columns else []
    return rows.select(*_keys(cfg), number, "us", *order)


def _is(number: int) -> Column:
    return F.col("step_no") == number


def _any(flag: Column) -> Column:
    return F.coalesce(F.bool_or(flag), F.lit(False))


def _chained(conversions: Sequence[Column]) -> list[Column]:
    """reached_i = reached_{i-1} AND converted_i."""
    reached: list[Column] = []
    for flag in conversions:
        reached.append(reached[-1] & flag if reached else flag)
    return reached


def _count_users(per_user: DataFrame, reached: Sequence[Column], cfg: FunnelConfig) -> DataFrame:
    by = ["segment"] if cfg.segmented else []
    return per_user.groupBy(*by).agg(
        *[F.count_if(flag).alias(f"n{i}") for i, flag in enumerate(reached)]
    )


def _first_only(rows: DataFrame, steps: Sequence[str], cfg: FunnelConfig, slices) -> DataFrame:
    """Converted when the first prev and curr events in data order lie within the window."""
    require_order(rows)
    keys, window = _keys(cfg), cfg.window_us
    firsts = {
        f"f{i}": F.min_by("us", F.when(_is(i), F.col("ord"))) for i in range(len(steps))
    }
    # Transitions that need a look at later steps between the two events.
    strict = [
        i
        for i in range(1, len(steps) - 1)
        if window > 0 and not any(word in steps[i - 1] for word in cfg.strict_order_exempt)
    ]
    if cfg.unordered:
        strict = []
    seen = _any(_is(0)).alias("seen")
    if not strict:
        per_user = rows.groupBy(*keys).agg(seen, *[c.alias(n) for n, c in firsts.items()])
    else:
        slices = resolve(rows, slices)
        with_firsts = totals(cut(rows, slices), firsts, slices=slices, keys=keys)
        skipped = [
            _any(
                (F.col("step_no") > i)
                & (F.col("us") > F.col(f"f{i - 1}"))
                & (F.col("us") < F.col(f"f{i}"))
            ).alias(f"bad{i}")
            for i in strict
        ]
        per_user = with_firsts.groupBy(*keys).agg(
            seen, *[F.max(n).alias(n) for n in firsts], *skipped
        )
    converted = [F.col("seen")]
    for i in range(1, len(steps)):
        gap = F.col(f"f{i}") - F.col(f"f{i - 1}")
        if window == 0:
            ok = gap == 0
        elif cfg.unordered:
            ok = F.abs(gap) < window
        else:
            ok = (gap >= 0) & (gap < window)
        if i in strict:
            ok = ok & ~F.col(f"bad{i}")
        converted.append(F.coalesce(ok, F.lit(False)))
    return _count_users(per_user, _chained(converted), cfg)


def _same_time(rows: DataFrame, steps: Sequence[str], cfg: FunnelConfig) -> DataFrame:
    """Zero window: some prev and curr event carry the same timestamp."""
    keys = _keys(cfg)
    per_time = rows.groupBy(*keys, "us").agg(
        *[_any(_is(i)).alias(f"e{i}") for i in range(len(steps))]
    )
    timed_pair = F.col("us").isNotNull()
    flags = [F.col("e0")] + [
        F.col(f"e{i - 1}") & F.col(f"e{i}") & timed_pair for i in range(1, len(steps))
    ]
    per_user = per_time.groupBy(*keys).agg(*[_any(f).alias(f"c{i}") for i, f in enumerate(flags)])
    return _count_users(per_user, _chained([F.col(f"c{i}") for i in range(len(steps))]), cfg)


def _reentry(rows: DataFrame, steps: Sequence[str], cfg: FunnelConfig, slices) -> DataFrame:
    """Converted when any prev event has its next curr event inside the window, with no
    later step strictly between the two."""
    keys, window = _keys(cfg), cfg.window_us
    slices = resolve(rows, slices)
    nexts = {f"x{i}": ("min", F.when(_is(i), F.col("us"))) for i in range(1, len(steps))}
    ahead = running(cut(rows, slices), nexts, side="after", slices=slices, keys=keys)
    flags = [_is(0)]
    for i in range(1, len(steps)):
        found = F.col(f"x{i}")
        ok = _is(i - 1) & (found - F.col("us") < window)
        later = [F.col(f"x{j}") for j in range(i + 1, len(steps))]
        if later:
            soonest = F.least(*later) if len(later) > 1 else later[0]
            ok = ok & (soonest.isNull() | (soonest >= found))
        flags.append(ok)
    per_user = ahead.groupBy(*keys).agg(*[_any(f).alias(f"c{i}") for i, f in enumerate(flags)])
    return _count_users(per_user, _chained([F.col(f"c{i}") for i in range(len(steps))]), cfg)


def _any_order_pairs(rows: DataFrame, steps: Sequence[str], cfg: FunnelConfig, slices) -> DataFrame:
    """Converted when some prev and curr event are less than the window apart."""
    keys, window = _keys(cfg), cfg.window_us
    slices = resolve(rows, slices)
    nexts = {f"x{i}": ("min", F.when(_is(i), F.col("us"))) for i in range(len(steps))}
    ahead = running(cut(rows, slices), nexts, side="after", ties=True, slices=slices, keys=keys)
    flags = [_is(0)]
    for i in range(1, len(steps)):
        forth = _is(i - 1) & (F.col(f"x{i}") - F.col("us") < window)
        back = _is(i) & (F.col(f"x{i - 1}") - F.col("us") < window)
        flags.append(forth | back)
    per_user = ahead.groupBy(*keys).agg(*[_any(f).alias(f"c{i}") for i, f in enumerate(flags)])
    return _count_users(per_user, _chained([F.col(f"c{i}") for i in range(len(steps))]), cfg)


def _unordered(rows: DataFrame, steps: Sequence[str], cfg: FunnelConfig) -> DataFrame:
    """Reached i when the first times of steps 0..i all exist and span at most the window."""
    per_user = rows.groupBy(*_keys(cfg)).agg(
        *[F.min(F.when(_is(i), F.col("us"))).alias(f"t{i}") for i in range(len(steps))]
    )
    flags = [F.col("t0").isNotNull()]
    for i in range(1, len(steps)):
        times = [F.col(f"t{j}") for j in range(i + 1)]
        present = reduce(lambda a, b: a & b, [t.isNotNull() for t in times])
        flags.append(present & (F.greatest(*times) - F.least(*times) <= cfg.window_us))
    return _count_users(per_user, _chained(flags), cfg)


def _event_totals(rows: DataFrame, steps: Sequence[str], cfg: FunnelConfig) -> DataFrame:
    by = ["segment"] if cfg.segmented else []
    return rows.groupBy(*by).agg(
        *[F.count_if(_is(i)).alias(f"n{i}") for i in range(len(steps))]
    )


def _with_requested_segments(counts: DataFrame, cfg: FunnelConfig, n: int) -> DataFrame:
    """Requested values without events are left out, unless no value matched at all.

    ``counts`` has at most one row per requested value, so it fits in one map.
    """
    columns = ", ".join(f"n{i}" for i in range(n))
    found = counts.agg(
        F.expr(f"map_from_entries(collect_list(struct(segment, struct({columns}))))").alias("m")
    )
    requested = ", ".join(text_literal(name) for name in segment_names(cfg))
    users = ", ".join(f"'n{i}', coalesce(m[s].n{i}, 0L)" for i in range(n))
    return found.selectExpr(
        f"""inline(transform(
            filter(array({requested}), s -> size(m) = 0 OR map_contains_key(m, s)),
            s -> named_struct('segment', s, {users})))"""
    )


def _rate(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole * 100).otherwise(F.lit(0.0))


def _unfold(counts: DataFrame, steps: Sequence[str]) -> DataFrame:
    """Counts n0..nk of a segment as rows with rates.  The generator is one SQL text: as
    nested Column calls it would dominate the time to plan a funnel."""

    def rate(part: str, whole: str) -> str:
        return f"IF({whole} > 0, {part} / {whole} * 100, 0D)"

    entries = []
    for i, step in enumerate(steps):
        now, before = f"n{i}", f"n{max(i - 1, 0)}"
        lost = f"({before} - {now})"
        first = i == 0
        entries.append(
            f"""named_struct(
                'step_idx', {i}, 'step', {text_literal(step)}, 'users', {now},
                'conversion_rate', {"100D" if first else rate(now, "n0")},
                'drop_off', {"0L" if first else lost},
                'drop_off_rate', {"0D" if first else rate(lost, before)},
                'step_rate', {"100D" if first else rate(now, before)})"""
        )
    return counts.selectExpr("segment", f"inline(array({', '.join(entries)}))")


def funnel(
    events: DataFrame,
    steps: Sequence[str],
    cfg: FunnelConfig = FunnelConfig(),
    *,
    slices="auto",
) -> DataFrame:
    """Funnel table: users, rates and drop-offs per step and segment.

    Fewer than two steps give an empty table.  Unordered funnels ignore the counting
    method and the re-entry mode.
    """
    steps = check_steps(steps)
    if len(steps) < 2:
        return events.sparkSession.createDataFrame([], FUNNEL_SCHEMA)
    rows = _rows(events, steps, cfg)
    if cfg.unordered:
        counts = _unordered(rows, steps, cfg)
    elif cfg.counting_method is CountingMethod.EVENT_TOTALS:
        counts = _event_totals(rows, steps, cfg)
    else:
        counts = _chained_counts(rows, steps, cfg, slices)
    if cfg.segmented:
        counts = _with_requested_segments(counts, cfg, len(steps))
    else:
        counts = counts.withColumn("segment", F.lit(ALL_USERS))
    return _unfold(counts, steps)


def _chained_counts(rows, steps, cfg: FunnelConfig, slices) -> DataFrame:
    if cfg.first_only:
        return _first_only(rows, steps, cfg, slices)
    if cfg.window_us == 0:
        return _same_time(rows, steps, cfg)
    if cfg.unordered:
        return _any_order_pairs(rows, steps, cfg, slices)
    return _reentry(rows, steps, cfg, slices)


def pair_conversion(
    events: DataFrame,
    steps: Sequence[str],
    cfg: FunnelConfig,
    *,
    slices="auto",
) -> DataFrame:
    """Step-to-step chaining without regard to direction: |gap| below the window.

    FIRST_ONLY compares the first events in data order, re-entry any pair.
    """
    steps = check_steps(steps)
    counts = _chained_counts(_rows(events, steps, cfg), steps, cfg, slices)
    if not cfg.segmented:
        counts = counts.withColumn("segment", F.lit(ALL_USERS))
    return _unfold(counts, steps)


# Tables derived from a funnel table.  Their windows run over the steps of one segment.

def _by_step():
    return Window.partitionBy("segment").orderBy("step_idx")


def _all_steps():
    return _by_step().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


def funnel_kpis(table: DataFrame) -> DataFrame:
    """Overall conversion, first and last users, total drop-offs, worst step, mean loss."""
    later = F.col("step_idx") > 0
    # Highest drop-off rate; the earlier step wins a tie.
    worst = F.min(
        F.when(later, F.struct(-F.col("drop_off_rate"), F.col("step_idx"), F.col("step")))
    )
    return (
        table.groupBy("segment")
        .agg(
            F.max_by("conversion_rate", "step_idx").alias("overall_conversion"),
            F.min_by("users", "step_idx").alias("starting_users"),
            F.max_by("users", "step_idx").alias("final_users"),
            F.sum("drop_off").alias("total_drop_offs"),
            worst.alias("_worst"),
            F.avg(F.when(later, F.col("drop_off_rate"))).alias("avg_step_drop_off"),
        )
        .select(
            "segment",
            "overall_conversion",
            "starting_users",
            "final_users",
            "total_drop_offs",
            F.col("_worst.step").alias("bottleneck_step"),
            (-F.col("_worst.col1")).alias("bottleneck_rate"),
            "avg_step_drop_off",
        )
    )


def completion_probability(table: DataFrame) -> DataFrame:
    """Share of the users at a step that finish the funnel; 100 at the last step."""
    final = F.last("users").over(_all_steps())
    is_last = F.col("step_idx") == F.max("step_idx").over(_all_steps())
    return table.select(
        "segment",
        "step_idx",
        "step",
        F.when(F.col("users") == 0, 0.0)
        .when(is_last, 100.0)
        .otherwise(final / F.col("users") * 100)
        .alias("completion_probability"),
    )


def flow_table(table: DataFrame) -> DataFrame:
    """Conversion and drop-off links between steps; links without users are left out."""
    ahead = table.select(
        "segment",
        F.col("step").alias("source"),
        F.lead("step").over(_by_step()).alias("next_step"),
        F.lead("users").over(_by_step()).alias("converted"),
        F.lead("drop_off").over(_by_step()).alias("lost"),
        F.lead("drop_off_rate").over(_by_step()).alias("rate"),
    ).filter(F.col("next_step").isNotNull())

    def link(target: Column, value: str, kind: str, severity: Column) -> Column:
        return F.struct(
            target.alias("target"),
            F.col(value).alias("value"),
            F.lit(kind).alias("kind"),
            severity.alias("severity"),
        )

    lost_to = F.concat(F.lit("Drop-off after "), F.col("source"))
    links = F.array(
        link(F.col("next_step"), "converted", "conversion", F.lit("success")),
        link(lost_to, "lost", "drop_off", bands("rate", ((50, "error"), (25, "warning")), "neutral")),
    )
    return ahead.select("segment", "source", F.inline(links)).filter(F.col("value") > 0)


def events_per_user(events: DataFrame, steps: Sequence[str]) -> DataFrame:
    """Events, users and their ratio per step."""
    per_user = (
        timed(step_events(events, steps))
        .groupBy("event_name", "user_id")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return (
        per_user.groupBy(F.col("event_name").alias("step"))
        .agg(F.sum("n").alias("events"), F.count(F.lit(1)).alias("users"))
        .withColumn("events_per_user", F.col("events") / F.col("users"))
    )


def segment_comparison(table: DataFrame) -> DataFrame:
    """First and last users and overall conversion per segment."""
    return (
        table.groupBy("segment")
        .agg(
            F.min_by("users", "step_idx").alias("starting_users"),
            F.max_by("users", "step_idx").alias("final_users"),
        )
        .withColumn(
            "overall_conversion", _rate(F.col("final_users"), F.col("starting_users"))
        )
    )


def segment_step_rates(table: DataFrame) -> DataFrame:
    """Users of a step as a share of the step before, per segment."""
    before = F.lag("users").over(_by_step())
    return table.select(
        "segment",
        "step_idx",
        "step",
        F.when(before.isNull(), 100.0)
        .when(before > 0, F.col("users") / before * 100)
        .otherwise(0.0)
        .alias("rate"),
    )
