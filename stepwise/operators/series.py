"""Time series of funnel starts, step reach and activity per period."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stepwise.functions.times import from_micros, period_end, period_start
from stepwise.model import FunnelConfig, check_steps
from stepwise.operators.events import require_order, step_events, timed
from stepwise.plans.ordered import ahead
from stepwise.plans.skew import cut, resolve


def _rows(events: DataFrame, steps: Sequence[str]) -> DataFrame:
    rows = timed(step_events(events, steps)).filter(F.col("us").isNotNull())
    extra = ["ord"] if "ord" in rows.columns else []
    return rows.select("user_id", "event_name", "us", "timestamp", *extra)


def _per_user(
    events: DataFrame,
    steps: Sequence[str],
    cfg: FunnelConfig,
    period: str,
    slices,
    *,
    strict: bool = False,
    legacy_month: bool = False,
) -> DataFrame:
    """One row per user and period: activity, the earliest start in the period (null
    without one), whether each step was reached from it in time, and completion.

    Activity and starts come from the same shuffled rows.
    """
    rows = _rows(events, steps)
    if strict and not cfg.unordered:
        require_order(rows)
    slices = resolve(rows, slices)
    nexts = {
        f"x{i}": F.when(F.col("event_name") == s, F.col("us")) for i, s in enumerate(steps) if i > 0
    }
    whole_path = strict and not cfg.unordered
    path = [F.col("event_name") == s for s in steps[1:]] if whole_path else []
    rows = ahead(cut(rows, slices), nexts, path, slices=slices)
    ends = None
    if whole_path:
        ends = F.col("end") if path else F.col("us")
    start_row = F.col("event_name") == steps[0]
    inside = F.col("timestamp") < period_end("period", period, legacy_month)
    # The next occurrence after the earliest start is the smallest of the next occurrences.
    grouped = (
        rows.withColumn("period", period_start("timestamp", period))
        .groupBy("user_id", "period")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.count_if(inside).alias("n_inside"),
            F.min(F.when(start_row, F.col("us"))).alias("start"),
            *[F.min(F.when(start_row, F.col(n))).alias(n) for n in nexts],
            *([] if ends is None else [F.min(F.when(start_row, ends)).alias("end")]),
        )
    )
    deadline = F.col("start") + cfg.window_us

    def in_time(name: str) -> Column:
        return F.coalesce(F.col(name) <= deadline, F.lit(False))

    reached = {"r0": F.col("start").isNotNull(), **{f"r{n[1:]}": in_time(n) for n in nexts}}
    grouped = grouped.withColumns(reached)
    if ends is not None:
        done = in_time("end")
    elif strict:
        done = F.expr(" AND ".join(reached))
    else:
        done = F.col(f"r{len(steps) - 1}")
    return grouped.withColumn("completed", done)


def _activity() -> list[Column]:
    return [
        F.count(F.lit(1)).alias("total_unique_users"),
        F.sum("n").alias("total_events"),
        F.count_if(F.col("n_inside") > 0).alias("daily_active_users"),
        F.sum("n_inside").alias("daily_events_total"),
    ]


def _capped(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, F.least(part / whole * 100, F.lit(100.0))).otherwise(F.lit(0.0))


def _finish(table: DataFrame, steps: Sequence[str]) -> DataFrame:
    users = [F.col(f"u{i}") for i in range(len(steps))]
    return table.select(
        "period",
        users[0].alias("started_funnel_users"),
        F.col("completed").alias("completed_funnel_users"),
        _capped(F.col("completed"), users[0]).alias("conversion_rate"),
        "total_unique_users",
        "total_events",
        "daily_active_users",
        "daily_events_total",
        *[u.alias(f"{s}_users") for u, s in zip(users, steps)],
        *[
            _capped(users[i + 1], users[i]).alias(f"{steps[i]}_to_{steps[i + 1]}_rate")
            for i in range(len(steps) - 1)
        ],
    )


def time_series(
    events: DataFrame,
    steps: Sequence[str],
    cfg: FunnelConfig = FunnelConfig(),
    period: str = "daily",
    *,
    all_periods: bool = False,
    strict: bool = False,
    legacy_month: bool = False,
    slices="auto",
) -> DataFrame:
    """Starters per period, how many reached each step within the window, and activity.

    Completion is credited to the period of the start and means reaching the last step;
    ``strict`` requires the whole path instead.  ``all_periods`` adds periods without
    starters.  ``legacy_month`` ends the activity of a month after 30 days.
    """
    steps = check_steps(steps)
    per_user = _per_user(
        events, steps, cfg, period, slices, strict=strict, legacy_month=legacy_month
    )
    table = per_user.groupBy("period").agg(
        *_activity(),
        *[F.count_if(f"r{i}").alias(f"u{i}") for i in range(len(steps))],
        F.count_if("completed").alias("completed"),
    )
    return _finish(table if all_periods else table.filter(F.col("u0") > 0), steps)


def period_activity(
    events: DataFrame, steps: Sequence[str], period: str = "daily", *, legacy_month: bool = False
) -> DataFrame:
    """Activity of the funnel events per period: whole, and up to the period's end."""
    inside = F.col("timestamp") < period_end("period", period, legacy_month)
    per_user = (
        _rows(events, steps)
        .select("user_id", "timestamp", period_start("timestamp", period).alias("period"))
        .groupBy("period", "user_id")
        .agg(F.count(F.lit(1)).alias("n"), F.count_if(inside).alias("n_inside"))
    )
    return per_user.groupBy("period").agg(*_activity())


def step_counts(
    events: DataFrame,
    steps: Sequence[str],
    cfg: FunnelConfig = FunnelConfig(),
    period: str = "daily",
    *,
    slices="auto",
) -> DataFrame:
    """Long form: users of a start period that reached each step."""
    steps = check_steps(steps)
    counts = (
        _per_user(events, steps, cfg, period, slices)
        .filter("r0")
        .groupBy("period")
        .agg(*[F.count_if(f"r{i}").alias(f"u{i}") for i in range(len(steps))])
    )
    entries = F.array(
        *[
            F.struct(F.lit(s).alias("step"), F.col(f"u{i}").alias("users"))
            for i, s in enumerate(steps)
        ]
    )
    return counts.select("period", F.inline(entries))


def strict_completion(
    events: DataFrame,
    steps: Sequence[str],
    cfg: FunnelConfig = FunnelConfig(),
    period: str = "daily",
    *,
    slices="auto",
) -> DataFrame:
    """Per starter and period: were all steps done in order inside the window?

    Unordered funnels need all steps, in any order.
    """
    steps = check_steps(steps)
    starts = _per_user(events, steps, cfg, period, slices, strict=True).filter("r0")
    return starts.select("user_id", "period", from_micros("start").alias("start"), "completed")


# Summaries of a time-series table; their windows run over its periods.


def series_summary(table: DataFrame, metric: str = "started_funnel_users") -> DataFrame:
    """Mean, peak and peak period of a metric, and the weighted conversion."""
    started, completed = F.sum("started_funnel_users"), F.sum("completed_funnel_users")
    peak = F.min(F.struct(-F.col(metric), F.col("period")))
    return table.agg(
        F.avg(metric).alias("mean_value"),
        F.max(metric).alias("peak_value"),
        peak["period"].alias("peak_period"),
        F.when(started > 0, completed / started * 100).otherwise(0.0).alias(
            "aggregate_conversion"
        ),
    )


def _direction(recent: Column, earlier: Column, margin: float) -> Column:
    return (
        F.when(recent > earlier + margin, "improving")
        .when(recent < earlier - margin, "declining")
        .otherwise("stable")
    )


def conversion_trend(table: DataFrame) -> DataFrame:
    """Weighted conversion of the later half of the periods against the earlier half."""
    order = Window.partitionBy().orderBy("period")
    numbered = table.select(
        "started_funnel_users",
        "completed_funnel_users",
        (F.row_number().over(order) - 1).alias("i"),
        F.count(F.lit(1)).over(Window.partitionBy()).alias("n"),
    )
    recent = F.col("i") >= F.call_function("div", F.col("n"), F.lit(2))

    def rate(part: Column) -> Column:
        started = F.sum(F.when(part, F.col("started_funnel_users")))
        done = F.sum(F.when(part, F.col("completed_funnel_users")))
        return F.when(started > 0, done / started * 100).otherwise(0.0)

    halves = numbered.agg(
        F.count(F.lit(1)).alias("periods"),
        rate(recent).alias("recent_value"),
        rate(~recent).alias("earlier_value"),
    )
    return _with_trend(halves, 1.0)


def metric_trend(table: DataFrame, metric: str) -> DataFrame:
    """Mean of the last three periods against the mean of the first three."""
    numbered = table.select(
        F.col(metric).alias("v"),
        F.row_number().over(Window.partitionBy().orderBy("period")).alias("first"),
        F.row_number().over(Window.partitionBy().orderBy(F.col("period").desc())).alias("last"),
    )
    ends = numbered.agg(
        F.count(F.lit(1)).alias("periods"),
        F.avg(F.when(F.col("last") <= 3, F.col("v"))).alias("recent_value"),
        F.avg(F.when(F.col("first") <= 3, F.col("v"))).alias("earlier_value"),
    )
    return _with_trend(ends, 0.0)


def _with_trend(ends: DataFrame, margin: float) -> DataFrame:
    trend = _direction(F.col("recent_value"), F.col("earlier_value"), margin)
    return ends.withColumn(
        "trend", F.when(F.col("periods") < 2, "single_period").otherwise(trend)
    )
