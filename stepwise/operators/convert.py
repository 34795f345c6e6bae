"""Time to convert between adjacent funnel steps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepwise.functions.times import whole_seconds
from stepwise.model import HOUR_US, FunnelConfig, check_steps
from stepwise.operators.events import segment_events, step_events, timed
from stepwise.plans.ordered import running
from stepwise.plans.quantiles import exact_quantiles
from stepwise.plans.skew import cut, resolve

PROBABILITIES = (0.5, 0.25, 0.75, 0.9)
_WHOLE = "CAST({} AS DECIMAL(38, 0))"


def _keys(cfg: FunnelConfig) -> list[str]:
    return ["segment", "user_id"] if cfg.segmented else ["user_id"]


def _unpivot_pairs(per_user: DataFrame, keys, steps, gap: str) -> DataFrame:
    pairs = F.array(
        *[
            F.struct(
                F.lit(i).alias("pair_idx"),
                F.lit(steps[i]).alias("step_from"),
                F.lit(steps[i + 1]).alias("step_to"),
                F.col(f"{gap}{i}").alias("gap_us"),
            )
            for i in range(len(steps) - 1)
        ]
    )
    return per_user.select(*keys, F.inline(pairs)).filter(F.col("gap_us").isNotNull())


def conversion_gaps(
    events: DataFrame,
    steps: Sequence[str],
    cfg: FunnelConfig = FunnelConfig(),
    *,
    slices="auto",
) -> DataFrame:
    """One gap in microseconds per user and step pair, over all users with both events.

    FIRST_ONLY: between the earliest events, whole seconds, 0 < gap <= window.
    Re-entry: from the earliest start that has an end inside the window to its next end.
    """
    steps = check_steps(steps)
    keys, window = _keys(cfg), cfg.window_us
    rows = segment_events(timed(step_events(events, steps)), cfg)
    extra = ["ord"] if "ord" in rows.columns else []
    rows = rows.select(*keys, "event_name", "us", *extra)
    if cfg.first_only:
        per_user = rows.groupBy(*keys).agg(
            *[
                F.min(F.when(F.col("event_name") == s, F.col("us"))).alias(f"t{i}")
                for i, s in enumerate(steps)
            ]
        )

        def first_gap(i: int) -> Column:
            exact = F.col(f"t{i + 1}") - F.col(f"t{i}")
            whole = whole_seconds(exact) * 1_000_000
            return F.when((exact > 0) & (whole <= window), whole)

        per_user = per_user.withColumns({f"g{i}": first_gap(i) for i in range(len(steps) - 1)})
        return _unpivot_pairs(per_user, keys, steps, "g")
    slices = resolve(rows, slices)
    nexts = {
        f"x{i}": ("min", F.when(F.col("event_name") == steps[i + 1], F.col("us")))
        for i in range(len(steps) - 1)
    }
    ahead = running(cut(rows, slices), nexts, side="after", slices=slices, keys=keys)

    def earliest_gap(i: int) -> Column:
        gap = F.col(f"x{i}") - F.col("us")
        valid = (F.col("event_name") == steps[i]) & (gap <= window)
        return F.min_by(gap, F.when(valid, F.col("us"))).alias(f"g{i}")

    per_user = ahead.groupBy(*keys).agg(*[earliest_gap(i) for i in range(len(steps) - 1)])
    return _unpivot_pairs(per_user, keys, steps, "g")


def conversion_hours(events, steps, cfg: FunnelConfig = FunnelConfig(), *, slices="auto"):
    """The gaps in hours."""
    gaps = conversion_gaps(events, steps, cfg, slices=slices)
    return gaps.withColumn("hours", F.col("gap_us") / HOUR_US).drop("gap_us", "pair_idx")


def conversion_stats(
    events: DataFrame,
    steps: Sequence[str],
    cfg: FunnelConfig = FunnelConfig(),
    *,
    slices="auto",
) -> DataFrame:
    """Count, mean, quartiles, 90th percentile and population deviation per step pair."""
    by = [*(["segment"] if cfg.segmented else []), "pair_idx", "step_from", "step_to"]
    gaps = conversion_gaps(events, steps, cfg, slices=slices)
    # Everything below works on distinct gaps per pair, so the gaps are computed once.
    counted = gaps.groupBy(*by, "gap_us").agg(F.count(F.lit(1)).alias("m"))
    # Exact moments: long gaps that lie close together keep their deviation.  Squares are taken
    # from the whole part of the mean, whose own square is then below one.
    stats = (
        counted.groupBy(*by)
        .agg(
            F.sum("m").alias("n"),
            F.expr(f"sum({_WHOLE.format('gap_us')} * m)").alias("_sum"),
            F.expr(f"sum({_WHOLE.format('gap_us')} * gap_us * m)").alias("_squares"),
        )
        .withColumn("_mean", F.expr(_WHOLE.format("_sum div n")))
        .withColumn("_rest", F.expr("CAST(_sum - _mean * n AS DOUBLE) / n"))
        .withColumn("_spread", F.expr("CAST(_squares - _mean * (2 * _sum - _mean * n) AS DOUBLE) / n"))
        .select(
            *by,
            "n",
            ((F.col("_mean").cast("double") + F.col("_rest")) / HOUR_US).alias("mean_hours"),
            (F.sqrt(F.expr("greatest(_spread - _rest * _rest, 0D)")) / HOUR_US).alias("std_hours"),
        )
    )
    names = ("median_hours", "p25_hours", "p75_hours", "p90_hours")
    exact = exact_quantiles(counted, by, "gap_us", "m", PROBABILITIES, cfg.window_us)
    stats = stats.join(exact, by)
    quantiles = {name: F.col(f"q{i}") / HOUR_US for i, name in enumerate(names)}
    return stats.withColumns(quantiles).select(
        *[c for c in by if c != "pair_idx"], "n", "mean_hours", *names, "std_hours"
    )


def speed_class(stats: DataFrame) -> DataFrame:
    """Label each pair by its median."""
    median = F.col("median_hours")
    return stats.withColumn(
        "speed",
        F.when(median < 1, "very_fast")
        .when(median < 24, "fast")
        .when(median < 168, "moderate")
        .otherwise("slow"),
    )


def extreme_transitions(stats: DataFrame) -> DataFrame:
    """Fastest and slowest pair by median; ties go to the alphabetically first pair."""
    pair = F.struct("step_from", "step_to", "median_hours")
    fastest = F.min(F.struct("median_hours", "step_from", "step_to", pair.alias("p")))
    slowest = F.min(F.struct(-F.col("median_hours"), "step_from", "step_to", pair.alias("p")))
    both = stats.agg(fastest.alias("f"), slowest.alias("s")).filter(F.col("f").isNotNull())
    entries = [
        F.struct(
            F.lit(label).alias("rank"),
            *[F.col(f"{c}.p.{n}").alias(n) for n in ("step_from", "step_to", "median_hours")],
        )
        for label, c in (("fastest", "f"), ("slowest", "s"))
    ]
    return both.select(F.inline(F.array(*entries)))
