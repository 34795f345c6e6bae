"""Monthly cohorts by the month of a user's first funnel step."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stepwise.functions.labels import bands
from stepwise.functions.times import from_micros
from stepwise.model import FunnelConfig, check_steps
from stepwise.operators.events import segment_events, step_events, timed

PERFORMANCE_BANDS = ((50, "High"), (20, "Medium"))


def _step_rows(events: DataFrame, steps: Sequence[str], cfg: FunnelConfig):
    keys = ["segment", "user_id"] if cfg.segmented else ["user_id"]
    rows = segment_events(timed(step_events(events, steps)), cfg)
    return keys, rows.select(*keys, "event_name", "us")


def _did(steps: Sequence[str]):
    return [
        F.bool_or(F.col("event_name") == s).alias(f"d{i}") for i, s in enumerate(steps)
    ]


def _unfold(sizes: DataFrame, by: list[str], steps: Sequence[str]) -> DataFrame:
    entries = F.array(
        *[
            F.struct(
                F.lit(i).alias("step_idx"),
                F.lit(s).alias("step"),
                F.col(f"c{i}").alias("converted"),
                (F.col(f"c{i}") / F.col("size") * 100).alias("rate"),
            )
            for i, s in enumerate(steps)
        ]
    )
    return sizes.select(*by, "cohort", "size", F.inline(entries))


def _month(us) -> object:
    return F.date_format(from_micros(us), "yyyy-MM")


def cohorts(
    events: DataFrame, steps: Sequence[str], cfg: FunnelConfig = FunnelConfig()
) -> DataFrame:
    """Cohort size and the share of the cohort that ever did each step."""
    steps = check_steps(steps)
    keys, rows = _step_rows(events, steps, cfg)
    by = keys[:-1]
    per_user = (
        rows.groupBy(*keys)
        .agg(
            F.min(F.when(F.col("event_name") == steps[0], F.col("us"))).alias("start"),
            *_did(steps),
        )
        .filter(F.col("start").isNotNull())
    )
    sizes = per_user.groupBy(*by, _month(F.col("start")).alias("cohort")).agg(
        F.count(F.lit(1)).alias("size"),
        *[F.count_if(f"d{i}").alias(f"c{i}") for i in range(len(steps))],
    )
    return _unfold(sizes, by, steps)


def cohorts_by_every_start(
    events: DataFrame, steps: Sequence[str], cfg: FunnelConfig = FunnelConfig()
) -> DataFrame:
    """Variant in which a user belongs to each month with a first-step event."""
    steps = check_steps(steps)
    keys, rows = _step_rows(events, steps, cfg)
    by = keys[:-1]
    # Counting months before collecting them: a user has few months, however many events.
    per_month = rows.groupBy(*keys, _month(F.col("us")).alias("cohort")).agg(*_did(steps))
    user = Window.partitionBy(*keys)
    ever = per_month.withColumns(
        {f"ever{i}": F.max(f"d{i}").over(user) for i in range(len(steps))}
    ).filter(F.col("d0") & F.col("cohort").isNotNull())
    sizes = ever.groupBy(*by, "cohort").agg(
        F.count(F.lit(1)).alias("size"),
        *[F.count_if(f"ever{i}").alias(f"c{i}") for i in range(len(steps))],
    )
    return _unfold(sizes, by, steps)


def _cohort_keys(table: DataFrame) -> list[str]:
    return [c for c in ("segment", "cohort") if c in table.columns]


def cohort_step_matrix(table: DataFrame) -> DataFrame:
    """Rate of each step as a share of the step before, where that one is above zero."""
    steps = Window.partitionBy(*_cohort_keys(table)).orderBy("step_idx")
    before = F.lag("rate").over(steps)
    return (
        table.withColumn("_before", before)
        .filter(F.col("_before") > 0)
        .select(
            *_cohort_keys(table),
            "step_idx",
            "step",
            (F.col("rate") / F.col("_before") * 100).alias("step_rate"),
        )
    )


def cohort_ranking(table: DataFrame) -> DataFrame:
    """Final conversion per cohort, its band, and whether it is the best or worst cohort."""
    final = table.groupBy(*_cohort_keys(table)).agg(
        F.max("size").alias("size"), F.max_by("rate", "step_idx").alias("final_rate")
    )
    by = [c for c in ("segment",) if c in table.columns]
    everything = Window.partitionBy(*by)  # one row per month
    best = F.min(F.struct(-F.col("final_rate"), F.col("cohort"))).over(everything)
    worst = F.min(F.struct(F.col("final_rate"), F.col("cohort"))).over(everything)
    return final.withColumns(
        {
            "performance": bands("final_rate", PERFORMANCE_BANDS, "Low"),
            "is_best": best["cohort"] == F.col("cohort"),
            "is_worst": worst["cohort"] == F.col("cohort"),
        }
    )
