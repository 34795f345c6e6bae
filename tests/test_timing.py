"""Time to convert, cohorts and time series on hand-made events."""

from __future__ import annotations

from datetime import datetime, timedelta

import numpy as np
import pytest

from stepwise.functions import times
from stepwise.model import FunnelConfig
from stepwise.operators import cohort, convert, series
from stepwise.operators.events import timed
from stepwise.plans.quantiles import exact_quantiles
from stepwise.plans.skew import measure
from tests.conftest import BASE

AB = ["A", "B"]
US = timedelta(microseconds=1)


def table(df, *columns):
    return [tuple(r) for r in df.orderBy("period").select("period", *columns).collect()]


@pytest.mark.parametrize(
    ("gap", "first", "again"),
    [
        (-US, 0, 0),
        (0 * US, 0, 0),
        (US, 1, 1),
        (timedelta(hours=1) - US, 1, 1),
        (timedelta(hours=1), 1, 1),
        # Whole seconds decide in first_only, exact times in re-entry.
        (timedelta(hours=1) + US, 1, 0),
        (timedelta(hours=1, seconds=1), 0, 0),
    ],
)
def test_gap_boundaries(make, gap, first, again):
    events = make([("u", "A", BASE), ("u", "B", BASE + gap)])
    for mode, want in (("first_only", first), ("optimized_reentry", again)):
        cfg = FunnelConfig(1, reentry_mode=mode)
        assert convert.conversion_gaps(events, AB, cfg).count() == want


def test_stats(make):
    hours = [1, 2, 4, 8, 16]
    rows = [(f"u{i}", "A", 0) for i in range(5)]
    rows += [(f"u{i}", "B", 60 * h) for i, h in enumerate(hours)]
    for mode in ("first_only", "optimized_reentry"):
        cfg = FunnelConfig(24, reentry_mode=mode)
        stats = convert.conversion_stats(make(rows), ["A", "B", "C"], cfg)
        (r,) = convert.speed_class(stats).collect()
        assert r["n"] == 5
        assert r["mean_hours"] == pytest.approx(np.mean(hours))
        assert r["std_hours"] == pytest.approx(np.std(hours))
        for name, q in (("median", 50), ("p25", 25), ("p75", 75), ("p90", 90)):
            assert r[f"{name}_hours"] == pytest.approx(np.percentile(hours, q))
        assert r["speed"] == "fast"


def test_exact_quantiles(spark):
    rng = np.random.default_rng(7)
    values = [("a", int(v)) for v in rng.integers(0, 1_000_000, 3000)]
    values += [("b", int(v)) for v in rng.integers(0, 50, 500)] + [("c", 5)]
    df = spark.createDataFrame(values, "k string, v bigint")
    probs = (0.0, 0.1, 0.5, 0.9, 1.0)
    counted = df.groupBy("k", "v").count()
    for row in exact_quantiles(counted, ["k"], "v", "count", probs, 1_000_000).collect():
        want = np.quantile([v for k, v in values if k == row["k"]], probs)
        assert [row[f"q{i}"] for i in range(len(probs))] == pytest.approx(list(want))


def cohort_rows():
    rows = []
    for day, counts in ((1, (1000, 700, 500, 300)), (2, (500, 400, 300, 200))):
        for step, (name, n) in enumerate(zip(("S", "V", "C", "P"), counts)):
            for u in range(n):
                at = datetime(2024, 1, day, 9) + timedelta(minutes=u % 60 + 30 * step)
                rows.append((f"d{day}_{u}", name, at))
    return rows


def test_exact_cohort_series(make):
    events, steps = make(cohort_rows()), ["S", "V", "C", "P"]
    columns = ("S_users", "V_users", "C_users", "P_users", "completed_funnel_users")
    daily = table(series.time_series(events, steps, FunnelConfig(24)), *columns)
    assert [r[1:] for r in daily] == [(1000, 700, 500, 300, 300), (500, 400, 300, 200, 200)]
    for period in ("weekly", "monthly", "1w"):
        (row,) = table(series.time_series(events, steps, FunnelConfig(24), period), *columns)
        assert row[1:] == (1500, 1100, 800, 500, 500)


def test_hour_boundaries(make):
    starts = [(0, 0), (0, 59), (1, 0), (1, 59), (23, 0), (23, 59)]
    rows = []
    for i, (h, m) in enumerate(starts):
        at = datetime(2024, 1, 1, h, m)
        rows += [(f"u{i}", s, at + timedelta(minutes=15 * k)) for k, s in enumerate("SME")]
    found = table(
        series.time_series(make(rows), ["S", "M", "E"], FunnelConfig(1), "hourly"),
        "started_funnel_users", "completed_funnel_users",
    )
    assert [r[1:] for r in found] == [(2, 2), (2, 2), (2, 2)]


def test_window_and_skipped_steps(make):
    rows = [("u1", "A", 0), ("u1", "B", 30), ("u2", "A", 0), ("u2", "B", 61), ("u3", "A", 0)]
    for mode in ("first_only", "optimized_reentry"):
        (row,) = table(
            series.time_series(make(rows), AB, FunnelConfig(1, reentry_mode=mode)),
            "started_funnel_users", "completed_funnel_users", "conversion_rate",
        )
        assert row[1:3] == (3, 1) and row[3] == pytest.approx(100 / 3)
    rows = [("1", "A", 0), ("1", "B", 60), ("1", "C", 120), ("2", "A", 0), ("2", "C", 60)]
    rows += [("3", "A", 0), ("3", "C", 60), ("3", "B", 120), ("4", "A", 0), ("4", "C", 5)]
    events, abc, cfg = make(rows), ["A", "B", "C"], FunnelConfig(4)
    columns = ("A_users", "B_users", "C_users", "completed_funnel_users", "conversion_rate")
    (row,) = table(series.time_series(events, abc, cfg), *columns)
    assert row[1:] == (4, 2, 4, 4, 100)
    (row,) = table(series.time_series(events, abc, cfg, strict=True), *columns)
    assert row[1:] == (4, 2, 4, 1, 25)
    slices = measure(timed(events), max_rows=1)
    (row,) = table(series.time_series(events, abc, cfg, strict=True, slices=slices), *columns)
    assert row[1:] == (4, 2, 4, 1, 25)


def test_completion_is_credited_to_the_start_day(make):
    rows = []
    for day, n, done in ((1, 5, 2), (2, 8, 3), (3, 6, 0)):
        for u in range(n):
            rows.append((f"{day}_{u}", "A", datetime(2024, 1, day, 12)))
            if u < done:
                rows.append((f"{day}_{u}", "B", datetime(2024, 1, day + 2, 11)))
    found = table(series.time_series(make(rows), AB, FunnelConfig(72)), "conversion_rate")
    assert [r[1] for r in found] == [40, 37.5, 0]
    every = table(
        series.time_series(make(rows), AB, FunnelConfig(72), all_periods=True),
        "started_funnel_users", "total_events",
    )
    assert [r[1:] for r in every] == [(5, 5), (8, 8), (6, 8), (0, 3)]


def test_month_ends(make):
    rows = [("u", "A", datetime(2024, 1, 1)), ("u", "A", datetime(2024, 1, 31, 5))]
    for legacy, want in ((False, 2), (True, 1)):
        (row,) = table(
            series.period_activity(make(rows), AB, "monthly", legacy_month=legacy),
            "daily_events_total", "total_events",
        )
        assert row[1:] == (want, 2)
    with pytest.raises(ValueError):
        series.period_activity(make(rows), AB, "fortnightly")


def test_summary_and_trend(make):
    table_ = series.time_series(make(cohort_rows()), ["S", "P"], FunnelConfig(24))
    (row,) = series.series_summary(table_).collect()
    assert (row["mean_value"], row["peak_value"]) == (750, 1000)
    assert row["aggregate_conversion"] == pytest.approx(100 / 3)
    (trend,) = series.conversion_trend(table_).collect()
    assert trend["trend"] == "improving"
    one = table_.limit(1)
    assert series.metric_trend(one, "conversion_rate").first()["trend"] == "single_period"


def test_cohorts(make):
    rows = [("a", "A", datetime(2024, 1, 5)), ("a", "B", datetime(2024, 3, 1))]
    rows += [("a", "A", datetime(2024, 2, 5)), ("b", "A", datetime(2024, 1, 31, 23, 59))]
    rows += [("c", "B", datetime(2024, 1, 1)), ("d", "A", datetime(2024, 2, 1))]
    events = make(rows)

    def rates(df):
        found = df.orderBy("cohort", "step_idx").collect()
        return [(r["cohort"], r["size"], r["converted"]) for r in found]

    assert rates(cohort.cohorts(events, AB)) == [
        ("2024-01", 2, 2), ("2024-01", 2, 1), ("2024-02", 1, 1), ("2024-02", 1, 0),
    ]
    assert rates(cohort.cohorts_by_every_start(events, AB)) == [
        ("2024-01", 2, 2), ("2024-01", 2, 1), ("2024-02", 2, 2), ("2024-02", 2, 1),
    ]
    ranked = cohort.cohort_ranking(cohort.cohorts(events, AB)).orderBy("cohort").collect()
    assert [(r["performance"], r["is_best"], r["is_worst"]) for r in ranked] == [
        ("Medium", True, False), ("Low", False, True),
    ]


def test_calendar_multiples(spark):
    df = spark.sql("SELECT timestamp_ntz'2024-08-15 10:00:00' AS t")
    for period, start, end in (
        ("1q", "2024-07-01", "2024-10-01"),
        ("1y", "2024-01-01", "2025-01-01"),
        ("2mo", "2024-07-01", "2024-09-01"),
        ("2y", "2024-01-01", "2026-01-01"),
    ):
        found = df.select(times.period_start("t", period).alias("s"))
        row = found.select("s", times.period_end("s", period).alias("e")).first()
        assert [str(x)[:10] for x in row] == [start, end], period


def test_compound_durations(spark):
    df = spark.sql("SELECT timestamp_ntz'2024-08-15 10:00:01.750300' AS t")
    for period, start, end in (
        ("1d12h", "2024-08-15 00:00:00", "2024-08-16 12:00:00"),
        ("1h30m", "2024-08-15 09:00:00", "2024-08-15 10:30:00"),
        ("1y6mo", "2023-07-01 00:00:00", "2025-01-01 00:00:00"),
        ("500ms", "2024-08-15 10:00:01.500000", "2024-08-15 10:00:02"),
        ("250us", "2024-08-15 10:00:01.750250", "2024-08-15 10:00:01.750500"),
        ("1000ns", "2024-08-15 10:00:01.750300", "2024-08-15 10:00:01.750301"),
        ("1w", "2024-08-12 00:00:00", "2024-08-19 00:00:00"),
        ("1w7d", "2024-08-08 00:00:00", "2024-08-22 00:00:00"),
    ):
        found = df.select(times.period_start("t", period).alias("s"))
        row = found.select("s", times.period_end("s", period).alias("e")).first()
        assert [str(x) for x in row] == [start, end], period


@pytest.mark.parametrize("period", ["1mo2w", "0d", "1ns", "h", "1d 2h", "2x", ""])
def test_durations_without_a_grid(period):
    with pytest.raises(ValueError):
        times.period_spec(period)


def test_deviation_of_long_close_gaps(make):
    base = 8000 * 60
    rows = []
    for i, late in enumerate((0, 1, 2, 3)):
        rows += [(f"u{i}", "A", 0), (f"u{i}", "B", base + late / 60)]
    rows = [(u, n, BASE + timedelta(minutes=m)) for u, n, m in rows]
    got = convert.conversion_stats(make(rows), ["A", "B"], FunnelConfig(9000)).first()
    assert abs(got["std_hours"] * 3600 / 1.25**0.5 - 1) < 1e-6
