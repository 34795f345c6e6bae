"""Funnel goldens and the inequality matrix."""

from __future__ import annotations

from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from stepwise.model import FunnelConfig
from stepwise.operators.events import timed
from stepwise.operators.funnel import funnel, funnel_kpis, pair_conversion, segment_comparison
from stepwise.operators.stats import significance
from stepwise.plans.reports import funnel_report
from stepwise.plans.skew import measure
from tests.conftest import BASE

DAY = FunnelConfig(24)
REENTRY = FunnelConfig(24, reentry_mode="optimized_reentry")
ABC = ["A", "B", "C"]


def linear(counts, names):
    return [
        (f"user_{u}", name, 60 * i)
        for i, (name, n) in enumerate(zip(names, counts))
        for u in range(n)
    ]


NAMES = ["Sign Up", "Email Verification", "First Login", "First Purchase"]


def test_linear_funnel(make):
    rows = funnel(make(linear([1000, 800, 600, 400], NAMES)), NAMES, DAY).orderBy("step_idx").collect()
    assert [r["users"] for r in rows] == [1000, 800, 600, 400]
    assert [r["conversion_rate"] for r in rows] == [100, 80, 60, 40]
    assert [r["drop_off"] for r in rows] == [0, 200, 200, 200]
    assert [round(r["drop_off_rate"], 4) for r in rows] == [0, 20, 25, 33.3333]


@pytest.mark.parametrize("counts", [[100, 0, 0], [50, 50, 50], [10, 6, 0]])
def test_counts(make, users, counts):
    for cfg in (DAY, REENTRY, FunnelConfig(24, funnel_order="unordered")):
        assert users(funnel(make(linear(counts, ABC)), ABC, cfg)) == counts


def test_degenerate(make, users, spark):
    some = make(linear([3, 2], ABC))
    assert funnel(some, ["A"], DAY).count() == 0
    empty = funnel(some, ["X", "Y"], DAY).orderBy("step_idx").collect()
    assert [(r["users"], r["conversion_rate"]) for r in empty] == [(0, 100), (0, 0)]
    assert users(funnel(some, ["A", "X", "Y"], DAY)) == [3, 0, 0]
    assert funnel_report(make([]), ABC, DAY)["funnel"].count() == 0
    with pytest.raises(ValueError):
        funnel(some, ["A", "A"], DAY)
    with pytest.raises(ValueError):
        funnel(some.drop("ord"), ABC, DAY)
    assert users(funnel(some.drop("ord"), ["A", "B"], REENTRY)) == [3, 2]


def test_counting_methods(make, users):
    rows = [("u1", "S", 0), ("u1", "S", 1), ("u2", "S", 0)]
    rows += [("u1", "V", 30), ("u2", "V", 30), ("u2", "V", 31), ("u2", "V", 32), ("u2", "V", 33)]
    events = make(rows)
    totals = FunnelConfig(24, counting_method="event_totals")
    assert users(funnel(events, ["S", "V"], DAY)) == [2, 2]
    assert users(funnel(events, ["S", "V"], totals)) == [3, 5]
    pairs = FunnelConfig(24, counting_method="unique_pairs")
    chain = make([(u, "A", 0) for u in "xyz"] + [(u, "B", 5) for u in "xy"] + [("x", "C", 9)])
    assert users(funnel(chain, ABC, pairs)) == [3, 2, 1]


def test_windows(make, users):
    hour = FunnelConfig(1)
    chain = make([("u", "A", 0), ("u", "B", 30), ("u", "C", 90)])
    assert users(funnel(chain, ABC, hour)) == [1, 1, 0]
    assert users(funnel(chain, ABC, FunnelConfig(2))) == [1, 1, 1]
    first_in = make([("u", "A", 0), ("u", "B", 30), ("u", "B", 90)])
    assert users(funnel(first_in, ["A", "B"], hour)) == [1, 1]
    # First in data order decides, not the earliest time.
    first_out = make([("u", "A", 0), ("u", "B", 90), ("u", "B", 30)])
    assert users(funnel(first_out, ["A", "B"], hour)) == [1, 0]
    zero = make([("u1", "A", 0), ("u1", "B", 0), ("u2", "A", 0), ("u2", "B", 1)])
    for mode in ("first_only", "optimized_reentry"):
        assert users(funnel(zero, ["A", "B"], FunnelConfig(0, reentry_mode=mode))) == [2, 1]
    far = make([("u", "A", 0), ("u", "B", 60 * 24 * 30)])
    assert users(funnel(far, ["A", "B"], FunnelConfig(24 * 365))) == [1, 1]


US = timedelta(microseconds=1)
W = timedelta(hours=1)


@pytest.mark.parametrize(
    ("gap", "first", "again", "span"),
    [
        (-US, 0, 0, 1),
        (0 * US, 1, 0, 1),
        (US, 1, 1, 1),
        (W - US, 1, 1, 1),
        (W, 0, 0, 1),
        (W + US, 0, 0, 0),
    ],
)
def test_boundaries(make, users, gap, first, again, span):
    events = make([("u", "A", BASE), ("u", "B", BASE + gap)])

    def converted(**kwargs):
        return users(funnel(events, ["A", "B"], FunnelConfig(1, **kwargs)))[1]

    assert converted() == first
    assert converted(reentry_mode="optimized_reentry") == again
    assert converted(funnel_order="unordered") == span
    near = int(abs(gap) < W)
    for mode in ("first_only", "optimized_reentry"):
        cfg = FunnelConfig(1, reentry_mode=mode, funnel_order="unordered")
        assert users(pair_conversion(events, ["A", "B"], cfg))[1] == near


def test_ties_and_order(make, users):
    ties = make(
        [(u, s, 0) for u in ("u1", "u2") for s in ("A", "B")] + [("u1", "C", 0)]
    )
    assert users(funnel(ties, ABC, DAY)) == [2, 2, 1]
    skipped = make(
        [("u1", "A", 0), ("u1", "B", 30), ("u1", "C", 60)]
        + [("u2", "A", 0), ("u2", "C", 30), ("u2", "B", 60)]
    )
    assert users(funnel(skipped, ABC, DAY)) == [2, 1, 1]
    assert users(funnel(skipped, ABC, REENTRY)) == [2, 1, 1]
    exempt = FunnelConfig(24, strict_order_exempt=("A",))
    assert users(funnel(skipped, ABC, exempt)) == [2, 2, 1]


def test_kyc_steps_are_exempt(make, users):
    steps = ["KYC start", "KYC done", "Deposit"]
    rows = [("u", steps[0], 0), ("u", steps[2], 10), ("u", steps[1], 20), ("u", steps[2], 30)]
    assert users(funnel(make(rows), steps, DAY))[:2] == [1, 1]


def test_dirty_rows(make, users):
    ids = make([("ok", "A", 0), ("ok", "B", 1)] + [(u, "A", 0) for u in (None, "", "nan", "None")])
    names = make([("u", "A", 0), ("u", None, 1), ("u", "B", 2)])
    times = make([("u1", "A", None), ("u2", "A", 0), ("u1", "B", None), ("u2", "B", None)])
    json = make([(f"u{i}", "A", 0, p) for i, p in enumerate(["{bad", "", '{"a": 1}'])])
    twice = make([("u", "A", 0), ("u", "A", 0), ("u", "B", 1), ("u", "B", 1)])
    for cfg in (DAY, REENTRY):
        assert users(funnel(ids, ["A", "B"], cfg)) == [1, 1]
        assert users(funnel(names, ["A", "B"], cfg)) == [1, 1]
        assert users(funnel(times, ["A", "B"], cfg)) == [2, 0]
        assert users(funnel(json, ["A", "B"], cfg)) == [3, 0]
        assert users(funnel(twice, ["A", "B"], cfg)) == [1, 1]


def test_unordered(make, users):
    events = make([("u1", "E", 0), ("u1", "S", 30), ("u2", "S", 0), ("u2", "E", 0)])
    cfg = FunnelConfig(24, funnel_order="unordered", counting_method="event_totals")
    assert users(funnel(events, ["S", "E"], cfg)) == [2, 2]


MOBILE = ('{"platform": "mobile"}', '{"subscription": "free"}')
DESKTOP = ('{"platform": "desktop"}', '{"subscription": "premium"}')


def test_segments(make, users):
    rows = [(f"m{u}", s, t, *MOBILE) for u in range(3) for s, t in zip(ABC, (1, 5, 10))]
    rows += [(f"d{u}", s, t, *DESKTOP) for u in range(2) for s, t in zip(ABC[:2], (2, 6))]
    events = make(rows)

    def by(prop, *values):
        cfg = FunnelConfig(24, segment_by=prop, segment_values=values)
        return users(funnel(events, ABC, cfg), segmented=True)

    assert by("event_properties_platform", "mobile", "desktop") == {
        "platform=mobile": [3, 3, 3],
        "platform=desktop": [2, 2, 0],
    }
    assert by("user_properties_subscription", "free", "premium") == {
        "subscription=free": [3, 3, 3],
        "subscription=premium": [2, 2, 0],
    }
    assert by("event_properties_platform", "mobile") == {"platform=mobile": [3, 3, 3]}
    assert by("event_properties_platform", "mobile", "tv") == {"platform=mobile": [3, 3, 3]}
    assert by("event_properties_platform", "tv") == {"platform=tv": [0, 0, 0]}
    assert by("event_properties_none", "x") == {"none=x": [0, 0, 0]}
    assert users(funnel(events, ABC, DAY)) == [5, 5, 3]


def test_significance(make):
    rows = []
    for name, converted in (("A", 8), ("B", 3)):
        props = f'{{"segment": "{name}"}}'
        rows += [(f"{name}{u}", "Start", 0, None, props) for u in range(10)]
        rows += [(f"{name}{u}", "Done", 30, None, props) for u in range(converted)]
    cfg = FunnelConfig(24, segment_by="user_properties_segment", segment_values=("A", "B"))
    table = funnel(make(rows), ["Start", "Done"], cfg)
    (test,) = significance(table, "segment=A", "segment=B").collect()
    assert (test["conversion_a"], test["conversion_b"]) == (80, 30)
    assert test["z_score"] == pytest.approx(2.247333, abs=1e-6)
    assert test["p_value"] == pytest.approx(0.0246189, abs=1e-5)
    assert test["is_significant"]
    ranked = segment_comparison(table).orderBy("segment").collect()
    assert [r["overall_conversion"] for r in ranked] == [80, 30]
    report = funnel_report(make(rows), ["Start", "Done"], cfg)
    assert set(report) == {"funnel", "kpis", "segments", "significance"}


def test_kpis(make):
    (row,) = funnel_kpis(funnel(make(linear([100, 50, 10], ABC)), ABC, DAY)).collect()
    assert (row["starting_users"], row["final_users"], row["total_drop_offs"]) == (100, 10, 90)
    assert (row["bottleneck_step"], row["bottleneck_rate"]) == ("C", 80)
    assert row["avg_step_drop_off"] == 65


def test_invariants(make):
    rows = funnel(make(linear([9, 7, 4, 4], NAMES)), NAMES, REENTRY).orderBy("step_idx").collect()
    counts = [r["users"] for r in rows]
    assert counts == sorted(counts, reverse=True)
    assert all(r["drop_off"] >= 0 and 0 <= r["conversion_rate"] <= 100 for r in rows)
    assert (rows[0]["conversion_rate"], rows[0]["drop_off"]) == (100, 0)


def test_hot_user_is_cut_and_counts_stay(make, users):
    """One user with most rows, many of them at one instant."""
    rows = [("hot", ABC[i % 2], 10 + i % 7) for i in range(200)]
    rows += [("hot", "B", 500)] * 60 + [("hot", "C", 501)]
    rows += [(f"u{i}", s, t) for i in range(5) for s, t in (("A", 0), ("B", 30), ("C", 40 + i))]
    events = make(rows)
    slices = measure(timed(events), max_rows=20)
    assert [r["user_id"] for r in slices.grid.collect()] == ["hot"]
    cells = slices.cut(timed(events)).groupBy("user_id", "_slice_time", "_slice_row").count()
    assert cells.agg(F.max("count")).first()[0] <= 20
    for cfg in (DAY, REENTRY, FunnelConfig(1, reentry_mode="optimized_reentry")):
        assert users(funnel(events, ABC, cfg, slices=slices)) == users(
            funnel(events, ABC, cfg, slices=None)
        )
        assert users(pair_conversion(events, ABC, cfg, slices=slices)) == users(
            pair_conversion(events, ABC, cfg, slices=None)
        )


def test_config_round_trip():
    cfg = FunnelConfig.window(2, "weeks", segment_by="user_properties_x", segment_values=["1"])
    assert cfg.conversion_window_hours == 336
    assert FunnelConfig.from_dict(cfg.to_dict()) == cfg
    assert FunnelConfig.from_dict({}) == FunnelConfig()
    with pytest.raises(ValueError):
        FunnelConfig(-1)
