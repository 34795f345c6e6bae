"""Paths and process mining on hand-made events, and against brute force."""

from __future__ import annotations

import random
from collections import Counter, defaultdict
from datetime import timedelta

import pytest

from stepwise.model import FunnelConfig
from stepwise.operators import mining, paths
from stepwise.operators.events import timed
from stepwise.plans.reports import funnel_report, process_report
from stepwise.plans.skew import measure
from tests.conftest import BASE

AB = ["A", "B"]
US = timedelta(microseconds=1)
HOUR = timedelta(hours=1)


def counts(df, key):
    found = defaultdict(dict)
    for r in df.collect():
        found[r[key]][r["event"]] = r["n"]
    return dict(found)


@pytest.mark.parametrize(
    ("gap", "ordered", "near"),
    [(-US, 0, 1), (0 * US, 0, 1), (US, 1, 1), (HOUR, 1, 1), (HOUR + US, 0, 0)],
)
def test_pair_boundaries(make, gap, ordered, near):
    events = make([("u", "A", BASE), ("u", "B", BASE + gap)])
    for mode in ("first_only", "optimized_reentry"):
        cfg = FunnelConfig(1, reentry_mode=mode)
        assert paths.conversion_pairs(events, AB, cfg).count() == ordered
        cfg = FunnelConfig(1, reentry_mode=mode, funnel_order="unordered")
        assert paths.conversion_pairs(events, AB, cfg).count() == near


def test_dropoffs(make):
    rows = [("u1", "A", 0), ("u1", "A", 10), ("u1", "X", 5), ("u1", "Y", 20), ("u1", "Z", 30)]
    rows += [("u2", "A", 0), ("u2", "Z", 60), ("u3", "A", 0), ("u3", "Z", 61)]
    rows += [("u4", "A", 0), ("u4", "B", 600), ("u5", "A", 0)]
    events = make(rows)
    found = counts(paths.dropoff_events(events, AB, FunnelConfig(1)), "step")
    assert found == {"A": {"Y": 1, "Z": 1, paths.NO_ACTIVITY: 2}}
    found = counts(
        paths.dropoff_events(events, AB, FunnelConfig(1), horizon_us=paths.WEEK_US), "step"
    )
    assert found == {"A": {"Y": 1, "Z": 2, paths.NO_ACTIVITY: 1}}
    dropped = paths.dropped_users(events, AB).orderBy("user_id").collect()
    assert [r["user_id"] for r in dropped] == ["u1", "u2", "u3", "u5"]


def brute_between(rows, steps, hours):
    """Events strictly inside each (A, next B) pair of the re-entry rule."""
    by_user = defaultdict(list)
    for user, name, at in rows:
        by_user[user].append((at, name))
    found = Counter()
    for history in by_user.values():
        inside = 0
        converted = False
        for at, name in history:
            later = [t for t, n in history if n == steps[1] and t > at]
            if name == steps[0] and later and min(later) - at <= hours * 60:
                converted = True
                for t, n in history:
                    if at < t < min(later) and n not in steps:
                        found[n] += 1
                        inside += 1
        found[paths.DIRECT] += converted and not inside
    return {k: v for k, v in found.items() if v}


@pytest.mark.parametrize("seed", range(3))
def test_between_against_brute_force(make, seed):
    rng = random.Random(seed)
    rows = [
        (f"u{rng.randrange(6)}", rng.choice("AABBXYZ"), rng.randrange(200)) for _ in range(160)
    ]
    events = make(rows)
    cfg = FunnelConfig(1, reentry_mode="optimized_reentry")
    want = {"A → B": brute_between(rows, AB, 1)}
    slices = measure(timed(events), max_rows=5)
    for cut in (None, slices):
        assert counts(paths.between_events(events, AB, cfg, slices=cut), "step_pair") == want


def test_funnel_report_paths(make):
    inside = '{"p": "x"}'
    rows = [("u1", "A", 0, inside), ("u1", "help", 5, None), ("u1", "B", 9, inside)]
    rows += [("u2", "A", 0, inside), ("u2", "B", 5, None), ("u3", "A", 0, None)]
    cfg = FunnelConfig(1, segment_by="event_properties_p", segment_values=("x",))
    report = funnel_report(make(rows), AB, cfg)
    assert [r["users"] for r in report["funnel"].orderBy("step_idx").collect()] == [2, 1]
    assert counts(report["between"], "step_pair") == {"A → B": {"help": 1}}
    # u2 did B outside the segment only, so it dropped off, and B is where it went.
    assert counts(report["dropoffs"], "step") == {"A": {"B": 1}}


def walk(user, names, hours=1):
    return [(user, n, 60 * hours * i) for i, n in enumerate(names)]


def test_linear_process(make):
    rows = [r for u in range(3) for r in walk(f"u{u}", ["Start", "Middle", "End"])]
    report = process_report(make(rows), min_frequency=1, materialise=True)
    acts = {r["event_name"]: r for r in report["activities"].collect()}
    assert set(acts) == {"Start", "Middle", "End"}
    assert acts["Start"]["is_start"] and not acts["Start"]["is_end"] and acts["End"]["is_end"]
    assert acts["Start"]["avg_duration"] == 1 and acts["End"]["avg_duration"] == 0
    assert acts["Start"]["activity_type"] == "entry" and acts["End"]["activity_type"] == "exit"
    edges = {(r["source"], r["target"]): r for r in report["transitions"].collect()}
    assert {k: r["frequency"] for k, r in edges.items()} == {
        ("Start", "Middle"): 3, ("Middle", "End"): 3,
    }
    assert all(r["probability"] == 50 and r["unique_users"] == 3 for r in edges.values())
    (stats,) = report["statistics"].collect()
    assert (stats["total_cases"], stats["unique_paths"], stats["avg_duration"]) == (3, 1, 2)
    (variant,) = report["variants"].collect()
    assert (variant["path"], variant["frequency"]) == ("Start → Middle → End", 3)
    ends = {(r["event_name"], r["kind"]): r["n"] for r in report["endpoints"].collect()}
    assert ends == {("Start", "start"): 3, ("End", "end"): 3}


def test_branches_and_cycles(make):
    rows = []
    for u in range(2):
        rows += walk(f"a{u}", ["Login", "Browse", "Purchase", "Checkout"])
        rows += walk(f"b{u}", ["Login", "Browse", "Cart", "Browse", "Cart", "Purchase"])
    rows += walk("c", ["Login", "Browse", "Error", "Exit"])
    report = process_report(make(rows), min_frequency=1)
    found = {r["cycle"]: r["frequency"] for r in report["cycles"].collect()}
    assert found == {"Browse → Cart": 2, "Cart → Browse": 2}
    acts = {r["event_name"]: r for r in report["activities"].collect()}
    assert acts["Error"]["activity_type"] == "error"
    assert acts["Cart"]["success_rate"] == 100 and acts["Exit"]["success_rate"] == 0
    log = mining.event_log(make(rows))
    walks = mining.journeys(log)
    graph = mining.graph_cycles(walks, mining.transitions(walks, 1)).collect()
    assert [(r["cycle"], r["frequency"], r["avg_cycle_time"]) for r in graph] == [
        ("Browse → Cart", 4, 1.0)
    ]


def test_bottleneck_insight(make):
    rows = []
    for u in range(10):
        rows += [(f"u{u}", "Start", 0), (f"u{u}", "Slow", 60), (f"u{u}", "End", 48 * 60)]
    found = {r["rule"]: r for r in process_report(make(rows))["insights"].collect()}
    assert (found["bottleneck"]["subject"], found["bottleneck"]["value"]) == ("Slow", 47)
    assert "low_completion" in found and "high_variability" not in found


def test_single_events_and_ties(make):
    one = process_report(make([("u", "A", 0)]), min_frequency=1)
    assert (one["activities"].count(), one["transitions"].count()) == (1, 0)
    assert one["statistics"].first()["total_cases"] == 1
    five = process_report(make([(f"u{i}", f"E{i}", 0) for i in range(5)]), min_frequency=1)
    assert (five["activities"].count(), five["cycles"].count()) == (5, 0)
    tied = mining.journeys(mining.event_log(make([("u", n, 0) for n in "XYZ"])))
    order = [r["event_name"] for r in tied.orderBy("pos").collect()]
    assert order == ["X", "Y", "Z"]


def test_hot_journey_in_slices(make):
    """Most rows at one instant: slices split them by input order."""
    rng = random.Random(3)
    rows = [("hot", rng.choice("PQR"), 30) for _ in range(120)]
    rows += [("hot", rng.choice("PQR"), rng.randrange(60)) for _ in range(40)]
    rows += [("u", "P", 0), ("u", "Q", 1)]
    log = mining.event_log(make(rows))
    slices = measure(log, max_rows=10)
    plain = sorted(map(repr, mining.journeys(log, slices=None).collect()))
    assert sorted(map(repr, mining.journeys(log, slices=slices).collect())) == plain


def test_main_path(make):
    rows = [r for u in range(3) for r in walk(f"u{u}", ["S", "T", "U", "T"])]
    rows += walk("v", ["S", "V"])
    walks = mining.journeys(mining.event_log(make(rows)))
    acts, edges = mining.activities(walks), mining.transitions(walks, 1)
    path = mining.main_path(acts, edges)
    assert [r["activity"] for r in path.orderBy("position").collect()] == ["S", "T", "U"]
    loss = mining.main_path_dropout(path, acts).orderBy("position").collect()
    assert [r["dropout_rate"] for r in loss] == [0, 25, 0]


def test_long_variants_are_spelled(make):
    rows = [r for u in range(2) for r in walk(f"u{u}", ["A", "B", "C", "D"] * 60)]
    rows += walk("v", ["A", "B"])
    walks = mining.journeys(mining.event_log(make(rows)))
    found = {r["example_user"]: r for r in mining.variants(walks, None).collect()}
    assert {u: (len(r["path"].split(" → ")), r["frequency"]) for u, r in found.items()} == {
        "u0": (240, 2), "v": (2, 1),
    }
    steps = mining.variant_steps(walks).filter("example_user = 'u0'").orderBy("position")
    assert [r["event_name"] for r in steps.collect()] == ["A", "B", "C", "D"] * 60


def test_main_path_of_any_length(make):
    rows = walk("u", [f"step {i:03}" for i in range(500)])
    walks = mining.journeys(mining.event_log(make(rows)))
    path = mining.main_path(mining.activities(walks), mining.transitions(walks, 1))
    assert [r["activity"] for r in path.orderBy("position").collect()] == [
        f"step {i:03}" for i in range(500)
    ]


def test_cycles_of_large_graphs(make):
    rows = []
    for u in range(3):
        rows += walk(f"u{u}", ["A", "B", "C", "A"] + [f"n{i}" for i in range(60)])
    log = mining.event_log(make(rows))
    edges = mining.transitions(mining.journeys(log), 1)
    threes = mining.three_step_cycles(edges, None)
    assert {tuple(r["path"]) for r in threes.collect()} == {
        ("A", "B", "C"), ("B", "C", "A"), ("C", "A", "B"),
    }
    assert mining.three_step_cycles(edges, None, max_edges=50).count() == 0
    everything = mining.cycles(log, edges, limit=None, two_step=None, three_step=None)
    assert everything.count() == 3


def test_dense_graph_without_cycles(spark):
    """Of 200 activities that lead to all later ones no transition is left to follow."""
    names = [f"n{i:03}" for i in range(200)]
    forward = [(a, b, 1) for i, a in enumerate(names) for b in names[i + 1 :]]
    edges = spark.createDataFrame(forward, "source string, target string, frequency long")
    assert mining.cyclic_hops(edges).count() == 0
    assert mining.simple_cycles(edges).count() == 0


@pytest.mark.parametrize("longest", [1, 2, 3, 5, 6])
def test_simple_cycles_against_brute_force(spark, longest):
    rng = random.Random(longest)
    names = "abcdefgh"
    edges = {(rng.choice(names), rng.choice(names)) for _ in range(18)}
    want = set()

    def grow(path):
        if (path[-1], path[0]) in edges:
            want.add(tuple(path))
        if len(path) < longest:
            for n in names:
                if n > path[0] and n not in path and (path[-1], n) in edges:
                    grow([*path, n])

    for n in names:
        grow([n])
    rows = [(a, b, 1) for a, b in sorted(edges)]
    table = spark.createDataFrame(rows, "source string, target string, frequency long")
    found = [tuple(r["path"]) for r in mining.simple_cycles(table, longest).collect()]
    assert len(found) == len(set(found)) and set(found) == want


def test_log_ends_at_as_of(make):
    rows = [("u", "A", m) for m in (0, 60, 120, 180)]
    log = mining.event_log(make(rows), time_window_hours=1, as_of=BASE + timedelta(minutes=120))
    assert log.count() == 2


def test_report_without_cycles(make):
    rows = [r for u in range(3) for r in walk(f"u{u}", ["A", "Error", "A", "Error"])]
    report = process_report(make(rows), min_frequency=1, include_cycles=False)
    assert "cycles" not in report
    assert {r["rule"] for r in report["insights"].collect()} == {
        "most_common_path", "low_completion",
    }
