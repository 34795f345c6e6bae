"""Shape of the physical plans, and all registered queries against SQL."""

from __future__ import annotations

import re

import pytest

from stepwise.model import FunnelConfig
from stepwise.operators import catalog, mining, paths, series
from stepwise.operators import events as ev_ops
from stepwise.operators.events import timed
from stepwise.operators.funnel import funnel
from stepwise.plans.skew import measure
from tests.compare import connect, difference
from workload.registry import QUERIES
from workload.tables import STEPS, events

SMALL = "/root/testdata/sf0.001"
REENTRY = FunnelConfig(24, reentry_mode="optimized_reentry")
UNORDERED = FunnelConfig(24, funnel_order="unordered")


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def data(spark):
    return events(spark, SMALL)


@pytest.mark.parametrize(
    "build",
    [
        lambda df: funnel(df, STEPS, FunnelConfig(24)),
        lambda df: funnel(df, STEPS, REENTRY),
        lambda df: funnel(df, STEPS, UNORDERED),
        lambda df: series.step_counts(df, STEPS, REENTRY),
        lambda df: series.strict_completion(df, STEPS, REENTRY),
        lambda df: paths.dropoff_events(df, STEPS, REENTRY),
        lambda df: paths.conversion_pairs(df, STEPS, REENTRY),
        lambda df: mining.journeys(mining.event_log(df)),
        lambda df: mining.activities(mining.journeys(mining.event_log(df))),
    ],
)
def test_rows_move_once(data, build):
    text = plan(build(data))
    assert len(re.findall(r"hashpartitioning\(user_id#\d+, \d+\)", text)) == 1
    assert "Join" not in text and "Python" not in text and "Cartesian" not in text


def test_scan_reads_what_it_needs(data):
    text = plan(funnel(data, STEPS, REENTRY))
    assert "In(event_type, [purchase,signup,view])" in text
    (schema,) = re.findall(r"ReadSchema: struct<(.*?)>", text)
    assert {c.split(":")[0] for c in schema.split(",")} == {"ts", "user_id", "event_type"}


def test_frames_start_at_an_end(data):
    """Frames ending at unbounded following are re-evaluated for every row."""
    for df in (funnel(data, STEPS, REENTRY), series.time_series(data, STEPS, REENTRY)):
        frames = re.findall(r"specifiedwindowframe\((\w+), ([^)]*\))", plan(df))
        assert frames and all("unboundedpreceding" in f[1] for f in frames)


def scans(df) -> int:
    return plan(df).count("FileScan parquet")


@pytest.mark.parametrize("count", [2, 4, 6])
@pytest.mark.parametrize("cfg", [REENTRY, FunnelConfig(24), UNORDERED])
def test_sliced_plans_read_rows_twice(data, count, cfg):
    """Whatever the number of steps: once for the rows and once for the table of slices."""
    names = [*STEPS, "click", "refund", "other"][:count]
    slices = measure(timed(data), max_rows=50)
    assert slices is not None
    for df in (
        series.strict_completion(data, names, cfg, slices=slices),
        paths.between_events(data, names, cfg, slices=slices),
    ):
        # The hot users' cut points are a stored table of their own, joined to both.
        reads = [x for x in plan(df).splitlines() if "FileScan" in x and "event_type" in x]
        assert 1 <= len(reads) <= 2


def test_catalogue_reads_once(data):
    for df in (catalog.overview(data), catalog.event_statistics(data)):
        assert scans(df) == 1
    assert scans(ev_ops.common_property_table(data, "event_properties")) == 1


def test_cycles_order_the_log_once(data):
    """Journeys and returns share the shuffle by user; the only other ones are of pairs."""
    log = mining.event_log(data)
    df = mining.cycles(log, mining.transitions(mining.journeys(log), 10))
    df.collect()
    final = plan(df).split("== Initial Plan ==")[0]
    by_user = [x for x in final.splitlines() if re.search(r"hashpartitioning\(user_id#\d+, \d+\)", x)]
    assert len([x for x in by_user if "ReusedExchange" not in x]) == 1, final


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_against_sql(spark, name):
    run, sql = QUERIES[name]
    df = run(spark, SMALL)
    text = plan(df)
    assert "Python" not in text and "CartesianProduct" not in text
    assert "BroadcastNestedLoopJoin" not in text
    got = df.toArrow()
    assert sql, "every registered query has an oracle"
    con = connect(SMALL)
    assert difference(got, con.sql(sql).to_arrow_table()) is None
