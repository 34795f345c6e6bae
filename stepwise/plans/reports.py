"""Whole analyses: the tables a funnel or a process study consists of.

Each entry is a lazy table; nothing is computed until the caller writes or shows it.
Callers that use several entries may persist the events (or journeys) first.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepwise.model import ALL_USERS, FunnelConfig
from stepwise.operators import cohort, convert, funnel, mining, paths, stats
from stepwise.operators.events import in_segment, segment_names, timed
from stepwise.plans.lineage import materialised
from stepwise.plans.skew import resolve
from stepwise.sources.readers import valid_users


def funnel_report(
    events: DataFrame,
    steps: Sequence[str],
    cfg: FunnelConfig = FunnelConfig(),
    *,
    slices="auto",
) -> dict[str, DataFrame]:
    """Funnel, its KPIs and, for one segment, timing, cohorts and paths; for two segments,
    the significance tests.

    An empty event table, like a funnel of fewer than two steps, gives an empty funnel.
    """
    slices = resolve(timed(events), slices)
    table = funnel.funnel(events, steps, cfg, slices=slices)
    if len(steps) < 2 or events.select("user_id").isEmpty():
        return {"funnel": table.limit(0)}
    report = {"funnel": table, "kpis": funnel.funnel_kpis(table)}
    names = segment_names(cfg) if cfg.segmented else [ALL_USERS]
    if len(names) == 1:
        chosen = in_segment(cfg) if cfg.segmented else None
        history = events
        if chosen is not None:
            # Full history of the users that have an event in the segment.
            users = valid_users(events).filter(chosen & F.col("event_name").isin(*steps))
            history = events.join(users.select("user_id").distinct(), "user_id", "left_semi")
        shared = {"funnel_filter": chosen, "slices": slices}
        report |= {
            "time_to_convert": convert.conversion_stats(events, steps, cfg, slices=slices),
            "cohorts": cohort.cohorts(events, steps, cfg),
            "dropoffs": paths.dropoff_events(history, steps, cfg, **shared),
            "between": paths.between_events(history, steps, cfg, include_direct=False, **shared),
        }
    else:
        report["segments"] = funnel.segment_comparison(table)
        if len(names) == 2:
            report["significance"] = stats.significance(table, *names)
    return report


def process_report(
    events: DataFrame,
    *,
    min_frequency: int = mining.MIN_FREQUENCY,
    include_cycles: bool = True,
    time_window_hours: float | None = None,
    as_of: datetime | None = None,
    filter_events: Sequence[str] | None = None,
    materialise: bool = False,
    slices="auto",
    variant_limit: int | None = mining.TOP_VARIANTS,
    cycle_limit: int | None = mining.TOP_CYCLES,
    two_step: int | None = mining.TOP_TWO_STEP,
    three_step: int | None = mining.TOP_THREE_STEP,
) -> dict[str, DataFrame]:
    """Activities, transitions, cycles, variants, endpoints, statistics and insights.

    The limits are those of ``variants`` and ``cycles``, None for all; insights are drawn from
    the listed variants and cycles.

    ``materialise`` writes the journeys and the transitions to the checkpoint folder once,
    so that the tables, each an action of its own, do not repeat the ordering of the log.
    """
    log = mining.event_log(
        events, time_window_hours=time_window_hours, as_of=as_of, filter_events=filter_events
    )
    slices = resolve(log, slices)
    walks = mining.journeys(log, slices=slices)
    walks = materialised(walks) if materialise else walks
    edges = mining.transitions(walks, min_frequency)
    edges = materialised(edges) if materialise else edges
    acts = mining.activities(walks)
    found = mining.variants(walks, variant_limit)
    stats_row = mining.statistics(walks, edges)
    limits = {"limit": cycle_limit, "two_step": two_step, "three_step": three_step}
    # Slices are those of whole users; cycles measure theirs unless there are none.
    apart = None if slices is None else "auto"
    loops = mining.cycles(log, edges, slices=apart, **limits) if include_cycles else None
    report = {
        "activities": acts,
        "transitions": edges,
        "variants": found,
        "endpoints": mining.endpoints(walks),
        "statistics": stats_row,
        "insights": mining.insights(acts, loops, found, stats_row),
    }
    return report if loops is None else {**report, "cycles": loops}
