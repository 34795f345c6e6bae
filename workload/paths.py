"""Path queries with their SQL oracles, written with joins per user."""

from __future__ import annotations

from stepwise.functions import labels
from stepwise.operators import paths
from workload import sqlkit as sk
from workload.funnels import REENTRY, UNORDERED, cfg
from workload.tables import ORDER_STEPS, STEPS, events, hot_slices, orders, rounded

QUERIES: dict[str, tuple] = {}
YEAR = 24 * 365


def _run(build, config, steps=STEPS, source=events, finish=lambda t: t, sliced=0, **options):
    def run(spark, sf_dir):
        df = source(spark, sf_dir)
        slices = hot_slices(spark, df, sliced) if sliced else "auto"
        return rounded(finish(build(df, steps, config, slices=slices, **options)))

    return run


def _adjacent(steps):
    return list(zip(steps, steps[1:]))


def _dropped(steps):
    parts = [
        f"""SELECT '{s}' AS step, user_id, max(timestamp) AS last_time FROM ev
            WHERE event_name = '{s}' AND user_id NOT IN
                (SELECT user_id FROM ev WHERE event_name = '{t}')
            GROUP BY user_id"""
        for s, t in _adjacent(steps)
    ]
    return f"dropped AS ({' UNION ALL '.join(parts)})"


def _dest(horizon):
    """CTE dest: destination counts of all steps."""
    return f"""nxt AS (
    SELECT d.step, d.user_id, arg_min(e.event_name, (e.timestamp, e.ord)) AS event
    FROM dropped d JOIN ev e ON e.user_id = d.user_id AND e.timestamp > d.last_time
     AND e.timestamp <= d.last_time + INTERVAL '{horizon} hours' AND e.event_name <> d.step
    GROUP BY d.step, d.user_id),
dest AS (SELECT d.step, coalesce(n.event, '{paths.NO_ACTIVITY}') AS event, count(*) AS n
         FROM dropped d LEFT JOIN nxt n ON n.step = d.step AND n.user_id = d.user_id
         GROUP BY ALL)"""


def _top(table, by, limit):
    return f"""(SELECT a.* FROM {table} a WHERE (SELECT count(*) FROM {table} b
        WHERE b.{by} = a.{by} AND (b.n > a.n OR (b.n = a.n AND b.event < a.event))) < {limit})"""


TOP_DEST = f"SELECT step, event, n FROM {_top('dest', 'step', 10)}"

QUERIES["g1_dropped_users"] = (
    lambda spark, sf_dir: paths.dropped_users(orders(spark, sf_dir), ORDER_STEPS),
    sk.query(sk.OD, _dropped(ORDER_STEPS), select="SELECT * FROM dropped"),
)
QUERIES["g2_dropoff_destinations"] = (
    _run(paths.dropoff_events, cfg(YEAR), ORDER_STEPS, orders),
    sk.query(sk.OD, _dropped(ORDER_STEPS), _dest(YEAR), select=TOP_DEST),
)
QUERIES["g2_dropoff_destinations_sliced"] = (
    _run(paths.dropoff_events, cfg(YEAR), ORDER_STEPS, orders, sliced=4),
    sk.query(sk.OD, _dropped(ORDER_STEPS), _dest(YEAR), select=TOP_DEST),
)
QUERIES["g3_dropoff_seven_days"] = (
    _run(paths.dropoff_events, cfg(24), ORDER_STEPS, orders, horizon_us=paths.WEEK_US),
    sk.query(sk.OD, _dropped(ORDER_STEPS), _dest(168), select=TOP_DEST),
)


def _pair_sql(mode, hours, steps=STEPS):
    """CTE pr: conversion pairs (user_id, step, next_step, step_a_time, step_b_time)."""
    w = f"INTERVAL '{hours} hours'"
    parts = []
    for s, t in _adjacent(steps):
        head = f"SELECT user_id, '{s}' AS step, '{t}' AS next_step"
        a = f"(SELECT user_id, timestamp AS ta, ord FROM ev WHERE event_name = '{s}')"
        b = f"(SELECT user_id, timestamp AS tb FROM ev WHERE event_name = '{t}')"
        first_a = f"(SELECT user_id, min(ta) AS ta FROM {a} GROUP BY user_id)"
        first_b = f"(SELECT user_id, min(tb) AS tb FROM {b} GROUP BY user_id)"
        after = f"a.user_id = b.user_id AND tb > ta AND tb <= ta + {w}"
        near = f"a.user_id = b.user_id AND tb <= ta + {w} AND ta <= tb + {w}"
        if mode == "first":
            body = f"""{head}, ta AS step_a_time, min(tb) AS step_b_time FROM (
                SELECT a.user_id, ta, tb FROM {first_a} a JOIN {b} b ON {after})
                GROUP BY user_id, ta"""
        elif mode == "every":
            body = f"""{head}, ta AS step_a_time, min(tb) AS step_b_time FROM (
                SELECT a.user_id, a.ord, ta, tb FROM {a} a JOIN {b} b ON {after})
                GROUP BY user_id, ord, ta"""
        elif mode == "optimal":
            body = f"""{head}, min(ta) AS step_a_time,
                arg_min(tb, ta) AS step_b_time FROM (
                SELECT a.user_id, ta, min(tb) AS tb FROM {a} a JOIN {b} b ON {after}
                GROUP BY a.user_id, ta) GROUP BY user_id"""
        elif mode == "unordered_first":
            body = f"""{head}, least(ta, tb) AS step_a_time, greatest(ta, tb) AS step_b_time
                FROM (SELECT a.user_id, ta, tb FROM {first_a} a JOIN {first_b} b ON {near})"""
        else:
            body = f"""{head}, lo AS step_a_time, min(hi) AS step_b_time FROM (
                SELECT a.user_id, least(ta, tb) AS lo, greatest(ta, tb) AS hi,
                       min(least(ta, tb)) OVER (PARTITION BY a.user_id) AS lowest
                FROM {a} a JOIN {b} b ON {near}) WHERE lo = lowest GROUP BY user_id, lo"""
        parts.append(f"({body})")
    return f"pr AS ({' UNION ALL '.join(parts)})"


MODES = {
    "g4_pairs_first_only": ("first", {}),
    "g5_pairs_reentry": ("every", REENTRY),
    "g7_pairs_unordered_first_only": ("unordered_first", UNORDERED),
    "g8_pairs_unordered_reentry": ("unordered_any", {**UNORDERED, **REENTRY}),
}
for name, (mode, options) in MODES.items():
    QUERIES[name] = (
        _run(paths.conversion_pairs, cfg(24, **options)),
        sk.query(sk.EV, _pair_sql(mode, 24), select="SELECT * FROM pr"),
    )
    QUERIES[f"{name}_sliced"] = (
        _run(paths.conversion_pairs, cfg(24, **options), sliced=9),
        sk.query(sk.EV, _pair_sql(mode, 24), select="SELECT * FROM pr"),
    )
QUERIES["g6_optimal_pairs"] = (
    _run(paths.optimal_pairs, cfg(24, **REENTRY)),
    sk.query(sk.EV, _pair_sql("optimal", 24), select="SELECT * FROM pr"),
)


def _between(steps, direct=True):
    """CTE btw: counts of events inside the pairs."""
    extra = f"""UNION ALL
    SELECT step || ' → ' || next_step, '{paths.DIRECT}', count(DISTINCT user_id) FROM pr
    WHERE (step, user_id) NOT IN (SELECT (step, user_id) FROM inside) GROUP BY ALL"""
    return f"""inside AS (
    SELECT p.step, p.next_step, p.user_id, e.event_name FROM pr p JOIN ev e
    ON e.user_id = p.user_id AND e.timestamp > p.step_a_time AND e.timestamp < p.step_b_time
    WHERE e.event_name NOT IN ({sk.quoted(steps)})),
btw AS (
    SELECT step || ' → ' || next_step AS step_pair, event_name AS event, count(*) AS n
    FROM inside GROUP BY ALL {extra if direct else ''})"""


TOP_BETWEEN = f"SELECT step_pair, event, n FROM {_top('btw', 'step_pair', 10)}"
for name, (mode, options) in MODES.items():
    key = name.split("_", 1)[1].replace("pairs", "g9_between")
    sql = sk.query(sk.EV, _pair_sql(mode, 24), _between(STEPS), select=TOP_BETWEEN)
    QUERIES[key] = (_run(paths.between_events, cfg(24, **options)), sql)
    QUERIES[f"{key}_sliced"] = (_run(paths.between_events, cfg(24, **options), sliced=9), sql)
QUERIES["g9_between_reentry_orders"] = (
    _run(paths.between_events, cfg(YEAR, **REENTRY), ["O", "F"], orders, include_direct=False),
    sk.query(sk.OD, _pair_sql("every", YEAR, ["O", "F"]), _between(["O", "F"], direct=False),
             select=TOP_BETWEEN),
)


def _summary_ctes(hours, horizon, top=10):
    return [
        sk.OD,
        _dropped(ORDER_STEPS),
        _dest(horizon),
        _pair_sql("first", hours, ORDER_STEPS),
        _between(ORDER_STEPS),
        f"""summ AS (SELECT 'dropoff' AS kind, step AS subject, event, n
                FROM {_top('dest', 'step', top)}
            UNION ALL SELECT 'between', step_pair, event, n
                FROM {_top('btw', 'step_pair', top)})""",
    ]


QUERIES["g10_path_summary"] = (
    _run(paths.path_summary, cfg(YEAR), ORDER_STEPS, orders),
    sk.query(*_summary_ctes(YEAR, 168), select="SELECT * FROM summ"),
)


def _label(name):
    text = f"regexp_replace({name}, '^\\s+|\\s+$', '', 'g')"
    return f"""CASE WHEN {name} IS NULL OR {name} = '' THEN '{labels.UNKNOWN_EVENT}'
        WHEN length({text}) > 30 THEN substring({text}, 1, 27) || '...' ELSE {text} END"""


_KIND = sk.first_match("event", labels.DROPOFF_KINDS, "'neutral'")
QUERIES["g11_path_flow"] = (
    _run(
        paths.path_summary, cfg(YEAR), ORDER_STEPS, orders,
        finish=lambda t: paths.path_flow(t, ORDER_STEPS), top=None,
    ),
    sk.query(
        *_summary_ctes(YEAR, 168, "(SELECT count(*) + 1 FROM ev)"),
        f"""rk AS (SELECT s.*, (SELECT count(*) FROM summ b WHERE b.kind = 'dropoff'
                AND b.subject = s.subject AND (b.n > s.n OR (b.n = s.n AND b.event < s.event)))
                < 8 AS is_top FROM summ s WHERE kind = 'dropoff')""",
        select=f"""SELECT split_part(subject, ' → ', 1) AS source,
            split_part(subject, ' → ', 2) AS target, split_part(subject, ' → ', 2) AS label,
            'conversion' AS kind,
            CAST(sum(n) AS BIGINT) AS value FROM summ WHERE kind = 'between' GROUP BY subject
        UNION ALL
        SELECT subject, CASE WHEN is_top THEN event
                ELSE 'Other destinations from ' || subject END,
            CASE WHEN is_top THEN {_label('event')}
                ELSE 'Other destinations from ' || subject END,
            'dropoff_' || CASE WHEN is_top THEN {_KIND} ELSE 'other' END,
            CAST(sum(n) AS BIGINT) FROM rk GROUP BY ALL""",
    ),
)
QUERIES["b15_destination_categories"] = (
    _run(paths.dropoff_events, cfg(YEAR), ORDER_STEPS, orders, finish=paths.categorised_dropoffs),
    sk.query(
        sk.OD, _dropped(ORDER_STEPS), _dest(YEAR),
        select=f"""SELECT step, event, n, {_label('event')} AS label,
            {sk.first_match('event', labels.DESTINATION_CATEGORIES, "'other'")} AS category
        FROM {_top('dest', 'step', 10)}""",
    ),
)
QUERIES["b16_between_categories"] = (
    _run(paths.between_events, cfg(24, **REENTRY), finish=paths.categorised_between),
    sk.query(
        sk.EV, _pair_sql("every", 24), _between(STEPS),
        select=f"""SELECT step_pair, event, n,
            {sk.first_match('event', labels.BETWEEN_CATEGORIES, "'other'")} AS category,
            CASE WHEN n > 100 THEN 'High' WHEN n > 10 THEN 'Medium' ELSE 'Low' END AS impact
        FROM {_top('btw', 'step_pair', 10)}""",
    ),
)
