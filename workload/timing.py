"""Time-to-convert, cohort and time-series queries with their SQL oracles."""

from __future__ import annotations

from stepwise.operators import cohort, convert, series
from workload import sqlkit as sk
from workload.funnels import REENTRY, TIERED, TIERS, UNORDERED, cfg
from workload.tables import ORDER_STEPS, STEPS, events, hot_slices, orders, rounded

QUERIES: dict[str, tuple] = {}
PAIRS = list(zip(STEPS, STEPS[1:]))


def _gaps(config, finish, source=events, steps=STEPS, sliced=0):
    def run(spark, sf_dir):
        df = source(spark, sf_dir)
        slices = hot_slices(spark, df, sliced) if sliced else "auto"
        return rounded(finish(df, steps, config, slices=slices))

    return run


def _first_gaps(hours):
    """CTE gaps: whole seconds between the earliest events."""
    parts = [
        f"""SELECT a.segment, '{s}' AS step_from, '{t}' AS step_to, a.user_id,
            date_sub('second', a.ts, b.ts) / 3600.0::DOUBLE AS hours
        FROM mins a JOIN mins b ON b.segment = a.segment AND b.user_id = a.user_id
        WHERE a.event_name = '{s}' AND b.event_name = '{t}' AND b.ts > a.ts
          AND date_sub('second', a.ts, b.ts) <= {hours} * 3600"""
        for s, t in PAIRS
    ]
    return (
        "mins AS (SELECT segment, user_id, event_name, min(timestamp) AS ts FROM ev GROUP BY ALL),\n"
        f"gaps AS ({' UNION ALL '.join(parts)})"
    )


def _again_gaps(hours):
    """CTE gaps: from the earliest start with an end in the window to its next end."""
    parts = [
        f"""SELECT segment, '{s}' AS step_from, '{t}' AS step_to, user_id,
            arg_min(cts_us - pts_us, pts_us) / 3600000000.0::DOUBLE AS hours
        FROM (SELECT p.segment, p.user_id, epoch_us(p.timestamp) AS pts_us,
                     epoch_us(min(c.timestamp)) AS cts_us
              FROM ev p JOIN ev c ON c.segment = p.segment AND c.user_id = p.user_id
               AND c.timestamp > p.timestamp
               AND c.timestamp <= p.timestamp + INTERVAL '{hours} hours'
              WHERE p.event_name = '{s}' AND c.event_name = '{t}'
              GROUP BY p.segment, p.user_id, p.timestamp) GROUP BY segment, user_id"""
        for s, t in PAIRS
    ]
    return f"gaps AS ({' UNION ALL '.join(parts)})"


RAW = "SELECT user_id, step_from, step_to, round(hours, 6) AS hours FROM gaps"
STATS = """st AS (
    SELECT segment, step_from, step_to, count(*) AS n, avg(hours) AS mean_hours,
           quantile_cont(hours, 0.5) AS median_hours, quantile_cont(hours, 0.25) AS p25_hours,
           quantile_cont(hours, 0.75) AS p75_hours, quantile_cont(hours, 0.9) AS p90_hours,
           stddev_pop(hours) AS std_hours
    FROM gaps GROUP BY ALL)"""
MEASURES = ("mean_hours", "median_hours", "p25_hours", "p75_hours", "p90_hours", "std_hours")
ROUNDED = ", ".join(f"round({m}, 6) AS {m}" for m in MEASURES)
ALL_STATS = f"SELECT step_from, step_to, n, {ROUNDED} FROM st"

QUERIES["e1_gaps_first_only"] = (
    _gaps(cfg(168), convert.conversion_hours),
    sk.query(sk.EV, _first_gaps(168), select=RAW),
)
QUERIES["e2_gaps_reentry"] = (
    _gaps(cfg(24, **REENTRY), convert.conversion_hours),
    sk.query(sk.EV, _again_gaps(24), select=RAW),
)
QUERIES["e2_gaps_sliced"] = (
    _gaps(cfg(24, **REENTRY), convert.conversion_hours, sliced=9),
    sk.query(sk.EV, _again_gaps(24), select=RAW),
)
QUERIES["e3_stats_first_only"] = (
    _gaps(cfg(168), convert.conversion_stats),
    sk.query(sk.EV, _first_gaps(168), STATS, select=ALL_STATS),
)
QUERIES["e3_stats_reentry"] = (
    _gaps(cfg(24, **REENTRY), convert.conversion_stats),
    sk.query(sk.EV, _again_gaps(24), STATS, select=ALL_STATS),
)
QUERIES["e3_stats_by_segment"] = (
    _gaps(cfg(48, **REENTRY, **TIERED), convert.conversion_stats),
    sk.query(
        sk.by_tier(TIERS), _again_gaps(48), STATS,
        select=f"SELECT segment, step_from, step_to, n, {ROUNDED} FROM st",
    ),
)
QUERIES["e4_speed_class"] = (
    _gaps(cfg(168), lambda *a, **k: convert.speed_class(convert.conversion_stats(*a, **k))),
    sk.query(
        sk.EV, _first_gaps(168), STATS,
        select=ALL_STATS.replace(
            " FROM st",
            """, CASE WHEN median_hours < 1 THEN 'very_fast' WHEN median_hours < 24 THEN 'fast'
                WHEN median_hours < 168 THEN 'moderate' ELSE 'slow' END AS speed FROM st""",
        ),
    ),
)
QUERIES["e5_extreme_transitions"] = (
    _gaps(
        cfg(168), lambda *a, **k: convert.extreme_transitions(convert.conversion_stats(*a, **k))
    ),
    sk.query(
        sk.EV, _first_gaps(168), STATS,
        select="""(SELECT 'fastest' AS rank, step_from, step_to,
                round(median_hours, 6) AS median_hours FROM st
             ORDER BY st.median_hours, step_from, step_to LIMIT 1)
            UNION ALL
            (SELECT 'slowest', step_from, step_to, round(median_hours, 6) FROM st
             ORDER BY st.median_hours DESC, step_from, step_to LIMIT 1)""",
    ),
)

# Cohorts: orders span 80 months.


def _cohorts(build, finish=lambda t: t):
    return lambda spark, sf_dir: rounded(finish(build(orders(spark, sf_dir), ORDER_STEPS)))


_GRID = "steps(step_idx, step) AS (VALUES " + ", ".join(
    f"({i}, '{s}')" for i, s in enumerate(ORDER_STEPS)
) + ")"
DID = "did AS (SELECT DISTINCT user_id, event_name FROM ev)"
MEMBERS_FIRST = f"""members AS (
    SELECT user_id, strftime(min(timestamp), '%Y-%m') AS cohort FROM ev
    WHERE event_name = '{ORDER_STEPS[0]}' GROUP BY user_id)"""
MEMBERS_EVERY = f"""members AS (
    SELECT DISTINCT user_id, strftime(timestamp, '%Y-%m') AS cohort FROM ev
    WHERE event_name = '{ORDER_STEPS[0]}')"""
COHORTS = """sizes AS (SELECT cohort, count(*) AS size FROM members GROUP BY cohort),
reached AS (SELECT m.cohort, d.event_name, count(*) AS converted
            FROM members m JOIN did d ON d.user_id = m.user_id GROUP BY ALL),
coh AS (
    SELECT s.cohort, s.size, CAST(g.step_idx AS INTEGER) AS step_idx, g.step,
           coalesce(r.converted, 0) AS converted,
           coalesce(r.converted, 0) / s.size * 100.0::DOUBLE AS rate
    FROM sizes s CROSS JOIN steps g
    LEFT JOIN reached r ON r.cohort = s.cohort AND r.event_name = g.step)"""


def _cohort_sql(members, select):
    return sk.query(sk.OD, _GRID, DID, members, COHORTS, select=select)


_ALL_COHORTS = "SELECT cohort, size, step_idx, step, converted, round(rate, 6) AS rate FROM coh"
QUERIES["f1_cohorts"] = (_cohorts(cohort.cohorts), _cohort_sql(MEMBERS_FIRST, _ALL_COHORTS))
QUERIES["f2_cohorts_by_every_start"] = (
    _cohorts(cohort.cohorts_by_every_start),
    _cohort_sql(MEMBERS_EVERY, _ALL_COHORTS),
)
QUERIES["f3_cohort_step_matrix"] = (
    _cohorts(cohort.cohorts, cohort.cohort_step_matrix),
    _cohort_sql(
        MEMBERS_FIRST,
        """SELECT c.cohort, c.step_idx, c.step, round(c.rate / p.rate * 100, 6) AS step_rate
        FROM coh c JOIN coh p ON p.cohort = c.cohort AND p.step_idx = c.step_idx - 1
        WHERE p.rate > 0""",
    ),
)
QUERIES["f4_cohort_ranking"] = (
    _cohorts(cohort.cohorts, cohort.cohort_ranking),
    _cohort_sql(
        MEMBERS_FIRST,
        """SELECT cohort, size, round(rate, 6) AS final_rate,
            CASE WHEN rate > 50 THEN 'High' WHEN rate > 20 THEN 'Medium' ELSE 'Low' END
                AS performance,
            cohort = (SELECT cohort FROM coh WHERE step_idx = 2 ORDER BY rate DESC, cohort LIMIT 1)
                AS is_best,
            cohort = (SELECT cohort FROM coh WHERE step_idx = 2 ORDER BY rate, cohort LIMIT 1)
                AS is_worst
        FROM coh WHERE step_idx = 2""",
    ),
)

# Time series.


def _series_ctes(steps, hours, period, base=sk.EV, *, ends=None, outer=False, completed=None):
    """CTE ser: the long list of series columns, one row per period."""
    start = period if "(" in period else f"date_trunc('{period}', timestamp)"
    start = f"CAST({start} AS TIMESTAMP)"
    unit = ends or f"INTERVAL 1 {period}"
    reach = ", ".join(
        f"""(SELECT count(*) FROM starters s WHERE s.period = p.period AND EXISTS (
            SELECT 1 FROM ev e WHERE e.user_id = s.user_id AND e.event_name = '{s}'
            AND e.timestamp >= s.start AND e.timestamp <= s.start + INTERVAL '{hours} hours'))
            AS u{i}"""
        for i, s in enumerate(steps)
    )
    keep = "" if outer else " WHERE period IN (SELECT period FROM starters)"
    done = completed or f"u{len(steps) - 1}"
    rates = ", ".join(
        f"""CASE WHEN u{i} > 0 THEN least(u{i + 1} / u{i} * 100.0, 100.0) ELSE 0.0 END::DOUBLE
            AS "{steps[i]}_to_{steps[i + 1]}_rate" """
        for i in range(len(steps) - 1)
    )
    users = ", ".join(f'u{i} AS "{s}_users"' for i, s in enumerate(steps))
    return [
        base,
        f"""fe AS (SELECT *, {start} AS period FROM ev
            WHERE event_name IN ({sk.quoted(steps)}))""",
        f"""starters AS (SELECT user_id, period, min(timestamp) AS start FROM fe
            WHERE event_name = '{steps[0]}' GROUP BY user_id, period)""",
        f"""act AS (SELECT period, count(DISTINCT user_id) AS total_unique_users,
                count(*) AS total_events,
                count(DISTINCT user_id) FILTER (timestamp < period + {unit})
                    AS daily_active_users,
                count(*) FILTER (timestamp < period + {unit}) AS daily_events_total
            FROM fe GROUP BY period)""",
        f"pts AS (SELECT p.*, {reach} FROM (SELECT * FROM act{keep}) p)",
        f"""ser AS (SELECT period, u0 AS started_funnel_users, {done} AS completed_funnel_users,
            CASE WHEN u0 > 0 THEN least({done} / u0 * 100.0, 100.0) ELSE 0.0 END::DOUBLE
                AS conversion_rate,
            total_unique_users, total_events, daily_active_users, daily_events_total,
            {users}, {rates} FROM pts)""",
    ]


def _all_series(steps):
    rates = ", ".join(
        f'round("{a}_to_{b}_rate", 6) AS "{a}_to_{b}_rate"' for a, b in zip(steps, steps[1:])
    )
    users = ", ".join(f'"{s}_users"' for s in steps)
    return f"""SELECT period, started_funnel_users, completed_funnel_users,
        round(conversion_rate, 6) AS conversion_rate, total_unique_users, total_events,
        daily_active_users, daily_events_total, {users}, {rates} FROM ser"""


def _series(config, period, steps=STEPS, source=events, finish=lambda t: t, sliced=0, **options):
    def run(spark, sf_dir):
        df = source(spark, sf_dir)
        slices = hot_slices(spark, df, sliced) if sliced else "auto"
        table = series.time_series(df, steps, config, period, slices=slices, **options)
        return rounded(finish(table))

    return run


def _series_sql(steps, hours, period, select=None, **options):
    return sk.query(
        *_series_ctes(steps, hours, period, **options), select=select or _all_series(steps)
    )


for name, unit in (("hourly", "hour"), ("daily", "day"), ("weekly", "week")):
    QUERIES[f"f5_series_{name}"] = (_series(cfg(24), name), _series_sql(STEPS, 24, unit))
QUERIES["f5_series_monthly_orders"] = (
    _series(cfg(24 * 60), "monthly", ORDER_STEPS, orders),
    _series_sql(ORDER_STEPS, 24 * 60, "month", base=sk.OD),
)
QUERIES["f5_series_six_hours"] = (
    _series(cfg(12), "6h"),
    _series_sql(
        STEPS, 12, "time_bucket(INTERVAL 6 HOUR, timestamp, TIMESTAMP '2000-01-01')",
        ends="INTERVAL 6 HOUR",
    ),
)
QUERIES["f5_series_sliced"] = (
    _series(cfg(24), "daily", sliced=9),
    _series_sql(STEPS, 24, "day"),
)
QUERIES["f6_step_rates"] = (
    _series(
        cfg(48), "daily",
        finish=lambda t: t.select(
            "period", "conversion_rate", "signup_to_view_rate", "view_to_purchase_rate"
        ),
    ),
    _series_sql(
        STEPS, 48, "day",
        """SELECT period, round(conversion_rate, 6) AS conversion_rate,
            round(signup_to_view_rate, 6) AS signup_to_view_rate,
            round(view_to_purchase_rate, 6) AS view_to_purchase_rate FROM ser""",
    ),
)
_ACT = """SELECT period, total_unique_users, total_events, daily_active_users,
    daily_events_total FROM act"""
QUERIES["f7_period_activity"] = (
    lambda spark, sf_dir: series.period_activity(events(spark, sf_dir), STEPS, "daily"),
    _series_sql(STEPS, 1, "day", _ACT),
)
QUERIES["f8_activity_thirty_day_months"] = (
    lambda spark, sf_dir: series.period_activity(
        orders(spark, sf_dir), ORDER_STEPS, "monthly", legacy_month=True
    ),
    _series_sql(ORDER_STEPS, 1, "month", _ACT, base=sk.OD, ends="INTERVAL 30 DAY"),
)
QUERIES["f8_activity_calendar_months"] = (
    lambda spark, sf_dir: series.period_activity(orders(spark, sf_dir), ORDER_STEPS, "monthly"),
    _series_sql(ORDER_STEPS, 1, "month", _ACT, base=sk.OD),
)

# Strict completion walks each start's events in order, here by recursion.
_STRICT = """walk AS (
    SELECT s.user_id, s.period, s.start, 0 AS done, s.start AS at,
           (SELECT min(ord) FROM ev e WHERE e.user_id = s.user_id AND e.event_name = '{first}'
            AND e.timestamp = s.start) AS at_ord
    FROM starters s
    UNION ALL
    SELECT w.user_id, w.period, w.start, w.done + 1, n.timestamp, n.ord
    FROM walk w JOIN steps t ON t.step_idx = w.done + 1
    JOIN ev n ON n.user_id = w.user_id AND n.event_name = t.step
     AND (n.timestamp > w.at OR (n.timestamp = w.at AND n.ord > w.at_ord))
     AND n.timestamp <= w.start + INTERVAL '{hours} hours'
    WHERE NOT EXISTS (SELECT 1 FROM ev m WHERE m.user_id = w.user_id AND m.event_name = t.step
        AND (m.timestamp > w.at OR (m.timestamp = w.at AND m.ord > w.at_ord))
        AND (m.timestamp < n.timestamp OR (m.timestamp = n.timestamp AND m.ord < n.ord)))),
strict AS (SELECT user_id, period, start, max(done) = {last} AS completed
           FROM walk GROUP BY ALL)"""


def _strict_sql(steps, hours, period, base):
    grid = ", ".join(f"({i}, '{s}')" for i, s in enumerate(steps))
    ctes = _series_ctes(steps, hours, period, base)[:3]
    strict = _STRICT.format(first=steps[0], hours=hours, last=len(steps) - 1)
    return sk.query(
        *ctes, f"steps(step_idx, step) AS (VALUES {grid})", strict, select="SELECT * FROM strict"
    )


def _strict(config, steps, source, period, sliced=0):
    return _gaps(
        config,
        lambda df, st, c, slices: series.strict_completion(df, st, c, period, slices=slices),
        source, steps, sliced,
    )


QUERIES["f9_strict_completion"] = (
    _strict(cfg(72), STEPS, events, "daily"),
    _strict_sql(STEPS, 72, "day", sk.EV),
)
QUERIES["f9_strict_completion_tied_times"] = (
    _strict(cfg(24 * 400), ORDER_STEPS, orders, "monthly"),
    _strict_sql(ORDER_STEPS, 24 * 400, "month", sk.OD),
)
QUERIES["f9_strict_completion_sliced"] = (
    _strict(cfg(72), STEPS, events, "daily", sliced=9),
    _strict_sql(STEPS, 72, "day", sk.EV),
)
QUERIES["f9_all_steps_any_order"] = (
    _gaps(
        cfg(24, **UNORDERED),
        lambda df, st, c, slices: series.strict_completion(
            df, st, c, "daily", slices=slices
        ).select("user_id", "period", "completed"),
    ),
    sk.query(
        *_series_ctes(STEPS, 24, "day")[:3],
        select=f"""SELECT s.user_id, s.period, (SELECT count(DISTINCT e.event_name) FROM fe e
            WHERE e.user_id = s.user_id AND e.timestamp >= s.start
            AND e.timestamp <= s.start + INTERVAL 24 HOUR) = {len(STEPS)} AS completed
        FROM starters s""",
    ),
)
QUERIES["f10_all_periods_orders"] = (
    _series(cfg(24 * 60), "monthly", ["P", "O", "F"], orders, all_periods=True),
    _series_sql(["P", "O", "F"], 24 * 60, "month", base=sk.OD, outer=True),
)
QUERIES["f10_all_periods_strict"] = (
    _series(cfg(72), "hourly", all_periods=True, strict=True),
    sk.query(
        *_series_ctes(STEPS, 72, "hour", outer=True, completed="""
            (SELECT count(*) FROM starters s WHERE s.period = pts.period AND EXISTS (
                SELECT 1 FROM ev b JOIN ev c ON c.user_id = b.user_id
                WHERE b.user_id = s.user_id AND b.event_name = 'view'
                AND c.event_name = 'purchase' AND b.timestamp > s.start
                AND c.timestamp > b.timestamp
                AND c.timestamp <= s.start + INTERVAL 72 HOUR))"""),
        select=_all_series(STEPS),
    ),
)
QUERIES["f11_series_summary"] = (
    _series(cfg(24), "daily", finish=series.series_summary),
    _series_sql(
        STEPS, 24, "day",
        """SELECT round(avg(started_funnel_users), 6) AS mean_value,
            max(started_funnel_users) AS peak_value,
            (SELECT period FROM ser ORDER BY started_funnel_users DESC, period LIMIT 1)
                AS peak_period,
            round(sum(completed_funnel_users) / sum(started_funnel_users) * 100.0::DOUBLE, 6)
                AS aggregate_conversion
        FROM ser""",
    ),
)
_HALVES = """num AS (SELECT s.*, (SELECT count(*) FROM ser t WHERE t.period < s.period) AS i,
    (SELECT count(*) FROM ser) AS n FROM ser s),
hv AS (SELECT count(*) AS periods,
    sum(completed_funnel_users) FILTER (i >= n // 2)
        / sum(started_funnel_users) FILTER (i >= n // 2) * 100.0::DOUBLE AS recent_value,
    sum(completed_funnel_users) FILTER (i < n // 2)
        / sum(started_funnel_users) FILTER (i < n // 2) * 100.0::DOUBLE AS earlier_value
    FROM num)"""
_ENDS = """num AS (SELECT s.*, (SELECT count(*) FROM ser t WHERE t.period < s.period) AS i,
    (SELECT count(*) FROM ser) AS n FROM ser s),
hv AS (SELECT count(*) AS periods,
    avg(view_to_purchase_rate) FILTER (i >= n - 3) AS recent_value,
    avg(view_to_purchase_rate) FILTER (i < 3) AS earlier_value FROM num)"""


def _trend_sql(halves, margin):
    return sk.query(
        *_series_ctes(STEPS, 24, "day"), halves,
        select=f"""SELECT periods, round(recent_value, 6) AS recent_value,
            round(earlier_value, 6) AS earlier_value,
            CASE WHEN periods < 2 THEN 'single_period'
                 WHEN recent_value > earlier_value + {margin} THEN 'improving'
                 WHEN recent_value < earlier_value - {margin} THEN 'declining'
                 ELSE 'stable' END AS trend FROM hv""",
    )


QUERIES["f12_conversion_trend"] = (
    _series(cfg(24), "daily", finish=series.conversion_trend),
    _trend_sql(_HALVES, 1),
)
QUERIES["f12_metric_trend"] = (
    _series(cfg(24), "daily", finish=lambda t: series.metric_trend(t, "view_to_purchase_rate")),
    _trend_sql(_ENDS, 0),
)
