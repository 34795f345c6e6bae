"""Process-mining queries with their SQL oracles."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from stepwise.functions import labels
from stepwise.operators import mining
from stepwise.plans.reports import process_report
from workload import sqlkit as sk
from workload.tables import conversations, events, hot_slices, orders, rounded

QUERIES: dict[str, tuple] = {}

# CTE wk: journeys.  Positions by counting, successors by position.
WALKS = """num AS (SELECT user_id, event_name, timestamp, ord,
        row_number() OVER (PARTITION BY user_id ORDER BY timestamp, ord) - 1 AS pos FROM ev),
wk AS (SELECT a.user_id, a.event_name, a.timestamp, a.pos, b.event_name AS next_event,
        date_sub('second', a.timestamp, b.timestamp) / 3600.0::DOUBLE AS hours,
        a.pos = 0 AS is_start, b.user_id IS NULL AS is_end
    FROM num a LEFT JOIN num b ON b.user_id = a.user_id AND b.pos = a.pos + 1)"""
SUCCESS = sk.contains("event_name", labels.SUCCESS_WORDS)


def _walks(finish, source=events, sliced=0):
    def run(spark, sf_dir):
        df = source(spark, sf_dir)
        slices = hot_slices(spark, df, sliced) if sliced else "auto"
        return rounded(finish(mining.journeys(mining.event_log(df), slices=slices)))

    return run


def _log_walks(finish, source=events, min_frequency=10):
    def run(spark, sf_dir):
        log = mining.event_log(source(spark, sf_dir))
        walks = mining.journeys(log)
        return rounded(finish(log, walks, mining.transitions(walks, min_frequency)))

    return run


_LOG = "SELECT user_id, event_name, timestamp, ord FROM ev "
_WHERE_LAST = "WHERE timestamp >= (SELECT max(timestamp) FROM ev) - INTERVAL 72 HOUR"


def _log(**options):
    return lambda spark, sf_dir: mining.event_log(events(spark, sf_dir), **options).select(
        "user_id", "event_name", "timestamp", "ord"
    )


QUERIES["h1_log_last_hours"] = (
    _log(time_window_hours=72, filter_events=["view", "error"]),
    sk.query(sk.EV, select=f"{_LOG} {_WHERE_LAST} AND event_name IN ('view', 'error')"),
)
QUERIES["h1_log_as_of"] = (
    _log(time_window_hours=48, as_of=datetime(2024, 1, 20)),
    sk.query(sk.EV, select=f"""{_LOG} WHERE timestamp BETWEEN TIMESTAMP '2024-01-18'
        AND TIMESTAMP '2024-01-20'"""),
)
_JOURNEYS = """SELECT user_id, event_name, timestamp, pos AS event_order,
    round(hours, 6) AS duration_to_next, is_start, is_end FROM wk"""
for key, source, base in (("", events, sk.EV), ("_tied_times", orders, sk.OD)):
    QUERIES[f"h2_journeys{key}"] = (
        lambda spark, sf_dir, source=source: rounded(
            mining.journey_table(mining.event_log(source(spark, sf_dir)))
        ),
        sk.query(base, WALKS, select=_JOURNEYS),
    )
QUERIES["h2_journeys_sliced"] = (
    lambda spark, sf_dir: rounded(
        mining.journey_table(
            mining.event_log(orders(spark, sf_dir)),
            slices=hot_slices(spark, orders(spark, sf_dir), 4),
        )
    ),
    sk.query(sk.OD, WALKS, select=_JOURNEYS),
)

ACTS = f"""okay AS (SELECT DISTINCT user_id FROM wk WHERE {SUCCESS}),
act AS (SELECT w.event_name, count(*) AS frequency, count(DISTINCT w.user_id) AS unique_users,
        coalesce(avg(hours), 0.0) AS avg_duration, bool_or(is_start) AS is_start,
        bool_or(is_end) AS is_end,
        {sk.first_match('w.event_name', labels.ACTIVITY_TYPES, "CASE WHEN bool_or(is_start) "
                        "THEN 'entry' WHEN bool_or(is_end) THEN 'exit' ELSE 'process' END")}
            AS activity_type,
        count(DISTINCT o.user_id) / count(DISTINCT w.user_id) * 100.0::DOUBLE AS success_rate,
        min(timestamp) AS first_occurrence, max(timestamp) AS last_occurrence
    FROM wk w LEFT JOIN okay o ON o.user_id = w.user_id GROUP BY w.event_name)"""
ALL_ACTS = """SELECT event_name, frequency, unique_users, round(avg_duration, 6) AS avg_duration,
    is_start, is_end, activity_type, round(success_rate, 6) AS success_rate,
    first_occurrence, last_occurrence FROM act"""
for key, source, base in (
    ("", events, sk.EV), ("_orders", orders, sk.OD), ("_conversations", conversations, sk.CV)
):
    QUERIES[f"h3_activities{key}"] = (
        _walks(mining.activities, source),
        sk.query(base, WALKS, ACTS, select=ALL_ACTS),
    )
QUERIES["h4_activity_success"] = (
    _walks(lambda w: mining.activities(w).select("event_name", "success_rate")),
    sk.query(sk.EV, WALKS, ACTS,
             select="SELECT event_name, round(success_rate, 6) AS success_rate FROM act"),
)
QUERIES["h5_continuation_rates"] = (
    _walks(mining.continuation_rates),
    sk.query(
        sk.EV, WALKS,
        select="""SELECT event_name, round(count(*) FILTER (NOT is_end) / count(*)
            * 100.0::DOUBLE, 6) AS continuation_rate FROM wk GROUP BY event_name""",
    ),
)


def _edges(min_frequency, legacy=False):
    duration = "avg(CASE WHEN hours > 0 THEN hours END)" if legacy else "avg(hours)"
    total = "raw" if legacy else "kept"
    return f"""raw AS (SELECT event_name AS source, next_event AS target, count(*) AS frequency,
        count(DISTINCT user_id) AS unique_users, coalesce({duration}, 0.0) AS avg_duration
    FROM wk WHERE NOT is_end GROUP BY ALL),
kept AS (SELECT * FROM raw WHERE frequency >= {min_frequency}),
edge AS (SELECT *, frequency / (SELECT sum(frequency) FROM {total}) * 100.0::DOUBLE AS probability,
        CASE WHEN source = target THEN 'loop' WHEN lower(target) LIKE '%error%'
             THEN 'error_transition' WHEN frequency > 100 THEN 'main_flow'
             ELSE 'alternative_flow' END AS transition_type FROM kept)"""


ALL_EDGES = """SELECT source, target, frequency, unique_users,
    round(avg_duration, 6) AS avg_duration, round(probability, 6) AS probability,
    transition_type FROM edge"""
QUERIES["h6_transitions"] = (
    _walks(lambda w: mining.transitions(w, 400)),
    sk.query(sk.EV, WALKS, _edges(400), select=ALL_EDGES),
)
QUERIES["h6_transitions_conversations"] = (
    _walks(lambda w: mining.transitions(w, 10), conversations),
    sk.query(sk.CV, WALKS, _edges(10), select=ALL_EDGES),
)
QUERIES["h6_transitions_sliced"] = (
    _walks(lambda w: mining.transitions(w, 400), sliced=9),
    sk.query(sk.EV, WALKS, _edges(400), select=ALL_EDGES),
)
QUERIES["h7_transitions_of_all"] = (
    _walks(lambda w: mining.transitions_of_all(w, 900), orders),
    sk.query(sk.OD, WALKS, _edges(900, legacy=True), select=ALL_EDGES),
)
QUERIES["h8_frequent_transitions"] = (
    _walks(lambda w: mining.frequent_transitions(mining.transitions(w), 420)),
    sk.query(sk.EV, WALKS, _edges(10), select=f"{ALL_EDGES} WHERE frequency >= 420"),
)
QUERIES["h22_top_transitions"] = (
    _walks(lambda w: mining.top_transitions(mining.transitions(w))),
    sk.query(sk.EV, WALKS, _edges(10),
             select=f"{ALL_EDGES} ORDER BY frequency DESC, source, target LIMIT 10"),
)

PATHS = f"""pth AS (SELECT user_id, string_agg(event_name, ' → ' ORDER BY pos) AS path,
        coalesce(sum(hours), 0.0) AS total, bool_or({SUCCESS}) AS any_success,
        bool_or(is_end AND {SUCCESS}) AS completed FROM wk GROUP BY user_id),
vr AS (SELECT path, count(*) AS frequency,
        avg(CASE WHEN any_success THEN 100.0 ELSE 0.0 END)::DOUBLE AS success_rate,
        avg(total) AS avg_duration FROM pth GROUP BY path
    HAVING count(*) >= greatest(1, (SELECT count(*) FROM pth) // 10))"""
VARIANT_TYPE = """CASE WHEN success_rate > 80 THEN 'high_success' WHEN success_rate > 50
    THEN 'medium_success' WHEN success_rate > 20 THEN 'low_success' ELSE 'problematic' END"""
ALL_VARIANTS = f"""SELECT path, frequency, round(success_rate, 6) AS success_rate,
    round(avg_duration, 6) AS avg_duration, {VARIANT_TYPE} AS variant_type FROM vr
    ORDER BY frequency DESC, path LIMIT 20"""


def _variants(walks):
    return mining.variants(walks).drop("example_user")


QUERIES["h9_variants"] = (
    _walks(_variants, conversations),
    sk.query(sk.CV, WALKS, PATHS, select=ALL_VARIANTS),
)
QUERIES["h9_variant_steps"] = (
    _walks(mining.variant_steps, conversations),
    sk.query(
        sk.CV, WALKS, PATHS,
        """ex AS (SELECT v.path, v.frequency, min(p.user_id) AS example_user
            FROM vr v JOIN pth p ON p.path = v.path GROUP BY ALL)""",
        select="""SELECT example_user, frequency, pos AS position, event_name
            FROM ex JOIN wk w ON w.user_id = ex.example_user""",
    ),
)
QUERIES["h9_variants_all_unique"] = (
    _walks(_variants),
    sk.query(sk.EV, WALKS, PATHS, select=ALL_VARIANTS),
)
QUERIES["h10_path_success"] = (
    _walks(mining.journey_success),
    sk.query(
        sk.EV, WALKS,
        select=f"""SELECT user_id,
            {sk.contains('event_name', labels.JOURNEY_SUCCESS_WORDS)} AS succeeded
        FROM wk WHERE is_end""",
    ),
)
for key, source, base in (("", events, sk.EV), ("_conversations", conversations, sk.CV)):
    QUERIES[f"h11_endpoints{key}"] = (
        _walks(mining.endpoints, source),
        sk.query(
            base, WALKS,
            select="""SELECT * FROM (
                SELECT event_name, 'start' AS kind, count(*) AS n FROM wk WHERE is_start GROUP BY ALL
                UNION ALL
                SELECT event_name, 'end', count(*) FROM wk WHERE is_end GROUP BY ALL)
            WHERE n >= greatest(1, (SELECT count(DISTINCT user_id) FROM wk) * 0.05)""",
        ),
    )

_NEG_LOOP = sk.contains("source", labels.LOOP_NEGATIVE_WORDS)
_NEG_CYCLE = sk.contains("cycle", labels.CYCLE_NEGATIVE_WORDS)
CYCLES = f"""c1 AS (SELECT source AS cycle, 1 AS length, frequency, 'loop' AS type,
        CASE WHEN {_NEG_LOOP} THEN 'negative' ELSE 'positive' END AS impact,
        source AS first_event, source AS last_event FROM edge WHERE source = target),
c2all AS (SELECT a.source || ' → ' || a.target AS cycle,
        least(a.frequency, b.frequency) AS frequency, a.source AS first_event,
        a.target AS last_event
    FROM edge a JOIN edge b ON b.source = a.target AND b.target = a.source
    WHERE a.source <> a.target),
c2 AS (SELECT * FROM c2all ORDER BY frequency DESC, cycle LIMIT 5),
c3all AS (SELECT a.source || ' → ' || b.source || ' → ' || c.source AS cycle,
        least(a.frequency, b.frequency, c.frequency) AS frequency
    FROM edge a JOIN edge b ON b.source = a.target JOIN edge c ON c.source = b.target
     AND c.target = a.source
    WHERE a.source <> b.source AND b.source <> c.source AND c.source <> a.source),
c3 AS (SELECT * FROM c3all ORDER BY frequency DESC, cycle LIMIT 3),
cyc AS (SELECT cycle, length, frequency, type, impact, first_event, last_event FROM c1
    UNION ALL SELECT cycle, 2, frequency, 'cycle',
        CASE WHEN {_NEG_CYCLE} THEN 'negative' ELSE 'positive' END, first_event, last_event FROM c2
    UNION ALL SELECT cycle, 3, frequency, 'cycle',
        CASE WHEN {_NEG_CYCLE} THEN 'negative' ELSE 'positive' END, NULL, NULL FROM c3),
topc AS (SELECT * FROM cyc ORDER BY frequency DESC, cycle LIMIT 10),
rec AS (SELECT a.event_name, avg(date_sub('hour', a.timestamp, b.timestamp)) AS t
    FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_name ORDER BY timestamp, ord)
          AS k FROM ev) a
    JOIN (SELECT *, row_number() OVER (PARTITION BY user_id, event_name ORDER BY timestamp, ord)
          AS k FROM ev) b
    ON b.user_id = a.user_id AND b.event_name = a.event_name AND b.k = a.k + 1
    WHERE date_sub('hour', a.timestamp, b.timestamp) > 0 GROUP BY a.event_name),
spn AS (SELECT cycle, avg(date_sub('hour', lo, hi)) AS t FROM (
        SELECT c.cycle, e.user_id, min(e.timestamp) AS lo, max(e.timestamp) AS hi
        FROM c2 c JOIN ev e ON e.event_name IN (c.first_event, c.last_event) GROUP BY ALL)
    WHERE lo <> hi GROUP BY cycle),
done AS (SELECT c.cycle, c.length, c.frequency, c.type, c.impact,
        CASE c.length WHEN 1 THEN coalesce(r.t, 0.0) WHEN 2 THEN coalesce(s.t, 0.0)
             ELSE 0.0 END::DOUBLE AS avg_cycle_time
    FROM topc c LEFT JOIN rec r ON r.event_name = c.cycle LEFT JOIN spn s ON s.cycle = c.cycle)"""


def _named(df):
    return df.select(
        F.array_join("path", mining.ARROW).alias("cycle"), "frequency", "type", "impact"
    )


QUERIES["h12_self_loops"] = (
    _log_walks(lambda log, w, e: _named(mining.self_loops(e))),
    sk.query(sk.EV, WALKS, _edges(10), CYCLES,
             select="SELECT cycle, frequency, type, impact FROM c1"),
)
QUERIES["h13_two_step_cycles"] = (
    _log_walks(lambda log, w, e: _named(mining.two_step_cycles(e))),
    sk.query(sk.EV, WALKS, _edges(10), CYCLES,
             select="SELECT cycle, frequency, type, impact FROM cyc WHERE length = 2"),
)
QUERIES["h13_two_step_cycles_all"] = (
    _log_walks(lambda log, w, e: _named(mining.two_step_cycles(e, None)).select(
        "cycle", "frequency"), conversations),
    sk.query(sk.CV, WALKS, _edges(10), CYCLES, select="SELECT cycle, frequency FROM c2all"),
)
QUERIES["h14_three_step_cycles"] = (
    _log_walks(lambda log, w, e: _named(mining.three_step_cycles(e))),
    sk.query(sk.EV, WALKS, _edges(10), CYCLES,
             select="SELECT cycle, frequency, type, impact FROM cyc WHERE length = 3"),
)
QUERIES["h15_cycles"] = (
    _log_walks(lambda log, w, e: mining.cycles(log, e)),
    sk.query(
        sk.EV, WALKS, _edges(10), CYCLES,
        select="""SELECT cycle, CAST(length AS BIGINT) AS length, frequency, type, impact,
            round(avg_cycle_time, 6) AS avg_cycle_time FROM done""",
    ),
)
for key, sliced in (("", 0), ("_sliced", 3)):
    QUERIES[f"h16_recurrence_time{key}"] = (
        lambda spark, sf_dir, sliced=sliced: rounded(
            mining.recurrence_hours(
                mining.event_log(events(spark, sf_dir)),
                slices=hot_slices(spark, events(spark, sf_dir), sliced, ("user_id", "event_name"))
                if sliced
                else "auto",
            )
        ),
        sk.query(sk.EV, WALKS, _edges(10), CYCLES,
                 select="SELECT event_name, round(t, 6) AS avg_cycle_time FROM rec"),
    )


def _graph_sql(source, min_frequency, order=""):
    """Cycles by recursion over edges; occurrences by joining journeys position by position."""
    negative = sk.contains("cycle", labels.LEGACY_NEGATIVE_WORDS)
    return sk.query(
        source, WALKS, _edges(min_frequency),
        """pa AS (
            SELECT DISTINCT source AS first, source AS last, [source] AS path FROM edge
            UNION ALL
            SELECT p.first, e.target, list_append(p.path, e.target) FROM pa p
            JOIN edge e ON e.source = p.last
            WHERE len(p.path) < 5 AND e.target > p.first AND NOT list_contains(p.path, e.target))""",
        """sc AS (SELECT array_to_string(p.path, ' → ') AS cycle, path, len(path) AS k FROM pa p
            WHERE EXISTS (SELECT 1 FROM edge e WHERE e.source = p.last AND e.target = p.first))""",
        """occ AS (
            SELECT c.cycle, c.path, c.k, w.user_id, w.pos, 1 AS m, 0.0::DOUBLE AS spent
            FROM sc c JOIN wk w ON w.event_name = c.path[1]
            UNION ALL
            SELECT o.cycle, o.path, o.k, o.user_id, o.pos, o.m + 1, o.spent + b.hours
            FROM occ o JOIN wk b ON b.user_id = o.user_id AND b.pos = o.pos + o.m - 1
            WHERE o.m < o.k AND b.next_event = o.path[o.m + 1])""",
        f"""gc AS (SELECT c.cycle, count(o.cycle) AS frequency,
                CASE WHEN c.k = 1 THEN 'loop' ELSE 'cycle' END AS type,
                CASE WHEN {negative.replace('cycle', 'c.cycle')} THEN 'negative'
                     ELSE 'positive' END AS impact,
                coalesce(avg(o.spent), 0.0) AS avg_cycle_time
            FROM sc c LEFT JOIN occ o ON o.cycle = c.cycle AND o.m = c.k GROUP BY c.cycle, c.k)""",
        select=f"""SELECT cycle, frequency, type, impact,
            round(avg_cycle_time, 6) AS avg_cycle_time FROM gc {order}""",
    )


_TOP_TEN = "ORDER BY frequency DESC, cycle LIMIT 10"
QUERIES["h17_graph_cycles"] = (
    _log_walks(lambda log, w, e: mining.graph_cycles(w, e)),
    _graph_sql(sk.EV, 10, _TOP_TEN),
)
QUERIES["h17_graph_cycles_all"] = (
    _log_walks(lambda log, w, e: mining.graph_cycles(w, e, limit=None)),
    _graph_sql(sk.EV, 10),
)

STATS = """stt AS (SELECT count(*) AS total_cases, avg(total) AS avg_duration,
        count(*) FILTER (completed) / count(*) * 100.0::DOUBLE AS completion_rate,
        count(DISTINCT path) AS unique_paths,
        (SELECT count(DISTINCT event_name) FROM wk) AS total_activities,
        (SELECT count(*) FROM edge) AS total_transitions FROM pth)"""
ALL_STATS = """SELECT total_cases, round(avg_duration, 6) AS avg_duration,
    round(completion_rate, 6) AS completion_rate, unique_paths, total_activities,
    total_transitions FROM stt"""
for key, source, base in (("", events, sk.EV), ("_conversations", conversations, sk.CV)):
    QUERIES[f"h18_statistics{key}"] = (
        _log_walks(lambda log, w, e: mining.statistics(w, e), source),
        sk.query(base, WALKS, _edges(10), PATHS, STATS, select=ALL_STATS),
    )
INSIGHTS = """SELECT 'high_variability' AS rule, CAST(NULL AS VARCHAR) AS subject,
        unique_paths::DOUBLE AS value FROM stt WHERE unique_paths > total_cases * 0.8
    UNION ALL (SELECT 'bottleneck', event_name, round(avg_duration, 6) FROM act
        WHERE avg_duration > 24 ORDER BY avg_duration DESC, event_name LIMIT 1)
    UNION ALL (SELECT 'most_common_path', path, frequency::DOUBLE FROM vr
        ORDER BY frequency DESC, path LIMIT 1)
    UNION ALL (SELECT 'negative_cycle', cycle, frequency::DOUBLE FROM done
        WHERE impact = 'negative' ORDER BY frequency DESC, cycle LIMIT 1)
    UNION ALL SELECT 'low_completion', NULL, round(completion_rate, 6) FROM stt
        WHERE completion_rate < 30
    UNION ALL SELECT 'high_completion', NULL, round(completion_rate, 6) FROM stt
        WHERE completion_rate > 70"""
for key, source, base in (
    ("", events, sk.EV), ("_orders", orders, sk.OD), ("_conversations", conversations, sk.CV)
):
    QUERIES[f"h19_insights{key}"] = (
        lambda spark, sf_dir, source=source: rounded(
            process_report(source(spark, sf_dir))["insights"]
        ),
        sk.query(base, WALKS, ACTS, _edges(10), CYCLES, PATHS, STATS, select=INSIGHTS),
    )

MAIN = """best AS (SELECT source, arg_min(target, (-frequency, target)) AS target
        FROM edge GROUP BY source),
st AS (SELECT coalesce(
        (SELECT min(source) FROM edge WHERE source NOT IN (SELECT target FROM edge)),
        (SELECT event_name FROM act ORDER BY frequency DESC, event_name LIMIT 1)) AS activity),
mp AS (SELECT 0 AS position, activity, [activity] AS visited FROM st
    UNION ALL
    SELECT m.position + 1, b.target, list_append(m.visited, b.target) FROM mp m
    JOIN best b ON b.source = m.activity WHERE NOT list_contains(m.visited, b.target))"""


def _main(finish, source):
    return _log_walks(
        lambda log, w, e: finish(mining.main_path(mining.activities(w), e), mining.activities(w)),
        source,
    )


for key, source, base in (("", events, sk.EV), ("_conversations", conversations, sk.CV)):
    QUERIES[f"h20_main_path{key}"] = (
        _main(lambda p, a: p, source),
        sk.query(base, WALKS, ACTS, _edges(10), MAIN, select="SELECT position, activity FROM mp"),
    )
    QUERIES[f"h21_main_path_dropout{key}"] = (
        _main(mining.main_path_dropout, source),
        sk.query(
            base, WALKS, ACTS, _edges(10), MAIN,
            select="""SELECT m.position, m.activity, a.unique_users, round(CASE
                WHEN b.unique_users > 0
                THEN (b.unique_users - a.unique_users) / b.unique_users * 100.0
                ELSE 0.0 END::DOUBLE, 6) AS dropout_rate
            FROM mp m JOIN act a ON a.event_name = m.activity
            LEFT JOIN mp p ON p.position = m.position - 1
            LEFT JOIN act b ON b.event_name = p.activity""",
        ),
    )
