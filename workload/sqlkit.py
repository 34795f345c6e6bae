"""SQL fragments of the oracle queries, written with joins rather than windows."""

from __future__ import annotations

from collections.abc import Sequence

EV = """ev AS (
    SELECT 'All Users' AS segment, CAST(user_id AS VARCHAR) AS user_id, event_type AS event_name,
           ts AS timestamp, props AS event_properties,
           CASE WHEN user_id % 3 = 0 THEN 'free' WHEN user_id % 3 = 1 THEN 'pro' ELSE 'team' END
               AS tier,
           event_id AS ord
    FROM events)"""
OD = """ev AS (
    SELECT 'All Users' AS segment, CAST(o_custkey AS VARCHAR) AS user_id,
           o_orderstatus AS event_name, o_orderdate AS timestamp, o_orderkey AS ord
    FROM orders)"""
CV = """ev AS (
    SELECT 'All Users' AS segment, CAST(conv_id AS VARCHAR) AS user_id, role AS event_name,
           TIMESTAMP '2024-01-01 00:00:00' + turn * INTERVAL 1 HOUR AS timestamp, turn AS ord
    FROM conversations)"""
NAMES = """names AS (
    SELECT url AS name FROM pages UNION SELECT p_name FROM part
    UNION SELECT event_type FROM events UNION SELECT r_name FROM region)"""


def quoted(values: Sequence[str]) -> str:
    return ", ".join(f"'{v}'" for v in values)


def by_tier(values: Sequence[str]) -> str:
    """Event table with the tier as segment."""
    return EV.replace("'All Users' AS segment", "'tier=' || CASE WHEN user_id % 3 = 0 THEN 'free' "
                      "WHEN user_id % 3 = 1 THEN 'pro' ELSE 'team' END AS segment").replace(
        "FROM events)", f"FROM events WHERE CASE WHEN user_id % 3 = 0 THEN 'free' "
        f"WHEN user_id % 3 = 1 THEN 'pro' ELSE 'team' END IN ({quoted(values)}))")


def by_k(values: Sequence[str]) -> str:
    """Event table with the event property k as segment."""
    key = "json_extract_string(props, '$.k')"
    return EV.replace("'All Users' AS segment", f"'k=' || {key} AS segment").replace(
        "FROM events)", f"FROM events WHERE {key} IN ({quoted(values)}))")


def contains(name: str, words: Sequence[str]) -> str:
    return f"regexp_matches(lower({name}), '{'|'.join(words)}')"


def first_match(name: str, table, default: str) -> str:
    cases = " ".join(f"WHEN {contains(name, words)} THEN '{label}'" for label, words in table)
    return f"CASE {cases} ELSE {default} END"


def chain(steps: Sequence[str], transitions: Sequence[str], segments: Sequence[str]) -> str:
    """CTEs ``cnt``: users per step after intersecting the transitions' user sets."""
    parts = [f"s0 AS (SELECT DISTINCT segment, user_id FROM ev WHERE event_name = '{steps[0]}')"]
    for i, sql in enumerate(transitions, 1):
        parts.append(f"t{i} AS ({sql})")
        parts.append(
            f"s{i} AS (SELECT segment, user_id FROM s{i - 1} INTERSECT "
            f"SELECT segment, user_id FROM t{i})"
        )
    union = " UNION ALL ".join(
        f"SELECT segment, {i} AS i FROM s{i}" for i in range(len(steps))
    )
    return ",\n".join(parts) + ",\n" + counted(steps, union, segments)


def counted(steps: Sequence[str], rows: str, segments: Sequence[str]) -> str:
    grid = ", ".join(
        f"('{seg}', {i}, '{s}')" for seg in segments for i, s in enumerate(steps)
    )
    return f"""hits AS ({rows}),
grid(segment, i, step) AS (VALUES {grid}),
cnt AS (SELECT g.segment, CAST(g.i AS INTEGER) AS step_idx, g.step,
               CAST(count(h.i) AS BIGINT) AS users
        FROM grid g LEFT JOIN hits h ON h.segment = g.segment AND h.i = g.i GROUP BY ALL)"""


TABLE = """tbl AS (
    SELECT c.segment, c.step_idx, c.step, c.users,
           CASE WHEN c.step_idx = 0 THEN 100.0 WHEN f.users > 0 THEN c.users / f.users * 100.0
                ELSE 0.0 END::DOUBLE AS conversion_rate,
           CASE WHEN c.step_idx = 0 THEN 0 ELSE p.users - c.users END AS drop_off,
           CASE WHEN c.step_idx = 0 OR p.users = 0 THEN 0.0
                ELSE (p.users - c.users) / p.users * 100.0 END::DOUBLE AS drop_off_rate,
           CASE WHEN c.step_idx = 0 THEN 100.0 WHEN p.users > 0 THEN c.users / p.users * 100.0
                ELSE 0.0 END::DOUBLE AS step_rate
    FROM cnt c JOIN cnt f ON f.segment = c.segment AND f.step_idx = 0
    LEFT JOIN cnt p ON p.segment = c.segment AND p.step_idx = c.step_idx - 1)"""
FUNNEL = """SELECT segment, step_idx, step, users, round(conversion_rate, 6) AS conversion_rate,
       drop_off, round(drop_off_rate, 6) AS drop_off_rate, round(step_rate, 6) AS step_rate
FROM tbl"""
FIRSTS = """firsts AS (
    SELECT segment, user_id, event_name, arg_min(timestamp, ord) AS ts
    FROM ev GROUP BY ALL)"""


def first_only(steps: Sequence[str], hours: float, exempt: Sequence[str] = ()) -> list[str]:
    out = []
    for i in range(1, len(steps)):
        sql = f"""SELECT p.segment, p.user_id FROM firsts p
            JOIN firsts c ON c.segment = p.segment AND c.user_id = p.user_id
            WHERE p.event_name = '{steps[i - 1]}' AND c.event_name = '{steps[i]}' AND """
        if hours == 0:
            sql += "c.ts = p.ts"
        else:
            sql += f"c.ts >= p.ts AND c.ts < p.ts + INTERVAL '{hours} hours'"
            later = steps[i + 1 :]
            if later and steps[i - 1] not in exempt:
                sql += f""" AND NOT EXISTS (SELECT 1 FROM ev l WHERE l.segment = p.segment
                    AND l.user_id = p.user_id AND l.event_name IN ({quoted(later)})
                    AND l.timestamp > p.ts AND l.timestamp < c.ts)"""
        out.append(sql)
    return out


def reentry(steps: Sequence[str], hours: float) -> list[str]:
    out = []
    for i in range(1, len(steps)):
        if hours == 0:
            out.append(
                f"""SELECT p.segment, p.user_id FROM ev p JOIN ev c ON c.segment = p.segment
                AND c.user_id = p.user_id AND c.timestamp = p.timestamp
                WHERE p.event_name = '{steps[i - 1]}' AND c.event_name = '{steps[i]}'"""
            )
            continue
        later = steps[i + 1 :]
        skip = ""
        if later:
            skip = f"""WHERE NOT EXISTS (SELECT 1 FROM ev l WHERE l.segment = n.segment
                AND l.user_id = n.user_id AND l.event_name IN ({quoted(later)})
                AND l.timestamp > n.pts AND l.timestamp < n.cts)"""
        out.append(
            f"""SELECT n.segment, n.user_id FROM (
                SELECT p.segment, p.user_id, p.timestamp AS pts, min(c.timestamp) AS cts
                FROM ev p JOIN ev c ON c.segment = p.segment AND c.user_id = p.user_id
                 AND c.timestamp > p.timestamp
                 AND c.timestamp < p.timestamp + INTERVAL '{hours} hours'
                WHERE p.event_name = '{steps[i - 1]}' AND c.event_name = '{steps[i]}'
                GROUP BY ALL) n {skip}"""
        )
    return out


def any_order(steps: Sequence[str], hours: float, source: str = "ev", ts: str = "timestamp"):
    return [
        f"""SELECT p.segment, p.user_id FROM {source} p JOIN {source} c ON c.segment = p.segment
            AND c.user_id = p.user_id
            WHERE p.event_name = '{steps[i - 1]}' AND c.event_name = '{steps[i]}'
            AND c.{ts} < p.{ts} + INTERVAL '{hours} hours'
            AND p.{ts} < c.{ts} + INTERVAL '{hours} hours'"""
        for i in range(1, len(steps))
    ]


def unordered(steps: Sequence[str], hours: float, segments: Sequence[str]) -> str:
    columns = ", ".join(
        f"min(timestamp) FILTER (event_name = '{s}') AS t{i}" for i, s in enumerate(steps)
    )
    rows = ["SELECT segment, 0 AS i FROM m WHERE t0 IS NOT NULL"]
    for i in range(1, len(steps)):
        times = ", ".join(f"t{j}" for j in range(i + 1))
        present = " AND ".join(f"t{j} IS NOT NULL" for j in range(i + 1))
        rows.append(
            f"SELECT segment, {i} FROM m WHERE {present} AND "
            f"greatest({times}) <= least({times}) + INTERVAL '{hours} hours'"
        )
    return (
        f"m AS (SELECT segment, user_id, {columns} FROM ev GROUP BY ALL),\n"
        + counted(steps, " UNION ALL ".join(rows), segments)
    )


def totals(steps: Sequence[str], segments: Sequence[str]) -> str:
    rows = " UNION ALL ".join(
        f"SELECT segment, {i} AS i FROM ev WHERE event_name = '{s}'" for i, s in enumerate(steps)
    )
    return counted(steps, rows, segments)


def query(*ctes: str, select: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(ctes) + "\n" + select


def funnel_sql(base: str, counts: str, *, firsts: bool = False, select: str = FUNNEL) -> str:
    parts = [base] + ([FIRSTS] if firsts else []) + [counts, TABLE]
    return query(*parts, select=select)
