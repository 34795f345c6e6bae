"""Funnel, segment and significance queries with their SQL oracles."""

from __future__ import annotations

from stepwise.functions.normal import ERFC_COEFFICIENTS
from stepwise.model import ALL_USERS, FunnelConfig
from stepwise.operators import funnel as fn
from stepwise.operators import stats
from stepwise.operators.events import segment_events
from stepwise.plans.reports import funnel_report
from workload import sqlkit as sk
from workload.tables import ORDER_STEPS, STEPS, events, hot_slices, orders, rounded

ALL = [ALL_USERS]
TIERS = ("free", "pro")
TIER_NAMES = [f"tier={t}" for t in TIERS]
QUERIES: dict[str, tuple] = {}


def cfg(hours=24, **kwargs) -> FunnelConfig:
    return FunnelConfig(conversion_window_hours=hours, **kwargs)


REENTRY = {"reentry_mode": "optimized_reentry"}
UNORDERED = {"funnel_order": "unordered"}
TIERED = {"segment_by": "user_properties_tier", "segment_values": TIERS}


def _funnel(config, steps=STEPS, source=events, finish=lambda t: t, sliced=0):
    def run(spark, sf_dir):
        df = source(spark, sf_dir)
        slices = hot_slices(spark, df, sliced) if sliced else "auto"
        return rounded(finish(fn.funnel(df, steps, config, slices=slices)))

    return run


def _first(hours, steps=STEPS, base=sk.EV, segments=ALL, select=sk.FUNNEL, exempt=()):
    counts = sk.chain(steps, sk.first_only(steps, hours, exempt), segments)
    return sk.funnel_sql(base, counts, firsts=True, select=select)


def _again(hours, steps=STEPS, base=sk.EV, segments=ALL, select=sk.FUNNEL):
    counts = sk.chain(steps, sk.reentry(steps, hours), segments)
    return sk.funnel_sql(base, counts, select=select)


for hours in (1, 6, 24, 168):
    QUERIES[f"d1_first_only_{hours}h"] = (_funnel(cfg(hours)), _first(hours))
    QUERIES[f"d2_reentry_{hours}h"] = (_funnel(cfg(hours, **REENTRY)), _again(hours))
    QUERIES[f"d6_unordered_{hours}h"] = (
        _funnel(cfg(hours, **UNORDERED)),
        sk.funnel_sql(sk.EV, sk.unordered(STEPS, hours, ALL)),
    )

FOUR = ["signup", "click", "view", "purchase"]
QUERIES["d3_out_of_order_four_steps"] = (
    _funnel(cfg(72, **REENTRY), FOUR),
    _again(72, FOUR),
)
QUERIES["d3_out_of_order_first_only"] = (_funnel(cfg(500), FOUR), _first(500, FOUR))
QUERIES["d4_zero_window_reentry"] = (
    _funnel(cfg(0, **REENTRY), ORDER_STEPS, orders),
    _again(0, ORDER_STEPS, sk.OD),
)
QUERIES["d4_zero_window_first_only"] = (
    _funnel(cfg(0), ORDER_STEPS, orders),
    _first(0, ORDER_STEPS, sk.OD),
)
QUERIES["d5_exempt_step"] = (
    _funnel(cfg(500, strict_order_exempt=("signup",)), FOUR),
    _first(500, FOUR, exempt=("signup",)),
)
QUERIES["d7_event_totals"] = (
    _funnel(cfg(24, counting_method="event_totals")),
    sk.funnel_sql(sk.EV, sk.totals(STEPS, ALL)),
)
QUERIES["d8_unique_pairs"] = (
    _funnel(cfg(24, counting_method="unique_pairs", **REENTRY)),
    _again(24),
)


def _pairs(config, sliced=0):
    def run(spark, sf_dir):
        df = events(spark, sf_dir)
        slices = hot_slices(spark, df, sliced) if sliced else "auto"
        return rounded(fn.pair_conversion(df, STEPS, config, slices=slices))

    return run


QUERIES["d9_any_direction_first_only"] = (
    _pairs(cfg(24, **UNORDERED)),
    sk.funnel_sql(
        sk.EV, sk.chain(STEPS, sk.any_order(STEPS, 24, "firsts", "ts"), ALL), firsts=True
    ),
)
_ANY = sk.funnel_sql(sk.EV, sk.chain(STEPS, sk.any_order(STEPS, 2), ALL))
QUERIES["d9_any_direction_reentry"] = (_pairs(cfg(2, **UNORDERED, **REENTRY)), _ANY)
UNKNOWN = ["signup", "no such event", "nor this"]
QUERIES["d10_unknown_steps"] = (_funnel(cfg(24), UNKNOWN), _first(24, UNKNOWN))
QUERIES["d11_report_funnel"] = (
    lambda spark, sf_dir: rounded(
        funnel_report(events(spark, sf_dir), STEPS, cfg(24, **UNORDERED, **REENTRY))["funnel"]
    ),
    sk.funnel_sql(sk.EV, sk.unordered(STEPS, 24, ALL)),
)
QUERIES["d12_kpis"] = (
    _funnel(cfg(24, **TIERED), finish=fn.funnel_kpis),
    _first(
        24,
        base=sk.by_tier(TIERS),
        segments=TIER_NAMES,
        select="""SELECT a.segment, round(l.conversion_rate, 6) AS overall_conversion,
            a.users AS starting_users, l.users AS final_users,
            CAST((SELECT sum(drop_off) FROM tbl t WHERE t.segment = a.segment) AS BIGINT)
                AS total_drop_offs,
            b.step AS bottleneck_step, round(b.drop_off_rate, 6) AS bottleneck_rate,
            round((SELECT avg(drop_off_rate) FROM tbl t
                   WHERE t.segment = a.segment AND t.step_idx > 0), 6) AS avg_step_drop_off
        FROM tbl a JOIN tbl l ON l.segment = a.segment AND l.step_idx = 2
        JOIN tbl b ON b.segment = a.segment AND b.step_idx > 0
         AND NOT EXISTS (SELECT 1 FROM tbl c WHERE c.segment = a.segment AND c.step_idx > 0
             AND (c.drop_off_rate > b.drop_off_rate
                  OR (c.drop_off_rate = b.drop_off_rate AND c.step_idx < b.step_idx)))
        WHERE a.step_idx = 0""",
    ),
)
QUERIES["d13_completion_probability"] = (
    _funnel(cfg(24), finish=fn.completion_probability),
    _first(
        24,
        select="""SELECT a.segment, a.step_idx, a.step,
            round(CASE WHEN a.users = 0 THEN 0.0 ELSE l.users / a.users * 100.0 END::DOUBLE, 6)
                AS completion_probability
        FROM tbl a JOIN tbl l ON l.segment = a.segment AND l.step_idx = 2""",
    ),
)
QUERIES["d14_flow"] = (
    _funnel(cfg(24, **REENTRY), finish=fn.flow_table),
    _again(
        24,
        select="""SELECT * FROM (
            SELECT a.segment, a.step AS source, b.step AS target, b.users AS value,
                   'conversion' AS kind, 'success' AS severity
            FROM tbl a JOIN tbl b ON b.segment = a.segment AND b.step_idx = a.step_idx + 1
            UNION ALL
            SELECT a.segment, a.step, 'Drop-off after ' || a.step, b.drop_off, 'drop_off',
                   CASE WHEN b.drop_off_rate > 50 THEN 'error' WHEN b.drop_off_rate > 25
                        THEN 'warning' ELSE 'neutral' END
            FROM tbl a JOIN tbl b ON b.segment = a.segment AND b.step_idx = a.step_idx + 1)
        WHERE value > 0""",
    ),
)
QUERIES["d15_events_per_user"] = (
    lambda spark, sf_dir: rounded(fn.events_per_user(events(spark, sf_dir), STEPS)),
    sk.query(
        sk.EV,
        select=f"""SELECT event_name AS step, count(*) AS events,
            count(DISTINCT user_id) AS users,
            round(count(*) / count(DISTINCT user_id), 6) AS events_per_user
        FROM ev WHERE event_name IN ({sk.quoted(STEPS)}) GROUP BY event_name""",
    ),
)

# Every user cut into slices, as a user with a large share of the rows would be.
QUERIES["d1_first_only_sliced"] = (_funnel(cfg(168), sliced=9), _first(168))
QUERIES["d2_reentry_sliced"] = (_funnel(cfg(6, **REENTRY), sliced=9), _again(6))
QUERIES["d9_any_direction_sliced"] = (_pairs(cfg(2, **UNORDERED, **REENTRY), sliced=9), _ANY)

# Segments.
K_VALUES = ("1", "2", "3")
K_NAMES = [f"k={v}" for v in K_VALUES]
BY_K = {"segment_by": "event_properties_k", "segment_values": K_VALUES}
QUERIES["c1_segment_by_event_property"] = (
    lambda spark, sf_dir: segment_events(events(spark, sf_dir), cfg(**BY_K)).select(
        "segment", "user_id", "event_name", "timestamp"
    ),
    sk.query(sk.by_k(K_VALUES), select="SELECT segment, user_id, event_name, timestamp FROM ev"),
)
QUERIES["c2_missing_segment_value"] = (
    _funnel(
        cfg(168, segment_by="user_properties_tier", segment_values=("free", "gold"), **REENTRY)
    ),
    _again(168, base=sk.by_tier(["free"]), segments=["tier=free"]),
)
QUERIES["c2_no_segment_value"] = (
    _funnel(cfg(168, segment_by="user_properties_tier", segment_values=("gold", "iron"))),
    _first(168, base=sk.by_tier(["gold"]), segments=["tier=gold", "tier=iron"]),
)
QUERIES["c3_funnel_by_user_property"] = (
    _funnel(cfg(24, **TIERED, **REENTRY)),
    _again(24, base=sk.by_tier(TIERS), segments=TIER_NAMES),
)
QUERIES["c3_funnel_by_event_property"] = (
    _funnel(cfg(500, **BY_K)),
    _first(500, base=sk.by_k(K_VALUES), segments=K_NAMES),
)
QUERIES["c4_segment_comparison"] = (
    _funnel(cfg(168, **TIERED), finish=fn.segment_comparison),
    _first(
        168,
        base=sk.by_tier(TIERS),
        segments=TIER_NAMES,
        select="""SELECT a.segment, a.users AS starting_users, l.users AS final_users,
            round(CASE WHEN a.users > 0 THEN l.users / a.users * 100.0 ELSE 0.0 END::DOUBLE, 6)
                AS overall_conversion
        FROM tbl a JOIN tbl l ON l.segment = a.segment AND a.step_idx = 0 AND l.step_idx = 2""",
    ),
)
QUERIES["c5_segment_step_rates"] = (
    _funnel(cfg(168, **TIERED), finish=fn.segment_step_rates),
    _first(
        168,
        base=sk.by_tier(TIERS),
        segments=TIER_NAMES,
        select="SELECT segment, step_idx, step, round(step_rate, 6) AS rate FROM tbl",
    ),
)

# Significance, with the same approximation of erfc spelled out in SQL.
_X = "(abs(z_score) / sqrt(2.0))"
_T = f"(1.0 / (1.0 + 0.5 * {_X}))"
_POLY = str(ERFC_COEFFICIENTS[-1])
for _c in reversed(ERFC_COEFFICIENTS[:-1]):
    _POLY = f"({_POLY} * tt + ({_c}))"
TESTS = [
    """base AS (
        SELECT a.step_idx, a.step, a.segment AS segment_a, b.segment AS segment_b,
               a.users / a0.users AS ra, b.users / b0.users AS rb,
               a0.users AS na, b0.users AS nb,
               (a.users + b.users) / (a0.users + b0.users) AS pooled
        FROM tbl a JOIN tbl b ON b.step_idx = a.step_idx
        JOIN tbl a0 ON a0.segment = a.segment AND a0.step_idx = 0
        JOIN tbl b0 ON b0.segment = b.segment AND b0.step_idx = 0
        WHERE a.segment = 'tier=free' AND b.segment = 'tier=pro')""",
    """z AS (
        SELECT *, (ra - rb) / sqrt(pooled * (1 - pooled) * (1.0 / na + 1.0 / nb)) AS z_score,
               1.96 * sqrt(ra * (1 - ra) / na + rb * (1 - rb) / nb) AS margin
        FROM base WHERE pooled > 0 AND pooled < 1)""",
    f"zt AS (SELECT *, {_X} AS xx, {_T} AS tt FROM z)",
    f"tests AS (SELECT *, tt * exp({_POLY} - xx * xx) AS p_value FROM zt)",
]


def _tests(hours, select):
    counts = sk.chain(STEPS, sk.first_only(STEPS, hours), TIER_NAMES)
    return sk.query(sk.by_tier(TIERS), sk.FIRSTS, counts, sk.TABLE, *TESTS, select=select)


def _significance(finish=lambda t: t):
    return _funnel(
        cfg(168, **TIERED), finish=lambda t: finish(stats.significance(t, *TIER_NAMES))
    )


QUERIES["j1_significance"] = (
    _significance(),
    _tests(
        168,
        """SELECT step_idx, step, segment_a, segment_b, round(ra * 100, 6) AS conversion_a,
            round(rb * 100, 6) AS conversion_b, round(z_score, 6) AS z_score,
            round(p_value, 6) AS p_value, p_value < 0.05 AS is_significant,
            round(ra - rb - margin, 6) AS ci_low, round(ra - rb + margin, 6) AS ci_high
        FROM tests""",
    ),
)
QUERIES["j2_significance_report"] = (
    _significance(stats.significance_report),
    _tests(
        168,
        """SELECT step, segment_a, segment_b, round(ra * 100, 6) AS conversion_a,
            round(rb * 100, 6) AS conversion_b, round(ra * 100 - rb * 100, 6) AS difference_pp,
            round(p_value, 6) AS p_value, p_value < 0.05 AS is_significant,
            round(z_score, 6) AS z_score, round((ra - rb - margin) * 100, 6) AS ci_low_pp,
            round((ra - rb + margin) * 100, 6) AS ci_high_pp
        FROM tests""",
    ),
)
