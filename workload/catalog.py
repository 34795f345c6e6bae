"""Source, property, label and catalogue queries with their SQL oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from stepwise.functions import labels, props, times
from stepwise.operators import catalog
from stepwise.operators import events as ev_ops
from stepwise.operators.funnel import funnel
from stepwise.plans.lineage import new_folder
from stepwise.plans.ranks import sums_before
from stepwise.sources import checks, readers
from workload import sqlkit as sk
from workload.funnels import REENTRY, _again, _first, cfg
from workload.tables import STEPS, events, names, orders, rounded, table

QUERIES: dict[str, tuple] = {}
CORE = ("user_id", "event_name", "timestamp", "event_properties", "ord")
SELECT_CORE = f"SELECT {', '.join(CORE)} FROM ev"


# Sources and sinks.


def _csv_round_trip(spark, sf_dir):
    path = new_folder(spark)
    readers.write_result(events(spark, sf_dir).select(*CORE), path + ".csv", "csv")
    return readers.read_events(spark, path + ".csv").select(*CORE)


def _files(spark, sf_dir, kind):
    """The events in several files, each holding a range of them in order, without ``ord``."""
    path = f"{new_folder(spark)}.{kind}"
    rows = events(spark, sf_dir).repartitionByRange(5, "ord").sortWithinPartitions("ord")
    readers.write_result(rows.withColumnRenamed("ord", "event_id"), path, kind)
    return path


def _parquet_files(spark, sf_dir):
    stored = readers.read_events(spark, _files(spark, sf_dir, "parquet"), with_order=True)
    return stored.select(*CORE[:-1], F.col("event_id").alias("ord"))


def _file_order(spark, sf_dir):
    """Places of events by the order that the reader derives from files and rows."""
    stored = readers.read_events(spark, _files(spark, sf_dir, "parquet"), with_order=True)
    placed = sums_before(stored.select("event_id", "ord"), ["ord"], "before")
    return placed.select("event_id", (F.col("before") + 1).alias("place"))


def _csv_funnel(spark, sf_dir):
    """The default, data-ordered funnel on an uploaded CSV of several files."""
    stored = readers.read_events(spark, _files(spark, sf_dir, "csv"))
    return rounded(funnel(stored, STEPS, cfg(168)))


def _result_round_trip(spark, sf_dir):
    path = new_folder(spark)
    result = rounded(funnel(events(spark, sf_dir), STEPS, cfg(24, **REENTRY)))
    readers.write_result(result, path)
    return spark.read.parquet(path)


def _dictionary(spark, sf_dir):
    """A dictionary file for some events of the data and some that are not in it."""
    path = new_folder(spark)
    known = table(spark, sf_dir, "events").select(F.col("event_type").alias("name")).distinct()
    known = known.filter(F.col("name") < "p")
    absent = table(spark, sf_dir, "region").select(F.col("r_name").alias("name"))
    entries = known.union(absent).select(
        "name",
        F.lit("Listed").alias("category"),
        F.concat(F.lit("About "), "name").alias("description"),
        F.lit("rare").alias("frequency"),
    )
    readers.write_result(entries, path + ".csv", "csv")
    return readers.read_dictionary(spark, path + ".csv")


DICT = """dict AS (SELECT name, 'Listed' AS category, 'About ' || name AS description,
        'rare' AS frequency FROM (
    SELECT DISTINCT event_type AS name FROM events WHERE event_type < 'p'
    UNION ALL SELECT r_name FROM region))"""
QUERIES["a1_csv_source"] = (_csv_round_trip, sk.query(sk.EV, select=SELECT_CORE))
QUERIES["a1_csv_funnel"] = (_csv_funnel, _first(168))
QUERIES["a2_parquet_source"] = (_parquet_files, sk.query(sk.EV, select=SELECT_CORE))
QUERIES["a5_quality_counts"] = (
    lambda spark, sf_dir: checks.quality_counts(
        events(spark, sf_dir).withColumn(
            "timestamp",
            F.when(F.col("ord") % 5 == 0, "not a time")
            .when(F.col("ord") % 5 == 1, F.lit(None))
            .otherwise(F.col("timestamp").cast("string")),
        )
    ),
    """SELECT count(*) AS rows, 0::BIGINT AS null_user_id, 0::BIGINT AS null_event_name,
        count(*) FILTER (event_id % 5 = 1) AS null_timestamp,
        count(*) FILTER (event_id % 5 = 0) AS bad_timestamps FROM events""",
)
QUERIES["a6_canonical_events"] = (
    lambda spark, sf_dir: readers.canonical(
        table(spark, sf_dir, "orders").select(
            F.col("o_custkey").alias("user_id"),
            F.col("o_orderstatus").alias("event_name"),
            F.col("o_orderdate").cast("string").alias("timestamp"),
            F.array("o_orderkey", "o_custkey").alias("keys"),
        )
    ),
    """SELECT CAST(o_custkey AS VARCHAR) AS user_id, o_orderstatus AS event_name,
        o_orderdate AS timestamp, '[' || o_orderkey || ',' || o_custkey || ']' AS keys
    FROM orders""",
)
QUERIES["a7_event_dictionary"] = (_dictionary, sk.query(DICT, select="SELECT * FROM dict"))
QUERIES["a8_step_filter"] = (
    lambda spark, sf_dir: ev_ops.step_events(events(spark, sf_dir), STEPS).select(*CORE),
    sk.query(sk.EV, select=f"{SELECT_CORE} WHERE event_name IN ({sk.quoted(STEPS)})"),
)
QUERIES["a9_result_sink"] = (_result_round_trip, _again(24))

# Preparation and properties.
K = "json_extract_string(event_properties, '$.k')"
QUERIES["b1_preprocess"] = (
    lambda spark, sf_dir: ev_ops.preprocess(events(spark, sf_dir), STEPS),
    sk.query(
        sk.EV,
        select=f"""SELECT user_id, event_name, timestamp, event_properties,
            '{{"tier":"' || tier || '"}}' AS user_properties, ord,
            {K} AS event_properties_k, tier AS user_properties_tier
        FROM ev WHERE event_name IN ({sk.quoted(STEPS)})""",
    ),
)
QUERIES["b2_clean_users"] = (
    lambda spark, sf_dir: readers.valid_users(
        table(spark, sf_dir, "events").select(
            F.when(F.col("user_id") % 5 == 0, "")
            .when(F.col("user_id") % 5 == 1, "nan")
            .when(F.col("user_id") % 5 == 2, "None")
            .when(F.col("user_id") % 5 == 3, F.col("user_id").cast("string"))
            .alias("user_id"),
            "event_id",
        )
    ),
    """SELECT CAST(user_id AS VARCHAR) AS user_id, event_id FROM events WHERE user_id % 5 = 3""",
)
QUERIES["b3_file_order"] = (
    _file_order,
    "SELECT event_id, row_number() OVER (ORDER BY event_id) AS place FROM events",
)
QUERIES["b4_json_field"] = (
    lambda spark, sf_dir: events(spark, sf_dir).select(
        "ord",
        props.property_value("event_properties", "k").alias("k"),
        props.property_value("event_properties", "absent").alias("absent"),
        props.property_value(F.concat(F.lit("{"), "event_properties"), "k").alias("malformed"),
    ),
    sk.query(
        sk.EV,
        select=f"""SELECT ord, {K} AS k, CAST(NULL AS VARCHAR) AS absent,
            CAST(NULL AS VARCHAR) AS malformed FROM ev""",
    ),
)
QUERIES["b5_common_properties"] = (
    lambda spark, sf_dir: ev_ops.common_property_table(
        events(spark, sf_dir).withColumn(
            "event_properties",
            F.when(F.col("ord") % 20 == 0, '{"rare": 1, "k": 2}')
            .when(F.col("ord") % 4 == 1, '{"often": 1}')
            .otherwise(F.col("event_properties")),
        ),
        "event_properties",
    ),
    """SELECT * FROM (
        SELECT 'often' AS key, count(*) FILTER (event_id % 4 = 1) AS n FROM events UNION ALL
        SELECT 'rare', count(*) FILTER (event_id % 20 = 0) FROM events UNION ALL
        SELECT 'k', count(*) FILTER (event_id % 4 <> 1) FROM events)
    WHERE n >= 0.1 * (SELECT count(*) FROM events)""",
)
QUERIES["b6_property_predicate"] = (
    lambda spark, sf_dir: ev_ops.filter_by_property(
        events(spark, sf_dir), "event_properties", "k", "42"
    ).select(*CORE),
    sk.query(sk.EV, select=f"{SELECT_CORE} WHERE {K} = '42'"),
)
QUERIES["b7_property_inventory"] = (
    lambda spark, sf_dir: ev_ops.property_inventory(events(spark, sf_dir)),
    """SELECT DISTINCT 'event_properties' AS prop_type, unnest(json_keys(props)) AS key FROM events
    UNION ALL SELECT 'user_properties', 'tier'""",
)
QUERIES["b8_property_values"] = (
    lambda spark, sf_dir: ev_ops.property_values(events(spark, sf_dir), "k"),
    sk.query(sk.EV, select=f"SELECT DISTINCT {K} AS value FROM ev ORDER BY 1"),
)
PERIODS = {
    "hourly": "date_trunc('hour', timestamp)",
    "1d": "date_trunc('day', timestamp)",
    "weeks": "date_trunc('week', timestamp)",
    "1mo": "date_trunc('month', timestamp)",
    "15m": "time_bucket(INTERVAL 15 MINUTE, timestamp, TIMESTAMP '2000-01-01')",
    "2w": "time_bucket(INTERVAL 14 DAY, timestamp, TIMESTAMP '1970-01-05')",
    "1d12h": "time_bucket(INTERVAL 36 HOUR, timestamp, TIMESTAMP '1970-01-01')",
    "1y6mo": "time_bucket(INTERVAL 18 MONTH, timestamp, TIMESTAMP '2001-01-01')",
    "1s500ms": "time_bucket(INTERVAL 1500 MILLISECOND, timestamp, TIMESTAMP '1970-01-01')",
    "250us": "time_bucket(INTERVAL 250 MICROSECOND, timestamp, TIMESTAMP '1970-01-01')",
}
QUERIES["b9_periods"] = (
    lambda spark, sf_dir: events(spark, sf_dir).select(
        "ord", *[times.period_start("timestamp", p).alias(f"p_{p}") for p in PERIODS]
    ),
    sk.query(
        sk.EV,
        select="SELECT ord, "
        + ", ".join(f'CAST({sql} AS TIMESTAMP) AS "p_{p}"' for p, sql in PERIODS.items())
        + " FROM ev",
    ),
)
QUERIES["b10_month_truncation"] = (
    lambda spark, sf_dir: orders(spark, sf_dir)
    .groupBy(times.period_start("timestamp", "monthly").alias("period"))
    .agg(F.count(F.lit(1)).alias("n")),
    sk.query(
        sk.OD,
        select="""SELECT CAST(date_trunc('month', timestamp) AS TIMESTAMP) AS period,
            count(*) AS n FROM ev GROUP BY ALL""",
    ),
)


def _labelled(column):
    return lambda spark, sf_dir: names(spark, sf_dir).select("name", column().alias("label"))


def _label_sql(expression):
    return sk.query(sk.NAMES, select=f"SELECT name, {expression} AS label FROM names")


QUERIES["b11_event_category"] = (
    _labelled(lambda: labels.event_category("name")),
    _label_sql(sk.first_match("name", labels.EVENT_CATEGORIES, "'Other'")),
)
QUERIES["b12_activity_type"] = (
    _labelled(
        lambda: labels.activity_type("name", F.length("name") % 2, F.length("name") % 3)
    ),
    _label_sql(
        sk.first_match(
            "name", labels.ACTIVITY_TYPES,
            """CASE WHEN length(name) % 2 > 0 THEN 'entry' WHEN length(name) % 3 > 0 THEN 'exit'
               ELSE 'process' END""",
        )
    ),
)
QUERIES["b13_transition_type"] = (
    lambda spark, sf_dir: names(spark, sf_dir).select(
        "name",
        labels.transition_type(
            F.substring("name", 1, 5), F.col("name"), F.length("name") * 3
        ).alias("label"),
    ),
    _label_sql(
        """CASE WHEN substring(name, 1, 5) = name THEN 'loop' WHEN contains(lower(name), 'error')
            THEN 'error_transition' WHEN length(name) * 3 > 100 THEN 'main_flow'
            ELSE 'alternative_flow' END"""
    ),
)
QUERIES["b14_variant_type"] = (
    lambda spark, sf_dir: table(spark, sf_dir, "part").select(
        "p_partkey", labels.variant_type(F.col("p_size") * 2).alias("label")
    ),
    """SELECT p_partkey, CASE WHEN p_size * 2 > 80 THEN 'high_success' WHEN p_size * 2 > 50
        THEN 'medium_success' WHEN p_size * 2 > 20 THEN 'low_success' ELSE 'problematic' END
        AS label FROM part""",
)
_SHORT = "CASE WHEN length(name) > 30 THEN substring(name, 1, 27) || '...' ELSE name END"
QUERIES["b15_destination_label"] = (
    lambda spark, sf_dir: names(spark, sf_dir).select(
        "name",
        labels.destination_label("name").alias("label"),
        labels.destination_category("name").alias("category"),
    ),
    sk.query(
        sk.NAMES,
        select=f"""SELECT name, {_SHORT} AS label,
            {sk.first_match('name', labels.DESTINATION_CATEGORIES, "'other'")} AS category
        FROM names""",
    ),
)
QUERIES["b16_between_label"] = (
    lambda spark, sf_dir: names(spark, sf_dir).select(
        "name",
        labels.between_category("name").alias("label"),
        labels.impact_level(F.length("name") * 3).alias("impact"),
    ),
    sk.query(
        sk.NAMES,
        select=f"""SELECT name, {sk.first_match('name', labels.BETWEEN_CATEGORIES, "'other'")}
            AS label, CASE WHEN length(name) * 3 > 100 THEN 'High' WHEN length(name) * 3 > 10
            THEN 'Medium' ELSE 'Low' END AS impact FROM names""",
    ),
)
QUERIES["b17_success_event"] = (
    lambda spark, sf_dir: names(spark, sf_dir).select(
        "name",
        labels.is_success("name").alias("success"),
        labels.is_journey_success("name").alias("journey_success"),
    ),
    sk.query(
        sk.NAMES,
        select=f"""SELECT name, {sk.contains('name', labels.SUCCESS_WORDS)} AS success,
            {sk.contains('name', labels.JOURNEY_SUCCESS_WORDS)} AS journey_success FROM names""",
    ),
)

# Catalogue.
KS = """ks AS (SELECT event_name, count(*) AS count, count(DISTINCT user_id) AS unique_users,
        count(*) / (SELECT count(*) FROM ev) * 100.0::DOUBLE AS share,
        count(DISTINCT user_id) / (SELECT count(DISTINCT user_id) FROM ev) * 100.0::DOUBLE
            AS coverage,
        count(*) / count(DISTINCT user_id)::DOUBLE AS per_user FROM ev GROUP BY event_name)"""


def _level(high, medium):
    return f"CASE WHEN share > {high} THEN 'high' WHEN share > {medium} THEN 'medium' ELSE 'low' END"


CATEGORY = sk.first_match("event_name", labels.EVENT_CATEGORIES, "'Other'")


def _meta(medium):
    return f"""SELECT event_name AS name, {CATEGORY} AS category,
        'Event: ' || event_name AS description, {_level(10, medium)} AS frequency,
        count AS total_occurrences, unique_users, share AS event_percentage,
        coverage AS user_penetration, per_user AS avg_events_per_user FROM ks"""


ROUND_META = """SELECT name, category, description, frequency, total_occurrences, unique_users,
    round(event_percentage, 6) AS event_percentage, round(user_penetration, 6) AS user_penetration,
    round(avg_events_per_user, 6) AS avg_events_per_user FROM meta"""
QUERIES["k1_overview"] = (
    lambda spark, sf_dir: catalog.overview(events(spark, sf_dir)),
    sk.query(
        sk.EV,
        select="""SELECT count(*) AS events, count(DISTINCT user_id) AS users,
            count(DISTINCT event_name) AS event_types,
            date_sub('hour', min(timestamp), max(timestamp)) // 24 AS days FROM ev""",
    ),
)
for key, source, base in (("", events, sk.EV), ("_orders", orders, sk.OD)):
    QUERIES[f"k2_event_statistics{key}"] = (
        lambda spark, sf_dir, source=source: rounded(
            catalog.event_statistics(source(spark, sf_dir))
        ),
        sk.query(
            base, KS,
            select=f"""SELECT event_name, count, unique_users,
                round(share, 6) AS percentage_of_events, round(coverage, 6) AS user_coverage,
                {_level(10, 1)} AS frequency_level, round(per_user, 6) AS avg_per_user FROM ks""",
        ),
    )
QUERIES["k3_event_metadata"] = (
    lambda spark, sf_dir: rounded(
        catalog.event_metadata(events(spark, sf_dir), _dictionary(spark, sf_dir))
    ),
    sk.query(
        sk.EV, KS, DICT, f"own AS ({_meta(5)})",
        """meta AS (SELECT coalesce(o.name, d.name) AS name,
            coalesce(d.category, o.category) AS category,
            coalesce(d.description, o.description) AS description,
            coalesce(d.frequency, o.frequency) AS frequency,
            coalesce(total_occurrences, 0) AS total_occurrences,
            coalesce(unique_users, 0) AS unique_users,
            coalesce(event_percentage, 0.0) AS event_percentage,
            coalesce(user_penetration, 0.0) AS user_penetration,
            coalesce(avg_events_per_user, 0.0) AS avg_events_per_user
            FROM own o FULL JOIN dict d ON d.name = o.name)""",
        select=ROUND_META,
    ),
)
QUERIES["k4_basic_metadata"] = (
    lambda spark, sf_dir: rounded(catalog.basic_metadata(events(spark, sf_dir))),
    sk.query(sk.EV, KS, f"meta AS ({_meta(1)})", select=ROUND_META),
)
QUERIES["k5_catalogue_filter"] = (
    lambda spark, sf_dir: rounded(
        catalog.filter_catalogue(
            catalog.basic_metadata(events(spark, sf_dir)), "I", ["Engagement", "Authentication"],
            ["high"],
        )
    ),
    sk.query(
        sk.EV, KS, f"meta AS ({_meta(1)})",
        select=f"""{ROUND_META} WHERE (contains(lower(name), 'i')
            OR contains(lower(description), 'i'))
            AND category IN ('Engagement', 'Authentication') AND frequency = 'high'""",
    ),
)
QUERIES["k6_event_names"] = (
    lambda spark, sf_dir: catalog.event_names(events(spark, sf_dir)),
    sk.query(sk.EV, select="SELECT DISTINCT event_name FROM ev ORDER BY event_name"),
)
QUERIES["k7_popularity"] = (
    lambda spark, sf_dir: rounded(
        catalog.popularity(catalog.event_statistics(orders(spark, sf_dir)))
    ),
    sk.query(
        sk.OD, KS,
        select="""SELECT event_name, round(coverage, 6) AS user_coverage,
            CASE WHEN coverage > 50 THEN 'popular' WHEN coverage > 20 THEN 'moderate'
                 ELSE 'rare' END AS popularity FROM ks""",
    ),
)
QUERIES["k8_profile"] = (
    lambda spark, sf_dir: rounded(checks.profile(table(spark, sf_dir, "orders"))),
    "\nUNION ALL ".join(
        f"""SELECT '{c}' AS column_name, '{t}' AS dtype, count(*) AS row_count,
            count(*) - count({c}) AS nulls,
            round((count(*) - count({c})) / count(*) * 100.0::DOUBLE, 6) AS null_pct FROM orders"""
        for c, t in (
            ("o_orderkey", "bigint"), ("o_custkey", "bigint"), ("o_orderstatus", "string"),
            ("o_totalprice", "double"), ("o_orderdate", "timestamp_ntz"),
            ("o_orderpriority", "string"),
        )
    ),
)
