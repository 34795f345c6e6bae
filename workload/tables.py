"""The given tables seen as event tables."""

from __future__ import annotations

from functools import reduce, wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stepwise.operators.events import timed
from stepwise.plans.skew import measure
from stepwise.sources.readers import canonical

STEPS = ["signup", "view", "purchase"]
ORDER_STEPS = ["O", "P", "F"]


def shared(build):
    """One lazy table per session and folder: files are listed and typed once, and read by
    each query that uses the table."""
    known: dict[tuple, DataFrame] = {}

    @wraps(build)
    def get(spark: SparkSession, sf_dir: str, *args: str) -> DataFrame:
        key = (spark.sparkContext.applicationId, sf_dir, *args)
        if key not in known:
            known[key] = build(spark, sf_dir, *args)
        return known[key]

    return get


@shared
def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@shared
def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    tier = F.when(F.col("user_id") % 3 == 0, "free").when(F.col("user_id") % 3 == 1, "pro")
    return canonical(
        table(spark, sf_dir, "events"),
        {
            "user_id": "user_id",
            "event_name": "event_type",
            "timestamp": "ts",
            "event_properties": "props",
            "user_properties": F.to_json(
                F.named_struct(F.lit("tier"), tier.otherwise("team"))
            ),
            "ord": "event_id",
        },
    )


@shared
def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of a customer: the status is the event, the order date its time."""
    return canonical(
        table(spark, sf_dir, "orders"),
        {
            "user_id": "o_custkey",
            "event_name": "o_orderstatus",
            "timestamp": "o_orderdate",
            "ord": "o_orderkey",
        },
    )


@shared
def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of a conversation, an hour apart."""
    start = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    return canonical(
        table(spark, sf_dir, "conversations"),
        {
            "user_id": "conv_id",
            "event_name": "role",
            "timestamp": start + F.make_dt_interval(hours=F.col("turn").cast("int")),
            "ord": "turn",
        },
    )


def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of several tables, used as event names."""
    parts = [("pages", "url"), ("part", "p_name"), ("events", "event_type"), ("region", "r_name")]
    texts = [table(spark, sf_dir, t).select(F.col(c).alias("name")) for t, c in parts]
    return reduce(DataFrame.union, texts).distinct()


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded so that two engines' results can be compared by value."""
    return df.selectExpr(
        *[
            f"round(`{name}`, {digits}) AS `{name}`" if kind == "double" else f"`{name}`"
            for name, kind in df.dtypes
        ]
    )


def hot_slices(spark: SparkSession, events_df: DataFrame, max_rows: int, keys=("user_id",)):
    """Measure with a tiny bound, so that every user is cut as a hot user would be."""
    rows = timed(events_df)
    return measure(rows, keys=keys, max_rows=max_rows)
