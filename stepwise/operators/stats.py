"""Significance of step conversion between two segments."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stepwise.functions.normal import two_sided_p

ALPHA = 0.05
Z_95 = 1.96


def significance(table: DataFrame, segment_a: str, segment_b: str) -> DataFrame:
    """Two-proportion z-test per step of a segmented funnel table.

    Steps where the pooled rate is 0 or 1, such as the first, have no test.
    """
    first = F.first("users").over(Window.partitionBy("segment").orderBy("step_idx"))
    base = table.select("segment", "step_idx", "step", "users", first.alias("base"))

    def side(segment: str, suffix: str) -> DataFrame:
        return base.filter(F.col("segment") == segment).select(
            "step_idx",
            "step",
            F.col("users").alias(f"n_{suffix}"),
            F.col("base").alias(f"base_{suffix}"),
        )

    both = side(segment_a, "a").join(side(segment_b, "b"), ["step_idx", "step"])
    both = both.filter((F.col("base_a") > 0) & (F.col("base_b") > 0))
    rate_a = F.col("n_a") / F.col("base_a")
    rate_b = F.col("n_b") / F.col("base_b")
    pooled = (F.col("n_a") + F.col("n_b")) / (F.col("base_a") + F.col("base_b"))
    both = both.withColumns({"rate_a": rate_a, "rate_b": rate_b, "pooled": pooled})
    both = both.filter((F.col("pooled") > 0) & (F.col("pooled") < 1))
    share = 1 / F.col("base_a") + 1 / F.col("base_b")
    both = both.withColumn("se", F.sqrt(F.col("pooled") * (1 - F.col("pooled")) * share))
    both = both.filter(F.col("se") > 0)
    difference = F.col("rate_a") - F.col("rate_b")
    spread = F.sqrt(
        F.greatest(F.col("rate_a") * (1 - F.col("rate_a")), F.lit(0.0)) / F.col("base_a")
        + F.greatest(F.col("rate_b") * (1 - F.col("rate_b")), F.lit(0.0)) / F.col("base_b")
    )
    tested = both.withColumns({"z_score": difference / F.col("se"), "margin": Z_95 * spread})
    tested = tested.withColumn("p_value", two_sided_p(F.col("z_score")))
    return tested.select(
        "step_idx",
        "step",
        F.lit(segment_a).alias("segment_a"),
        F.lit(segment_b).alias("segment_b"),
        (F.col("rate_a") * 100).alias("conversion_a"),
        (F.col("rate_b") * 100).alias("conversion_b"),
        "z_score",
        "p_value",
        (F.col("p_value") < ALPHA).alias("is_significant"),
        (difference - F.col("margin")).alias("ci_low"),
        (difference + F.col("margin")).alias("ci_high"),
    )


def significance_report(tests: DataFrame) -> DataFrame:
    """Differences and confidence limits in percentage points."""
    return tests.select(
        "step",
        "segment_a",
        "segment_b",
        "conversion_a",
        "conversion_b",
        (F.col("conversion_a") - F.col("conversion_b")).alias("difference_pp"),
        "p_value",
        "is_significant",
        "z_score",
        (F.col("ci_low") * 100).alias("ci_low_pp"),
        (F.col("ci_high") * 100).alias("ci_high_pp"),
    )
