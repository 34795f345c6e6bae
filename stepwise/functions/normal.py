"""Tail of the normal distribution as a Column expression."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Coefficients of the published rational approximation of erfc
# (Numerical Recipes, "erfcc"), relative error below 1.2e-7.
ERFC_COEFFICIENTS = (
    -1.26551223,
    1.00002368,
    0.37409196,
    0.09678418,
    -0.18628806,
    0.27886807,
    -1.13520398,
    1.48851587,
    -0.82215223,
    0.17087277,
)


def two_sided_p(z: Column) -> Column:
    """P(|Z| >= |z|) = erfc(|z| / sqrt 2)."""
    x = F.abs(z) / F.sqrt(F.lit(2.0))
    t = 1 / (1 + x * 0.5)
    poly = reduce(lambda acc, c: acc * t + c, reversed(ERFC_COEFFICIENTS[:-1]),
                  F.lit(ERFC_COEFFICIENTS[-1]))
    return t * F.exp(poly - x * x)
