"""Exact interpolated quantiles of integers without holding a group in one task.

Values are counted in about sqrt(range) equal cells per group, the cells that contain a
wanted rank are found from the running counts, and only the values in those cells are
ranked.  Both ranking tables are bounded by sqrt(range) rows per group and cell.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def exact_quantiles(
    counted: DataFrame,
    keys: Sequence[str],
    value: str,
    weight: str,
    probabilities: Sequence[float],
    upper: int,
) -> DataFrame:
    """Columns ``keys`` and ``q0..qn`` for integer values in [0, upper].

    ``counted`` has one row per group and distinct value, with its number of occurrences.
    Linear interpolation between neighbouring ranks, as numpy and Spark's ``percentile``.
    """
    keys = list(keys)
    width = max(1, math.isqrt(upper) + 1)
    placed = counted.withColumn("_cell", F.call_function("div", F.col(value), F.lit(width)))
    cells = (
        placed.groupBy(*keys, "_cell")
        .agg(F.sum(weight).alias("_n"))
        .withColumn("_upto", F.sum("_n").over(Window.partitionBy(*keys).orderBy("_cell")))
        .withColumn("_total", F.sum("_n").over(Window.partitionBy(*keys)))
    )
    wanted = []
    for i, p in enumerate(probabilities):
        position = f"({float(p)!r}D * (_total - 1))"
        for end, rank in (("lo", "floor"), ("hi", "ceil")):
            wanted.append(
                f"named_struct('_q', {i}, '_end', '{end}', "
                f"'_inner', {rank}({position}) - (_upto - _n), "
                f"'_part', {position} - floor({position}))"
            )
    # Cells that hold a wanted rank, with the ranks' places inside: two per group and
    # probability at most.
    hit = cells.selectExpr(
        *keys,
        "_cell",
        f"filter(array({', '.join(wanted)}), w -> w._inner >= 0 AND w._inner < _n) AS _wants",
    ).filter("size(_wants) > 0")
    by_value = Window.partitionBy(*keys, "_cell").orderBy(value)
    found = (
        placed.join(hit, [*keys, "_cell"])
        .withColumn("_seen", F.sum(weight).over(by_value))
        .selectExpr(
            *keys,
            value,
            f"inline(filter(_wants, w -> w._inner < _seen AND w._inner >= _seen - {weight}))",
        )
    )
    low = "max(IF(_q = {i} AND _end = 'lo', {v}, NULL))"
    high = "max(IF(_q = {i} AND _end = 'hi', {v}, NULL))"
    part = "max(IF(_q = {i}, _part, NULL))"
    text = f"{low} + ({high} - {low}) * {part}"
    return found.groupBy(*keys).agg(
        *[F.expr(text.format(i=i, v=value)).alias(f"q{i}") for i in range(len(probabilities))]
    )
