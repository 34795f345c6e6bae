"""Running sums over one global order, or one per key, without a key's rows in one task.

Rows are cut into ranges of the order, summed inside each range, and moved up by the sum of
the ranges before it.  The table of those sums has one row per range and key in it, so at most
as many rows as there are ranges and keys together.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stepwise.plans.lineage import stored


def sums_before(
    df: DataFrame,
    order: Sequence[str],
    name: str,
    weight: Column | None = None,
    by: Sequence[str] = (),
) -> DataFrame:
    """The rows with the sum of ``weight`` (or the number of rows) over all rows of the same
    ``by`` that come before in ``order``, which should name each row of a key once.

    The ranges are stored: were they computed twice, they could be cut at different places.
    """
    by, order = list(by), list(order)
    weight = F.lit(1).cast("bigint") if weight is None else weight
    parts = stored(
        df.repartitionByRange(*by, *order).withColumns(
            {"_range": F.spark_partition_id(), "_weight": weight}
        )
    )
    earlier = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = parts.groupBy("_range", *by).agg(F.sum("_weight").alias("_sum"))
    bases = sums.select("_range", *by, F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("_range", *by).orderBy(*order)
    inside = inside.rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("_base") + F.coalesce(F.sum("_weight").over(inside), F.lit(0))
    return parts.join(bases, ["_range", *by]).withColumn(name, before).drop("_range", "_weight", "_base")
