"""Cutting hot users into slices.

Ordered work is partitioned by user, so one user holding a large share of all rows would
become one task.  ``measure`` counts rows per user and, for users above a bound only, cuts
the user's history into slices below the bound.  A moment that alone exceeds the bound
becomes a slice of one microsecond, split further by ``ord``.

Hot users and cut points stay tables; no row of them reaches the driver.  The hot users'
moments are counted, put in order by ranges (``ranks``), and a moment whose running count
passes a multiple of the slice size is a cut point.  There are at most ``GRID`` cut points:
where rows ask for more, slices grow, so what is broadcast to cut the rows is bounded
whatever the table.  All other users keep one slice, and when nobody is hot the plans carry
no trace of this module.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepwise.plans.lineage import stored
from stepwise.plans.ranks import sums_before

MAX_ROWS = 2_000_000
# Cut points are this many times as dense as max_rows asks for: a slice ends with the moment
# that passes its size.
STEPS_PER_SLICE = 4
# Cut points of all keys together, at most: 8 MB of numbers.
GRID = 1 << 20
# Files whose row counts the driver reads itself; more are counted by a job.
FOOTERS = 32

SLICE_TIME = "_slice_time"
SLICE_ROW = "_slice_row"
HOT = "_hot"
TIED = "_tied"
SLICE_COLUMNS = (SLICE_TIME, SLICE_ROW, HOT, TIED)


@dataclass(frozen=True)
class Slices:
    """Sorted cut points (microseconds) of the hot keys: key columns and ``_cuts``."""

    grid: DataFrame
    keys: tuple[str, ...]
    max_rows: int

    def cut(self, df: DataFrame) -> DataFrame:
        """Add the slice columns: ``_slice_time`` counts the cut points up to the row's
        time, ``_slice_row`` splits rows that share one microsecond or have no time."""
        # Binary search: halving jumps over the sorted cut points, null past the end.
        place = (
            "aggregate(sequence(length(bin(size(_cuts))) - 1, 0), -1, (i, bit) -> "
            "IF(get(_cuts, i + shiftleft(1, bit)) <= us, i + shiftleft(1, bit), i))"
        )
        row_cell = f"ord div {self.max_rows}" if "ord" in df.columns else "0L"
        return (
            df.join(F.broadcast(self.grid), list(self.keys), "left")
            .withColumn(HOT, F.expr("_cuts IS NOT NULL"))
            .withColumn(
                SLICE_TIME, F.expr(f"IF({HOT}, IF(us IS NULL, -2, {place}), -1)")
            )
            .withColumn(
                TIED,
                F.expr(
                    f"{HOT} AND (us IS NULL OR coalesce("
                    f"get(_cuts, {SLICE_TIME} + 1) = get(_cuts, {SLICE_TIME}) + 1, false))"
                ),
            )
            .withColumn(SLICE_ROW, F.expr(f"CAST(IF({TIED}, {row_cell}, 0) AS BIGINT)"))
            .drop("_cuts")
        )


# Plan nodes that never give more rows than they take.
_SHRINKING = {"Project", "Filter", "Sort", "Aggregate", "Window", "Distinct", "RepartitionByExpression", "SubqueryAlias"}


def rows_at_most(df: DataFrame) -> int | None:
    """A bound on the rows of a table, from the row counts in the footers of its Parquet files,
    or None where that takes a job: many files, other formats, or a plan that may add rows."""
    if not hasattr(df, "_jdf"):
        return None
    node = df._jdf.queryExecution().optimizedPlan()
    while node.children().size() == 1 and node.nodeName() in _SHRINKING:
        node = node.children().head()
    if node.children().size() or node.nodeName() != "LogicalRelation":
        return None
    files = df.inputFiles()
    if len(files) > FOOTERS or not all(name.endswith(".parquet") for name in files):
        return None
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
    parquet, path = jvm.org.apache.parquet.hadoop, jvm.org.apache.hadoop.fs.Path
    rows = 0
    for name in files:
        reader = parquet.ParquetFileReader.open(parquet.util.HadoopInputFile.fromPath(path(name), conf))
        rows += reader.getRecordCount()
        reader.close()
    return rows


def cut(df: DataFrame, slices: Slices | None) -> DataFrame:
    return df if slices is None else slices.cut(df)


def resolve(
    df: DataFrame, slices: Slices | str | None, keys: Sequence[str] = ("user_id",)
) -> Slices | None:
    """Turn the ``slices`` argument of an operator into cut points or None."""
    return measure(df, keys=keys) if slices == "auto" else slices


def measure(
    df: DataFrame,
    *,
    keys: Sequence[str] = ("user_id",),
    max_rows: int = MAX_ROWS,
) -> Slices | None:
    """Find hot keys of ``df`` (needs the key columns and ``us``); None when there are none.

    Tables of at most max_rows rows have none.  Otherwise this runs one counting job, and jobs
    over the hot keys' moments if there are any.  Callers that run several operators over the
    same events can measure once and pass the result on.
    """
    keys = tuple(keys)
    most = rows_at_most(df)
    if most is not None and most <= max_rows:
        return None
    # Rows without a key stay together: no operator follows them through time.
    narrow = df.select(*keys, "us").dropna(subset=list(keys))
    counts = narrow.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    # At most rows / max_rows rows.
    hot = stored(counts.filter(F.col("_n") > max_rows))
    if hot.isEmpty():
        return None
    asked, room = F.lit(max(1, max_rows // STEPS_PER_SLICE)), F.lit(GRID / 3)
    step = F.greatest(asked, F.ceil(hot.agg(F.sum("_n").alias("n")).scalar() / room))
    chosen = narrow.filter("us IS NOT NULL").join(hot.select(*keys), list(keys), "left_semi")
    moments = chosen.groupBy(*keys, "us").agg(F.count(F.lit(1)).alias("_n")).withColumn("_step", step)
    placed = sums_before(moments, ["us"], "_before", F.col("_n"), keys)
    # A moment opens a slice if the running count passes a multiple of the step with it; a
    # crowded moment is a slice of its own.
    opens = F.expr("(_before + _n) div _step > _before div _step")
    points = placed.filter(opens).select(
        *keys, F.explode(F.expr("IF(_n >= _step, array(us, us + 1), array(us))")).alias("_cut")
    )
    grid = stored(points.groupBy(*keys).agg(F.sort_array(F.collect_set("_cut")).alias("_cuts")))
    return Slices(grid, keys, max_rows)
