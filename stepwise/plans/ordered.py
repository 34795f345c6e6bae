"""Per-user ordered scans on event rows.

Rows need ``user_id``, ``us`` (event time in microseconds) and, for row order, ``ord``.
Every scan looks from a row towards one end of the user's history and uses a frame that
starts at that end, so Spark evaluates it in one pass over the sorted rows.  (A frame that
*ends* at unbounded following is re-evaluated for each row, which is quadratic per user;
"after" scans therefore sort backwards.)

With slices, each scan runs inside a slice, and a small table with one row per slice of
the hot users carries the value in from the neighbouring slices.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stepwise.plans.skew import HOT, SLICE_COLUMNS, SLICE_ROW, SLICE_TIME, TIED, Slices

USER = ("user_id",)
AGG = {"min": F.min, "max": F.max, "sum": F.sum}
Scan = tuple[str, Column]


def _combine(how: str, left: Column, right: Column) -> Column:
    if how == "min":
        return F.least(left, right)
    if how == "max":
        return F.greatest(left, right)
    return F.coalesce(left, F.lit(0)) + F.coalesce(right, F.lit(0))


def local_keys(slices: Slices | None, keys: Sequence[str] = USER) -> list[str]:
    """The columns whose rows one task sorts: the keys and, with slices, the slice."""
    return list(keys) if slices is None else [*keys, SLICE_TIME, SLICE_ROW]


def cells_of(
    rows: DataFrame, aggregates: Mapping[str, Column], keys: Sequence[str] = USER
) -> DataFrame:
    """One row per slice of the hot keys, with its aggregates."""
    cells = rows.filter(HOT).groupBy(*keys, SLICE_TIME, SLICE_ROW)
    return cells.agg(*[c.alias(n) for n, c in aggregates.items()], F.first(TIED).alias(TIED))


def beyond(
    value: Callable[[Column], Column],
    column: Column,
    *,
    side: str,
    ties: bool = False,
    by: str = "time",
    keys: Sequence[str] = USER,
) -> Column:
    """In a table of slices, the aggregate of a column over the slices before or after.

    Rows at one time never straddle time slices.  Where a slice is a single microsecond split
    by ``ord``, all of its rows see the same neighbours in time, so ``by="time"`` looks at
    other time slices only; with ties those rows also see all of their own moment.
    """
    sign = -1 if side == "after" else 1
    if by == "row":
        window = Window.partitionBy(*keys).orderBy(sign * F.col(SLICE_TIME), sign * F.col(SLICE_ROW))
        return value(column).over(window.rowsBetween(Window.unboundedPreceding, -1))
    window = Window.partitionBy(*keys).orderBy(sign * F.col(SLICE_TIME))
    others = value(column).over(window.rangeBetween(Window.unboundedPreceding, -1))
    if not ties:
        return others
    own = value(column).over(window.rangeBetween(Window.unboundedPreceding, 0))
    return F.when(F.col(TIED), own).otherwise(others)


def with_cells(rows: DataFrame, cells: DataFrame, keys: Sequence[str] = USER) -> DataFrame:
    """The rows with the columns of their slice; null for users that are not hot."""
    return rows.join(cells.drop(TIED), [*keys, SLICE_TIME, SLICE_ROW], "left")


def running(
    df: DataFrame,
    scans: Mapping[str, Scan],
    *,
    side: str,
    ties: bool = False,
    by: str = "time",
    slices: Slices | None = None,
    keys: Sequence[str] = USER,
) -> DataFrame:
    """Add, per row, the min/max/sum of a value over the user's earlier or later rows.

    ``by="time"`` compares event times: strictly earlier/later, or including rows at the
    same time with ``ties=True``.  ``by="row"`` uses the total order (time, ord).

    With slices the input is read twice: once for the rows and once for what each slice
    carries to the others.  Values that depend on one another should share that table, as
    ``ahead`` does, rather than nest this function.
    """
    if ties and any(how == "sum" for how, _ in scans.values()):
        raise ValueError("sums are defined for strict scans only")
    rows = local(df, scans, side=side, ties=ties, by=by, part=local_keys(slices, keys))
    if slices is None:
        return rows
    cells = cells_of(df, {f"_c_{n}": AGG[how](value) for n, (how, value) in scans.items()}, keys)
    carry = cells.withColumns(
        {
            f"_c_{n}": beyond(AGG[how], F.col(f"_c_{n}"), side=side, ties=ties, by=by, keys=keys)
            for n, (how, _) in scans.items()
        }
    )
    return with_cells(rows, carry, keys).withColumns(
        {n: _combine(how, F.col(n), F.col(f"_c_{n}")) for n, (how, _) in scans.items()}
    ).drop(*[f"_c_{n}" for n in scans])


def local(
    rows: DataFrame,
    scans: Mapping[str, Scan],
    *,
    side: str,
    part: Sequence[str],
    ties: bool = False,
    by: str = "time",
) -> DataFrame:
    """``running`` inside each group of rows with equal ``part`` columns."""
    after = side == "after"
    window = Window.partitionBy(*part)
    if by == "row":
        order = [F.col("us"), F.col("ord")]
        order = [c.desc() for c in order] if after else order
        frame = window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    else:
        order = -F.col("us") if after else F.col("us")
        frame = window.orderBy(order).rangeBetween(Window.unboundedPreceding, 0 if ties else -1)
    values = {n: AGG[how](value).over(frame) for n, (how, value) in scans.items()}
    return rows.withColumns(
        {n: F.coalesce(c, F.lit(0)) if scans[n][0] == "sum" else c for n, c in values.items()}
    )


# A path that is still waiting for step i of k at the end of its slice: later than any time, and
# the later the fewer steps it has done.
_WAITING = 1 << 62


def _resolved(code: Column, first: int, count: int) -> Column:
    """The end of a path inside its slice or, from the step that it waits for there, beyond."""
    end = F.when(code < _WAITING, code)
    for j in range(first, count):
        end = end.when(code == _WAITING + count - j, F.col(f"_a{j}"))
    return end


def ahead(
    df: DataFrame,
    nexts: Mapping[str, Column],
    path: Sequence[Column] = (),
    *,
    slices: Slices | None = None,
    keys: Sequence[str] = USER,
) -> DataFrame:
    """Add the next time, at or after a row's own, of each of ``nexts`` (times, or null) and, if
    a path of conditions is given, ``end``: when the path that starts after a row and takes the
    next row of each condition, in (time, ord) order, is complete.

    With slices, a path that is not complete at the end of its slice waits for one of the
    steps.  A table of slices says, for each step that a path may wait for at the slice's start,
    where it stands at the slice's end; that table is folded from the last slice to the first,
    so rows are read twice whatever the number of steps.
    """
    part, count = local_keys(slices, keys), len(path)
    rows = local(
        df, {n: ("min", v) for n, v in nexts.items()}, side="after", ties=True, part=part
    )
    end, edges = F.col("us"), {}
    for i in range(count - 1, -1, -1):
        met = F.when(path[i], end)
        waiting = F.lit(_WAITING + count - i)
        edges[f"_t{i}"] = F.coalesce(F.min(met), waiting)
        rows = local(rows, {f"_e{i}": ("min", met)}, side="after", by="row", part=part)
        end = F.col(f"_e{i}") if slices is None else F.coalesce(F.col(f"_e{i}"), waiting)
    scratch = [f"_e{i}" for i in range(count)]
    if slices is None:
        return rows.withColumn("end", end).drop(*scratch) if count else rows
    rows = rows.withColumn("_code", end)
    cells = cells_of(rows, {**{f"_c_{n}": F.min(v) for n, v in nexts.items()}, **edges}, keys)
    cells = cells.withColumns(
        {f"_c_{n}": beyond(F.min, F.col(f"_c_{n}"), side="after", ties=True, keys=keys) for n in nexts}
    )
    for i in range(count - 1, -1, -1):
        done = _resolved(F.col(f"_t{i}"), i + 1, count)
        cells = cells.withColumn(f"_a{i}", beyond(F.min, done, side="after", by="row", keys=keys))
    rows = with_cells(rows, cells, keys).withColumns(
        {n: F.least(F.col(n), F.col(f"_c_{n}")) for n in nexts}
    )
    if count:
        rows = rows.withColumn("end", _resolved(F.col("_code"), 0, count))
    extra = [f"{p}{i}" for p in ("_t", "_a") for i in range(count)]
    return rows.drop("_code", *scratch, *extra, *[f"_c_{n}" for n in nexts])


def totals(
    df: DataFrame,
    aggregates: Mapping[str, Column],
    *,
    slices: Slices | None = None,
    keys: Sequence[str] = USER,
) -> DataFrame:
    """Add per-user aggregates to every row of the user."""
    keys = list(keys)
    if slices is None:
        window = Window.partitionBy(*keys)
        return df.withColumns({n: c.over(window) for n, c in aggregates.items()})
    window = Window.partitionBy(*keys, SLICE_TIME, SLICE_ROW)
    hot = (
        df.filter(HOT).groupBy(*keys).agg(*[c.alias(f"_t_{n}") for n, c in aggregates.items()])
    )
    inside = df.withColumns({n: c.over(window) for n, c in aggregates.items()})
    # One row per hot user, and each has a cut point: at most skew.GRID rows.
    joined = inside.join(F.broadcast(hot), keys, "left")
    return joined.withColumns(
        {n: F.when(F.col(HOT), F.col(f"_t_{n}")).otherwise(F.col(n)) for n in aggregates}
    ).drop(*[f"_t_{n}" for n in aggregates])


def sequence(
    df: DataFrame, *, slices: Slices | None = None, keys: Sequence[str] = USER
) -> DataFrame:
    """Add each row's position and its successor in the user's (time, ord) order."""
    keys = list(keys)
    cells = [] if slices is None else [SLICE_TIME, SLICE_ROW]
    window = Window.partitionBy(*keys, *cells).orderBy("us", "ord")
    rows = df.withColumns(
        {
            "pos": (F.row_number().over(window) - 1).cast("bigint"),
            "next_us": F.lead("us").over(window),
            "next_event": F.lead("event_name").over(window),
            "is_end": F.lead(F.lit(1)).over(window).isNull(),
        }
    )
    if slices is not None:
        order = Window.partitionBy(*keys).orderBy(*cells)
        carry = (
            df.filter(HOT)
            .groupBy(*keys, *cells)
            .agg(
                F.count(F.lit(1)).alias("_n"),
                F.min(F.struct("us", "ord", "event_name")).alias("_first"),
            )
            .select(
                *keys,
                *cells,
                F.sum("_n").over(order.rowsBetween(Window.unboundedPreceding, -1)).alias("_before"),
                F.lead("_first").over(order).alias("_next"),
            )
        )
        last = F.col("is_end") & F.col("_next").isNotNull()
        rows = (
            rows.join(carry, keys + cells, "left")
            .withColumns(
                {
                    "pos": F.col("pos") + F.coalesce("_before", F.lit(0)),
                    "next_us": F.when(last, F.col("_next.us")).otherwise(F.col("next_us")),
                    "next_event": F.when(last, F.col("_next.event_name")).otherwise(
                        F.col("next_event")
                    ),
                    "is_end": F.col("is_end") & F.col("_next").isNull(),
                }
            )
            .drop("_before", "_next")
        )
    return rows.withColumn("is_start", F.col("pos") == 0).drop(*SLICE_COLUMNS)
