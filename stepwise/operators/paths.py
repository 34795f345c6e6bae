"""Path analysis: what users do after dropping off and between two steps.

All step pairs are computed in one pass.  Pairs are user-level columns or scans over the
sorted history, so no event is joined with another event of the same user.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stepwise.functions.labels import (
    DROPOFF_KINDS,
    between_category,
    destination_category,
    destination_label,
    first_match,
    impact_level,
)
from stepwise.functions.texts import text_literal
from stepwise.functions.times import from_micros
from stepwise.model import HOUR_US, FunnelConfig, check_steps
from stepwise.operators.events import timed
from stepwise.plans.ordered import AGG, beyond, cells_of, local, local_keys, running, totals, with_cells
from stepwise.plans.skew import HOT, TIED, cut, resolve

NO_ACTIVITY = "(no further activity)"
DIRECT = "(direct conversion)"
TOP_EVENTS = 10
FLOW_EVENTS = 8
WEEK_US = 168 * HOUR_US


def _history(events: DataFrame, funnel_filter: Column | None) -> DataFrame:
    """All rows of all users, with ``in_funnel`` marking rows that may act as steps."""
    rows = timed(events)
    flag = F.lit(True) if funnel_filter is None else F.coalesce(funnel_filter, F.lit(False))
    rows = rows.withColumn("in_funnel", flag).filter(F.col("us").isNotNull())
    extra = ["ord"] if "ord" in rows.columns else []
    return rows.select("user_id", "event_name", "us", "in_funnel", *extra)


def _step(name: str) -> Column:
    return F.col("in_funnel") & (F.col("event_name") == name)


def _time_of(name: str) -> Column:
    return F.when(_step(name), F.col("us"))


def _pairs(steps: Sequence[str]) -> list[tuple[int, str, str]]:
    return [(i, steps[i], steps[i + 1]) for i in range(len(steps) - 1)]


def dropped_users(
    events: DataFrame, steps: Sequence[str], *, funnel_filter: Column | None = None
) -> DataFrame:
    """Users that did a step and never the next one, with their last time at the step."""
    steps = check_steps(steps)
    rows = _history(events, funnel_filter).filter(F.col("event_name").isin(*steps))
    per_user = rows.groupBy("user_id").agg(
        *[F.max(_time_of(s)).alias(f"last{i}") for i, s in enumerate(steps)]
    )
    entries = F.array(
        *[
            F.struct(
                F.lit(s).alias("step"),
                F.when(F.col(f"last{i + 1}").isNull(), F.col(f"last{i}")).alias("last_us"),
            )
            for i, s, _ in _pairs(steps)
        ]
    )
    return (
        per_user.select("user_id", F.inline(entries))
        .filter(F.col("last_us").isNotNull())
        .select("user_id", "step", from_micros("last_us").alias("last_time"))
    )


def _ranked(counts: DataFrame, by: Sequence[str], limit: int) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.col("n").desc(), F.col("event"))
    return counts.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)


def dropoff_events(
    events: DataFrame,
    steps: Sequence[str],
    cfg: FunnelConfig = FunnelConfig(),
    *,
    horizon_us: int | None = None,
    top: int | None = TOP_EVENTS,
    funnel_filter: Column | None = None,
    slices="auto",
) -> DataFrame:
    """Per step, the first other event of each dropped user within the horizon.

    The horizon starts after the user's last event of the step and is the conversion
    window unless given.  ``top=None`` keeps all events.
    """
    steps = check_steps(steps)
    horizon = cfg.window_us if horizon_us is None else horizon_us
    rows = _history(events, funnel_filter)
    slices = resolve(rows, slices)
    lasts = {f"last{i}": F.max(_time_of(s)) for i, s in enumerate(steps)}
    known = totals(cut(rows, slices), lasts, slices=slices)
    order = [c for c in ("us", "ord") if c in rows.columns]

    def following(i: int, step: str) -> Column:
        since = F.col("us") - F.col(f"last{i}")
        inside = (since > 0) & (since <= horizon) & (F.col("event_name") != step)
        return F.min(F.when(inside, F.struct(*order, "event_name")))["event_name"]

    per_user = known.groupBy("user_id").agg(
        *[F.max(n).alias(n) for n in lasts],
        *[following(i, s).alias(f"after{i}") for i, s, _ in _pairs(steps)],
    )
    entries = F.array(
        *[
            F.struct(
                F.lit(i).alias("step_idx"),
                F.lit(s).alias("step"),
                (F.col(f"last{i}").isNotNull() & F.col(f"last{i + 1}").isNull()).alias("dropped"),
                F.coalesce(f"after{i}", F.lit(NO_ACTIVITY)).alias("event"),
            )
            for i, s, _ in _pairs(steps)
        ]
    )
    counts = (
        per_user.select(F.inline(entries))
        .filter("dropped")
        .groupBy("step_idx", "step", "event")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    if top is not None:
        counts = _ranked(counts, ["step_idx"], top)
    return counts.select("step", "event", "n")


def _pair_rows(per_user: DataFrame, steps: Sequence[str]) -> DataFrame:
    """Long form of per-user columns a{i}, b{i}."""
    entries = F.array(
        *[
            F.struct(
                F.lit(s).alias("step"),
                F.lit(t).alias("next_step"),
                F.col(f"a{i}").alias("a_us"),
                F.col(f"b{i}").alias("b_us"),
            )
            for i, s, t in _pairs(steps)
        ]
    )
    return per_user.select("user_id", F.inline(entries)).filter(
        F.col("a_us").isNotNull() & F.col("b_us").isNotNull()
    )


def _as_times(pairs: DataFrame) -> DataFrame:
    return pairs.select(
        "user_id",
        "step",
        "next_step",
        from_micros("a_us").alias("step_a_time"),
        from_micros("b_us").alias("step_b_time"),
    )


def _valid(steps: Sequence[str], window: int) -> dict[int, Column]:
    """Row is a pair's A event whose next B (column x{i+1}) lies inside the window."""
    return {
        i: _step(s) & F.coalesce(F.col(f"x{i + 1}") - F.col("us") <= window, F.lit(False))
        for i, s, _ in _pairs(steps)
    }


def _with_next_steps(rows: DataFrame, steps: Sequence[str], slices, *, ties=False) -> DataFrame:
    nexts = {
        f"x{i}": ("min", _time_of(s)) for i, s in enumerate(steps) if i > 0 or ties
    }
    return running(rows, nexts, side="after", ties=ties, slices=slices)


def _pair_mode(cfg: FunnelConfig) -> str:
    if cfg.unordered:
        return "unordered_first" if cfg.first_only else "unordered_any"
    return "first" if cfg.first_only else "every"


def _pair_aggregates(
    rows: DataFrame, steps: Sequence[str], window: int, mode: str, slices
) -> tuple[DataFrame, dict[str, Column], dict[str, Column]]:
    """What finds one pair per user: scanned rows, the per-user aggregates p{i} and q{i},
    and the columns a{i}, b{i} (null without a pair) made from those."""
    if mode != "unordered_first":
        rows = _with_next_steps(rows, steps, slices, ties=mode == "unordered_any")
    return _pair_ends(rows, steps, window, mode)


def _pair_ends(
    rows: DataFrame, steps: Sequence[str], window: int, mode: str
) -> tuple[DataFrame, dict[str, Column], dict[str, Column]]:
    """``_pair_aggregates`` of rows that know the next event of each step (columns x{i})."""
    us = F.col("us")
    aggregates: dict[str, Column] = {}
    if mode in ("first", "optimal"):
        valid = _valid(steps, window)
        for i, s, _ in _pairs(steps):
            # The earliest A, or the earliest A that converts; its B is the next one.
            a = F.when(valid[i] if mode == "optimal" else _step(s), us)
            aggregates[f"p{i}"] = F.min(a)
            aggregates[f"q{i}"] = F.min_by(F.col(f"x{i + 1}"), a)
    elif mode == "unordered_first":
        for i, s, t in _pairs(steps):
            aggregates[f"p{i}"] = F.min(_time_of(s))
            aggregates[f"q{i}"] = F.min(_time_of(t))
    else:
        # The earliest event of either kind whose next opposite event is inside the window.
        for i, s, t in _pairs(steps):
            partner = F.when(_step(s), F.col(f"x{i + 1}")).when(_step(t), F.col(f"x{i}"))
            start = F.when(partner - us <= window, us)
            aggregates[f"p{i}"] = F.min(start)
            aggregates[f"q{i}"] = F.min_by(partner, start)
    ends: dict[str, Column] = {}
    for i, _, _ in _pairs(steps):
        p, q = F.col(f"p{i}"), F.col(f"q{i}")
        inside = F.abs(q - p) <= window
        ends[f"a{i}"] = F.when(inside, F.least(p, q))
        ends[f"b{i}"] = F.when(inside, F.greatest(p, q))
    return rows, aggregates, ends


def _one_pair_per_user(rows, steps, window: int, mode: str, slices) -> DataFrame:
    rows, aggregates, ends = _pair_aggregates(rows, steps, window, mode, slices)
    per_user = rows.groupBy("user_id").agg(*[c.alias(n) for n, c in aggregates.items()])
    return _as_times(_pair_rows(per_user.withColumns(ends), steps))


def _step_rows(events: DataFrame, steps: Sequence[str], funnel_filter) -> DataFrame:
    return _history(events, funnel_filter).filter(F.col("event_name").isin(*steps))


def conversion_pairs(
    events: DataFrame,
    steps: Sequence[str],
    cfg: FunnelConfig = FunnelConfig(),
    *,
    funnel_filter: Column | None = None,
    slices="auto",
) -> DataFrame:
    """Matched events of adjacent steps, as (earlier, later) times.

    Ordered: A < B <= A + window, from the earliest A only (FIRST_ONLY) or for every A with
    its next B (re-entry).  Unordered: |A - B| <= window between the earliest A and B, or
    the pair that begins earliest among all (re-entry).
    """
    steps = check_steps(steps)
    rows = _step_rows(events, steps, funnel_filter)
    slices = resolve(rows, slices) if not (cfg.unordered and cfg.first_only) else None
    rows = cut(rows, slices)
    mode = _pair_mode(cfg)
    if mode == "every":
        return _as_times(_every_pair(rows, steps, cfg, slices))
    return _one_pair_per_user(rows, steps, cfg.window_us, mode, slices)


def _every_pair(rows: DataFrame, steps: Sequence[str], cfg: FunnelConfig, slices) -> DataFrame:
    ahead = _with_next_steps(rows, steps, slices)
    valid = _valid(steps, cfg.window_us)
    entries = F.array(
        *[
            F.struct(
                F.lit(s).alias("step"),
                F.lit(t).alias("next_step"),
                F.when(valid[i], F.col("us")).alias("a_us"),
                F.col(f"x{i + 1}").alias("b_us"),
            )
            for i, s, t in _pairs(steps)
        ]
    )
    return ahead.select("user_id", F.inline(entries)).filter(F.col("a_us").isNotNull())


def optimal_pairs(
    events: DataFrame,
    steps: Sequence[str],
    cfg: FunnelConfig = FunnelConfig(),
    *,
    funnel_filter: Column | None = None,
    slices="auto",
) -> DataFrame:
    """One pair per user: the earliest A that converts, with its next B."""
    steps = check_steps(steps)
    rows = _step_rows(events, steps, funnel_filter)
    slices = resolve(rows, slices)
    return _one_pair_per_user(cut(rows, slices), steps, cfg.window_us, "optimal", slices)


def _covered(
    events: DataFrame, steps: Sequence[str], cfg: FunnelConfig, funnel_filter, slices
) -> DataFrame:
    """History rows with, per pair index i, ``m{i}``: in how many of the user's pairs the
    row lies strictly inside, and ``converted{i}``: whether the row itself opens a pair, or,
    where a user has one pair at most, whether there is one."""
    rows = _history(events, funnel_filter)
    slices = resolve(rows, slices)
    mode = _pair_mode(cfg)
    if slices is not None:
        return _covered_sliced(rows, steps, cfg.window_us, mode, slices)
    inner = ~F.col("event_name").isin(*steps)
    us = F.col("us")
    if mode != "every":
        rows, aggregates, ends = _pair_aggregates(rows, steps, cfg.window_us, mode, None)
        return _inside_one_pair(totals(rows, aggregates).withColumns(ends), steps)
    # Re-entry: each valid A opens a pair that its next B closes.  At an inner event the
    # open pairs are the valid A events since the last B, all of which share the next B.
    rows = _with_next_steps(rows, steps, None)
    opened = {
        f"o{i}": ("sum", F.when(valid, F.lit(1)).otherwise(F.lit(0)).cast("bigint"))
        for i, valid in _valid(steps, cfg.window_us).items()
    }
    rows = running(rows, opened, side="before")
    closed = {
        f"z{i}": ("max", F.when(_step(t), F.col(f"o{i}"))) for i, _, t in _pairs(steps)
    }
    rows = running(rows, closed, side="before", ties=True)
    valid = _valid(steps, cfg.window_us)
    columns = {}
    for i, _, _ in _pairs(steps):
        open_now = F.col(f"o{i}") - F.coalesce(f"z{i}", F.lit(0))
        columns[f"m{i}"] = F.when(inner, open_now).otherwise(F.lit(0)).cast("bigint")
        columns[f"converted{i}"] = valid[i]
    return rows.withColumns(columns)


def _inside_one_pair(rows: DataFrame, steps: Sequence[str]) -> DataFrame:
    inner, us = ~F.col("event_name").isin(*steps), F.col("us")
    columns = {}
    for i, _, _ in _pairs(steps):
        a, b = F.col(f"a{i}"), F.col(f"b{i}")
        within = F.coalesce(inner & (us > a) & (us < b), F.lit(False))
        columns[f"m{i}"] = within.cast("bigint")
        columns[f"converted{i}"] = a.isNotNull() & b.isNotNull()
    return rows.withColumns(columns)


# Hot users.  Which pair a row lies in depends on rows of other slices in two ways: on what is
# next or last there, and on which A events lie inside the window of a B that is far away.  The
# second question becomes one of the first kind by an *expiry* row for each step event, one
# window after it: an A event can still convert at a B if its expiry is not over.  So one table
# of slices is enough, and rows are read twice whatever the number of steps.

_EXPIRY = "_expiry"


def _with_expiries(rows: DataFrame, steps: Sequence[str], window: int) -> DataFrame:
    step = F.col("in_funnel") & F.col("event_name").isin(*steps)
    kinds = F.when(step, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))
    late = F.col("us") + F.when(F.col(_EXPIRY), window).otherwise(0)
    return rows.withColumn(_EXPIRY, F.explode(kinds)).withColumn("us", late)


def _covered_sliced(
    rows: DataFrame, steps: Sequence[str], window: int, mode: str, slices
) -> DataFrame:
    if mode in ("every", "unordered_any"):
        rows = _with_expiries(rows, steps, window)
    else:
        rows = rows.withColumn(_EXPIRY, F.lit(False))
    rows = cut(rows, slices)
    if mode == "every":
        rows = _open_pairs(rows, steps, slices)
    elif mode == "unordered_any":
        rows = _inside_earliest_pair(rows, steps, window, slices)
    else:
        rows = _inside_one_pair(_first_pairs(rows, steps, window, mode, slices), steps)
    columns = [f"{c}{i}" for i, _, _ in _pairs(steps) for c in ("m", "converted")]
    return rows.filter(~F.col(_EXPIRY)).select("user_id", "event_name", *columns)


def _is(name: str) -> Column:
    return _step(name) & ~F.col(_EXPIRY)


def _expires(name: str) -> Column:
    return _step(name) & F.col(_EXPIRY)


def _open_pairs(rows: DataFrame, steps: Sequence[str], slices) -> DataFrame:
    """Re-entry.  A events are numbered in time.  Open at a row are those before it that are
    neither at nor before the number reached at the last B, nor expired at the next B."""
    part, pairs = local_keys(slices), _pairs(steps)
    count = {}
    for i, s, _ in pairs:
        count[f"p{i}"] = ("sum", _is(s).cast("bigint"))
        count[f"e{i}"] = ("sum", _expires(s).cast("bigint"))
    rows = local(rows, count, side="before", part=part)
    last = {f"z{i}": ("max", F.when(_is(t), F.col(f"p{i}"))) for i, _, t in pairs}
    following = {f"x{i}": ("min", F.when(_is(t), F.col(f"e{i}"))) for i, _, t in pairs}
    rows = local(rows, last, side="before", ties=True, part=part)
    rows = local(rows, following, side="after", part=part)
    sums = {f"_{n}": F.sum(value) for n, (_, value) in count.items()}
    ends = {f"_{n}": AGG[how](value) for n, (how, value) in {**last, **following}.items()}
    cells = cells_of(rows, {**sums, **ends})
    # Numbers count from the slice's start; make them count from the user's.
    cells = cells.withColumns(
        {n: F.coalesce(beyond(F.sum, F.col(n), side="before"), F.lit(0)) for n in sums}
    )
    for i, _, _ in pairs:
        reached, expired = F.col(f"_z{i}") + F.col(f"_p{i}"), F.col(f"_x{i}") + F.col(f"_e{i}")
        cells = cells.withColumns(
            {
                f"_z{i}": beyond(F.max, reached, side="before", ties=True),
                f"_x{i}": beyond(F.min, expired, side="after"),
            }
        )
    rows = with_cells(rows, cells)
    inner = ~F.col("event_name").isin(*steps)
    columns = {}
    for i, s, _ in pairs:
        p0, e0 = F.coalesce(f"_p{i}", F.lit(0)), F.coalesce(f"_e{i}", F.lit(0))
        seen = F.col(f"p{i}") + p0
        closed = F.coalesce(F.greatest(F.col(f"z{i}") + p0, F.col(f"_z{i}")), F.lit(0))
        gone = F.least(F.col(f"x{i}") + e0, F.col(f"_x{i}"))
        open_now = F.when(gone.isNotNull(), F.greatest(F.lit(0), seen - F.greatest(closed, gone)))
        columns[f"m{i}"] = F.when(inner, open_now).cast("bigint")
        columns[f"converted{i}"] = _is(s) & F.coalesce(gone <= seen, F.lit(False))
    return rows.withColumns(columns).fillna(0, [f"m{i}" for i, _, _ in pairs])


def _of_user(
    rows: DataFrame,
    own: dict[str, Column],
    cells: DataFrame,
    far: dict[str, Column],
    slices,
    others: Sequence[str] = (),
) -> DataFrame:
    """The rows with aggregates over their user: those of its one slice or, for a hot user,
    those over its slices.  Other columns of the slices come along."""
    user = Window.partitionBy("user_id")
    cells = cells.withColumns({f"_u_{n}": c.over(user) for n, c in far.items()})
    cells = cells.select(*local_keys(slices), TIED, *[f"_u_{n}" for n in far], *others)
    rows = with_cells(totals(rows, own, keys=local_keys(slices)), cells)
    return rows.withColumns({n: F.when(F.col(HOT), F.col(f"_u_{n}")).otherwise(F.col(n)) for n in far})


def _first_pairs(rows: DataFrame, steps: Sequence[str], window: int, mode: str, slices) -> DataFrame:
    """First only: the earliest A with the next B (ordered), or with the earliest B."""
    pairs = _pairs(steps)
    if mode == "first":
        nexts = {f"x{i}": ("min", _time_of(s)) for i, s in enumerate(steps) if i}
        rows = local(rows, nexts, side="after", part=local_keys(slices))
    rows, own, ends = _pair_ends(rows, steps, window, mode)
    cells = cells_of(rows, {**own, **{f"b{i}": F.min(_time_of(t)) for i, _, t in pairs}})
    far = {}
    for i, _, _ in pairs:
        p, q = F.col(f"p{i}"), F.col(f"q{i}")
        far[f"p{i}"], far[f"q{i}"] = F.min(p), F.min(q)
        if mode == "first":
            following = F.least(q, beyond(F.min, F.col(f"b{i}"), side="after"))
            cells = cells.withColumn(f"_q{i}", following)
            far[f"q{i}"] = F.min_by(f"_q{i}", p)
    return _of_user(rows, own, cells, far, slices).withColumns(ends)


def _inside_earliest_pair(rows: DataFrame, steps: Sequence[str], window: int, slices) -> DataFrame:
    """Unordered re-entry.  The earliest A with a B at most a window later is the earliest that
    some B finds unexpired; likewise with the kinds exchanged.  The pair ends with the first
    event of the other kind at or after its start."""
    part, pairs, us = local_keys(slices), _pairs(steps), F.col("us")
    expiry = {f"x{i}": ("min", F.when(_expires(s), us)) for i, s in enumerate(steps)}
    last = {f"l{i}": ("max", F.when(_is(s), us)) for i, s in enumerate(steps)}
    rows = local(rows, expiry, side="after", ties=True, part=part)
    rows = local(rows, last, side="before", ties=True, part=part)
    own, late = {}, {}
    for i, s, t in pairs:
        for name, opens, closes in ((f"p{i}", i, t), (f"q{i}", i + 1, s)):
            start = F.col(f"x{opens}") - window
            own[name] = F.min(F.when(_is(closes) & (start <= us), start))
            # Rows whose unexpired partner, if any, is that of the slice's end.
            late[f"_{name}"] = F.max(F.when(_is(closes) & F.col(f"x{opens}").isNull(), us))
    scans = {f"_{n}": AGG[how](value) for n, (how, value) in {**expiry, **last}.items()}
    cells = cells_of(rows, {**own, **late, **scans})
    cells = cells.withColumns(
        {
            **{f"_{n}": beyond(F.min, F.col(f"_{n}"), side="after", ties=True) for n in expiry},
            **{f"_{n}": beyond(F.max, F.col(f"_{n}"), side="before", ties=True) for n in last},
        }
    )
    far = {}
    for i, _, _ in pairs:
        for name, opens in ((f"p{i}", i), (f"q{i}", i + 1)):
            start = F.col(f"_x{opens}") - window
            found = F.least(F.col(name), F.when(start <= F.col(f"_{name}"), start))
            cells, far[name] = cells.withColumn(name, found), F.min(name)
    rows = _of_user(rows, own, cells, far, slices, [f"_{n}" for n in last])
    rows = rows.withColumns({n: F.greatest(F.col(n), F.col(f"_{n}")) for n in last})
    inner, columns = ~F.col("event_name").isin(*steps), {}
    for i, _, _ in pairs:
        p, q = F.col(f"p{i}"), F.col(f"q{i}")
        # Where both kinds start together the pair has no inside.
        by_a = (us > p) & ((p < q) | q.isNull()) & (F.coalesce(F.col(f"l{i + 1}") < p, F.lit(True)))
        by_b = (us > q) & ((q < p) | p.isNull()) & (F.coalesce(F.col(f"l{i}") < q, F.lit(True)))
        within = F.coalesce(inner & (F.coalesce(by_a, F.lit(False)) | F.coalesce(by_b, F.lit(False))), F.lit(False))
        columns[f"m{i}"] = within.cast("bigint")
        columns[f"converted{i}"] = p.isNotNull() | q.isNotNull()
    return rows.withColumns(columns)


def between_events(
    events: DataFrame,
    steps: Sequence[str],
    cfg: FunnelConfig = FunnelConfig(),
    *,
    include_direct: bool = True,
    top: int | None = TOP_EVENTS,
    funnel_filter: Column | None = None,
    slices="auto",
) -> DataFrame:
    """Per step pair, events strictly inside the conversion pairs, other than steps.

    An event inside several pairs of a user counts once per pair.  Converted users without
    any such event count as a direct conversion.
    """
    steps = check_steps(steps)
    rows = _covered(events, steps, cfg, funnel_filter, slices)
    counts = _between_counts(rows, steps, include_direct)
    if top is not None:
        counts = _ranked(counts, ["pair_idx"], top)
    return counts.select("step_pair", "event", "n")


def _between_counts(rows: DataFrame, steps: Sequence[str], include_direct: bool) -> DataFrame:
    pairs = _pairs(steps)
    # One row per user and event name and one per user, from one pass: a user with very many
    # names is many small groups.
    sets = [["user_id", "event_name"], ["user_id"]] if include_direct else [["user_id", "event_name"]]
    grouped = rows.groupingSets(sets, "user_id", "event_name").agg(
        F.grouping_id().alias("whole_user"),
        *[F.sum(f"m{i}").alias(f"m{i}") for i, _, _ in pairs],
        *[F.bool_or(f"converted{i}").alias(f"converted{i}") for i, _, _ in pairs],
    )
    whole, entries = F.col("whole_user") == 1, []
    for i, s, t in pairs:
        direct = F.when(F.col(f"converted{i}") & (F.col(f"m{i}") == 0), 1).otherwise(0)
        entries.append(
            F.struct(
                F.lit(i).alias("pair_idx"),
                F.lit(f"{s} → {t}").alias("step_pair"),
                F.when(whole, F.lit(DIRECT)).otherwise(F.col("event_name")).alias("event"),
                F.when(whole, direct).otherwise(F.col(f"m{i}")).cast("bigint").alias("n"),
            )
        )
    return (
        grouped.select(F.inline(F.array(*entries)))
        .filter("n > 0")
        .groupBy("pair_idx", "step_pair", "event")
        .agg(F.sum("n").alias("n"))
    )


def path_summary(
    events: DataFrame,
    steps: Sequence[str],
    cfg: FunnelConfig = FunnelConfig(),
    *,
    horizon_us: int = WEEK_US,
    include_direct: bool = True,
    top: int | None = TOP_EVENTS,
    funnel_filter: Column | None = None,
    slices="auto",
) -> DataFrame:
    """Drop-off destinations and between-step events of all adjacent step pairs."""
    slices = resolve(_history(events, funnel_filter), slices)
    shared = {"top": top, "funnel_filter": funnel_filter, "slices": slices}
    drop = dropoff_events(events, steps, cfg, horizon_us=horizon_us, **shared)
    between = between_events(events, steps, cfg, include_direct=include_direct, **shared)
    return drop.select(F.lit("dropoff").alias("kind"), F.col("step").alias("subject"), "event", "n"
    ).unionByName(
        between.select(
            F.lit("between").alias("kind"), F.col("step_pair").alias("subject"), "event", "n"
        )
    )


def path_flow(summary: DataFrame, steps: Sequence[str]) -> DataFrame:
    """Links of the path diagram: conversions, the top destinations, and the remainder.

    ``summary`` must be complete (``top=None``), so that the links of a step add up to all its
    dropped users.  Targets are whole names; ``label`` is what a diagram has room for.
    """
    names = {f"{s} → {t}": (s, t) for s, t in zip(steps, steps[1:])}
    source, target = F, F
    for name, (s, t) in names.items():
        source = source.when(F.col("subject") == name, s)
        target = target.when(F.col("subject") == name, t)
    conversions = (
        summary.filter(F.col("kind") == "between")
        .groupBy("subject")
        .agg(F.sum("n").alias("value"))
        .select(source.alias("source"), target.alias("target"), target.alias("label"),
                F.lit("conversion").alias("kind"), "value")
    )
    order = Window.partitionBy("subject").orderBy(F.col("n").desc(), F.col("event"))
    is_top = F.col("rank") <= FLOW_EVENTS
    other = F.concat(F.lit("Other destinations from "), F.col("subject"))
    kind = first_match(F.col("event"), DROPOFF_KINDS, "neutral")
    drops = (
        summary.filter(F.col("kind") == "dropoff")
        .withColumn("rank", F.row_number().over(order))
        .select(
            F.col("subject").alias("source"),
            F.when(is_top, F.col("event")).otherwise(other).alias("target"),
            F.when(is_top, destination_label("event")).otherwise(other).alias("label"),
            F.concat(F.lit("dropoff_"), F.when(is_top, kind).otherwise("other")).alias("kind"),
            "n",
        )
        .groupBy("source", "target", "label", "kind")
        .agg(F.sum("n").alias("value"))
    )
    return conversions.unionByName(drops)


def categorised_dropoffs(drop: DataFrame) -> DataFrame:
    """Destination label and category of each drop-off event."""
    return drop.withColumns(
        {"label": destination_label("event"), "category": destination_category("event")}
    )


def categorised_between(between: DataFrame) -> DataFrame:
    """Category and impact of each between-step event."""
    return between.withColumns({"category": between_category("event"), "impact": impact_level("n")})
