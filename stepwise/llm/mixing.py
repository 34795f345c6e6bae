"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

A document's size is its number of words.  Sources have weights and share the size of all
documents by them; none is used more than ``MOST`` times over, and what it cannot give, the
others share by weight.  A source whose target is ``r`` times its size gives ``floor(r)`` passes
over its documents and a part of one more.  The unit is a block, a pseudo-random part of the
source's documents.  The block that the last part ends in is cut again into blocks of its own,
and the block that it ends in there is counted off document by document.

Blocks are dealt to output shards by a tree.  Each node splits its blocks in two by a draw
without replacement, so the numbers of each source's blocks on either side are multivariate
hypergeometric; the leaves are the shards' exact quotas.  A source's blocks, in permuted order,
fill its quotas in turn, so shards draw disjoint blocks, and each shard is shuffled on its own.
All draws are orders of hashes: reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stepwise.llm.shared import saved

MOST = 3
# Blocks of a source, and again of the block that its last part ends in.
BLOCKS = 256
LEVELS = 4
WEIGHTS = (5, 2, 1)


def size_of(text: Column) -> Column:
    """Number of words; null texts have none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame) -> DataFrame:
    """source, source_size and target of sizes(source, source_size).

    Sources in the order of their code points, null last, weigh 5, 2, 1 in turn.  Below their
    limits, targets are weights times one level, found where the limits, in the order in which
    they are reached, leave enough for the rest.  The table has a row for each source, which
    bounds its windows.
    """
    listed = Window.orderBy(F.col("source").asc_nulls_last())
    everything = Window.partitionBy(F.lit(0))
    reached = Window.orderBy("level", F.col("source").asc_nulls_last())
    before = reached.rowsBetween(Window.unboundedPreceding, -1)
    weights = F.array(*[F.lit(float(w)) for w in WEIGHTS])
    nth = (F.row_number().over(listed) - 1) % len(WEIGHTS) + 1
    rows = (
        sizes.withColumn("weight", F.element_at(weights, nth))
        .withColumn("limit", F.col("source_size") * F.lit(float(MOST)))
        .withColumn("level", F.col("limit") / F.col("weight"))
        .withColumn("total", F.sum("source_size").over(everything))
        .withColumn("weights", F.sum("weight").over(everything))
        .withColumn("given", F.coalesce(F.sum("limit").over(before), F.lit(0.0)))
        .withColumn("past", F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        # The level if this source and all later ones stay below their limits.
        .withColumn("own", (F.col("total") - F.col("given")) / (F.col("weights") - F.col("past")))
        .withColumn("nth", F.row_number().over(reached))
        .withColumn(
            "first",
            F.min(F.when(F.col("own") <= F.col("level"), F.struct("nth", "own"))).over(everything),
        )
    )
    target = F.least("limit", F.coalesce(F.col("first.own") * F.col("weight"), F.col("limit")))
    return rows.select("source", "source_size", target.alias("target"))


def _part(salt: str) -> Column:
    return F.pmod(F.xxhash64(F.lit(salt), "doc_id"), F.lit(BLOCKS)).cast("int")


def _same(a: str, b: str, *columns: str) -> Column:
    """Equal columns of two aliases, null equal to null."""
    on = F.lit(True)
    for c in columns:
        on = on & F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}"))
    return on


def _fill(parts: DataFrame, key: str) -> DataFrame:
    """parts(source, key, words, room) in permuted order: ``whole`` while they fit into the room,
    then one ``cut``, then ``none``.  A source has at most ``BLOCKS`` parts."""
    order = Window.partitionBy("source").orderBy(F.xxhash64(F.lit(key), key), key)
    before = F.sum("words").over(order.rowsBetween(Window.unboundedPreceding, -1))
    state = (
        F.when(F.col("before") + F.col("words") <= F.col("room"), "whole")
        .when(F.col("before") < F.col("room"), "cut")
        .otherwise("none")
    )
    parts = parts.withColumn("before", F.coalesce(before, F.lit(0)))
    return parts.withColumn("state", state)


def deal(units: DataFrame, levels: int = LEVELS) -> DataFrame:
    """units(source, ...) with the shard of each, of 2 ** levels shards.

    The tree works on the numbers of blocks that sources have: a row stands for one of a source's
    blocks, no matter which, and a node keeps half of its rows by the order of their hashes.
    """
    permuted = Window.partitionBy("source").orderBy(F.xxhash64("block", "pass"), "block", "pass")
    numbered = saved(units.withColumn("n", F.row_number().over(permuted)))
    tree = numbered.select("source", "n").withColumn("node", F.lit(0))
    for level in range(levels):
        order = Window.partitionBy("node").orderBy(
            F.xxhash64(F.lit(level), "source", "n"), F.col("source").asc_nulls_last(), "n"
        )
        left = F.row_number().over(order) * 2 <= F.count("*").over(Window.partitionBy("node"))
        tree = tree.withColumn("_left", left)
        tree = tree.withColumn("node", F.col("node") * 2 + F.when(F.col("_left"), 0).otherwise(1)).drop("_left")
    quotas = tree.groupBy("source", "node").agg(F.count("*").alias("quota"))
    earlier = Window.partitionBy("source").orderBy("node").rowsBetween(Window.unboundedPreceding, -1)
    slots = quotas.withColumn("first", F.coalesce(F.sum("quota").over(earlier), F.lit(0)) + 1).select(
        "source",
        F.col("node").alias("shard"),
        F.explode(F.sequence("first", F.col("first") + F.col("quota") - 1)).alias("n"),
    )
    return (
        numbered.alias("a")
        .join(slots.alias("b"), _same("a", "b", "source") & (F.col("a.n") == F.col("b.n")))
        .select("a.*", "b.shard")
    )


def mix(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies and shards of every row of
    docs(doc_id, text, source).

    shards has the output shard of each copy; there are at most ``MOST`` copies, and taken is size
    times copies.  A source's taken words differ from its target by less than one document's.
    Rows that repeat a doc_id share their block and hence their shards, save where documents are
    counted off one by one; a null doc_id is an id like any other, and a null source is a source.
    Wordless documents come with their block.  The columns in ``keep`` come along, so that each row
    has its own copies; other columns are ignored.  An empty table gives no rows.
    """
    kept = [F.col(c).alias(f"kept_{c}") for c in keep]
    # Tells rows that repeat a doc_id apart where they are counted off, as they are told apart by keep.
    mark = F.xxhash64("text") if keep else F.lit(0)
    rows = saved(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            "source",
            size_of(F.col("text")).alias("size"),
            mark.alias("mark"),
            *kept,
        )
        .withColumn("block", _part("block"))
        .withColumn("inner", _part("inner"))
    )
    words = saved(rows.groupBy("source", "block").agg(F.sum("size").alias("words")))
    goals = targets(words.groupBy("source").agg(F.sum("words").alias("source_size")))
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    goals = saved(
        goals.withColumn("passes", passes.cast("int")).withColumn(
            "room", F.col("target") - F.col("passes") * F.col("source_size")
        )
    )
    outer = words.alias("w").join(goals.alias("g"), _same("w", "g", "source"))
    outer = saved(
        _fill(
            outer.select("w.*", "g.source_size", "g.target", "g.passes", "g.room"),
            "block",
        )
    )
    passes_of_block = F.col("passes") + F.when(F.col("state") == "none", 0).otherwise(1)
    units = outer.where(passes_of_block > 0).select(
        "source",
        "block",
        "passes",
        "state",
        F.explode(F.sequence(F.lit(1), passes_of_block)).alias("pass"),
    )
    partial = (F.col("state") == "cut") & (F.col("pass") > F.col("passes"))
    dealt = (
        deal(units)
        .groupBy("source", "block")
        .agg(
            F.sort_array(F.collect_list(F.when(~partial, F.col("shard")))).alias("shards"),
            F.max(F.when(partial, F.col("shard"))).alias("partial"),
        )
    )
    plan = saved(
        outer.alias("o")
        .join(dealt.alias("d"), _same("o", "d", "source", "block"), "left")
        .select(
            "o.source",
            "o.block",
            "o.source_size",
            "o.target",
            F.when(F.col("o.state") == "cut", F.col("o.room") - F.col("o.before")).alias("room"),
            F.coalesce("d.shards", F.array().cast("array<int>")).alias("shards"),
            "d.partial",
        )
    )
    placed = rows.alias("r").join(plan.alias("p"), _same("r", "p", "source", "block")).select(
        "r.*", "p.source_size", "p.target", "p.shards", "p.partial", "p.room"
    )
    in_cut = placed.where("room is not null")
    inner = saved(
        _fill(
            in_cut.groupBy("source", "inner").agg(F.sum("size").alias("words"), F.first("room").alias("room")),
            "inner",
        )
    )
    counted = (
        in_cut.drop("room")
        .alias("r")
        .join(inner.alias("i"), _same("r", "i", "source", "inner"))
        .select("r.*", "i.state", (F.col("i.room") - F.col("i.before")).alias("left"))
    )
    order = Window.partitionBy("source").orderBy(F.xxhash64(F.lit("document"), "doc_id"), "doc_id", "size", "mark")
    before = F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1))
    one_by_one = counted.where("state = 'cut'").withColumn(
        "more", F.coalesce(before, F.lit(0)) + F.col("size") / 2 <= F.col("left")
    )
    parts = [
        placed.where("room is null").withColumn("more", F.lit(False)),
        counted.where("state <> 'cut'").withColumn("more", F.col("state") == "whole"),
        one_by_one,
    ]
    out = None
    for part in parts:
        shards = F.when(F.col("more"), F.array_append("shards", F.col("partial"))).otherwise(F.col("shards"))
        part = part.select(
            "doc_id", "size", "source_size", "target", shards.alias("shards"), *[f"kept_{c}" for c in keep]
        )
        out = part if out is None else out.union(part)
    return out.withColumn("copies", F.size("shards")).select(
        "doc_id",
        "size",
        "source_size",
        "target",
        (F.col("size") * F.col("copies")).alias("taken"),
        "copies",
        "shards",
        *[F.col(f"kept_{c}").alias(c) for c in keep],
    )


def shards(docs: DataFrame, mixed: DataFrame) -> DataFrame:
    """The mix itself: the rows of docs as often as they are taken, with their shard, each shard
    in random order in one partition.  docs must not repeat a doc_id."""
    copies = mixed.select("doc_id", F.posexplode("shards").alias("copy", "shard"))
    return (
        docs.join(copies, "doc_id")
        .repartition(1 << LEVELS, "shard")
        .sortWithinPartitions("shard", F.xxhash64(F.lit("order"), "doc_id", "copy"))
    )
