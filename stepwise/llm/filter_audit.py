"""Audit of filters in every order: which filter removes a document depends on those before it.

Each document gets a mask of the filters that it fails.  Five of them need only its own text; the
last one, duplicates, needs all texts, and most texts must not move for it:

1. *Prepass.*  Every text is hashed, and a counting Bloom filter counts the hashes: tasks count
   their own cells, and the partial sketches are merged by adding.  A text with a cell counted
   once is certainly unique and cleared.  What remains of the sketch, one bit for each cell
   counted twice or more, has a fixed size and goes to all tasks.
2. *Exact stage.*  Only texts that all their cells call possible repeats are shuffled, each once
   for a task that holds copies of it, to find the smallest id of every text.  Documents then
   find out by their id and the text's SHA-256 whether theirs is the smallest; the ids that pass
   are spread evenly, however many copies one text has.

Masks are counted by part and label.  Everything asked of any order of the filters is a sum of
these counts over masks, so the orders only meet a table of at most 32 rows for each part.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepwise.llm.shared import saved

# The filters, in the order of their bits.
FILTERS = "ABCDE"
FEW_WORDS, DISTINCT_SHARE, CAPITAL_SHARE = 50, 65, 5
DUPLICATE = FILTERS.index("E")
# Cells of the sketch for each document, and at most: bits that go to every task are an eighth.
CELLS_PER_ROW, MOST_CELLS = 16, 1 << 27
_HASHES = 2
_BITMAP = 1 << 15


def text_mask(text: Column) -> Column:
    """Bits of the filters that look at one text alone; text is not null."""
    words = F.regexp_extract_all(text, F.lit("([^\\x20\\x09-\\x0D]+)"), 1)
    few = F.size(words) < FEW_WORDS
    same = 100 * F.size(F.array_distinct(words)) < DISTINCT_SHARE * F.size(words)
    loud = 100 * F.length(F.regexp_replace(text, "[^A-Z]+", "")) > CAPITAL_SHARE * F.length(text)
    signs = text.rlike("[#$%&*|]")
    return sum((f.cast("int") * (1 << i) for i, f in enumerate((few, same, loud, signs))), F.lit(0))


def _cells(text: Column, cells: int) -> list[Column]:
    """The text's cells in a sketch of so many, a power of two: halves of one 64-bit hash."""
    code = F.xxhash64(text)
    return [F.shiftrightunsigned(code, 32 * i).bitwiseAND(F.lit(cells - 1)) for i in range(_HASHES)]


def repeated_cells(texts: DataFrame, cells: int) -> DataFrame:
    """The merged sketch of texts(text), reduced to the cells counted twice or more: bitmaps of
    32,768 cells with their number, so at most cells / 32,768 rows of 4 KB."""
    counters = texts.select(F.explode(F.array(*_cells(F.col("text"), cells))).alias("cell")).groupBy("cell").count()
    place = F.col("cell")
    return (
        counters.where("count > 1")
        .groupBy(F.floor(place / _BITMAP).alias("bitmap"))
        .agg(F.bitmap_construct_agg(place % _BITMAP).alias("bits"))
    )


def _possible_repeats(rows: DataFrame, sketch: DataFrame, cells: int) -> DataFrame:
    """The rows with ``possible``: whether all cells of their text were counted twice or more."""
    possible = F.lit(True)
    for i, cell in enumerate(_cells(F.col("text"), cells)):
        rows = rows.withColumn(f"_cell{i}", cell)
        named = sketch.select(F.col("bitmap").alias(f"_bitmap{i}"), F.col("bits").alias(f"_bits{i}"))
        rows = rows.join(F.broadcast(named), F.floor(F.col(f"_cell{i}") / _BITMAP) == F.col(f"_bitmap{i}"), "left")
        place = F.col(f"_cell{i}") % _BITMAP
        byte = F.conv(F.hex(F.substring(F.col(f"_bits{i}"), (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10)
        bit = F.floor(byte.cast("int") / F.pow(F.lit(2), place % 8)) % 2
        possible = possible & F.coalesce(bit == 1, F.lit(False))
    return rows.withColumn("possible", possible)


def sketch_cells(rows: int) -> int:
    """Cells for so many documents: a power of two between one bitmap and ``MOST_CELLS``."""
    return min(MOST_CELLS, max(_BITMAP, 1 << (CELLS_PER_ROW * max(rows, 1) - 1).bit_length()))


def masks(docs: DataFrame, cells: int | None = None) -> DataFrame:
    """doc_id, part, mask and n: how many rows of docs(doc_id, text, source) have these three.

    part is the source, null as an empty string.  mask has bit i for a document that fails filter
    i: (A) under 50 words; (B) distinct words under 65 % of the words; (C) capitals A-Z above 5 %
    of the characters; (D) one of ``#$%&*|``; (E) a text that some smaller doc_id has too.
    A null text is empty.  Rows without doc_id count, but never as a smaller or larger id.  A
    document repeated under one id fails E in no row for that.  The sketch has ``cells`` cells;
    a small or full one only lets more texts move.
    """
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce("source", F.lit("")).alias("part"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    if cells is None:
        cells = sketch_cells(docs.count())
    named = rows.where("doc_id is not null")
    sketch = saved(repeated_cells(named, cells))
    seen = saved(
        _possible_repeats(rows, sketch, cells).select(
            "doc_id",
            "part",
            text_mask(F.col("text")).alias("mask"),
            F.when(F.col("possible") & F.col("doc_id").isNotNull(), F.sha2("text", 256)).alias("digest"),
        )
    )
    moved = _possible_repeats(named, sketch, cells).where("possible")
    least = moved.groupBy("text").agg(F.min("doc_id").alias("doc_id")).select("doc_id", F.sha2("text", 256).alias("digest"))
    counted = seen.groupBy("doc_id", "part", "mask", "digest").agg(F.count("*").alias("n"))
    first = least.withColumn("first", F.lit(True))
    copy = F.col("digest").isNotNull() & F.col("first").isNull()
    return counted.join(first, ["doc_id", "digest"], "left").select(
        "doc_id", "part", (F.col("mask") + copy.cast("int") * (1 << DUPLICATE)).alias("mask"), "n"
    )


def mask_counts(masked: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, n, good and toxic: documents with this mask, those of them with a label
    quality = 1, and those with a label toxic = 1 in labels(doc_id, quality, toxic).

    Null labels are none; of several rows for one id each label counts if any row has it.
    """
    told = (
        labels.where("doc_id is not null and (quality = 1 or toxic = 1)")
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    )
    n = F.col("n")
    # Rows without an id are one group by now, whatever their number.
    return (
        masked.join(told, "doc_id", "left")
        .groupBy("part", "mask")
        .agg(
            F.sum(n).alias("n"),
            F.sum(n * F.coalesce("good", F.lit(0))).alias("good"),
            F.sum(n * F.coalesce("toxic", F.lit(0))).alias("toxic"),
        )
    )


def _effects(spark) -> DataFrame:
    """For each mask, each filter and each set of filters before it: whether such a document is
    kept, removed here, or failing here and removed before, whether it fails only here, and in
    how many of all orders this filter removes it."""
    count = len(FILTERS)
    rows = []
    for mask in range(1 << count):
        for f in range(count):
            fails = mask >> f & 1
            share = factorial(count) // mask.bit_count() if fails else 0
            for before in range(1 << count):
                if not before >> f & 1:
                    gone = bool(mask & before)
                    rows.append(
                        (mask, f, before, int(not gone and not fails), int(not gone and fails), int(gone and fails),
                         int(mask == 1 << f), share)
                    )
    names = "mask int, filter int, before int, kept int, removed int, redundant int, unique int, share int"
    return spark.createDataFrame(rows, names)


def _steps(spark) -> DataFrame:
    """Every step of every order, with its filter and the set of filters before it."""
    rows = []
    for order in permutations(range(len(FILTERS))):
        before = 0
        for step, f in enumerate(order, 1):
            rows.append(("".join(FILTERS[i] for i in order), step, f, before))
            before |= 1 << f
    return spark.createDataFrame(rows, "filter_order string, step int, filter int, before int")


def audit(docs: DataFrame, labels: DataFrame, cells: int | None = None) -> DataFrame:
    """One row per part, order of the filters and step (from 1) of docs(doc_id, text, source) and
    labels(doc_id, quality, toxic): kept, removed, redundant, unique_fails, good_lost, toxic_lost
    and shapley, the removals by the step's filter summed over all orders.

    Zeros included; an empty table has no parts and gives no rows.  See ``masks`` and
    ``mask_counts`` for nulls and repeats.  Further columns are ignored.
    """
    spark = docs.sparkSession
    counts = saved(mask_counts(masks(docs, cells), labels))

    def total(effect: str, of: str, name: str) -> Column:
        return F.sum(F.col(effect) * F.col(of)).alias(name)

    by_set = (
        counts.join(F.broadcast(_effects(spark)), "mask")
        .groupBy("part", "filter", "before")
        .agg(
            total("kept", "n", "kept"),
            total("removed", "n", "removed"),
            total("redundant", "n", "redundant"),
            total("unique", "n", "unique_fails"),
            total("removed", "good", "good_lost"),
            total("removed", "toxic", "toxic_lost"),
            total("share", "n", "shapley"),
        )
    )
    return by_set.join(F.broadcast(_steps(spark)), ["filter", "before"]).select(
        "part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"
    )
