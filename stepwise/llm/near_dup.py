"""Near-duplicate documents by bottom-k sketches of their word shingles.

A document's set holds the distinct shingles of five lower-cased words; two documents are
linked when the Jaccard similarity of their full sets is at least 0.75.  One hash function
orders all shingles, and a document retains the smallest ``K`` of them.  Inverted lists of the
retained values generate the overlaps of documents:

* Documents with equal sets are one *class*; only its smallest doc_id takes part below.
* A list of at most ``HEAVY`` classes yields the pairs of its classes.  Pairs with too small an
  overlap go, an estimate from the sketch of the union filters the rest, and the full sets
  decide.  A pair at 0.75 whose sets are mostly light misses this path with a probability below
  1e-6, as each of some forty values at least is shared with a chance above one half.
* A longer list yields no pairs.  Classes whose sketches consist mostly of such values (large
  groups of near copies, texts around a well-known passage) are compared on full sets with the
  list's *pivot*, its most typical class.  Two classes linked to the pivot are in its component.
  If A is not linked to the pivot P, then A and B can only be linked when the differences of A
  and of B from P share at least ``(x + y - min(|A|, |B|) / 3) / 2`` shingles, x and y being
  the sizes of the differences.  A prefix filter on the differences, rarest first, finds
  exactly those pairs.  Of them only those count whose classes the links with pivots do not
  join already, as far as two steps show, so members of one root never meet; and the parities of
  the differences by hash, ``PARITIES`` bits that two classes differ in at most as often as
  their sets do, drop pairs that are too far apart.  Neither filter loses a component.

Components of the links give each document the smallest doc_id it reaches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stepwise.llm.components import components
from stepwise.llm.shared import lean, saved
from stepwise.llm.textscan import mix, seeds, text_bytes, word_hashes

WORDS = 5
NUMERATOR, DENOMINATOR = 75, 100
K = 64
HEAVY = 24
SALTS = 16
# Size of the bitmap of documents whose full sets are needed: 2 MB of bits.
BITS = 1 << 24
# Smallest share of light values for which the light path alone is enough.
LIGHT_SHARE = 0.6
# Smallest overlap of two sketches, as a share of the light values of the poorer one.
OVERLAP_SHARE = 0.1
# Bits of the parities of a difference, a multiple of 64.
PARITIES = 512
# Values of a difference before one in its prefix, by which two classes know that they met.
BEFORE = 8
# Six standard deviations of the estimate from K values.
ESTIMATE = NUMERATOR / DENOMINATOR - 6 * (0.75 * 0.25 / K) ** 0.5
_STEPS = seeds(WORDS, 1000)


def shingle_sets(texts: pa.Array) -> list[np.ndarray]:
    """Sorted hashes of each text's distinct shingles; null and wordless texts have none."""
    words, owners = word_hashes(*text_bytes(texts))
    counts = np.bincount(owners, minlength=len(texts))
    ends = np.cumsum(counts)
    shingles = np.zeros(len(words), np.uint64)
    full = max(len(words) - WORDS + 1, 0)
    for j, step in enumerate(_STEPS):
        shingles[:full] += words[j : j + full] * step
    shingles = mix(shingles).view(np.int64)
    sets = []
    for count, end in zip(counts.tolist(), ends.tolist(), strict=True):
        start = end - count
        if count >= WORDS:
            sets.append(np.unique(shingles[start : end - WORDS + 1]))
        elif count:
            whole = (words[start:end] * _STEPS[:count]).sum(dtype=np.uint64, keepdims=True)
            sets.append(mix(whole + np.uint64(count)).view(np.int64))
        else:
            sets.append(shingles[:0])
    return sets


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.zeros(len(arrays) + 1, np.int32)
    np.cumsum([len(a) for a in arrays], out=offsets[1:])
    flat = np.concatenate(arrays) if arrays else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))


_SKETCH = "doc_id long, n int, sum long, xor long, sketch array<long>"


@lean
def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 1000):
            part = batch.slice(at, 1000)
            sets = shingle_sets(part.column("text"))
            spread = [mix(s.view(np.uint64) + np.uint64(7)) for s in sets]
            total = [s.sum(dtype=np.uint64) for s in spread]
            parity = [np.bitwise_xor.reduce(s) if len(s) else np.uint64(0) for s in spread]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"),
                    pa.array([len(s) for s in sets], pa.int32()),
                    pa.array(np.array(total, np.uint64).view(np.int64)),
                    pa.array(np.array(parity, np.uint64).view(np.int64)),
                    _lists([s[:K] for s in sets]),
                ],
                ["doc_id", "n", "sum", "xor", "sketch"],
            )


def sketches(docs: DataFrame) -> DataFrame:
    """One row per row of docs: set size, 128-bit set fingerprint, and the bottom-K values."""
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_sketches, _SKETCH)


@lean
def _full_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 1000):
            part = batch.slice(at, 1000)
            sets = [s.tobytes() for s in shingle_sets(part.column("text"))]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(sets, pa.binary())], ["doc_id", "set"]
            )


def _linked(shared: Column, n_a: Column, n_b: Column) -> Column:
    return shared * DENOMINATOR >= (n_a + n_b - shared) * NUMERATOR


def _values(raw: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), np.int64) for x in raw]


def _shared_size(a: np.ndarray, b: np.ndarray) -> int:
    """Values in both of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = len(b) - 1
    return int(np.count_nonzero(b[at] == a))


@lean
def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        left, right = _values(batch.column("set_a")), _values(batch.column("set_b"))
        shared = [_shared_size(x, y) for x, y in zip(left, right, strict=True)]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("a"),
                batch.column("b"),
                pa.array([len(x) for x in left], pa.int64()),
                pa.array([len(x) for x in right], pa.int64()),
                pa.array(shared, pa.int64()),
            ],
            ["a", "b", "n_a", "n_b", "shared"],
        )


def _parities(sets: list[np.ndarray]) -> pa.Array:
    """``PARITIES`` bits of each set, as longs: whether an odd number of its values have a hash.

    The exclusive or of two rows has the bits of the values in one set only, so it has at most
    as many ones as there are such values.
    """
    rows = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    values = np.concatenate([*sets, np.zeros(0, np.int64)]).view(np.uint64)
    place = (mix(values + np.uint64(11)) % np.uint64(PARITIES)).astype(np.int64)
    odd = np.bincount(rows * PARITIES + place, minlength=len(sets) * PARITIES) & 1
    words = np.packbits(odd.astype(np.uint8).reshape(len(sets), PARITIES), axis=1).view(np.int64)
    return _lists(list(words))


@lean
def _differences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            part = batch.slice(at, 500)
            left, right = _values(part.column("set_a")), _values(part.column("set_b"))
            apart = [np.setxor1d(x, y, assume_unique=True) for x, y in zip(left, right, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("a"),
                    part.column("b"),
                    pa.array([len(x) for x in left], pa.int64()),
                    pa.array([len(x) for x in right], pa.int64()),
                    _lists(apart),
                    _parities(apart),
                ],
                ["a", "b", "n_a", "n_b", "apart", "parities"],
            )


def _with_sets(pairs: DataFrame, sets: DataFrame, salts: int = 1) -> DataFrame:
    """pairs(a, b) with both full sets.  Where few b are in very many pairs, their sets are
    dealt over salts."""
    right = sets.select(F.col("doc_id").alias("b"), F.col("set").alias("set_b"))
    left, key = pairs, ["b"]
    if salts > 1:
        chosen = pairs.select("b").distinct()
        right = right.join(chosen, "b", "left_semi").withColumn(
            "salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))
        )
        left = left.withColumn("salt", F.pmod(F.xxhash64("a"), F.lit(salts)).cast("int"))
        key = ["b", "salt"]
    return (
        left.join(right, key)
        .join(sets.select(F.col("doc_id").alias("a"), F.col("set").alias("set_a")), "a")
        .select("a", "b", "set_a", "set_b")
    )


def _bitmap(ids: DataFrame) -> np.ndarray:
    """Bits of the hashes of ids, of one size whatever their number."""
    place = F.pmod(F.xxhash64("doc_id"), F.lit(BITS))
    words = (
        ids.select(place.alias("place"))
        .groupBy(F.shiftright("place", 5).alias("word"))
        .agg(F.expr("bit_or(shiftleft(1L, cast(place % 32 as int)))").alias("bits"))
        .toArrow()
    )
    bits = np.zeros(BITS // 32, np.int64)
    bits[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    return bits


def _sets_of(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """Full sets of the documents of pairs.  Most other texts are left out by a bitmap before
    any text moves; the join with the ids settles the rest."""
    ids = saved(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct())
    shared = docs.sparkSession.sparkContext.broadcast(_bitmap(ids))

    def likely(batches):
        for batch in batches:
            place = batch.column("place").to_numpy()
            chosen = (shared.value[place >> 5] >> (place & 31)) & 1
            yield batch.drop_columns(["place"]).filter(pa.array(chosen > 0))

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(
        "doc_id is not null"
    )
    marked = texts.withColumn("place", F.pmod(F.xxhash64("doc_id"), F.lit(BITS)))
    chosen = marked.mapInArrow(likely, texts.schema).join(ids, "doc_id", "left_semi")
    return chosen.mapInArrow(_full_sets, "doc_id long, set binary")


def _light_pairs(postings: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs of classes that share enough light values and whose union sketch agrees."""
    light = postings.where(F.col("lists") <= HEAVY).select("v", "id", "n", "light")
    a, b = light.alias("a"), light.alias("b")
    pairs = (
        a.join(b, F.col("a.v") == F.col("b.v"))
        .where("a.id < b.id")
        .where(F.col("a.n") * DENOMINATOR >= F.col("b.n") * NUMERATOR)
        .where(F.col("b.n") * DENOMINATOR >= F.col("a.n") * NUMERATOR)
        .groupBy(F.col("a.id").alias("a"), F.col("b.id").alias("b"))
        .agg(
            F.count("*").alias("overlap"),
            F.first(F.least("a.light", "b.light")).alias("light"),
        )
        .where(F.col("overlap") >= F.ceil(F.col("light") * OVERLAP_SHARE))
        .select("a", "b")
    )
    sketch = classes.select(F.col("id"), "sketch")
    both = pairs.join(sketch.select(F.col("id").alias("a"), F.col("sketch").alias("s")), "a").join(
        sketch.select(F.col("id").alias("b"), F.col("sketch").alias("t")), "b"
    )
    union = F.slice(F.array_sort(F.array_union("s", "t")), 1, K)
    in_both = F.size(F.array_intersect(F.array_intersect(union, "s"), "t"))
    return both.where(in_both >= F.size(union) * F.lit(ESTIMATE)).select("a", "b")


def _pivot_pairs(postings: DataFrame) -> DataFrame:
    """(a, b): classes of mostly heavy sketches, and the pivots of their heavy lists."""
    heavy = postings.where(F.col("lists") > HEAVY).where(
        F.col("light") < F.col("retained") * LIGHT_SHARE
    )
    pivots = heavy.groupBy("v").agg(
        F.max(F.struct("typical", (-F.col("id")).alias("negative"))).alias("best")
    )
    return (
        heavy.join(pivots, "v")
        .select(F.col("id").alias("a"), (-F.col("best.negative")).alias("b"))
        .where("a <> b")
        .distinct()
    )


def _reached(compared: DataFrame) -> DataFrame:
    """(node, root): the smallest pivot that two steps over links with pivots reach.

    Classes of one root are in one component; a component may have several roots.
    """
    pivots = compared.select(F.col("b").alias("a"), "b").distinct()
    reached = compared.where("linked").select("a", "b").union(pivots)
    once = saved(reached.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root")))
    again = once.select(F.col("node").alias("root"), F.col("root").alias("next"))
    return once.join(again, "root").select("node", F.col("next").alias("root"))


def _pairs_beside_pivots(compared: DataFrame) -> DataFrame:
    """Pairs (a, b) of one pivot, a not known to be in its component nor in that of b, whose
    differences can make a link."""
    return _meetings(compared).distinct()


def _meetings(compared: DataFrame) -> DataFrame:
    """Those pairs, each where it meets in the prefixes: at its first common value, and later only
    where none of the ``BEFORE`` values before is common."""
    roots = saved(_reached(compared))
    of_member = roots.select(F.col("node").alias("a"), F.col("root").alias("root_a"))
    of_pivot = roots.select(F.col("node").alias("b"), F.col("root").alias("root_b"))
    compared = (
        compared.join(of_member, "a", "left")
        .join(of_pivot.join(compared.select("b").distinct(), "b", "left_semi"), "b", "left")
        .withColumn("root", F.coalesce("root_a", "a"))
        .withColumn("inside", F.col("root") == F.coalesce("root_b", "b"))
    )
    pivot = compared.select(F.col("b").alias("pivot"), F.col("n_b").alias("n")).distinct()
    members = compared.select(
        F.col("b").alias("pivot"),
        F.col("a").alias("id"),
        F.col("n_a").alias("n"),
        F.size("apart").alias("x"),
        "root",
        "inside",
        "parities",
        F.explode("apart").alias("e"),
    )
    members = members.join(pivot.select("pivot"), "pivot", "left_semi")
    spread = members.groupBy("pivot", "e").agg(F.count("*").alias("holders"))
    order = Window.partitionBy("pivot", "id").orderBy("holders", "e")
    placed = (
        members.join(spread, ["pivot", "e"])
        .where("holders > 1")
        .withColumn("rest", F.count("*").over(Window.partitionBy("pivot", "id")))
        # Values that nobody shares come first, so places count from behind them.
        .withColumn("place", F.row_number().over(order) + F.col("x") - F.col("rest"))
        # The order is that of the list, so what is before in two differences is so in both.
        .withColumn("before", F.collect_list("e").over(order.rowsBetween(-BEFORE, -1)))
        # The least a partner asks for, whatever its size.
        .where(F.col("place") <= F.col("x") - F.greatest(F.lit(1), F.ceil((F.col("x") - F.col("n") / 3) / 2)) + 1)
        .select("pivot", "e", "id", "n", "x", "root", "inside", "parities", "place", "before")
    )
    a, b = placed.where("not inside").alias("a"), placed.alias("b")
    # The sets of a link differ in so many values at most.
    differing = sum(
        F.bit_count(F.col("a.parities")[i].bitwiseXOR(F.col("b.parities")[i])) for i in range(PARITIES // 64)
    )
    need = F.greatest(
        F.lit(1),
        F.ceil((F.col("a.x") + F.col("b.x") - F.least("a.n", "b.n") / 3) / 2),
    )
    return (
        a.join(b, (F.col("a.pivot") == F.col("b.pivot")) & (F.col("a.e") == F.col("b.e")))
        .where("a.root <> b.root and (b.inside or a.id < b.id)")
        .where(F.col("a.n") * DENOMINATOR >= F.col("b.n") * NUMERATOR)
        .where(F.col("b.n") * DENOMINATOR >= F.col("a.n") * NUMERATOR)
        .where(F.col("a.place") <= F.col("a.x") - need + 1)
        .where(F.col("b.place") <= F.col("b.x") - need + 1)
        .where(differing * (DENOMINATOR + NUMERATOR) <= (F.col("a.n") + F.col("b.n")) * (DENOMINATOR - NUMERATOR))
        .where(~F.arrays_overlap("a.before", "b.before"))
        .select(F.col("a.id").alias("a"), F.col("b.id").alias("b"))
    )


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of docs(doc_id, text).

    component_id is the smallest doc_id that links reach, kept whether it is the row's own.
    Null, empty and wordless texts have no shingles and stand alone; texts of fewer than five
    words have their whole sequence as one shingle.  Rows that repeat a doc_id are one document
    to the links: they share a component.  A row without a doc_id is linked with nothing, has no
    component and is not kept.  Other columns are ignored; an empty table gives no rows.
    """
    rows = saved(sketches(docs))
    links = saved(_links(docs, rows))
    roots = components(links)
    return (
        rows.select("doc_id", F.col("n").cast("long").alias("n_shingles"))
        .join(roots.withColumnRenamed("node", "doc_id"), "doc_id", "left")
        .withColumn("component_id", F.coalesce("root", "doc_id"))
        .select(
            "doc_id",
            "n_shingles",
            "component_id",
            F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"),
        )
    )


def _links(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """links(a, b): every document with its class, and the verified links of classes."""
    with_words = rows.where("n > 0 and doc_id is not null")
    key = ["n", "sum", "xor"]
    smallest = saved(with_words.groupBy(*key).agg(F.min("doc_id").alias("id")))
    copies = with_words.select("doc_id", *key).join(smallest, key).where("doc_id <> id")
    classes = saved(
        with_words.join(
            smallest.select(*key, F.col("id").alias("doc_id")), [*key, "doc_id"], "left_semi"
        )
        .dropDuplicates(["doc_id", *key])
        .select(F.col("doc_id").alias("id"), "n", "sketch")
    )
    values = classes.select("id", F.explode("sketch").alias("v"))
    lists = values.groupBy("v").agg(F.count("*").alias("lists")).where("lists > 1")
    held = values.join(lists, "v").join(
        classes.select("id", "n", F.size("sketch").alias("retained")), "id"
    )
    light = F.col("retained") - F.count(F.when(F.col("lists") > HEAVY, 1)).over(_of_class())
    typical = F.sum(F.when(F.col("lists") > HEAVY, F.log("lists")).otherwise(0.0)).over(_of_class())
    postings = saved(
        held.withColumn("light", light).withColumn("typical", typical / F.col("retained"))
    )
    near = saved(_light_pairs(postings, classes))
    pivots = saved(_pivot_pairs(postings))
    sets = saved(_sets_of(docs, near.union(pivots)))
    schema = "a long, b long, n_a long, n_b long, shared long"
    good = _linked(F.col("shared"), F.col("n_a"), F.col("n_b"))
    light = _with_sets(near, sets).mapInArrow(_compare, schema).where(good).select("a", "b")
    apart = _with_sets(pivots, sets, SALTS).mapInArrow(
        _differences, "a long, b long, n_a long, n_b long, apart array<long>, parities array<long>"
    )
    shared = (F.col("n_a") + F.col("n_b") - F.size("apart")) / 2
    compared = saved(apart.withColumn("linked", _linked(shared, F.col("n_a"), F.col("n_b"))))
    beside = saved(_pairs_beside_pivots(compared))
    found = _with_sets(beside, sets).mapInArrow(_compare, schema).where(good).select("a", "b")
    return (
        copies.select(F.col("doc_id").alias("a"), F.col("id").alias("b"))
        .union(compared.where("linked").select("a", "b"))
        .union(light)
        .union(found)
    )


def _of_class():
    """A class has at most K rows here."""
    return Window.partitionBy("id")
