"""Document fingerprints by Order MinHash, in SQL functions only.

A text is cut into words and these into bits of at most four characters; a k-mer is ``KMER``
neighbouring bits.  Where more than ``LONG`` characters of a word are left, a bit starts at every
character, so that an edit in text without white space shifts no more than the bits of the last
``LONG`` characters, which are counted from the word's end.  Equal k-mers of a text are numbered in their order, so that repeats count.
One hash function orders the numbered k-mers; the ``KEPT`` smallest are selected and put back
into the order in which they stand in the text.  Each two neighbours of that sequence are
hashed into one entry of the signature.  Moved, inserted or deleted passages change the order or
the neighbours, so the share of common entries falls with the edit distance, not only with the
set of words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType
from pyspark.sql.window import Window

from stepwise.llm.shared import saved

KMER = 2
KEPT = 64
LONG = 16
# Places in a text that a k-mer's number can hold; beyond, order is modulo this.
_PLACES = (1 << 24) - 1
# Steps of a search among up to 2 ** 24 equal k-mers.
_STEPS = [1 << b for b in range(23, -1, -1)]
_WORD = r"[^\x20\x09-\x0D]"
_BITS = rf"(?=({_WORD}{{1,4}}))(?:(?={_WORD}{{{LONG + 1}}}){_WORD}|{_WORD}{{1,4}})"


def bits_of(text: str) -> Column:
    """The bits of a text column, in order."""
    return F.regexp_extract_all(text, F.lit(_BITS), F.lit(1))


def with_signature(df: DataFrame, text: str, out: str) -> DataFrame:
    """df with the signature of a text column, an array of at most KEPT - 1 numbers.

    The steps are columns of their own: an array that several lambdas read is computed once.
    """
    bits, sorted_, low = f"_{out}_bits", f"_{out}_sorted", f"_{out}_low"
    rest = F.lit(~_PLACES)
    # Hash above, place below: equal k-mers are neighbours, in the order of the text.
    kmers = F.transform(
        F.sequence(F.lit(0), F.greatest(F.size(bits) - KMER, F.lit(0))),
        lambda i: F.xxhash64(F.slice(bits, i + 1, KMER))
        .bitwiseAND(rest)
        .bitwiseOR(i.cast("long").bitwiseAND(F.lit(_PLACES))),
    )
    nothing = F.array().cast("array<long>")
    same = lambda x, i: F.get(sorted_, i).bitwiseXOR(x).bitwiseAND(rest) == 0

    def numbered(x: Column, i: Column) -> Column:
        # How many equal ones stand before: the longest step back that stays among them.
        number = F.aggregate(
            F.lit(_STEPS).cast("array<int>"),
            F.lit(0),
            lambda back, step: F.when((i >= back + step) & same(x, i - back - step), back + step).otherwise(back),
        )
        again = F.xxhash64(x.bitwiseAND(rest), number).bitwiseAND(rest)
        place = x.bitwiseAND(F.lit(_PLACES))
        return F.when((i > 0) & same(x, i - 1), again.bitwiseOR(place)).otherwise(x)

    places = F.sort_array(
        F.transform(
            low,
            lambda x, i: F.shiftleft(x.bitwiseAND(F.lit(_PLACES)), 8).bitwiseOR(i.cast("long")),
        )
    )
    in_order = f"_{out}_order"
    pairs = F.transform(
        F.sequence(F.lit(0), F.greatest(F.size(in_order) - 2, F.lit(0))),
        lambda i: F.xxhash64(F.get(in_order, i), F.get(in_order, i + 1)).bitwiseAND(F.lit(0xFFFFFFFF)),
    )
    return (
        df.withColumn(bits, bits_of(text))
        .withColumn(sorted_, F.when(F.size(bits) == 0, nothing).otherwise(F.sort_array(kmers)))
        .drop(bits)
        .withColumn(low, F.slice(F.sort_array(F.transform(sorted_, numbered)), 1, KEPT))
        .drop(sorted_)
        .withColumn(f"_{out}_places", places)
        .withColumn(
            in_order,
            F.transform(
                f"_{out}_places",
                lambda p: F.get(low, p.bitwiseAND(F.lit(255)).cast("int")).bitwiseAND(rest),
            ),
        )
        .withColumn(out, F.when(F.size(in_order) == 0, nothing).otherwise(pairs))
        .drop(low, f"_{out}_places", in_order)
    )


def written(signature: str) -> Column:
    """A signature as text."""
    return F.array_join(F.transform(signature, lambda v: F.lower(F.hex(v))), "-")


def likeness(a: str, b: str) -> Column:
    """Common entries of two signatures, of all their entries; 1 for two empty ones."""
    every = F.size(F.array_union(a, b))
    return F.when(every == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / every)


def followers(ids: DataFrame) -> DataFrame:
    """doc_id and next_id of distinct ids(doc_id): the next smaller id, and for the smallest the
    largest.  Ids are ranged over partitions; one row of each meets in a window."""
    ranged = saved(
        ids.repartitionByRange("doc_id").withColumn("part", F.spark_partition_id())
    )
    parts = ranged.groupBy("part").agg(F.max("doc_id").alias("top"))
    below = F.lag("top").over(Window.orderBy("part"))
    top = F.max("top").over(Window.partitionBy(F.lit(0)))
    parts = parts.withColumn("entry", F.coalesce(below, top)).select("part", "entry")
    inside = F.lead("doc_id").over(Window.partitionBy("part").orderBy(F.desc("doc_id")))
    return (
        ranged.withColumn("inside", inside)
        .join(parts, "part")
        .select("doc_id", F.coalesce("inside", "entry").alias("next_id"))
    )


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next
    of every row of docs(doc_id, text).

    The edited text ends with as many characters of the next document, in descending order of
    doc_id, as it loses: a third.  Null texts are empty.  Where rows repeat a doc_id, each has its
    own edited text, and the one with the smallest text stands for them as another's next.  Rows
    without doc_id have an empty next document and are nobody's.  A single document is its own
    next.  Other columns are ignored; an empty table gives no rows.
    """
    # The column as it is, or its cast: a needless one would leave a renaming in one of the two
    # uses of ``placed`` only, and Spark would move the texts twice.
    doc_id = "doc_id" if docs.schema["doc_id"].dataType == LongType() else F.col("doc_id").cast("long").alias("doc_id")
    texts = docs.select(doc_id, F.coalesce("text", F.lit("")).alias("text"))
    # Of rows that repeat a doc_id, the first stands for them.
    standing = F.lag("doc_id").over(Window.partitionBy("doc_id").orderBy("text")).isNull()
    named = texts.where("doc_id is not null")
    third = F.floor(F.char_length("text") / 3).cast("int")
    needs = named.groupBy("doc_id").agg(F.max(third).alias("need"))
    order = saved(followers(needs.select("doc_id")).join(needs, "doc_id"))
    placed = named.withColumn("standing", standing)
    heads = (
        placed.where("standing")
        .join(
            order.select(F.col("doc_id").alias("reader"), F.col("next_id").alias("doc_id"), "need"),
            "doc_id",
        )
        .select(
            F.col("reader").alias("doc_id"),
            F.col("doc_id").alias("next_id"),
            F.expr("substring(text, 1, need)").alias("head"),
        )
    )
    nameless = texts.where("doc_id is null").select(
        "doc_id", "text", F.lit(False).alias("standing"), F.lit(None).cast("long").alias("next_id"), F.lit("").alias("head")
    )
    rows = placed.join(heads, "doc_id").select("doc_id", "text", "standing", "next_id", "head").union(nameless)
    rows = rows.withColumn("n_chars", F.char_length("text").cast("long")).withColumn(
        "edited",
        F.concat(
            F.expr("substring(text, 1, cast(n_chars - floor(n_chars / 3) as int))"),
            F.expr("substring(head, 1, cast(floor(n_chars / 3) as int))"),
        ),
    )
    signed = with_signature(with_signature(rows, "text", "own"), "edited", "changed")
    done = saved(
        signed.select(
            "doc_id",
            "next_id",
            "n_chars",
            F.sha2("edited", 256).alias("edited_sha256"),
            "own",
            "changed",
            "standing",
        )
    )
    known = done.where("standing").select(F.col("doc_id").alias("next_id"), F.col("own").alias("next_own"))
    return (
        done.join(known, "next_id", "left")
        .withColumn("next_own", F.coalesce("next_own", F.array().cast("array<long>")))
        .select(
            "doc_id",
            "n_chars",
            "edited_sha256",
            written("own").alias("fingerprint"),
            written("changed").alias("edited_fingerprint"),
            likeness("own", "changed").alias("near_edited"),
            likeness("own", "next_own").alias("near_next"),
        )
    )
