"""Bounded samples of labelled rows, for fitting small models on the driver."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

_SCALE = 1 << 30


def text_beside(part: pa.RecordBatch, row: str | None) -> tuple[pa.Array, list[pa.Array], list[str]]:
    """A batch's texts, its other columns and their names.

    The text is the last column or, where the batch carries whole rows as a struct, a field of
    that, so that long texts travel once.
    """
    if row is None:
        return part.columns[-1], part.columns[:-1], part.schema.names[:-1]
    return pc.struct_field(part.column(row), "text"), part.columns, part.schema.names


def remainder(doc_id: Column, divisor: int) -> Column:
    """crc32 of the id's text, modulo the divisor; null without an id."""
    return F.crc32(doc_id.cast("string")) % divisor


def class_sizes(rows: DataFrame, label: str) -> dict:
    """Number of rows of each class; one row per class reaches the driver."""
    return {r[label]: r["count"] for r in rows.groupBy(label).count().collect()}


def sample(rows: DataFrame, label: str, sizes: dict, most: int) -> DataFrame:
    """At most ``most`` rows of each class, by a hash of doc_id.

    A threshold per class first leaves about twice as many rows, whatever the class's share, so
    the ranking that follows moves only few.
    """
    share = F.lit(0)
    for name, size in sizes.items():
        limit = min(_SCALE, int(_SCALE * 2 * most / size) + 1)
        share = F.when(F.col(label) == name, limit).otherwise(share)
    place = F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(_SCALE))
    order = Window.partitionBy(label).orderBy("_place", "doc_id")
    return (
        rows.withColumn("_place", place)
        .where(F.col("_place") < share)
        .withColumn("_rank", F.row_number().over(order))
        .where(F.col("_rank") <= most)
        .drop("_place", "_rank")
    )


def labelled_texts(docs: DataFrame, labels: DataFrame, label: str, most: int) -> tuple[DataFrame, dict]:
    """doc_id, text and label of at most ``most`` labelled documents of each class, and the
    number of labels of each class.

    The labels are sampled, so what is broadcast is bounded by the sample's size, and no text
    moves but those of the sample.  Labels without a document or a text leave it smaller.
    """
    named = labels.select(F.col("doc_id").cast("long").alias("doc_id"), label).where(
        F.col("doc_id").isNotNull() & F.col(label).isNotNull()
    )
    sizes = class_sizes(named, label)
    ids = sample(named, label, sizes, most)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text is not null")
    return texts.join(F.broadcast(ids), "doc_id"), sizes
