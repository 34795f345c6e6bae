"""Packing documents into fixed-length sequences by first-fit decreasing.

Documents become pieces of at most the sequence length: whole sequences first, then the rest.
Whole sequences stand alone.  The rests are dealt at random into groups of about ``GROUP``
pieces, and each group is packed on its own: pieces go, longest first, to the first bin that has
room, found in a tournament tree over the bins' free capacities.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepwise.llm.shared import lean, saved
from stepwise.llm.tokenise import crc32, documents, encoder

LENGTH = 4096
GROUP = 8192
_BINS = 1 << 24


class Tournament:
    """First bin with enough room among many; every inner node holds its best capacity."""

    def __init__(self, bins: int, capacity: int):
        self.leaves = 1 << max(bins - 1, 0).bit_length()
        self.best = [capacity] * (2 * self.leaves)

    def place(self, size: int) -> tuple[int, int]:
        """Take size from the first bin that has it: the bin and its capacity before."""
        best, node = self.best, 1
        while node < self.leaves:
            node *= 2
            if best[node] < size:
                node += 1
        before = best[node]
        best[node] = before - size
        at = node >> 1
        while at:
            best[at] = max(best[2 * at], best[2 * at + 1])
            at >>= 1
        return node - self.leaves, before


def first_fit_decreasing(sizes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each size; equal sizes keep their order."""
    tree = Tournament(len(sizes), length)
    bins, offsets = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    for i in np.argsort(-sizes, kind="stable"):
        bins[i], free = tree.place(int(sizes[i]))
        offsets[i] = length - free
    return bins, offsets


_PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, ids binary"


@lean
def _pieces(batches: Iterator[pa.RecordBatch], path: str, length: int, keep: bool):
    try:
        yield from _cut(batches, path, length, keep)
    finally:
        # The process stays for tasks of other operators, which need the memory of the words.
        encoder(path).forget()


def _cut(batches: Iterator[pa.RecordBatch], path: str, length: int, keep: bool):
    for batch in batches:
        for at in range(0, batch.num_rows, 1000):
            part = batch.slice(at, 1000)
            ids, offsets = documents(part.column("text"), path)
            sizes = np.diff(offsets)
            pieces = -(-sizes // length)
            row = np.repeat(np.arange(len(sizes)), pieces)
            start = (np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * length
            size = np.minimum(sizes[row] - start, length)
            begin = offsets[row] + start
            cut = [ids[b : b + n] for b, n in zip(begin.tolist(), size.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id").take(pa.array(row)),
                    pa.array(start, pa.int64()),
                    pa.array(size, pa.int64()),
                    pa.array([crc32(c) for c in cut], pa.int64()),
                    pa.array(sizes[row], pa.int64()),
                    pa.array([c.astype("<u4").tobytes() if keep else None for c in cut], pa.binary()),
                ],
                ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"],
            )


def pack(
    docs: DataFrame, tokenizer: str, length: int = LENGTH, group: int = GROUP, keep_ids: bool = False
) -> DataFrame:
    """One row per piece of docs(doc_id, text): doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id and offset, with the piece's ids (little-endian) if asked for.

    Every document ends with an id of its own, so null and empty texts still give a piece.
    Repeated rows are packed each on its own.  A row without doc_id is packed as any other.
    Other columns are ignored; an empty table gives no rows.  No text is too long: only its
    last piece takes part in the fitting.
    """

    def cut(batches):
        return _pieces(batches, tokenizer, length, keep_ids)

    pieces = saved(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, _PIECE))
    # Numbers of the stored rows: the same in every attempt, and even for repeated rows.
    numbered = pieces.withColumn("row", F.monotonically_increasing_id())
    whole = (
        numbered.where(F.col("length") == length)
        .withColumn("sequence_id", F.col("row") + F.lit(1 << 62))
        .withColumn("offset", F.lit(0).cast("long"))
    )
    rests = numbered.where(F.col("length") < length)
    groups = max(1, -(-rests.count() // group))
    fit = _fit(length)
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    fields = ", ".join(f"{name} long" for name in names)
    out = (
        rests.drop("ids")
        .withColumn("pack_group", F.pmod(F.xxhash64("row"), F.lit(groups)))
        .groupBy("pack_group")
        .applyInPandas(fit, f"{fields}, row long")
    )
    if keep_ids:
        out = out.join(rests.select("row", "ids"), "row")
        names.append("ids")
    return out.select(*names).unionByName(whole.select(*names))


def _fit(length: int):
    def fit(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("row", kind="stable")
        bins, offsets = first_fit_decreasing(group["length"].to_numpy(), length)
        number = int(group["pack_group"].iloc[0])
        out = group.drop(columns="pack_group")
        return out.assign(sequence_id=number * _BINS + bins, offset=offsets)

    return fit


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, length and the joined ids of each sequence of pieces that hold their ids."""
    held = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(
        F.sum("length").alias("length"),
        F.aggregate(held, F.lit(b"").cast("binary"), lambda all_, p: F.concat(all_, p["ids"])).alias("ids"),
    )
