"""Token ids on disk in patched frame-of-reference blocks.

A *segment* holds whole documents in the order of their ids::

    magic (8 bytes) | values, documents, blocks: u64 each
    per document: has an id u8, doc_id i64, number of ids u64
    block starts: u64 per block and one for the end, from the first block
    per block of 256 values: minimum u32, width u8, exceptions u16,
        256 residuals of that width, bit by bit from the lowest,
        exception positions u8, exception residuals u32

All numbers are little-endian.  The width holds the 90th percentile of a block's residuals;
larger ones are exceptions.  The last block is filled up with its minimum.  Segments are rows of
a Parquet table in the shared folder, keyed by range partition and number, so that whatever file
system Spark writes to will do, and any block can be read on its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stepwise.llm.shared import saved
from stepwise.llm.tokenise import crc32, documents

MAGIC = b"PFORSEG1"
VALUES = 256
PERCENTILE = 0.9
SEGMENT_IDS = 1 << 20
_HEAD = 7


def _bit_lengths(x: np.ndarray) -> np.ndarray:
    return np.ceil(np.log2(x.astype(np.float64) + 1)).astype(np.int64)


def _bits(rows: np.ndarray, width: int) -> np.ndarray:
    """Rows of 256 residuals as width bits each."""
    kind = np.dtype("<u2") if width <= 16 else np.dtype("<u4")
    raw = np.unpackbits(
        rows.astype(kind).view(np.uint8).reshape(len(rows), VALUES, kind.itemsize),
        axis=2,
        bitorder="little",
    )
    return np.packbits(raw[:, :, :width].reshape(len(rows), -1), axis=1, bitorder="little")


def _unbits(raw: np.ndarray, width: int) -> np.ndarray:
    kind = np.dtype("<u2") if width <= 16 else np.dtype("<u4")
    bits = np.unpackbits(raw, axis=1, bitorder="little").reshape(len(raw), VALUES, width)
    full = np.zeros((len(raw), VALUES, kind.itemsize * 8), np.uint8)
    full[:, :, :width] = bits
    packed = np.packbits(full.reshape(len(raw), -1), axis=1, bitorder="little")
    return packed.view(kind).astype(np.uint32)


def encode_blocks(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The blocks' bytes and the starts of the blocks, with the end."""
    count = -(-len(ids) // VALUES)
    if not count:
        return np.zeros(0, np.uint8), np.zeros(1, np.uint64)
    table = np.empty(count * VALUES, np.uint32)
    table[: len(ids)] = ids
    table[len(ids) :] = ids[(count - 1) * VALUES :].min()
    table = table.reshape(count, VALUES)
    least = table.min(axis=1)
    table -= least[:, None]
    place = int(np.ceil(PERCENTILE * VALUES)) - 1
    widths = _bit_lengths(np.partition(table, place, axis=1)[:, place])
    beyond = (table >> widths[:, None].astype(np.uint32)) > 0
    beyond[widths >= 32] = False
    exceptions = beyond.sum(axis=1)
    sizes = _HEAD + widths * (VALUES // 8) + exceptions * 5
    starts = np.zeros(count + 1, np.uint64)
    np.cumsum(sizes, out=starts[1:])
    at = starts[:-1].astype(np.int64)
    out = np.zeros(int(starts[-1]), np.uint8)
    out[at[:, None] + np.arange(4)] = least.astype("<u4").view(np.uint8).reshape(-1, 4)
    out[at + 4] = widths
    out[at[:, None] + np.array([5, 6])] = exceptions.astype("<u2").view(np.uint8).reshape(-1, 2)
    for width in np.unique(widths).tolist():
        chosen = np.flatnonzero(widths == width)
        if width:
            low = table[chosen] & np.uint32((1 << width) - 1)
            spots = at[chosen, None] + _HEAD + np.arange(width * (VALUES // 8))
            out[spots] = _bits(low, width)
    block, position = np.nonzero(beyond)
    if len(block):
        nth = np.arange(len(block)) - np.repeat(np.cumsum(exceptions) - exceptions, exceptions)
        tail = at[block] + _HEAD + widths[block] * (VALUES // 8)
        out[tail + nth] = position
        values = table[block, position].astype("<u4").view(np.uint8).reshape(-1, 4)
        out[(tail + exceptions[block] + 4 * nth)[:, None] + np.arange(4)] = values
    return out, starts


def decode_blocks(raw: np.ndarray, starts: np.ndarray, count: int) -> np.ndarray:
    """The first count values of blocks."""
    blocks = len(starts) - 1
    if blocks < 1:
        return np.zeros(0, np.uint32)
    at = starts[:-1].astype(np.int64)
    least = np.ascontiguousarray(raw[at[:, None] + np.arange(4)]).view("<u4")[:, 0]
    widths = raw[at + 4].astype(np.int64)
    exceptions = np.ascontiguousarray(raw[at[:, None] + np.array([5, 6])]).view("<u2")[:, 0].astype(np.int64)
    table = np.zeros((blocks, VALUES), np.uint32)
    for width in np.unique(widths).tolist():
        if width:
            chosen = np.flatnonzero(widths == width)
            spots = at[chosen, None] + _HEAD + np.arange(width * (VALUES // 8))
            table[chosen] = _unbits(raw[spots], width)
    block = np.repeat(np.arange(blocks), exceptions)
    if len(block):
        nth = np.arange(len(block)) - np.repeat(np.cumsum(exceptions) - exceptions, exceptions)
        tail = at[block] + _HEAD + widths[block] * (VALUES // 8)
        values = raw[(tail + exceptions[block] + 4 * nth)[:, None] + np.arange(4)]
        table[block, raw[tail + nth]] = np.ascontiguousarray(values).view("<u4")[:, 0]
    table += least[:, None]
    return table.reshape(-1)[:count]


def encode_segment(doc_ids: list[int | None], sizes: np.ndarray, ids: np.ndarray) -> bytes:
    blocks, starts = encode_blocks(ids)
    parts = [
        np.frombuffer(MAGIC, np.uint8),
        np.array([len(ids), len(doc_ids), len(starts) - 1], "<u8"),
        np.array([d is not None for d in doc_ids], np.uint8),
        np.array([d or 0 for d in doc_ids], "<i8"),
        np.asarray(sizes, "<u8"),
        starts.astype("<u8"),
        blocks,
    ]
    return b"".join(p.tobytes() for p in parts)


def decode_segment(image: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """doc_ids, numbers of ids and all ids of a segment."""
    if image[:8] != MAGIC:
        raise ValueError("not a segment of token blocks")
    values, docs, blocks = np.frombuffer(image, "<u8", 3, 8).tolist()
    at = 32
    has = np.frombuffer(image, np.uint8, docs, at)
    names = np.frombuffer(image, "<i8", docs, at + docs)
    sizes = np.frombuffer(image, "<u8", docs, at + 9 * docs)
    at += 17 * docs
    starts = np.frombuffer(image, "<u8", blocks + 1, at)
    raw = np.frombuffer(image, np.uint8, offset=at + 8 * (blocks + 1))
    ids = decode_blocks(raw, starts, values)
    doc_ids = [d if h else None for d, h in zip(names.tolist(), has.tolist(), strict=True)]
    return doc_ids, sizes.astype(np.int64), ids


_SEGMENT = "part int, segment int, docs long, ids long, image binary"


def _write(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    part, number = TaskContext.get().partitionId(), 0
    names: list = []
    sizes: list[np.ndarray] = []
    held: list[np.ndarray] = []
    total = 0

    def segment():
        nonlocal names, sizes, held, total, number
        ids = np.concatenate(held)
        image = encode_segment(names, np.concatenate(sizes), ids)
        row = [[part], [number], [len(names)], [len(ids)], [image]]
        kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
        names, sizes, held, total, number = [], [], [], 0, number + 1
        return pa.RecordBatch.from_arrays(
            [pa.array(v, k) for v, k in zip(row, kinds, strict=True)],
            ["part", "segment", "docs", "ids", "image"],
        )

    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            some = batch.slice(at, 500)
            ids, offsets = documents(some.column("text"), path)
            names += some.column("doc_id").to_pylist()
            sizes.append(np.diff(offsets))
            held.append(ids)
            total += len(ids)
            if total >= SEGMENT_IDS:
                yield segment()
    if names:
        yield segment()


def write_tokens(docs: DataFrame, tokenizer: str) -> DataFrame:
    """The stored segments of docs(doc_id, text), in ascending doc_id order, nulls first.

    Segments are ordered by (part, segment).  Rows that repeat a doc_id follow each other in the
    order of their texts.
    """
    ordered = (
        docs.select(F.col("doc_id").cast("long"), "text")
        .repartitionByRange("doc_id")
        .sortWithinPartitions("doc_id", "text")
    )

    def write(batches):
        return _write(batches, tokenizer)

    return saved(ordered.mapInArrow(write, _SEGMENT))


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in range(batch.num_rows):
            doc_ids, sizes, ids = decode_segment(batch.column("image")[row].as_buffer().to_pybytes())
            ends = np.cumsum(sizes)
            spans = zip((ends - sizes).tolist(), ends.tolist(), strict=True)
            n = len(doc_ids)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([batch.column("part")[row].as_py()] * n, pa.int32()),
                    pa.array([batch.column("segment")[row].as_py()] * n, pa.int32()),
                    pa.array(doc_ids, pa.int64()),
                    pa.array(ends - sizes, pa.int64()),
                    pa.array(sizes, pa.int64()),
                    pa.array([crc32(ids[s:e]) for s, e in spans], pa.int64()),
                ],
                ["part", "segment", "doc_id", "within", "n_tokens", "ids_crc32"],
            )


def read_tokens(segments: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every stored document, decoded from its blocks."""
    sizes = segments.select("part", "segment", "ids")
    # One row per range partition, of which there are as many as shuffle partitions.
    parts = sizes.groupBy("part").agg(F.sum("ids").alias("all"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("all").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("part").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.join(parts, "part").select(
        "part",
        "segment",
        (F.col("base") + F.coalesce(F.sum("ids").over(inside), F.lit(0))).alias("begin"),
    )
    rows = segments.select("part", "segment", "image").mapInArrow(
        _read,
        "part int, segment int, doc_id long, within long, n_tokens long, ids_crc32 long",
    )
    return rows.join(starts, ["part", "segment"]).select(
        "doc_id", (F.col("begin") + F.col("within")).alias("start"), "n_tokens", "ids_crc32"
    )


def token_files(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Documents as read back from the token blocks that were written for them.

    Null and empty texts have their end id alone.  Rows without doc_id come first; repeated rows
    have a row each.  Other columns are ignored; an empty table gives no rows.  A document is
    never split over segments, so one segment holds at least the longest document.
    """
    return read_tokens(write_tokens(docs, tokenizer))
