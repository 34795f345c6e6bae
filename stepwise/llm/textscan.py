"""Words of many texts at once, as hashes over the UTF-8 bytes of an Arrow column.

A batch's texts lie in one byte buffer.  Words are runs of bytes other than white space
(``\\x20`` and ``\\x09-\\x0D``); a word's hash joins two polynomials over its bytes modulo the
prime 2 ** 31 - 1, read off running sums, so that hashes of prefixes cost no further pass.  (Modulo
a power of two, some long words would collide for every base.)  Buffers are worked on in blocks
that end at white space or at the end of a text: memory follows the block, not the text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

BLOCK = 1 << 18


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values evenly (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


GOLDEN = 0x9E3779B97F4A7C15


def seeds(n: int, start: int = 1) -> np.ndarray:
    """n fixed, well spread odd 64-bit numbers."""
    steps = np.arange(start, start + n, dtype=np.uint64) * np.uint64(GOLDEN)
    return mix(steps) | np.uint64(1)


SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
PRIME = (1 << 31) - 1
# Two bases, each with its own values of the 256 bytes.
BASES = (0x2545F491, 0x5851F42D)
BYTES = tuple(seeds(256, 1 + 256 * i) % np.uint64(PRIME) for i in range(len(BASES)))
_powers: dict[int, np.ndarray] = {}


def folded(x: np.ndarray) -> np.ndarray:
    """The same values modulo ``PRIME``, below 2 ** 33."""
    return (x & np.uint64(PRIME)) + (x >> np.uint64(31))


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0..n-1, modulo ``PRIME``; kept per process."""
    known = _powers.get(base)
    if known is None or len(known) < n:
        known = np.ones(1, np.uint64)
        while len(known) < max(n, BLOCK + 1):
            step = np.uint64(pow(base, len(known), PRIME))
            known = np.concatenate([known, known * step % np.uint64(PRIME)])
        _powers[base] = known
    return known[:n]


def text_bytes(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The column's UTF-8 bytes and the n + 1 offsets of its texts; a null has no bytes."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data, offsets


def block_ranges(data: np.ndarray, offsets: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Byte ranges of about limit bytes that cut no word."""
    low, end = int(offsets[0]), int(offsets[-1])
    while low < end:
        high = min(low + limit, end)
        if high < end:
            whole = int(offsets[np.searchsorted(offsets, high, "right") - 1])
            if whole > low:
                high = whole
            else:
                high = _cut_inside(data, offsets, low, high)
        yield low, high
        low = high


def _cut_inside(data, offsets, low: int, high: int) -> int:
    """A cut within the text that starts at or before low: at white space, or else after the
    word that is longer than a block."""
    gaps = np.flatnonzero(SPACE[data[low:high]])
    if len(gaps) and gaps[-1] > 0:
        return low + int(gaps[-1])
    text_end = int(offsets[np.searchsorted(offsets, low, "right")])
    while high < text_end:
        gaps = np.flatnonzero(SPACE[data[high : min(high + BLOCK, text_end)]])
        if len(gaps):
            return high + int(gaps[0])
        high = min(high + BLOCK, text_end)
    return text_end


@dataclass
class Words:
    """The words of one block: byte positions in it, and the index of each word's text."""

    bytes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    texts: np.ndarray
    sums: tuple[np.ndarray, ...]
    at: int

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hashes of byte ranges of the block, equal for equal bytes."""
        prime, joined = np.uint64(PRIME), np.zeros(len(starts), np.uint64)
        for base, sums in zip(BASES, self.sums, strict=True):
            back = powers(pow(base, -1, PRIME), len(sums))
            value = (sums[ends] - sums[starts]) % prime * back[starts] % prime
            joined = (joined << np.uint64(31)) | value
        return mix(joined + (ends - starts).astype(np.uint64) * np.uint64(GOLDEN))


def word_blocks(
    data: np.ndarray, offsets: np.ndarray, lower: bool = True, limit: int = BLOCK
) -> Iterator[Words]:
    """All words of the texts, in order, block by block."""
    for low, high in block_ranges(data, offsets, limit):
        piece = data[low:high]
        if lower:
            piece = LOWER[piece]
        inside = ~SPACE[piece]
        first, last = np.searchsorted(offsets, [low, high])
        borders = offsets[first:last] - low
        before = np.empty(len(piece), bool)
        before[0] = True
        before[1:] = ~inside[:-1]
        before[borders[borders < len(piece)]] = True
        starts = np.flatnonzero(inside & before)
        after = np.empty(len(piece), bool)
        after[-1] = True
        after[:-1] = ~inside[1:]
        after[borders[borders > 0] - 1] = True
        ends = np.flatnonzero(inside & after) + 1
        texts = np.searchsorted(offsets, starts + low, "right") - 1
        sums = tuple(np.zeros(len(piece) + 1, np.uint64) for _ in BASES)
        for base, values, out in zip(BASES, BYTES, sums, strict=True):
            np.cumsum(folded(values[piece] * powers(base, len(piece))), dtype=np.uint64, out=out[1:])
        yield Words(piece, starts, ends, texts, sums, low)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text index of every lower-cased word of the texts."""
    found = [(b.hashes(b.starts, b.ends), b.texts) for b in word_blocks(data, offsets)]
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate([h for h, _ in found]), np.concatenate([t for _, t in found])
