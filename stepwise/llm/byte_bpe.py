"""Byte-level BPE in linear time: longest matches, taken back where tokens cannot be neighbours.

The pattern cuts a text into pieces, and each piece is encoded on its own.  All tokens of the
vocabulary stand in an Aho-Corasick automaton over bytes written as Latin-1 characters; one pass
gives the longest token at every byte of a piece.  Two tokens are *compatible* if merging the
bytes of both in rank order ends with just these two; an encoding whose neighbours are all
compatible is the one that the merges give.  So the encoder takes the longest token that is
compatible with the one before it, tries ever shorter prefixes of it where it is not, and steps
back where none is; a byte from which the rest cannot be reached is marked and not met again.
Compatibility of a pair depends on the two tokens only and is remembered.

A piece that is itself a token is that token, as in the tiktoken library, also where merges alone
would not reach it.  Ranks must rise from merge to merge, as trained vocabularies have them.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

# Remembered pieces and pairs of a process, at most, and the longest piece that is remembered.
MOST_PIECES, MOST_PAIRS, LONGEST_PIECE = 1 << 19, 1 << 20, 64
# Characters that the pattern sees at once, and the matches at their end that more text may change.
WINDOW, UNSURE = 1 << 20, 3
# Bytes of text in one batch that goes back to Spark, roughly.
BATCH = 8 << 20


def read_ranks(path: str) -> dict[bytes, int]:
    """Token to rank, from a file with a base64 token and its rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (x.split() for x in lines if x.strip())}


class Vocabulary:
    """Tokens, how each comes about by merging two, and which may be neighbours."""

    def __init__(self, ranks: dict[bytes, int]):
        if any(bytes([b]) not in ranks for b in range(256)):
            raise ValueError("the vocabulary lacks single bytes")
        self.ranks = ranks
        self.bytes = {rank: token for token, rank in ranks.items()}
        self.halves: dict[int, tuple[int, int]] = {}
        self.shorter: dict[int, tuple[int, int] | None] = {}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.automaton = ahocorasick.Automaton()
        # In rank order, so that whatever a token is merged from is known before it.
        for rank in sorted(self.bytes):
            token = self.bytes[rank]
            if len(token) == 1 or self._halve(token, rank):
                self.automaton.add_word(token.decode("latin-1"), (len(token) - 1, rank))
        self.automaton.make_automaton()
        for _, rank in self.automaton.values():
            self.shorter[rank] = self._prefix(self.bytes[rank])

    def _reached(self, token: bytes) -> int | None:
        """The token's rank, if merges lead to it."""
        rank = self.ranks.get(token)
        return rank if rank is not None and (len(token) == 1 or rank in self.halves) else None

    def _halve(self, token: bytes, rank: int) -> bool:
        """Find the two tokens whose merge is this one; there is at most one such pair, as merges
        run in one order only."""
        for cut in range(len(token) - 1, 0, -1):
            left, right = self._reached(token[:cut]), self._reached(token[cut:])
            if left is not None and right is not None and self._neighbours(left, right, rank):
                self.halves[rank] = (left, right)
                return True
        return False

    def _prefix(self, token: bytes) -> tuple[int, int] | None:
        """The next shorter token that starts alike, as its last byte's place and its rank."""
        for cut in range(len(token) - 1, 0, -1):
            rank = self._reached(token[:cut])
            if rank is not None:
                return cut - 1, rank
        return None

    def compatible(self, left: int, right: int) -> bool:
        known = self.pairs.get((left, right))
        if known is None:
            if len(self.pairs) >= MOST_PAIRS:
                self.pairs.clear()
            known = self.pairs[left, right] = self._neighbours(left, right, None)
        return known

    def _neighbours(self, left: int, right: int, below: int | None) -> bool:
        """Whether the merges of both tokens' bytes leave exactly these two, by undoing merges on
        the two sides of the border, the later one first: at every moment before, the tokens at
        the border must not have merged.  Of equal ranks the left one merges first.  Merges of
        rank ``below`` and more do not count.
        """
        joined = self.ranks.get(self.bytes[left] + self.bytes[right])
        if joined is not None and (below is None or joined < below):
            return False
        while True:
            parts_left, parts_right = self.halves.get(left), self.halves.get(right)
            if parts_left is None and parts_right is None:
                return True
            # Undo the merge that came last; until then the border had to hold.
            if parts_right is None or (parts_left is not None and left > right):
                moment, left, first = left, parts_left[1], False
            else:
                moment, right, first = right, parts_right[0], True
            joined = self.ranks.get(self.bytes[left] + self.bytes[right])
            # A merge across the border lies left of the right token's merges of the same rank,
            # and right of the left token's.
            if joined is not None and (joined <= moment if first else joined < moment):
                return False

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one piece."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        # Ends only grow, so the last token found for a start is its longest.
        longest: list = [None] * len(piece)
        for end, found in self.automaton.iter(piece.decode("latin-1")):
            longest[end - found[0]] = found
        known, shorter, compatible = self.pairs, self.shorter, self.compatible
        open_at = bytearray(b"\1") * (len(piece) + 1)
        ids: list[int] = []
        at, last, found = 0, -1, longest[0]
        while True:
            reach, token = found
            after = at + reach + 1
            fits = open_at[after]
            if fits and last >= 0:
                fits = known.get((last, token))
                if fits is None:
                    fits = compatible(last, token)
            if fits:
                ids.append(token)
                if after == len(piece):
                    return ids
                at, last, found = after, token, longest[after]
                continue
            found = shorter[token]
            if found is None:
                # Nothing fits here: never come back, and shorten the token before.
                open_at[at] = 0
                ids.pop()
                at -= len(self.bytes[last])
                found = (len(self.bytes[last]) - 1, last)
                last = ids[-1] if ids else -1


class _Pieces(dict):
    """Piece to its ids as little-endian unsigned 32-bit numbers; short pieces are remembered."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.vocabulary = vocabulary

    def __missing__(self, piece: str) -> bytes:
        ids = np.array(self.vocabulary.merge(piece.encode()), "<u4").tobytes()
        if len(piece) <= LONGEST_PIECE:
            if len(self) >= MOST_PIECES:
                self.clear()
            self[piece] = ids
        return ids


def pieces(pattern: regex.Pattern, text: str, window: int = WINDOW) -> Iterator[list[str]]:
    """The pattern's matches, in lists for about a window of the text each.

    A window's last matches might be others if the text went on, so the next window starts
    with them.
    """
    at = 0
    while at < len(text):
        width = window
        while True:
            found = pattern.findall(text, at, min(at + width, len(text)))
            if at + width >= len(text):
                yield found
                return
            if len(found) > UNSURE:
                break
            width *= 2
        found = found[:-UNSURE]
        yield found
        at += sum(map(len, found))


class Codec:
    def __init__(self, path: str, pattern: str):
        self.pattern = regex.compile(pattern)
        vocabulary = Vocabulary(read_ranks(path))
        self.known = _Pieces(vocabulary)
        self.tokens = vocabulary.bytes

    def encode(self, text: str) -> bytes:
        """The text's ids as little-endian unsigned 32-bit numbers."""
        return b"".join(map(self.known.__getitem__, chain.from_iterable(pieces(self.pattern, text))))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_codecs: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """The process's codec for a rank file."""
    if (path, pattern) not in _codecs:
        _codecs[path, pattern] = Codec(path, pattern)
    return _codecs[path, pattern]


def _map(batches: Iterator[pa.RecordBatch], change) -> Iterator[pa.RecordBatch]:
    """Each batch with its last column changed value by value, in batches of bounded bytes."""
    for batch in batches:
        done, low, held = [], 0, 0
        for i, value in enumerate(batch.columns[-1]):
            done.append(change(value))
            held += len(done[-1])
            if held >= BATCH or i == batch.num_rows - 1:
                rest = [c.slice(low, len(done)) for c in batch.columns[:-1]]
                yield pa.RecordBatch.from_arrays([*rest, pa.array(done, pa.binary())], batch.schema.names)
                done, low, held = [], i + 1, 0


def _changed(df: DataFrame, column: str, name: str, change) -> DataFrame:
    """The other columns of df, and the changed one under its new name at the end."""
    others = [c for c in df.columns if c != column]
    sent = df.select(*others, F.col(column).cast("binary").alias(name))
    return sent.mapInArrow(
        lambda batches: _map(batches, change()),
        StructType([*sent.schema.fields[:-1], StructField(name, BinaryType())]),
    )


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and ids for every row of docs(doc_id, text), further columns ignored.

    ids are little-endian unsigned 32-bit numbers in one binary value, as ``size`` and
    ``decode`` read them: those of the rank file at ``path`` for each match of the pattern, without
    special tokens.  Null and empty texts have no ids (an empty value).  Bytes that are no UTF-8
    count as U+FFFD.  Rows stay as many as they are: repeated rows are encoded alike, a null
    doc_id stays null, an empty table gives none.  A text is held whole in its task; its pieces
    are found in windows of a million characters, and a single piece takes about ten times its
    bytes.
    """

    def change():
        coder = codec(path, pattern)

        def one(value: pa.Scalar) -> bytes:
            raw = value.as_buffer()
            return coder.encode(raw.to_pybytes().decode("utf-8", "replace")) if raw else b""

        return one

    return _changed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "text", "ids", change)


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """The rows of encoded(..., ids) with the bytes of their tokens, ``decoded``, in place of ids.

    Null ids are as none.  An id that the rank file lacks is an error.
    """

    def change():
        coder = codec(path, pattern)

        def one(value: pa.Scalar) -> bytes:
            raw = value.as_buffer()
            return coder.decode(raw.to_pybytes()) if raw else b""

        return one

    return _changed(encoded, "ids", "decoded", change)


def size(ids: Column) -> Column:
    """Number of ids in a binary value of ``encode``."""
    return (F.octet_length(ids) / 4).cast("long")


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, and the SHA-256 of ids and of the bytes decoded from them, for every row."""
    ids = F.col("ids")
    coded = encode(docs, path, pattern).select("doc_id", size(ids).alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), "ids")
    decoded = decode(coded, path, pattern)
    return decoded.select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))
