"""Token ids of whole texts with a tokenizers file, encoding each distinct word once.

The tokenizer drops white space and lower-cases, so texts can be cut at white space without
changing any id, and plain words also where letters, digits and signs meet.  A batch's words are
found and hashed by ``textscan``; only words that the process has not met go to the library.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import regex

from stepwise.llm.textscan import SPACE, text_bytes, word_blocks

DOCUMENT_END = 2
# Known words of a process; beyond this many it starts anew.
MOST_WORDS = 1 << 20
# Bytes that leave a word whole: apostrophes of contractions, the sign that opens a special
# token, control bytes, and everything beyond ASCII but the letters below.
_LETTER, _DIGIT, _SIGN, _ODD = 1, 2, 3, 4
_KIND = np.full(256, _ODD, np.uint8)
_KIND[33:127] = _SIGN
_KIND[48:58] = _DIGIT
_KIND[65:91] = _KIND[97:123] = _LETTER
_KIND[[0x27, 0x3C]] = _ODD
_KIND[SPACE] = 0
_PLAIN = regex.compile(r"[a-zà-öø-ÿß]+|[0-9]|[!-&(-/:;=-@\[-`{-~]+")


def _byte_letters() -> dict[int, str]:
    """Letters that stand for bytes in byte-level vocabularies: printable Latin-1 characters
    stand for themselves, the other bytes for the letters from 256 on, in order."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(others)}


_BYTE_LETTERS = _byte_letters()


class Encoder:
    """Ids of texts, with a bounded memory of words."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.forget()

    def forget(self) -> None:
        self.codes = np.zeros(0, np.uint64)
        self.first = np.zeros(0, np.int64)
        self.count = np.zeros(0, np.int64)
        self.pool = np.zeros(0, np.uint32)

    def word(self, raw: bytes) -> list[int]:
        text = raw.decode()
        low = text.lower()
        if _PLAIN.fullmatch(low):
            letters = low if low.isascii() else "".join(map(_BYTE_LETTERS.get, low.encode()))
            return [t.id for t in self.tokenizer.model.tokenize(letters)]
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def learn(self, codes: np.ndarray, words: list[bytes]) -> None:
        ids = [self.word(w) for w in words]
        count = np.array([len(x) for x in ids], np.int64)
        first = len(self.pool) + np.cumsum(count) - count
        flat = np.fromiter((i for x in ids for i in x), np.uint32, int(count.sum()))
        at = np.searchsorted(self.codes, codes)
        self.codes = np.insert(self.codes, at, codes)
        self.first = np.insert(self.first, at, first)
        self.count = np.insert(self.count, at, count)
        self.pool = np.concatenate([self.pool, flat])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and the n + 1 offsets of each text's ids; null is empty."""
        data, offsets = text_bytes(texts)
        found, totals = [], np.zeros(len(texts) + 1, np.int64)
        for block in word_blocks(data, offsets):
            if not len(block.starts):
                continue
            starts, ends, owners = _units(block)
            codes, sample, back = np.unique(
                block.hashes(starts, ends), return_index=True, return_inverse=True
            )
            if len(self.codes) > MOST_WORDS:
                self.forget()
            at = np.searchsorted(self.codes, codes)
            known = np.zeros(len(codes), bool)
            inside = at < len(self.codes)
            known[inside] = self.codes[at[inside]] == codes[inside]
            if not known.all():
                raw = data[block.at : block.at + len(block.bytes)]
                new = sample[~known]
                words = [raw[s:e].tobytes() for s, e in zip(starts[new], ends[new], strict=True)]
                self.learn(codes[~known], words)
                at = np.searchsorted(self.codes, codes)
            at = at[back]
            count = self.count[at]
            total = int(count.sum())
            places = np.repeat(self.first[at] - np.cumsum(count) + count, count)
            found.append(self.pool[places + np.arange(total)])
            totals[1:] += np.bincount(owners, weights=count, minlength=len(texts)).astype(np.int64)
        ids = np.concatenate(found) if found else np.zeros(0, np.uint32)
        return ids, np.cumsum(totals)


def _units(block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and texts of the pieces of words that are encoded on their own."""
    raw = block.bytes
    kind = _KIND[raw]
    # Two-byte letters with accents, of which capitals lie 32 below.
    lead = np.flatnonzero(raw[:-1] == 0xC3)
    lead = lead[(raw[lead + 1] != 0x97) & (raw[lead + 1] != 0xB7)]
    kind[lead] = kind[lead + 1] = _LETTER
    cut = np.zeros(len(raw), bool)
    cut[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)
    odd = np.flatnonzero(np.add.reduceat(kind == _ODD, block.starts, dtype=np.int64))
    for start, end in zip(block.starts[odd].tolist(), block.ends[odd].tolist(), strict=True):
        cut[start:end] = False
    cut[block.starts] = True
    cut &= kind != 0
    starts = np.flatnonzero(cut)
    word = np.searchsorted(block.starts, starts, "right") - 1
    ends = np.minimum(np.append(starts[1:], len(raw)), block.ends[word])
    return starts, ends, block.texts[word]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The process's encoder for a tokenizer file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def documents(texts: pa.Array, path: str, end: int = DOCUMENT_END) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the texts with the end id after each, and the n + 1 offsets of the texts."""
    ids, offsets = encoder(path).encode(texts)
    out = np.full(len(ids) + len(texts), end, np.uint32)
    ended = offsets + np.arange(len(offsets))
    keep = np.ones(len(out), bool)
    keep[ended[1:] - 1] = False
    out[keep] = ids
    return out, ended


def crc32(ids: np.ndarray) -> int:
    """Unsigned CRC of ids as little-endian unsigned 32-bit numbers."""
    return zlib.crc32(np.ascontiguousarray(ids, "<u4").data)
