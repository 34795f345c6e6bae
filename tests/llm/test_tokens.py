from __future__ import annotations

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from stepwise.llm import packing, textscan, token_blocks, tokenise

SPECIAL = [
    "Don't you're it's 'S 's'", "a<|endoftext|>b <|startoftext|> x", "naïve café é É É", "中文 字",
    "x\x00y \x1c z", "１２ ²³¼ 12ab34", "ÀÉß× ÷a ñ", "ﬁ İstanbul ΑΣ", "a b c\u0085d", "!!??...,a.b",
    "😀😀 a😀b", "'ll 've '' ''s", "<<>>", "a_b_c __x__", "´`^~ ©®", "ªº µ a­b",
]


def expected(tokenizer, texts):
    plain = Tokenizer.from_file(tokenizer)
    return [[*plain.encode(t or "", add_special_tokens=False).ids, 2] for t in texts]


def test_words_are_encoded_as_texts_are(tokenizer):
    letters = "aAzZéÉñß×÷ \n\t\r\x0b\x0c'<|>_-.,!09²µªé中😀"
    rng = random.Random(0)
    texts = SPECIAL + ["".join(rng.choices(letters, k=rng.randrange(60))) for _ in range(1500)] + [None, ""]
    ids, ends = tokenise.documents(pa.array(texts, pa.string()), tokenizer)
    got = [ids[a:b].tolist() for a, b in zip(ends[:-1], ends[1:], strict=True)]
    assert got == expected(tokenizer, texts)


def thue_morse(letters: str, doublings: int) -> str:
    word = letters[0]
    for _ in range(doublings):
        word += "".join(letters[1] if c == letters[0] else letters[0] for c in word)
    return word


def test_words_that_collide_modulo_powers_of_two(tokenizer):
    texts = [thue_morse(letters, 12) for letters in ("ab", "ba")]
    hashes, _ = textscan.word_hashes(*textscan.text_bytes(pa.array(texts)))
    assert hashes[0] != hashes[1]
    ids, ends = tokenise.documents(pa.array(texts), tokenizer)
    assert [ids[a:b].tolist() for a, b in zip(ends[:-1], ends[1:], strict=True)] == expected(tokenizer, texts)


def test_memory_of_words_is_bounded(tokenizer, monkeypatch):
    monkeypatch.setattr(tokenise, "MOST_WORDS", 5)
    texts = [f"word{i} other{i}" for i in range(30)]
    encoder = tokenise.Encoder(tokenizer)
    for _ in range(2):
        for t in texts:
            ids, _ = encoder.encode(pa.array([t]))
            assert [*ids.tolist(), 2] == expected(tokenizer, [t])[0]
            assert len(encoder.codes) < 12


@given(st.lists(st.one_of(st.none(), st.text(alphabet="ab \n\té", max_size=60)), max_size=8), st.integers(1, 40))
@settings(max_examples=60, deadline=None)
def test_words_do_not_depend_on_blocks(texts, limit):
    data, offsets = textscan.text_bytes(pa.array(texts, pa.string()))
    words = []
    for block in textscan.word_blocks(data, offsets, limit=limit):
        raw = block.bytes.tobytes()
        words += [(int(t), raw[s:e].decode()) for t, s, e in zip(block.texts, block.starts, block.ends, strict=True)]
    assert words == [(i, w) for i, t in enumerate(texts) for w in (t or "").split()]


@pytest.mark.parametrize(
    "ids",
    [[], [5], [7] * 256, [0, 2**32 - 1] * 300, list(range(1000)), [3] * 255 + [2**31], [2**32 - 1] * 10],
)
def test_blocks_round_trip(ids):
    values = np.array(ids, np.uint32)
    raw, starts = token_blocks.encode_blocks(values)
    assert (token_blocks.decode_blocks(raw, starts, len(values)) == values).all()
    # Any block can be read alone, from its start in the index.
    for b in range(len(starts) - 1):
        piece = raw[int(starts[b]) : int(starts[b + 1])]
        one = token_blocks.decode_blocks(piece, np.array([0, len(piece)], np.uint64), 256)
        some = values[256 * b : 256 * (b + 1)]
        assert (one[: len(some)] == some).all()


def test_patched_blocks_are_small():
    """Outliers cost five bytes each and leave the width alone."""
    values = np.arange(256, dtype=np.uint32) % 16
    values[[3, 77]] = 1_000_000
    raw, _ = token_blocks.encode_blocks(values)
    assert len(raw) == 7 + 4 * 32 + 2 * 5


def test_token_files(documents, odd_rows, tokenizer):
    got = token_blocks.token_files(documents(odd_rows), tokenizer).orderBy("start").collect()
    order = sorted(odd_rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    start = 0
    for row, ids, r in zip(order, expected(tokenizer, [t for _, t, *_ in order]), got, strict=True):
        assert (r["doc_id"], r["start"], r["n_tokens"]) == (row[0], start, len(ids))
        assert r["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
    assert token_blocks.token_files(documents([]), tokenizer).count() == 0


def test_first_fit_decreasing_is_first_fit():
    rng = np.random.default_rng(2)
    for n in (0, 1, 2, 7, 200):
        sizes = rng.integers(1, 101, n)
        bins, offsets = packing.first_fit_decreasing(sizes, 100)
        free: list[int] = []
        for i in np.argsort(-sizes, kind="stable"):
            b = next((k for k, f in enumerate(free) if f >= sizes[i]), len(free))
            if b == len(free):
                free.append(100)
            assert (bins[i], offsets[i]) == (b, 100 - free[b])
            free[b] -= sizes[i]


def test_packing(documents, odd_rows, tokenizer):
    packed = packing.pack(documents(odd_rows), tokenizer, length=256, group=4, keep_ids=True)
    rows = packed.collect()
    whole = dict(zip(range(len(odd_rows)), expected(tokenizer, [t for _, t, *_ in odd_rows]), strict=True))
    ids = sorted((tuple(x) for x in whole.values()))
    pieces: dict = {}
    for r in rows:
        assert zlib.crc32(bytes(r["ids"])) == r["ids_crc32"]
        assert len(r["ids"]) == 4 * r["length"]
        pieces.setdefault(r["doc_id"], []).append(r)
    assert sum(r["length"] for r in rows) == sum(map(len, ids))
    for doc, text in ((9, odd_rows[11][1]), (2, ""), (12, odd_rows[14][1])):
        got = sorted(pieces[doc], key=lambda r: r["start"])
        joined = b"".join(bytes(r["ids"]) for r in got)
        assert np.frombuffer(joined, "<u4").tolist() == expected(tokenizer, [text])[0]
        assert all(r["doc_tokens"] == len(joined) // 4 for r in got)
        assert [r["start"] for r in got] == np.cumsum([0, *(r["length"] for r in got)])[:-1].tolist()
    sequences = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for spans in sequences.values():
        spans.sort()
        assert [o for o, _ in spans] == np.cumsum([0, *(n for _, n in spans)])[:-1].tolist()
        assert sum(n for _, n in spans) <= 256
    joined = packing.sequences(packed).collect()
    assert all(len(r["ids"]) == 4 * r["length"] for r in joined)
    assert packing.pack(documents([]), tokenizer).count() == 0


def test_a_packing_task_leaves_no_words_in_its_process(tokenizer):
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array([1, 2]), "text": pa.array(["some plain words", None])})
    assert sum(b.num_rows for b in packing._pieces(iter([batch]), tokenizer, 4096, False)) == 2
    assert not len(tokenise.encoder(tokenizer).codes) and not len(tokenise.encoder(tokenizer).pool)
