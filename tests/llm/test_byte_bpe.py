from __future__ import annotations

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from stepwise.llm import byte_bpe

FILES = ["byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken"]


def library(path):
    ranks = byte_bpe.read_ranks(path)
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def merges(ranks, piece):
    """Byte pairs merged one at a time: the lowest rank, of equal ones the leftmost."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while True:
        found = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]
        if not found:
            return [ranks[p] for p in parts]
        _, i = min(found)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


def texts(count):
    rng = random.Random(2)
    sets = [
        "abc", "aaaab", "  \n\t a", "xyzétü", "中文字漢😀", "0123 ", "ing the of'll", "'sStT 'VE", " 　\x1c\x85 a",
        "".join(map(chr, range(32, 127))), "".join(map(chr, range(128, 900))), "\x00\x01\x7f",
    ]
    for i in range(count):
        letters = [rng.choice(sets)] if i % 2 else sets
        yield "".join(rng.choice(rng.choice(letters)) for _ in range(rng.randrange(200)))


@pytest.mark.parametrize("name", FILES)
def test_ids_are_those_of_the_library(name):
    path = public_tokenizers.path(name)
    coder, plain = byte_bpe.codec(path, public_tokenizers.PATTERN), library(path)
    for text in texts(1500):
        ids = coder.encode(text)
        assert np.frombuffer(ids, "<u4").tolist() == plain.encode_ordinary(text)
        assert coder.decode(ids) == text.encode()


def test_random_vocabularies_against_plain_merges():
    """Vocabularies trained on random strings, and one with a token that no merge reaches."""
    for seed in range(25):
        rng = random.Random(seed)
        ranks = {bytes([b]): b for b in range(256)}
        parts = [[bytes([rng.choice(b"abc")]) for _ in range(60)] for _ in range(12)]
        for rank in range(256, 256 + 40):
            pairs = [p[i] + p[i + 1] for p in parts for i in range(len(p) - 1) if p[i] + p[i + 1] not in ranks]
            if not pairs:
                break
            token = max(sorted(set(pairs)), key=pairs.count)
            ranks[token] = rank
            for p in parts:
                i = 0
                while i < len(p) - 1:
                    if p[i] + p[i + 1] == token:
                        p[i : i + 2] = [token]
                    i += 1
        ranks[b"zzqz"] = 999
        vocabulary = byte_bpe.Vocabulary(ranks)
        for _ in range(200):
            piece = bytes(rng.choice(b"abc") for _ in range(rng.randrange(1, 60)))
            assert vocabulary.merge(piece) == ([ranks[piece]] if piece in ranks else merges(ranks, piece))
        assert vocabulary.merge(b"zzqz") == [999] and vocabulary.merge(b"zzqzz") == [ranks[bytes([b])] for b in b"zzqzz"]


def test_long_pieces_take_linear_time():
    path = public_tokenizers.path(FILES[0])
    coder, plain = byte_bpe.codec(path, public_tokenizers.PATTERN), library(path)
    rng = random.Random(4)
    for text in ("a" * 200_000, "".join(rng.choices("abcdefgh", k=50_000)), " " * 5000 + "x"):
        ids = coder.encode(text)
        assert coder.decode(ids) == text.encode()
        assert np.frombuffer(ids[:40_000], "<u4")[:3000].tolist() == plain.encode_ordinary(text[:40_000])[:3000]


def test_windows_cut_no_match(monkeypatch):
    import regex

    pattern = regex.compile(public_tokenizers.PATTERN)
    for text in texts(400):
        for window in (3, 7, 50):
            assert [m for part in byte_bpe.pieces(pattern, text, window) for m in part] == pattern.findall(text)


def test_memories_are_bounded(monkeypatch):
    path = public_tokenizers.path(FILES[0])
    monkeypatch.setattr(byte_bpe, "MOST_PIECES", 7)
    monkeypatch.setattr(byte_bpe, "MOST_PAIRS", 7)
    coder, plain = byte_bpe.Codec(path, public_tokenizers.PATTERN), library(path)
    for text in texts(100):
        assert np.frombuffer(coder.encode(text), "<u4").tolist() == plain.encode_ordinary(text)
        assert len(coder.known) <= 7 and len(coder.known.vocabulary.pairs) <= 7


def test_rows(spark, documents, odd_rows):
    path, pattern = public_tokenizers.path(FILES[0]), public_tokenizers.PATTERN
    plain = library(path)
    rows = odd_rows + [(100 + i, t, "en", "a") for i, t in enumerate(texts(60))]

    def row(doc_id, text):
        ids = np.array(plain.encode_ordinary(text or ""), "<u4").tobytes()
        return (doc_id, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest())

    got = [tuple(r) for r in byte_bpe.round_trip(documents(rows), path, pattern).collect()]
    assert sorted(got, key=repr) == sorted((row(i, t) for i, t, *_ in rows), key=repr)
    assert byte_bpe.round_trip(documents([]), path, pattern).collect() == []
    coded = byte_bpe.encode(documents(rows), path, pattern)
    back = {(r["doc_id"], bytes(r["decoded"])) for r in byte_bpe.decode(coded, path, pattern).collect()}
    assert back == {(i, (t or "").encode()) for i, t, *_ in rows}
