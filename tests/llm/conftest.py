from __future__ import annotations

import random

import pytest
import public_tokenizers

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, row int, n int, id int"


@pytest.fixture(scope="session")
def tokenizer():
    return public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="session")
def documents(spark):
    """A documents table of (doc_id, text, lang, source), with columns whose names operators use
    themselves."""

    def build(rows):
        full = [(i, t, lang, source, None if t is None else len(t), "x", 1, 2, 3) for i, t, lang, source in rows]
        return spark.createDataFrame(full, SCHEMA)

    return build


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty, wordless, tiny and very long texts, equal texts and repeated rows."""
    words = [f"w{random.Random(i).randrange(300)}" for i in range(40_000)]
    long_text = " ".join(words)
    return [
        (None, "a row without an id", "en", "a"),
        (None, None, None, None),
        (1, None, "en", "a"),
        (2, "", "en", None),
        (3, " \n\t ", None, "b"),
        (4, "One", "en", "b"),
        (5, "One", "de", "b"),
        (6, "Four words are here", "en", "a"),
        (7, "zwölf Boxkämpfer jagen Viktor quer über den großen Sylter Deich", "de", "c"),
        (8, "zwölf Boxkämpfer jagen Viktor quer über den großen Sylter Deich", "de", "c"),
        (8, "zwölf Boxkämpfer jagen Viktor quer über den großen Sylter Deich", "de", "c"),
        (9, long_text, "en", "a"),
        (10, long_text + " and an end", "en", "a"),
        (11, "x" * 300_000, "en", "c"),
        (12, "中文 😀 12 !!", "zh", ""),
        (-5, "negative ids too", "en", "a"),
    ]
