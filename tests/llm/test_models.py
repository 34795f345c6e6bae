from __future__ import annotations

import math
import random
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest

from stepwise.llm import language, quality, toxicity
from stepwise.llm.textscan import text_bytes

SYLLABLES = {"aa": ["ka", "ro", "mi", "tu"], "bb": ["ské", "přá", "žu", "dně"], "cc": ["xo", "qui", "zat", "wem"]}


def sentence(lang, rng, words=12):
    return " ".join("".join(rng.choices(SYLLABLES[lang], k=rng.randrange(1, 4))) for _ in range(words)) + "."


def ppm_bits(texts, text, order):
    """Code length by context counts, looked up anew for each byte."""
    counts: dict = {}
    for t in texts:
        raw = t.encode()
        for i in range(len(raw)):
            for k in range(order + 1):
                if i >= k:
                    counts.setdefault(raw[i - k : i], {}).setdefault(raw[i], 0)
                    counts[raw[i - k : i]][raw[i]] += 1
    bits, raw = 0.0, text.encode()
    for i, byte in enumerate(raw):
        for k in range(min(order, i), -1, -1):
            seen = counts.get(raw[i - k : i])
            if seen is None:
                continue
            total, distinct = sum(seen.values()), len(seen)
            if byte in seen:
                bits -= math.log2(seen[byte] / (total + distinct))
                break
            bits -= math.log2(distinct / (total + distinct))
        else:
            bits += 8
    return bits


def grams(texts, order):
    counts: dict = {}
    for t in texts:
        raw = t.encode()
        for size in range(1, order + 2):
            for i in range(len(raw) - size + 1):
                key = (0, size, int.from_bytes(raw[i : i + size], "big"))
                counts[key] = counts.get(key, 0) + 1
    return [(*k, n) for k, n in counts.items()]


@pytest.mark.parametrize("order", [0, 1, 3])
def test_code_lengths_against_plain_ppm(order):
    rng = random.Random(1)
    texts = [sentence("bb", rng) for _ in range(5)]
    model = language.build(["bb"], grams(texts, order), order)
    asked = [texts[0], sentence("bb", rng), sentence("aa", rng), "", "x", "ské", "☃ snow"]
    got = language.code_lengths(model, pa.array(asked), order)[:, 0]
    # The plain form knows no context at the end of a training text; such bytes differ.
    for text, bits in zip(asked, got, strict=True):
        assert bits == pytest.approx(ppm_bits(texts, text, order), rel=1e-3)


def test_language_of_whole_texts(documents, odd_rows):
    rng = random.Random(2)
    rows = [(i, sentence(lang, rng), lang, "s") for i, lang in enumerate(["aa", "bb", "cc"] * 40)]
    rows += [(1000, None, "aa", "s"), (1001, "12 345 !!", "aa", "s"), (1002, "", None, None), (None, rows[0][1], "aa", None)]
    rows += [(1003, "中文", None, None), (1004, sentence("cc", rng, 60_000), "cc", "s"), rows[1]]
    got = language.identify(documents(rows)).collect()
    assert len(got) == len(rows)
    by_id = {r["doc_id"]: r for r in got}
    for i, text, lang, _ in rows[:120]:
        assert by_id[i]["lang_pred"] == lang
        assert by_id[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0)
        assert 0 <= by_id[i]["score"] <= 1
    assert [by_id[i]["lang_pred"] for i in (1000, 1001, 1002, 1004)] == ["und", "und", "und", "cc"]
    assert by_id[1003]["bits"] > language.RAW_BITS
    assert by_id[None]["lang_pred"] == "aa" and by_id[None]["held_out"] is False
    assert {r["lang_pred"] for r in language.identify(documents([(1, "abc", None, None)])).collect()} == {"und"}
    assert language.identify(documents([])).count() == 0


def forward_backward(odds, moves):
    """Marginals of one chain by adding up all paths."""
    n = len(odds)
    total, hits = 0.0, np.zeros(n)
    for path in range(1 << n):
        states = [(path >> i) & 1 for i in range(n)]
        weight = math.exp(
            sum(o * s for o, s in zip(odds, states, strict=True))
            + sum(moves[a][b] for a, b in zip(states, states[1:], strict=False))
        )
        total += weight
        hits += weight * np.array(states)
    return hits / total, math.log(total)


def test_marginals_against_all_paths():
    rng = np.random.default_rng(0)
    lengths = [1, 5, 2, 7, 1]
    odds, moves = rng.normal(size=sum(lengths)), rng.normal(size=(2, 2))
    starts = np.cumsum([0, *lengths[:-1]])
    got, moved, log_z = toxicity.Chains(starts, len(odds)).marginals(odds, moves)
    expected = [forward_backward(odds[s : s + n], moves) for s, n in zip(starts, lengths, strict=True)]
    assert np.allclose(got, np.concatenate([m for m, _ in expected]))
    assert log_z == pytest.approx(sum(z for _, z in expected))
    assert moved.sum() == pytest.approx(sum(lengths) - len(lengths))


@pytest.fixture(scope="module")
def labelled_rows(spark, documents):
    rng = random.Random(5)
    rows, labels = [], []
    for i in range(500):
        words = sentence(rng.choice(["aa", "cc"]), rng, 30).split()
        toxic = i % 4 == 0
        if toxic:
            words[rng.randrange(30)] = rng.choice(["blarg", "Snork,", "snorkly"])
        bad = i % 5 == 0
        if bad:
            words = [w + "###" for w in words]
        rows.append((i, " ".join(words), "en", "s"))
        labels.append((i, 0 if bad else 1, int(toxic)))
    extra = [(900, None, None, None), (901, "", None, None), (None, "a Snork here", None, None), rows[3]]
    extra.append((902, sentence("aa", rng, 50_000) + " blarg", None, None))
    labels += [(900, 1, 1), (None, 1, 0), (903, None, None), (904, 0, 0)]
    return documents(rows + extra), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), labels[:500]


def test_toxic_documents_and_spans(labelled_rows, documents):
    docs, labels, truth = labelled_rows
    got = {r["doc_id"]: r for r in toxicity.detect(docs, labels).collect()}
    assert len(got) == 504
    wrong = [i for i, _, toxic in truth if got[i]["predicted"] != toxic]
    assert len(wrong) <= 5
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    spans = [texts[i][s["start"] : s["end"]] for i, _, toxic in truth if toxic for s in got[i]["spans"]]
    assert spans and {w.rstrip("#,").lower() for w in spans} <= {"blarg", "snork", "snorkly"}
    assert got[900]["predicted"] == got[901]["predicted"] == 0
    assert got[None]["held_out"] is False and got[902]["spans"]
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items() if i is not None)
    assert toxicity.detect(documents([]), labels).count() == 0
    assert toxicity.detect(docs, labels.limit(0)).where("predicted = 1").count() == 0


def test_quality_scores(labelled_rows, documents):
    docs, labels, truth = labelled_rows
    got = {r["doc_id"]: r for r in quality.rank(docs, labels).collect()}
    assert len(got) == 504
    assert all(got[i]["predicted"] == good for i, good, _ in truth)
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items() if i is not None)
    assert got[900]["score"] == got[901]["score"] and got[None]["held_out"] is False
    assert all((r["score"] >= quality.CUT) == r["predicted"] for r in got.values())
    assert quality.rank(documents([]), labels).count() == 0
    assert quality.rank(docs, labels.limit(0)).count() == docs.count()


def test_quality_is_fitted_to_all_pairs(spark, documents):
    rng = random.Random(5)
    rows, labels = [], []
    for i in range(1200):
        good = i % 5 > 0
        words = [rng.choice(["aa", "Bb", "c1", "dd,", "ee#"]) for _ in range(rng.randrange(3, 30))]
        rows.append((i, " ".join(words) + ("" if good and i % 7 else rng.choice(["!", "###", " X"])), None, None))
        labels.append((i, int(good), 0))
    docs, marks = documents(rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = quality.train(docs, marks)
    used = [i for i in range(1200) if zlib.crc32(str(i).encode()) % 4 != 2]
    x = quality.features(pa.array([rows[i][1] for i in used]))
    good = np.array([labels[i][1] for i in used], bool)
    assert np.allclose(model.mean, x.mean(axis=0), atol=1e-8)
    assert np.allclose(model.spread, x.std(axis=0) + 1e-6, atol=1e-8)
    z = model.standard(x)
    gap = (z[good][:, None] - z[~good]).reshape(-1, x.shape[1])
    w, ridge = np.zeros(x.shape[1]), quality.RIDGE * np.eye(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-gap @ w))
        slope = gap.T @ (p - 1) / len(gap) + ridge @ w
        curve = (gap * (p * (1 - p))[:, None]).T @ gap / len(gap) + ridge
        w = w - np.clip(np.linalg.solve(curve, slope), -2, 2)
    assert np.allclose(model.weights, w, atol=1e-5)
    # The curve passes through CUT between the strengths around the share of bad ones.
    strength, bad = np.sort(model.strengths(x)), int((~good).sum())
    cut = (strength[bad - 1] + strength[bad]) / 2
    assert abs(model.scale * cut + model.shift - np.log(quality.CUT / (1 - quality.CUT))) < 1e-6
    again = quality.train(docs.repartition(7), marks)
    assert (again.weights == model.weights).all() and again.shift == model.shift


def test_features_do_not_depend_on_neighbours():
    texts = ["One two two. ", None, "", "UP! ### |", "a b a b a b\na b a b"]
    together = quality.features(pa.array(texts))
    for i, text in enumerate(texts):
        assert np.allclose(together[i], quality.features(pa.array([text], pa.string()))[0])
    assert len(text_bytes(pa.array([], pa.string()))[1]) == 1


def test_memory_of_the_toxicity_fit():
    """Fitting 690,000 tokens takes less than 90 MB at the peak."""
    rng = random.Random(4)
    texts = pa.array([" ".join(f"w{rng.randrange(30_000)}" for _ in range(300)) for _ in range(2300)])
    tracemalloc.start()
    try:
        toxicity.fit(texts, np.arange(2300) % 8 == 0)
        assert tracemalloc.get_traced_memory()[1] < 90 << 20
    finally:
        tracemalloc.stop()


def test_tokens_found_for_some_texts_at_a_time():
    rng = random.Random(6)
    texts = [None, "", "one. two! three", *(sentence("aa", rng, rng.randrange(1, 150)) for _ in range(40)), " "]
    whole, some = toxicity.tokens(pa.array(texts)), toxicity.chained_features(pa.array(texts), 7)
    for name in ("features", "chain_starts", "texts"):
        assert np.array_equal(getattr(whole, name), getattr(some, name)), name
    assert len(toxicity.chained_features(pa.array([], pa.string())).texts) == 0
