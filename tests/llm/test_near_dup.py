from __future__ import annotations

import random
import re

import numpy as np
import pytest

from stepwise.llm import near_dup
from stepwise.llm.components import components


def shingles(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def brute_force(rows):
    """Smallest reachable id of each row, by comparing all pairs."""
    sets = [(i, shingles(t)) for i, t in rows if i is not None]
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for at, (i, a) in enumerate(sets):
        for j, b in sets[:at]:
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                low, high = sorted((find(i), find(j)))
                root[high] = low
    return {i: find(i) for i in root}


def found(table):
    return {r["doc_id"]: r for r in table.collect()}


def test_edge_rows(documents, odd_rows):
    result = near_dup.near_duplicates(documents(odd_rows))
    rows = result.collect()
    assert len(rows) == len(odd_rows)
    expected = brute_force([(i, t) for i, t, *_ in odd_rows])
    for r in rows:
        if r["doc_id"] is None:
            assert (r["component_id"], r["kept"]) == (None, False)
        else:
            assert r["component_id"] == expected[r["doc_id"]]
            assert r["kept"] == (r["doc_id"] == r["component_id"])
    sizes = {r["doc_id"]: r["n_shingles"] for r in rows}
    assert (sizes[1], sizes[2], sizes[3], sizes[4], sizes[6]) == (0, 0, 0, 1, 1)
    assert near_dup.near_duplicates(documents([]).select("doc_id", "text")).count() == 0


@pytest.mark.parametrize("heavy", [2, near_dup.HEAVY])
def test_groups_against_brute_force(documents, monkeypatch, heavy):
    """Chains of edits, a popular passage and a large group, also with nearly all lists heavy."""
    monkeypatch.setattr(near_dup, "HEAVY", heavy)
    rng = random.Random(3)
    vocabulary = [f"{a}{b}" for a in "abcdefgh" for b in "klmnopqr"]
    make = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    passage, texts = make(60), []
    for _ in range(25):
        texts.append(make(rng.randrange(1, 30)) + passage + make(rng.randrange(1, 30)))
    for size in (6, 40, 150):
        base = make(size)
        for _ in range(30):
            words = list(base)
            for _ in range(rng.randrange(0, 4)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            texts.append(words[: rng.randrange(max(1, size - 12), size + 1)])
    chain = make(100)
    for step in range(12):
        texts.append(chain[step * 4 : step * 4 + 60])
    rows = [(1000 - i, " ".join(w)) for i, w in enumerate(texts)]
    result = found(near_dup.near_duplicates(documents([(i, t, None, None) for i, t in rows])))
    assert {i: r["component_id"] for i, r in result.items()} == brute_force(rows)


def test_components_of_long_chain_and_star(spark):
    links = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(200)] + [(7, 7)]
    table = spark.createDataFrame(links, "a long, b long")
    got = {r["node"]: r["root"] for r in components(table).collect()}
    assert got == {i: 0 for i in range(301)} | {i: 1000 for i in range(1000, 1200)}
    assert components(table.limit(0)).count() == 0


def test_long_unlike_words_are_not_linked(documents):
    one = "a"
    for _ in range(11):
        one += one.translate(str.maketrans("ab", "ba"))
    out = near_dup.near_duplicates(documents([(1, one, "en", "a"), (2, one.translate(str.maketrans("ab", "ba")), "en", "a")]))
    assert sorted(r["component_id"] for r in out.collect()) == [1, 2]


def test_pairs_beside_pivots_of_a_group_of_near_copies(documents, monkeypatch):
    """Pairs are some a text, not a share of all 79,800."""
    rng = random.Random(8)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(400):
        words = list(base)
        for place in rng.sample(range(150), 1 + i % 5):
            words[place] = f"x{rng.randrange(10**9)}"
        rows.append((i, " ".join(words)))
    paired, pairs = [], near_dup._pairs_beside_pivots

    def counted(*args):
        out = pairs(*args)
        paired.append(out.count())
        return out

    monkeypatch.setattr(near_dup, "_pairs_beside_pivots", counted)
    result = found(near_dup.near_duplicates(documents([(i, t, None, None) for i, t in rows])))
    assert {i: r["component_id"] for i, r in result.items()} == brute_force(rows)
    assert sum(paired) < 10 * len(rows)


def test_parities_differ_at_most_as_often_as_sets():
    rng = np.random.default_rng(5)
    sets = [np.zeros(0, np.int64), *(np.unique(rng.integers(-(2**62), 2**62, n)) for n in (1, 7, 300, 4000))]
    sets += [np.unique(np.append(sets[3][:-2], 5)), sets[3]]
    bits = [np.array(x, np.int64) for x in near_dup._parities(sets).to_pylist()]
    assert {len(x) for x in bits} == {near_dup.PARITIES // 64}
    for a, p in zip(sets, bits, strict=True):
        for b, q in zip(sets, bits, strict=True):
            ones = int(np.bitwise_count(p ^ q).sum())
            assert ones <= len(np.setxor1d(a, b))
    assert (bits[3] == bits[-1]).all() and near_dup._parities([]).to_pylist() == []


def test_pairs_beside_pivots_meet_once(spark, monkeypatch):
    """Near copies of a long text far from the pivot meet once, not at each value they share."""
    rng = np.random.default_rng(9)
    pivot, common, loose = (rng.integers(1, 2**62, n) for n in (400, 300, 400))
    sets = [np.union1d(np.append(pivot[:100], common), rng.integers(1, 2**62, 10)) for _ in range(30)]
    sets += [np.union1d(np.append(pivot[:300], rng.choice(loose, 90)), rng.integers(1, 2**62, 5)) for _ in range(30)]
    apart = [np.setxor1d(pivot, s) for s in sets]
    odd = near_dup._parities(apart).to_pylist()
    rows = [
        (i + 1, 0, len(s), len(pivot), x.tolist(), p, False)
        for i, (s, x, p) in enumerate(zip(sets, apart, odd, strict=True))
    ]
    schema = "a long, b long, n_a long, n_b long, apart array<long>, parities array<long>, linked boolean"
    compared = spark.createDataFrame(rows, schema)
    met = [tuple(r) for r in near_dup._meetings(compared).collect()]
    pairs = {tuple(r) for r in near_dup._pairs_beside_pivots(compared).collect()}
    assert len([p for p in met if max(p) <= 30]) == 30 * 29 // 2
    assert len(met) < 2 * len(pairs)
    for i, s in enumerate(sets):
        for j, t in enumerate(sets[:i]):
            shared = len(np.intersect1d(s, t))
            assert 100 * shared < 75 * (len(s) + len(t) - shared) or (j + 1, i + 1) in pairs
    monkeypatch.setattr(near_dup, "BEFORE", 1)
    assert {tuple(r) for r in near_dup._meetings(compared).collect()} == pairs
