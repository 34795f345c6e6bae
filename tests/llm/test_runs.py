from __future__ import annotations

import hashlib
import math
import random
import zlib

from hypothesis import given, settings
from hypothesis import strategies as st

from stepwise.llm import periodic


def brute(words, least=6, exponent=4):
    """Every stretch of every period that no neighbour continues, without those of a smaller period."""
    out, n = [], len(words)
    for q in range(1, n // exponent + 1):
        start = 0
        while start + q < n:
            end = start
            while end + q < n and words[end] == words[end + q]:
                end += 1
            size = end + q - start
            smaller = any(
                all(words[i] == words[i + p] for i in range(start, start + size - p)) for p in range(1, q)
            )
            if end > start and size >= max(least, exponent * q) and not smaller:
                out.append((start, size, q))
            start = end + 1
    return sorted(out, key=lambda run: (run[0], run[2]))


def sample(rng):
    words = [rng.randrange(rng.choice([1, 2, 3, 6])) for _ in range(rng.randrange(70))]
    for _ in range(rng.randrange(4) if words else 0):
        at, period = rng.randrange(len(words)), rng.randrange(1, 9)
        for i in range(at, min(len(words), at + rng.randrange(50))):
            words[i] = words[at + (i - at) % period]
    return words


def test_runs_against_brute_force():
    rng = random.Random(5)
    for _ in range(1500):
        words = sample(rng)
        assert periodic.runs(words) == brute(words)
        assert periodic.stretch_runs(words) == brute(words)
        assert periodic.stretch_runs(words, 2, 2) == brute(words, 2, 2)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=40), st.integers(1, 9), st.integers(0, 60))
def test_runs_of_repeated_parts(words, times, more):
    words = (words * times)[:120] + [9] * (more % 12) + words[:more]
    assert periodic.runs(words) == brute(words)


def test_access_meets_few_segments():
    """All accesses together meet n log n segments at most."""
    rng = random.Random(1)
    for words in ([1] * 20_000, [rng.randrange(30) for _ in range(5000)] * 4):
        automaton = periodic.Automaton(words)
        forest = periodic.Forest(automaton.link)
        met = sum(sum(1 for _ in forest.access(s, i)) for i, s in enumerate(automaton.prefixes))
        assert met <= len(words) * math.log2(len(words))


def digest(raw: bytes) -> str:
    return hashlib.sha256(raw).hexdigest()


def expected(doc_id, text):
    """The contract's row by brute force."""
    words = (text or "").encode().split()
    n = len(words)
    h = None if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    found = brute(words)
    gone = {i for s, size, q in found for i in range(s + q, s + size)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else (None, None, None)
    lines = "".join(f"{s},{size},{q}\n" for s, size, q in found)
    kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
    milli = None if best[0] is None else 1000 * best[1] // best[2]
    return (len(found), *best, milli, digest(lines.encode()), digest(kept))


COLUMNS = ["n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def test_rows_against_brute_force(spark, documents):
    rng = random.Random(7)
    rows = [(i, " ".join(f"w{w}" for w in sample(rng)), "en", "a") for i in range(250)]
    rows += [(i, " \t".join(f"é{rng.randrange(9)}" for _ in range(rng.randrange(120))), "en", "a") for i in range(250, 400)]
    rows += [(None, "a b " * 9, "en", "a"), (None, None, None, None), (500, None, "en", "a"), (501, "", "en", "a")]
    rows += [(502, " \n\x0b ", "en", "a"), (3, rows[3][1], "en", "b"), (503, "x y " * 8, "en", "b")]
    rows += [(i, " ".join(f"w{w}" for w in sample(rng)), "en", "c") for i in range(600, 900)]
    out = periodic.digests(periodic.find_runs(periodic.with_periods(documents(rows)))).collect()
    got = sorted(((r["doc_id"], *(r[c] for c in COLUMNS)) for r in out), key=repr)
    assert got == sorted(((r[0], *expected(r[0], r[1])) for r in rows), key=repr)
    assert sum(r["n_runs"] for r in out) > 200


def test_odd_rows_and_empty_table(spark, documents, odd_rows):
    out = periodic.find_runs(documents(odd_rows)).collect()
    assert len(out) == len(odd_rows)
    for r in out:
        if r["doc_id"] in (1, 2, 3):
            assert r["runs"] == [] and r["collapsed"] == ""
    assert periodic.digests(periodic.find_runs(periodic.with_periods(documents([])))).collect() == []


def test_very_long_runs(spark, documents):
    text = "start " + "one two three " * 40_000 + "end"
    (row,) = periodic.find_runs(documents([(1, text, "en", "a")])).collect()
    assert [tuple(r) for r in row["runs"]] == [(1, 120_000, 3)]
    assert row["collapsed"] == "start one two three end"
