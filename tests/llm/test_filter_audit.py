from __future__ import annotations

import random
import re
from itertools import permutations

import duckdb
import pytest

from stepwise.llm import filter_audit
from stepwise.llm.queries import FILTER_AUDIT

WORD = re.compile("[^\x20\x09-\x0d]+")
LABELS = "doc_id long, quality int, toxic int, text string, part string"


def fails(doc_id, text, least):
    words = WORD.findall(text)
    return (
        len(words) < 50,
        100 * len(set(words)) < 65 * len(words),
        100 * len(re.findall("[A-Z]", text)) > 5 * len(text),
        re.search("[#$%&*|]", text) is not None,
        doc_id is not None and doc_id > least[text],
    )


def brute(rows, labels):
    """Every row against every order, one filter after the other."""
    rows = [(i, text or "", source or "") for i, text, _, source in rows]
    least: dict = {}
    for i, text, _ in rows:
        if i is not None:
            least[text] = min(least.get(text, i), i)
    good = {i for i, quality, _, *_ in labels if quality == 1}
    toxic = {i for i, _, bad, *_ in labels if bad == 1}
    out: dict = {}
    for part in {r[2] for r in rows}:
        known = [(i, fails(i, text, least)) for i, text, source in rows if source == part]
        for order in permutations(range(5)):
            left = known
            for step, f in enumerate(order, 1):
                gone = [r for r in left if r[1][f]]
                left = [r for r in left if not r[1][f]]
                out[part, "".join("ABCDE"[x] for x in order), step] = [
                    len(left),
                    len(gone),
                    sum(x[f] for _, x in known) - len(gone),
                    sum(x[f] and sum(x) == 1 for _, x in known),
                    sum(i in good for i, _ in gone if i is not None),
                    sum(i in toxic for i, _ in gone if i is not None),
                ]
    total: dict = {}
    for (part, order, step), counts in out.items():
        key = part, order[step - 1]
        total[key] = total.get(key, 0) + counts[1]
    return {(*k, *v, total[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    out = []
    for i in range(300):
        words = [f"{rng.choice('abcdefg')}{rng.randrange(rng.choice([20, 500]))}" for _ in range(rng.choice([3, 49, 50, 80]))]
        if rng.random() < 0.3:
            words = [w.upper() if rng.random() < 0.2 else w for w in words]
        if rng.random() < 0.2:
            words.append(rng.choice("#$%&*|"))
        out.append((i, rng.choice(" \n").join(words), "en", rng.choice(["a", "b", "", None])))
    copies = [(1000 + i, out[rng.randrange(300)][1], "en", rng.choice(["a", "c"])) for i in range(120)]
    return out + copies


@pytest.fixture(scope="module")
def labels(rows):
    rng = random.Random(4)
    out = [(r[0], rng.choice([0, 1, None]), rng.choice([0, 1, None]), "x", "y") for r in rows if rng.random() < 0.6]
    return out + [(None, 1, 1, "x", "y"), (5, 0, 1, "x", "y"), (5, 1, 0, "x", "y"), (99_999, 1, 1, "x", "y")]


NAMES = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def table(df):
    out = [tuple(r) for r in df.select(NAMES).collect()]
    assert len(out) == len(set(out))
    return set(out)


@pytest.mark.parametrize("cells", [None, 1 << 15, 1 << 18, 2])
def test_against_every_order(spark, documents, rows, labels, cells):
    """Also with a sketch that is so full that it clears nothing."""
    out = filter_audit.audit(documents(rows), spark.createDataFrame(labels, LABELS), cells)
    assert table(out) == brute(rows, labels)


def test_odd_rows(spark, documents, odd_rows, labels):
    for extra in ([], [(None, "a row without an id", "en", "a")] * 3 + [(2, "", "en", None), (12, "twice", "", "")]):
        out = filter_audit.audit(documents(odd_rows + extra), spark.createDataFrame(labels, LABELS))
        assert table(out) == brute(odd_rows + extra, labels)
    assert filter_audit.audit(documents([]), spark.createDataFrame([], LABELS)).collect() == []


def test_sql_says_the_same(spark, documents, rows, labels):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?)", rows)
    con.execute("CREATE TABLE labels (doc_id BIGINT, quality INT, toxic INT, text VARCHAR, part VARCHAR)")
    con.executemany("INSERT INTO labels VALUES (?, ?, ?, ?, ?)", labels)
    found = con.execute(FILTER_AUDIT).fetchdf()[NAMES]
    assert set(found.itertuples(index=False, name=None)) == brute(rows, labels)


def test_sketch_clears_unique_texts(spark, documents, rows):
    """No repeat is cleared, and most unique texts are."""
    docs = documents(rows)
    cells = filter_audit.sketch_cells(len(rows))
    assert cells == 1 << 15
    sketch = filter_audit.repeated_cells(docs, cells)
    found = filter_audit._possible_repeats(docs.select("doc_id", "text"), sketch, cells).collect()
    texts = [r[1] for r in rows]
    for r in found:
        if texts.count(r["text"]) > 1:
            assert r["possible"]
    assert sum(r["possible"] and texts.count(r["text"]) == 1 for r in found) < 0.02 * len(rows)
    assert filter_audit.sketch_cells(10**12) == filter_audit.MOST_CELLS
