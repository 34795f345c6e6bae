from __future__ import annotations

import hashlib
import random
import re

import duckdb
import numpy as np
import pytest

from stepwise.llm import chat, fingerprint, language, mixing, near_dup, neighbours, packing, shared, toxicity
from stepwise.llm.queries import CONVERSATIONS


def words_of(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def targets(sizes):
    """Targets by sharing out again and again."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    fixed: set = set()
    while True:
        rest = sum(sizes.values()) - sum(3 * sizes[s] for s in fixed)
        open_ = [s for s in order if s not in fixed]
        goal = {s: rest * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if goal[s] > 3 * sizes[s]]
        if not over:
            return goal | {s: 3 * sizes[s] for s in fixed}
        fixed |= set(over)


def check_mix(rows, result):
    sizes: dict = {}
    for _, text, _, source in rows:
        sizes[source] = sizes.get(source, 0) + words_of(text)
    goal = targets(sizes)
    got = result.collect()
    assert len(got) == len(rows)
    largest = max([1, *(words_of(t) for _, t, *_ in rows)])
    # Sources are told apart by their size and target here.
    taken: dict = {}
    for r in got:
        assert r["taken"] == r["size"] * r["copies"] <= 3 * r["size"]
        key = (r["source_size"], round(r["target"], 4))
        taken[key] = taken.get(key, 0) + r["taken"]
    assert set(taken) == {(sizes[s], round(goal[s], 4)) for s in sizes}
    if len(taken) == len(sizes):
        for (_, target), words in taken.items():
            assert abs(words - target) <= largest


def test_mix_reaches_targets(documents):
    rng = random.Random(4)
    rows = []
    for i in range(900):
        source = rng.choice(["a", "a", "a", "b", None, "ü", "z", "Z", ""])
        rows.append((i, " ".join(["w"] * rng.randrange(0, 60)), None, source))
    rows.append((5000, "tiny source", None, "zz"))
    docs = documents(rows)
    mixed = mixing.mix(docs)
    check_mix(rows, mixed)
    key = lambda r: (r["doc_id"], r["taken"], r["shards"])
    assert sorted(map(key, mixed.collect())) == sorted(map(key, mixing.mix(docs.repartition(5)).collect()))
    out = mixing.shards(docs, mixed)
    assert out.count() == sum(r["copies"] for r in mixed.collect())
    assert set(docs.columns) < set(out.columns)


def test_mix_edge_rows(documents, odd_rows):
    check_mix(odd_rows, mixing.mix(documents(odd_rows)))
    wordless = [(1, None, None, "a"), (2, "", None, None)]
    assert all(r["taken"] == 0 and r["target"] == 0 for r in mixing.mix(documents(wordless)).collect())
    assert mixing.mix(documents([])).count() == 0


def test_tree_deals_all_units_evenly(spark):
    units = [(s, b, p) for s, n in (("a", 40), (None, 23), ("b", 1)) for b in range(n) for p in (1, 2)]
    table = spark.createDataFrame(units, "source string, block int, pass int")
    dealt = mixing.deal(table, levels=3).collect()
    assert sorted((str(r["source"]), r["block"], r["pass"]) for r in dealt) == sorted(
        (str(s), b, p) for s, b, p in units
    )
    counts = np.bincount([r["shard"] for r in dealt], minlength=8)
    assert counts.max() - counts.min() <= 1


def plain_signature(spark, text):
    """The same selection step by step, with Spark's hash of values only."""
    bits = re.findall(r"[^\x20\x09-\x0D]{1,4}", text)
    if not bits:
        return []
    low = fingerprint._PLACES

    def hashes(values, kind):
        rows = spark.createDataFrame([(i, *v) for i, v in enumerate(values)], f"i int, {kind}")
        names = ", ".join(rows.columns[1:])
        return [r[0] for r in rows.orderBy("i").selectExpr(f"xxhash64({names})").collect()]

    kmers = [bits[i : i + fingerprint.KMER] for i in range(max(1, len(bits) - fingerprint.KMER + 1))]
    codes = [h & ~low for h in hashes([(k,) for k in kmers], "k array<string>")]
    seen: dict = {}
    numbers = []
    for c in codes:
        numbers.append(seen.get(c, 0))
        seen[c] = numbers[-1] + 1
    again = hashes(list(zip(codes, numbers, strict=True)), "c long, n int")
    final = [(c if n == 0 else a & ~low) | i for i, (c, n, a) in enumerate(zip(codes, numbers, again, strict=True))]
    kept = [x & ~low for x in sorted(sorted(final)[: fingerprint.KEPT], key=lambda x: x & low)]
    if len(kept) == 1:
        kept.append(None)
    pairs = hashes(list(zip(kept, kept[1:], strict=False)), "a long, b long")
    return [p & 0xFFFFFFFF for p in pairs]


def test_fingerprints(documents, odd_rows, spark):
    rows = [r for r in odd_rows if r[0] != 8] + [(8, odd_rows[8][1], "de", "c"), (20, "a b a b a b " * 40, None, None)]
    got = fingerprint.fingerprints(documents(rows)).collect()
    assert len(got) == len(rows)
    named = sorted((r for r in rows if r[0] is not None), key=lambda r: -r[0])
    by_id = {r["doc_id"]: r for r in got if r["doc_id"] is not None}
    for i, (doc, text, *_) in enumerate(named):
        text, following = text or "", named[(i + 1) % len(named)]
        third = len(text) // 3
        edited = text[: len(text) - third] + (following[1] or "")[:third]
        r = by_id[doc]
        assert r["n_chars"] == len(text)
        assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        if len(text) < 1000:
            assert r["fingerprint"] == "-".join(f"{v:x}" for v in plain_signature(spark, text))
    assert by_id[4]["fingerprint"] == by_id[5]["fingerprint"]
    assert by_id[8]["near_next"] == 1.0
    assert by_id[10]["near_edited"] > 0.2 > by_id[10 - 1]["near_next"]
    assert by_id[1]["fingerprint"] == by_id[2]["fingerprint"] == ""
    assert {r["near_next"] for r in got if r["doc_id"] is None} == {0.0, 1.0}
    repeated = fingerprint.fingerprints(documents(odd_rows)).where("doc_id = 8").collect()
    assert len(repeated) == 2 and repeated[0] == repeated[1]
    alone = fingerprint.fingerprints(documents([(3, "just one text", None, None)])).first()
    assert alone["near_next"] == 1.0
    assert fingerprint.fingerprints(documents([])).count() == 0


def test_fingerprints_feel_order(documents):
    rng = random.Random(6)
    words = ["".join(rng.choices("abcdefghijklmnop", k=8)) for _ in range(400)]
    shuffled = words[200:] + words[:200]
    mixed = rng.sample(words, 400)
    rows = [(3, " ".join(words), None, None), (2, " ".join(shuffled), None, None), (1, " ".join(mixed), None, None)]
    near = {r["doc_id"]: r["near_next"] for r in fingerprint.fingerprints(documents(rows)).collect()}
    assert near[3] > 0.8 and near[2] < 0.1


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(40, 16)) * 3
    x = (centres[rng.integers(0, 40, 3000)] + rng.normal(size=(3000, 16))).astype(np.float32)
    x[100:160] = x[100]
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    bad = [
        (5000, None, 0), (5020, [0.0] * 16, 0), (5040, [float("nan")] + [1.0] * 15, 0),
        (5060, [None] + [1.0] * 15, 0), (5080, [float("inf")] + [1.0] * 15, 0), (None, [1.0] * 16, 0), rows[40],
    ]
    return spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>, label int"), x


def nearest(x, query, k=20):
    score = np.zeros(len(x))
    for j in range(x.shape[1]):
        score += x[query, j].astype(float) * x[:, j].astype(float)
    order = [i for i in np.lexsort((np.arange(len(x)), -score)) if i != query][:k]
    return [(i, score[i]) for i in order]


def test_recall_against_brute_force(vectors):
    table, x = vectors
    got: dict = {}
    for r in neighbours.search(table, table.where("vec_id % 20 = 0")).collect():
        got.setdefault(r["query_id"], []).append(r)
    assert set(got) == set(range(0, 3000, 20))
    hits = 0
    for query, rows in got.items():
        rows.sort(key=lambda r: r["rank"])
        assert [r["rank"] for r in rows] == list(range(1, 21))
        keys = [(-r["score"], r["vec_id"]) for r in rows]
        assert keys == sorted(keys)
        best = dict(nearest(x, query))
        hits += sum(r["vec_id"] in best for r in rows)
        exact = [(r["vec_id"], r["score"]) for r in rows if r["vec_id"] in best]
        assert all(best[i] == s for i, s in exact)
    assert hits / (20 * len(got)) >= 0.9
    # Sixty rows share a vector: of these the smallest ids come, without the query's own.
    same = [r["vec_id"] for r in got[120] if 100 <= r["vec_id"] < 160]
    assert len(same) > 5 and same == [i for i in range(100, 121) if i != 120][: len(same)]


def test_ties_go_to_the_smaller_id(spark):
    """Far more different vectors than asked for share the largest product."""
    rows = [(i, [1.0, float(i)] if i else [1.0, 0.0]) for i in range(400)]
    table = spark.createDataFrame(rows[::-1], "vec_id long, embedding array<double>")
    found = neighbours.search(table, table.where("vec_id = 0")).orderBy("rank").collect()
    assert [(r["vec_id"], r["score"]) for r in found] == [(i, 1.0) for i in range(1, 21)]


def test_few_vectors(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [2.0, 0.0]), (3, [1.0, 1.0, 1.0]), (20, [0.5, 0.5])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = neighbours.search(table, table.where("vec_id % 20 = 0")).collect()
    by = {}
    for r in sorted(got, key=lambda r: r["rank"]):
        by.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert by == {0: [(2, 2.0), (1, 0.5), (20, 0.5)], 20: [(2, 1.0), (0, 0.5), (1, 0.5)]}
    assert neighbours.search(table.limit(0), table).count() == 0
    assert neighbours.search(table, table.limit(0)).count() == 0


def test_partition_stays_balanced():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 8))
    near = neighbours.graph(x, 10)
    first = neighbours.halved(x, 10)
    part = neighbours.balanced_partition(near, first, 10)
    assert np.bincount(part).tolist() == np.bincount(first).tolist() == [40] * 10
    assert (part[near] == part[:, None]).mean() > (first[near] == first[:, None]).mean()


def plain_links(rows):
    """Parents of each (conversation, turn), by scanning earlier messages."""
    def sentences(text):
        plain = re.sub(r"\s+", " ", text).lower()
        return [s.strip() for s in re.split(r"(?<=[.!?]) ", plain) if s.strip()]

    parsed: dict = {}
    for conv, turn, _, text in rows:
        if conv is None or turn is None:
            continue
        levels: dict = {0: []}
        for line in re.split(r"\r\n|\r|\n", text or ""):
            marks = re.match(r"^\s*>[>\s]*", line)
            level = marks.group(0).count(">") if marks else 0
            levels.setdefault(level, []).append(line[marks.end() :] if marks else line)
        own = set(sentences("\n".join(levels.pop(0))))
        parsed.setdefault((conv, turn), []).append((own, levels))
    parents = {}
    for (conv, turn), versions in parsed.items():
        votes: dict = {}
        for _, levels in versions:
            for level, quoted in levels.items():
                for s in sentences(" ".join(quoted)):
                    earlier = [t for (c, t), v in parsed.items() if c == conv and t < turn and any(s in o for o, _ in v)]
                    if earlier:
                        by = votes.setdefault(level, {})
                        by[max(earlier)] = by.get(max(earlier), 0) + 1
        if votes:
            outer = votes[min(votes)]
            parents[conv, turn] = max(outer, key=lambda t: (outer[t], t))
    return parents


def test_quotation_links(spark):
    rng = random.Random(8)
    pool = [f"Sentence {i} of {w}." for i, w in enumerate("alpha beta gamma delta epsilon zeta eta".split())]
    rows = [
        (1, 0, "user", "Hello there. How are you?\nSecond line here."),
        (1, 1, "assistant", "> Hello there. How\n> are you?\nFine, thanks."),
        (1, 2, "user", ">> Hello there. How are you?\r\n> Fine,   THANKS.\n\nGreat news!"),
        (1, 3, "user", "> Second line here.\nOk."),
        (1, 4, "user", "no quote > here"),
        (2, 0, None, None),
        (2, 1, "user", "> Hello there."),
        (None, 1, "user", "> a"),
        (3, None, "user", "> b"),
        (1, 3, "user", "> Second line here.\nOk."),
    ]
    for turn in range(40):
        lines = [rng.choice(["", "> ", ">> "]) + rng.choice(pool) for _ in range(rng.randrange(0, 5))]
        rows.append((4, turn, "user", "\n".join(lines)))
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = chat.link(table).collect()
    assert len(got) == len(rows)
    expected = plain_links(rows)
    found = {(r["conv_id"], r["turn"]): r for r in got}
    assert {k: r["parent_turn"] for k, r in found.items() if r["parent_turn"] is not None} == expected
    for key, r in found.items():
        at, depth = key, 0
        while at in expected:
            at, depth = (at[0], expected[at]), depth + 1
        assert (r["root_turn"], r["depth"]) == (at[1], depth)
        assert not any(line.startswith(">") for line in r["content"].split("\n"))
    # The registered SQL gives the same rows.
    con = duckdb.connect()
    con.register("conversations", table.toArrow())
    by_sql = con.execute(CONVERSATIONS).to_arrow_table().select(chat.link(table).columns).to_pylist()
    assert sorted(map(repr, by_sql)) == sorted(repr(r.asDict()) for r in got)
    assert found[1, 2]["content"] == "Great news!" and found[1, 2]["quote_levels"] == 2
    assert chat.link(table.limit(0)).count() == 0
    in_order = [r["turn"] for r in chat.ordered(chat.link(table.where("conv_id = 1").distinct())).collect()]
    assert in_order == [0, 1, 2, 3, 4]


def parted_links(rows):
    """Parents where sentences that are not found count by their passages, and these by their lines;
    plain_links has the rule for whole sentences only."""
    def parts(lines):
        """Sentences of (passage, words), each as a list of passages of lists of lines."""
        out, at = [], None
        for run, words in lines:
            for piece in re.split(r"(?<=[.!?])\s+", words.strip()):
                piece = " ".join(re.split(r"\s+", piece.strip())).lower()
                if not piece:
                    continue
                if at is None:
                    out.append(at := {})
                at.setdefault(run, []).append(piece)
                if piece[-1] in ".!?":
                    at = None
        return [list(s.values()) for s in out]

    def text(pieces):
        return " ".join(pieces)

    messages = []
    for conv, turn, _, body in rows:
        levels: dict = {}
        run, before = 0, None
        for line in re.split(r"\r\n|\r|\n", body):
            marks = re.match(r"^\s*>[>\s]*", line)
            level = marks.group(0).count(">") if marks else 0
            run += level != before
            before = level
            levels.setdefault(level, []).append((run, line[marks.end() :] if marks else line))
        own = set()
        for s in parts(levels.pop(0, [])):
            own |= {text(text(p) for p in s)} | {text(p) for p in s} | {x for p in s for x in p}
        messages.append((conv, turn, own, {n: parts(x) for n, x in levels.items()}))
    parents = {}
    for conv, turn, _, levels in messages:
        def source(s, conv=conv, turn=turn):
            return max((t for c, t, own, _ in messages if c == conv and t < turn and s in own), default=None)

        for level in sorted(levels):
            votes = []
            for s in levels[level]:
                whole = source(text(text(p) for p in s))
                if whole is not None:
                    votes.append(whole)
                    continue
                for p in s:
                    votes += [source(text(p))] if source(text(p)) is not None else [source(x) for x in p]
            votes = [v for v in votes if v is not None]
            if votes:
                parents[conv, turn] = max(votes, key=lambda t: (votes.count(t), t))
                break
    return parents


def test_inline_quotations_without_stops(spark):
    rows = [
        (1, 0, "user", "how do I install it"),
        (1, 1, "assistant", "use pip"),
        (1, 2, "user", "> how do I install it\nrun setup\n> use pip\nagreed"),
        (2, 0, "user", "first item\nsecond item\nthird  item"),
        (2, 1, "user", "something else"),
        (2, 2, "user", "> Second item\nyes"),
        (3, 0, "user", "one line of\na sentence that is wrapped"),
        (3, 1, "user", "> one line\n> of a sentence\nno\n> that is wrapped\nwhy"),
        (3, 2, "user", "> no\n> why"),
        (4, 0, "user", "install python\n> nothing\nthen use it"),
        (4, 1, "user", "well"),
        (4, 2, "user", "> then use it\nok"),
    ]
    rng = random.Random(3)
    pool = ["alpha", "beta two", "gamma.", "delta", "Mid. epsilon", "zeta!", "eta  x", ""]
    for turn in range(60):
        lines = [rng.choice(["", "> ", "> ", ">> "]) + rng.choice(pool) for _ in range(rng.randrange(1, 6))]
        rows.append((9, turn, "user", "\n".join(lines)))
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = {(r["conv_id"], r["turn"]): r["parent_turn"] for r in chat.link(table).collect()}
    assert {k: v for k, v in found.items() if v is not None} == parted_links(rows)
    assert (found[1, 2], found[2, 2], found[3, 1], found[3, 2], found[4, 2]) == (1, 0, 0, 1, 0)


def test_fingerprints_of_text_without_white_space(documents):
    rng = random.Random(9)
    han = "".join(chr(rng.randrange(0x4E00, 0x9FA5)) for _ in range(3000))
    emoji = "".join(chr(rng.randrange(0x1F600, 0x1F640)) for _ in range(3000))
    code = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz(){};=.", k=3000))
    spaced = " ".join("https://example.org/" + "".join(rng.choices("abcdefgh/?=&", k=80)) for _ in range(40))
    texts = []
    for text in (han, emoji, code, spaced):
        texts += ["+" + text, text, text[1:], text[:1500] + "+" + text[1500:]]
    # The next of a text is the one before it in this list.
    docs = documents([(i, t, None, None) for i, t in enumerate(texts)])
    near = {r["doc_id"]: r["near_next"] for r in fingerprint.fingerprints(docs).collect()}
    assert all((near[i] > 0.7) == (i % 4 > 0) for i in range(len(texts)))

    def bits(text):
        out = []
        for word in re.findall(r"[^\x20\x09-\x0D]+", text):
            head = max(0, len(word) - fingerprint.LONG)
            out += [word[i : i + 4] for i in range(head)]
            out += [word[i : i + 4] for i in range(head, len(word), 4)]
        return out

    words = [chr(0x1F600) * n for n in range(15, 20)] + ["abcdefghijklmnopqrstuvwxyz"[:n] for n in range(1, 27)]
    for text in [*texts, " ".join(words), "\t".join(words)]:
        row = documents([(1, text, None, None)]).select(fingerprint.bits_of("text").alias("b")).first()
        assert row["b"] == bits(text)


def test_fingerprints_move_texts_once(spark, documents, monkeypatch):
    plans = []

    def saved(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return stored(df)

    stored = fingerprint.saved
    monkeypatch.setattr(fingerprint, "saved", saved)
    settings = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        fingerprint.fingerprints(documents([(i, f"text {i}", None, None) for i in range(20)])).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert any(" ReusedExchange [doc_id" in line and "text" in line for line in plans[-1].splitlines())


def test_tasks_give_memory_back(monkeypatch):
    calls = []
    monkeypatch.setattr(shared, "give_back", lambda: calls.append("given"))
    assert list(shared.lean(lambda batches: (b + 1 for b in batches))([1, 2])) == [2, 3] and calls == ["given"]
    tasks = [toxicity._fitted, toxicity._score, language._predict, near_dup._sketches, near_dup._compare, packing._pieces]
    assert all(hasattr(task, "__wrapped__") for task in tasks)
