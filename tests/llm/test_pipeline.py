from __future__ import annotations

import corpus_pipeline
from stepwise.llm import mixing, near_dup
from stepwise.llm.shared import saved

SF = "/root/testdata/sf0.001"


def test_stages_on_given_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    toxic = {r["doc_id"] for r in spark.read.parquet(f"{SF}/labels.parquet").where("toxic = 1").collect()}
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = saved(stage(spark, before, SF))
        assert after.schema.names == docs.schema.names, name
        kept = {r["doc_id"] for r in after.select("doc_id").collect()}
        held = {r["doc_id"] for r in before.select("doc_id").collect()}
        assert kept <= held and len(kept) > 0.5 * len(held)
        if name == "toxicity":
            assert len(held - kept - toxic) <= 0.03 * len(held)
        if name == "language":
            assert len(kept) >= len(held) - 2
        if name == "near_duplicates":
            groups = near_dup.near_duplicates(before).where("kept").select("doc_id").collect()
            assert kept == {r["doc_id"] for r in groups} and after.count() == len(kept)
        if name == "mixing":
            assert after.groupBy("doc_id").count().where("count > 3").count() == 0
        before = after
    packed = corpus_pipeline.STAGES[-1][1](spark, before, SF)
    assert packed.where("start = 0").count() == before.count()
    assert corpus_pipeline.run(spark, SF).count() == packed.count()


def test_stages_on_odd_and_empty_rows(spark, documents, odd_rows):
    for rows in (odd_rows, []):
        docs = documents(rows)
        for _, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SF)
            out.collect()


def test_mixing_takes_each_row_by_its_own_source(spark, documents):
    rows = [(i if i % 5 else None, f"a{i} " + "word " * (i % 40), None, "a") for i in range(240)]
    rows += [(i if i % 3 else None, f"b{i} " + "word " * (i % 7), None, "b") for i in range(30)]
    rows += [(7, "b again", None, "b"), (None, None, None, "b"), (None, "alone", None, None)]
    docs = documents(rows)
    taken: dict = {}
    for r in mixing.mix(docs).collect():
        taken[r["source_size"]] = taken.get(r["source_size"], 0) + r["taken"]
    copies: dict = {}
    for r in corpus_pipeline.mix_sources(spark, docs, SF).collect():
        key = (r["doc_id"], r["text"], None, r["source"])
        copies[key] = copies.get(key, 0) + 1
    assert set(copies) <= set(rows)
    size = lambda text: len((text or "").split())
    for source in ("a", "b", None):
        whole = sum(size(r[1]) for r in rows if r[3] == source)
        assert sum(size(k[1]) * n for k, n in copies.items() if k[3] == source) == taken[whole]
    # The small sources give all their rows three times, whatever the large one's rows of these ids do.
    assert all(copies[r] == 3 for r in rows if r[3] != "a")
    assert 0 < sum(r not in copies for r in rows if r[3] == "a")
    again = corpus_pipeline.mix_sources(spark, docs.repartition(5), SF).collect()
    assert len(again) == sum(copies.values()) and {(r["doc_id"], r["text"], None, r["source"]) for r in again} == set(copies)


def test_unlike_texts_of_one_id_stay(spark, documents):
    text = lambda k: " ".join(f"{k}{i}" for i in range(30))
    rows = [(1, text("a"), "en", "s"), (1, text("b"), "en", "s"), (1, text("b"), "en", "s"), (1, None, "en", "s")]
    rows += [(2, text("b") + " end", "en", "s"), (3, text("c"), "en", "s"), (4, text("c"), "en", "s"), (None, text("c"), "en", "s")]
    out = corpus_pipeline.drop_near_duplicates(spark, documents(rows), SF).collect()
    got = sorted(((r["doc_id"], r["text"]) for r in out), key=repr)
    want = [(1, text("a")), (1, None), (2, text("b") + " end"), (3, text("c")), (None, text("c"))]
    assert got == sorted(want, key=repr)
