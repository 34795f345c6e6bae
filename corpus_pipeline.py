"""From raw documents to packed training sequences: five stages, each a table to a table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stepwise.llm import language, mixing, near_dup, packing, toxicity
from stepwise.llm.shared import saved, ship, table

TOKENIZER = "word_bpe_49k.json"


def _whole(docs: DataFrame) -> DataFrame:
    """Rows as one column beside what the operators read, whatever the columns are called."""
    return docs.select(
        F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text"
    )


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model does not reject."""
    ship(spark)
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(_whole(docs), model, keep=("row",), row="row")
    return scored.where("score < 0.5").select("row.*")


def drop_unknown_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with letters that some learned language encodes better than chance."""
    ship(spark)
    held_out = language.remainder(F.col("doc_id"), language.FOLDS) == 0
    model = language.train(docs.where(~held_out))
    found = language.predict(_whole(docs), model, keep=("row",), row="row")
    known = (F.col("lang_pred") != language.UNDETERMINED) & (F.col("bits") <= language.RAW_BITS)
    return found.where(known).select("row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, and documents without an id.

    Rows that repeat an id and a text are one document; unlike texts under one id are documents
    of their own.  Of a group the smallest id stays, an id that does not repeat before others.
    Null, empty and wordless texts are like nothing; an empty table gives none.
    """
    ship(spark)
    rows = _whole(docs).where("doc_id is not null")
    repeated = saved(rows.groupBy("doc_id").count().where("count > 1").select("doc_id", F.lit(True).alias("again")))
    # Repeated ids give way to numbers made of id and text, which lie above other ids.
    made = F.xxhash64("doc_id", "text").bitwiseAND(F.lit((1 << 62) - 1)).bitwiseOR(F.lit(1 << 62))
    rows = rows.join(repeated, "doc_id", "left").select(
        "row", "text", "again", F.when(F.col("again"), made).otherwise(F.col("doc_id")).alias("doc_id")
    )
    kept = near_dup.near_duplicates(rows).where("kept").select("doc_id").distinct()
    found = rows.join(kept, "doc_id", "left_semi")
    once = found.where("again is null").select("row")
    of_repeats = found.where("again").dropDuplicates(["doc_id"]).select("row")
    nameless = docs.where(F.col("doc_id").isNull()).select(F.struct(*docs.columns).alias("row"))
    return once.union(of_repeats).union(nameless).select("row.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    ship(spark)
    # Ids may be null or repeat in other sources, so each row carries its own copies.
    whole = docs.select(F.struct(*docs.columns).alias("row"), "doc_id", "text", "source")
    taken = mixing.mix(whole, keep=("row",)).where("copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), "copies"))).select("row.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of fixed length."""
    ship(spark)
    return packing.pack(docs, public_tokenizers.path(TOKENIZER))


STAGES = [
    ("toxicity", drop_toxic),
    ("language", drop_unknown_language),
    ("near_duplicates", drop_near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack),
]

# The models of the first stages have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each stored before the next."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
