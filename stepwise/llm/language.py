"""Language identification by prediction by partial matching (PPM).

Each language has a tree of byte contexts of up to ``ORDER`` bytes with counts of the bytes that
follow.  A byte seen in a context costs ``-log2(count / (total + distinct))`` bits; an unseen one
costs the escape, ``-log2(distinct / (total + distinct))``, and is then looked up in the next
shorter context, down to ``1/256`` for each byte.  The statistics are frozen after training, so
the cost of a byte depends on the last ``ORDER`` bytes only: the trees become one automaton over
contexts with a table of costs by context, byte and language, and whole texts are scored with
array lookups.  The language with the shortest code wins; ties go to the first name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from stepwise.llm.labelled import class_sizes, remainder, sample, text_beside
from stepwise.llm.shared import lean
from stepwise.llm.textscan import text_bytes

ORDER = 3
# Training texts of each language, at most.
TEXTS = 400
# Contexts that a model keeps, the most frequent first: states x bytes x languages.
CELLS = 1 << 23
UNDETERMINED = "und"
# A best code well beyond the 8 bits of a raw byte means that no learned language fits.
RAW_BITS = 10.0
FOLDS = 5
_BLOCK = 1 << 19
_LETTERS = np.zeros(256, bool)
_LETTERS[65:91] = _LETTERS[97:123] = True
_LETTER = regex.compile(r"\p{L}")


@lean
def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of byte strings of 1 to ORDER + 1 bytes by language."""
    for batch in batches:
        names = np.array(batch.column("lang").to_pylist(), object)
        for lang in sorted(set(names)):
            data, offsets = text_bytes(batch.column("text").filter(pa.array(names == lang)))
            data = data[offsets[0] : offsets[-1]]
            owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
            value = np.zeros(len(data), np.uint64)
            for size in range(1, ORDER + 2):
                value = value[: len(data) - size + 1] if len(data) >= size else value[:0]
                value = (value << np.uint64(8)) | data[size - 1 : size - 1 + len(value)]
                whole = owner[: len(value)] == owner[size - 1 : size - 1 + len(value)]
                grams, counts = np.unique(value[whole], return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([lang] * len(grams)),
                        pa.array([size] * len(grams), pa.int32()),
                        pa.array(grams.astype(np.int64)),
                        pa.array(counts, pa.int64()),
                    ],
                    ["lang", "size", "gram", "count"],
                )


@dataclass
class Model:
    """langs; the code of each byte; step and cost by context and code, 0 being the border
    between texts."""

    langs: list[str]
    width: int
    codes: np.ndarray
    step: np.ndarray
    cost: np.ndarray


def build(langs: list[str], counts: list[tuple[int, int, int, int]], order: int = ORDER) -> Model:
    """The automaton of counts (language index, size, gram, count)."""
    rows = np.array(counts, np.int64).reshape(-1, 4)
    seen = np.unique(rows[rows[:, 1] == 1, 2])
    codes = np.zeros(256, np.uint8)
    codes[:] = len(seen) + 1  # UTF-8 has fewer than 250 byte values
    codes[seen] = np.arange(1, len(seen) + 1)
    width = len(seen) + 2
    unseen = len(seen) + 1
    # Contexts by size and value; the empty one is 0.
    total: dict[tuple[int, int], int] = {}
    for _, size, gram, count in rows.tolist():
        if size <= order:
            total[size, gram] = total.get((size, gram), 0) + count
    room = max(1 + 256, CELLS // (width * max(len(langs), 1)))
    kept = sorted(sorted(total, key=lambda k: -total[k])[: room - 1])
    ids = {(0, 0): 0}
    for size, gram in kept:
        shorter = (size - 1, gram & ((1 << 8 * (size - 1)) - 1))
        if shorter in ids:
            ids[size, gram] = len(ids)
    states = len(ids)
    suffix = np.zeros(states, np.int64)
    depth = np.zeros(states, np.int64)
    step = np.zeros((states, width), np.int32)
    children: dict[int, list[tuple[int, int]]] = {}
    for (size, gram), state in ids.items():
        if size:
            depth[state] = size
            suffix[state] = ids[size - 1, gram & ((1 << 8 * (size - 1)) - 1)]
            parent = ids.get((size - 1, gram >> 8))
            if parent is not None:
                children.setdefault(parent, []).append((int(codes[gram & 255]), state))
    table = np.zeros((states, width, len(langs)), np.float32)
    for lang, size, gram, count in rows.tolist():
        state = ids.get((size - 1, gram >> 8))
        if state is not None:
            table[state, codes[gram & 255], lang] += count
    n = table.sum(axis=1)
    distinct = (table > 0).sum(axis=1)
    with np.errstate(divide="ignore", invalid="ignore"):
        escape = np.where(n > 0, -np.log2(distinct / (n + distinct)), 0.0)
        hit = -np.log2(table / (n + distinct)[:, None, :])
    cost = np.empty_like(table)
    for level in range(order + 1):
        at = np.flatnonzero(depth == level)
        below = cost[suffix[at]] if level else np.full((1, width, len(langs)), 8.0, np.float32)
        cost[at] = np.where(table[at] > 0, hit[at], escape[at][:, None, :] + below)
        if level:
            step[at] = step[suffix[at]]
        for state in at.tolist():
            for code, child in children.get(state, ()):
                step[state, code] = child
    step[:, 0] = 0
    step[:, unseen] = 0
    cost[:, 0] = 0
    return Model(langs, width, codes, step.reshape(-1), cost.reshape(states * width, len(langs)))


def code_lengths(model: Model, texts: pa.Array, order: int = ORDER) -> np.ndarray:
    """Bits of each text under each language's model."""
    data, offsets = text_bytes(texts)
    out = np.zeros((len(texts), len(model.langs)))
    if not len(texts) or not model.langs:
        return out
    low = int(offsets[0])
    codes = np.zeros(int(offsets[-1]) - low + len(texts), np.uint8)
    place = np.ones(len(codes), bool)
    borders = offsets[:-1] - low + np.arange(len(texts))
    place[borders] = False
    codes[place] = model.codes[data[low : int(offsets[-1])]]
    padded = np.concatenate([np.zeros(order, np.uint8), codes])
    for begin in range(0, len(codes), _BLOCK):
        end = min(begin + _BLOCK, len(codes))
        state = np.zeros(end - begin, np.int32)
        for back in range(order):
            state = model.step[state * model.width + padded[begin + back : end + back]]
        costs = model.cost[state * model.width + codes[begin:end]]
        first = int(np.searchsorted(borders, begin, "right")) - 1
        last = int(np.searchsorted(borders, end, "left"))
        starts = np.maximum(borders[first:last] - begin, 0)
        out[first:last] += np.add.reduceat(costs, starts, axis=0, dtype=np.float64)
    return out


def has_letter(texts: pa.Array) -> np.ndarray:
    """Whether each text has a letter of any script."""
    data, offsets = text_bytes(texts)
    marks = np.concatenate([[0], np.cumsum(_LETTERS[data[offsets[0] : offsets[-1]]])])
    at = offsets - offsets[0]
    found = marks[at[1:]] > marks[at[:-1]]
    for i in np.flatnonzero(~found).tolist():
        text = texts[i].as_py()
        found[i] = bool(text) and _LETTER.search(text) is not None
    return found


def train(labelled: DataFrame, texts: int = TEXTS) -> Model:
    """The model of labelled(doc_id, text, lang), from at most ``texts`` texts a language.

    Strings of several bytes seen once tell little and are left out.  Rows without text or
    language are ignored; without any row the model knows no language.
    """
    rows = labelled.where("text is not null and lang is not null").select("doc_id", "text", "lang")
    sizes = class_sizes(rows, "lang")
    counts = (
        sample(rows, "lang", sizes, texts)
        .select("lang", "text")
        .mapInArrow(_grams, "lang string, size int, gram long, count long")
        .groupBy("lang", "size", "gram")
        .agg(F.sum("count").alias("count"))
        .where("size = 1 or count > 1")
        .collect()
    )
    langs = sorted(sizes)
    index = {lang: i for i, lang in enumerate(langs)}
    return build(langs, [(index[r["lang"]], r["size"], r["gram"], r["count"]) for r in counts])


@lean
def _predict(
    batches: Iterator[pa.RecordBatch], model: Model, row: str | None
) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            part = batch.slice(at, 500)
            texts, rest, kept = text_beside(part, row)
            lengths = code_lengths(model, texts)
            known = has_letter(texts)
            n = len(texts)
            best = lengths.argmin(axis=1) if model.langs else np.zeros(n, int)
            least = lengths.min(axis=1, initial=np.inf)
            if model.langs:
                odds = np.exp2(np.maximum(least[:, None] - lengths, -1000.0))
                score = np.where(known, 1 / odds.sum(axis=1), 0.0)
                _, offsets = text_bytes(texts)
                bits = least / np.maximum(np.diff(offsets), 1)
            else:
                score, bits, known = np.zeros(n), np.zeros(n), np.zeros(n, bool)
            names = [
                model.langs[b] if k else UNDETERMINED
                for b, k in zip(best.tolist(), known.tolist(), strict=True)
            ]
            columns = [pa.array(names, pa.string()), pa.array(score), pa.array(bits)]
            yield pa.RecordBatch.from_arrays(
                [*rest, *columns],
                [*kept, "lang_pred", "score", "bits"],
            )


def predict(
    docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",), row: str | None = None
) -> DataFrame:
    """The kept columns with lang_pred, score and bits for every row of docs, whose text is the
    column ``text`` or, if row is given, that field of the kept struct.

    score is the winner's share of the posterior under equal priors; bits is its code length per
    byte.  Null texts and texts without a letter are ``und`` with score 0.  Whole texts are
    scored in blocks, so long ones take no more memory.  Repeated rows are scored alike; an
    empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        return _predict(batches, shared.value, row)

    kept = docs.select(*keep)
    schema = StructType(
        [
            *kept.schema.fields,
            StructField("lang_pred", StringType()),
            StructField("score", DoubleType()),
            StructField("bits", DoubleType()),
        ]
    )
    scored = [] if row else [F.col("text").alias("_scored")]
    return docs.select(*keep, *scored).mapInArrow(run, schema)


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score and bits for every row of docs(doc_id, text, lang).

    Learns from rows whose crc32(doc_id) modulo ``FOLDS`` is not 0.  Rows without doc_id are
    predicted but never learned from.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    held_out = remainder(F.col("doc_id"), FOLDS) == 0
    model = train(rows.where(~held_out))
    return predict(rows, model).select(
        "doc_id",
        F.coalesce(remainder(F.col("doc_id"), FOLDS) == 0, F.lit(False)).alias("held_out"),
        "lang_pred",
        "score",
        "bits",
    )
