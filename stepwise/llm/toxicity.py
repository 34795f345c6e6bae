"""Toxic spans and documents by a linear-chain conditional random field (CRF).

Documents are labelled as a whole; tokens get their labels from them.  A feature (a word, its
first or last letters) is *telling* if it occurs in toxic training texts far oftener than in
others, and a token of a toxic text that has a telling feature is a toxic token.  The CRF has
two states, weights of hashed token features for the toxic state and a weight for each pair of
neighbouring states; it is fitted to the labelled tokens by maximum likelihood.  Sentences are
its chains.  The forward-backward marginals give offending spans, and their largest value and
sum give the document's score by a logistic calibration.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (
    ArrayType,
    DoubleType,
    LongType,
    StructField,
    StructType,
)

from stepwise.llm.labelled import labelled_texts, remainder, text_beside
from stepwise.llm.near_dup import shingle_sets
from stepwise.llm.shared import give_back, lean, saved
from stepwise.llm.textscan import text_bytes, word_blocks

FOLDS = 5
# Training texts of each class, at most, and bytes of them that reach the driver, at most.
TEXTS = 4000
BYTES = 10 << 20
BUCKETS = 1 << 20
CHAIN = 48
# Chains whose marginals are computed at once.
TOGETHER = 1 << 13
# A telling feature is this many times as frequent in toxic texts, and its likelihood-ratio
# statistic exceeds what chance reaches among all features by this margin.
TELLING, MARGIN = 6.0, 10.0
# Of the chains without a toxic token, one in so many is trained on.
CLEAN_CHAINS = 8
STEPS, RATE, DECAY = 40, 0.3, 1e-4
FEATURES = 5
_SIGNS = np.zeros(256, bool)
_SIGNS[33:48] = _SIGNS[58:65] = _SIGNS[91:97] = _SIGNS[123:127] = True
_STOPS = np.zeros(256, bool)
_STOPS[[0x21, 0x2E, 0x3F]] = True


@dataclass
class Tokens:
    """Tokens of texts: feature buckets, chain starts, text index, and byte spans in their text."""

    features: np.ndarray
    chain_starts: np.ndarray
    texts: np.ndarray
    starts: np.ndarray
    ends: np.ndarray


def tokens(texts: pa.Array) -> Tokens:
    """All tokens of the texts, without signs around them, with their feature buckets."""
    data, offsets = text_bytes(texts)
    parts: list[tuple] = []
    for block in word_blocks(data, offsets):
        starts, ends = block.starts.copy(), block.ends.copy()
        if not len(starts):
            continue
        stop = _STOPS[block.bytes[ends - 1]]
        for _ in range(3):
            ends -= _SIGNS[block.bytes[ends - 1]] & (ends - starts > 1)
            starts += _SIGNS[block.bytes[starts]] & (ends - starts > 1)
        kinds = [
            block.hashes(starts, ends),
            *(block.hashes(starts, np.minimum(starts + n, ends)) for n in (4, 6)),
            *(block.hashes(np.maximum(ends - n, starts), ends) for n in (4, 6)),
        ]
        buckets = [
            ((k + np.uint64(i * 0x1234567)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)
            for i, k in enumerate(kinds)
        ]
        parts.append((np.stack(buckets, 1).astype(np.int32), stop, block.texts, starts + block.at, ends + block.at))
    if not parts:
        none = np.zeros(0, np.int64)
        return Tokens(np.zeros((0, FEATURES), np.int32), none, none, none, none)
    features, stop, owner, starts, ends = (np.concatenate(x) for x in zip(*parts, strict=True))
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | stop[:-1]
    # Long sentences are cut into chains of bounded length.
    at = np.arange(len(owner))
    since = at - np.maximum.accumulate(np.where(new, at, 0))
    new |= since % CHAIN == 0
    return Tokens(features, np.flatnonzero(new), owner, starts - offsets[owner], ends - offsets[owner])


def chained_features(texts: pa.Array, together: int = 100) -> Tokens:
    """The tokens of the texts without their places, found for some texts at a time."""
    none = np.zeros(0, np.int64)
    features, chains, owners, total = [np.zeros((0, FEATURES), np.int32)], [none], [none], 0
    for first in range(0, len(texts), together):
        found = tokens(texts.slice(first, together))
        features.append(found.features)
        chains.append(found.chain_starts + total)
        owners.append(found.texts + first)
        total += len(found.texts)
    return Tokens(np.concatenate(features), np.concatenate(chains), np.concatenate(owners), none, none)


class Chains:
    """Forward-backward over many chains at once, the longest first."""

    def __init__(self, starts: np.ndarray, total: int):
        lengths = np.diff(np.append(starts, total))
        order = np.argsort(-lengths, kind="stable")
        self.starts, self.lengths = starts[order], lengths[order]
        longest = int(self.lengths[0]) if len(order) else 0
        # Chains that reach each step.
        self.live = [int(np.searchsorted(-self.lengths, -t, "left")) for t in range(longest)]

    def marginals(self, odds: np.ndarray, moves: np.ndarray):
        """P(toxic) of each token, the expected moves between states, and the log-likelihood's
        normaliser, for token log-odds and the 2 x 2 log-weights of moves."""
        weight = np.exp(np.clip(odds, -30, 30))
        move = np.exp(moves)
        forward = np.zeros((len(odds), 2))
        backward = np.ones((len(odds), 2))
        log_z = 0.0
        for t, live in enumerate(self.live):
            at = self.starts[:live] + t
            if t:
                now = forward[at - 1] @ move
            else:
                now = np.ones((live, 2))
            now[:, 1] *= weight[at]
            scale = now.sum(axis=1, keepdims=True)
            log_z += float(np.log(scale).sum())
            forward[at] = now / scale
        for t in range(len(self.live) - 1, 0, -1):
            at = self.starts[: self.live[t]] + t
            after = backward[at].copy()
            after[:, 1] *= weight[at]
            now = after @ move.T
            backward[at - 1] = now / now.sum(axis=1, keepdims=True)
        moved = np.zeros((2, 2))
        for t in range(1, len(self.live)):
            at = self.starts[: self.live[t]] + t
            after = backward[at].copy()
            after[:, 1] *= weight[at]
            joint = forward[at - 1][:, :, None] * move * after[:, None, :]
            moved += (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
        both = np.multiply(forward, backward, out=forward)
        return both[:, 1] / both.sum(axis=1), moved, log_z


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    moves: np.ndarray
    calibration: np.ndarray

    def marginals(self, found: Tokens) -> np.ndarray:
        """P(toxic) of each token, for some thousand chains at a time."""
        toxic, borders = np.zeros(len(found.texts)), np.append(found.chain_starts, len(found.texts))
        for first in range(0, len(borders) - 1, TOGETHER):
            some = borders[first : first + TOGETHER + 1]
            low, high = some[0], some[-1]
            odds = self.weights[found.features[low:high]].sum(axis=1) + self.bias
            toxic[low:high] = Chains(some[:-1] - low, len(odds)).marginals(odds, self.moves)[0]
        return toxic


def document_features(toxic: np.ndarray, owner: np.ndarray, texts: int) -> np.ndarray:
    """1, the largest marginal and the log of the summed marginals of each text."""
    out = np.zeros((texts, 3))
    out[:, 0] = 1
    np.maximum.at(out[:, 1], owner, toxic)
    out[:, 2] = np.log1p(np.bincount(owner, toxic, minlength=texts))
    return out


def token_labels(found: Tokens, toxic_text: np.ndarray) -> np.ndarray:
    """Tokens of toxic texts that have a telling feature."""
    if not len(found.texts):
        return np.zeros(0, bool)
    rows = toxic_text.sum(), (~toxic_text).sum()
    share = rows[0] / len(toxic_text)
    toxic = np.zeros(len(found.texts), bool)
    for j in range(FEATURES):
        seen = np.unique(found.texts * np.int64(BUCKETS) + found.features[:, j])
        bucket, is_toxic = seen % BUCKETS, toxic_text[seen // BUCKETS]
        hits = np.bincount(bucket[is_toxic], minlength=BUCKETS)
        misses = np.bincount(bucket[~is_toxic], minlength=BUCKETS)
        del seen, bucket, is_toxic
        met = np.flatnonzero(hits + misses)
        hits, misses = hits[met], misses[met]
        ratio = ((hits + 0.2) / (rows[0] + 1)) / ((misses + 0.2) / (rows[1] + 1))
        both = hits + misses
        with np.errstate(divide="ignore", invalid="ignore"):
            evidence = 2 * (
                np.where(hits, hits * np.log(hits / (both * share)), 0)
                + np.where(misses, misses * np.log(misses / (both * (1 - share))), 0)
            )
        telling = np.zeros(BUCKETS, bool)
        telling[met] = (ratio >= TELLING) & (evidence >= 2 * np.log(max(1, len(met))) + MARGIN)
        toxic |= telling[found.features[:, j]]
    return toxic_text[found.texts] & toxic


def distinct_texts(texts: pa.Array, retained: int = 8) -> list[int]:
    """Indices of texts that share fewer than two of their smallest shingles with an earlier one."""
    seen: set[int] = set()
    kept = []
    for first in range(0, len(texts), 100):
        for i, shingles in enumerate(shingle_sets(texts.slice(first, 100)), first):
            least = shingles[:retained].tolist()
            if sum(v in seen for v in least) < min(2, len(least) or 1):
                kept.append(i)
                seen.update(least)
    return kept


def fit(texts: pa.Array, toxic_text: np.ndarray) -> Model:
    """The CRF and its calibration for texts and their labels.

    Of near copies one is used: words of a text that was copied often prove nothing.
    """
    single = distinct_texts(texts)
    texts, toxic_text = texts.take(pa.array(single, pa.int64())), toxic_text[single]
    found = chained_features(texts)
    texts = None
    give_back()
    labels = token_labels(found, toxic_text)
    give_back()
    chain = np.zeros(len(labels), np.int64)
    chain[found.chain_starts] = 1
    chain = np.cumsum(chain) - 1
    has = np.bincount(chain, labels, minlength=len(found.chain_starts)) > 0
    chosen = (has | (np.arange(len(has)) % CLEAN_CHAINS == 0))[chain]
    label, features = labels[chosen], found.features[chosen]
    starts = np.flatnonzero(np.diff(chain[chosen], prepend=-1))
    weights, bias, moves = np.zeros(BUCKETS), -2.0, np.zeros((2, 2))
    chains = Chains(starts, len(label))
    follows = np.ones(len(label), bool)
    follows[starts] = False
    pairs = np.flatnonzero(follows)
    seen_moves = np.bincount(2 * label[pairs - 1] + label[pairs], minlength=4).reshape(2, 2)
    used = np.unique(features)
    spots = [np.searchsorted(used, column).astype(np.int32) for column in features.T]
    del features, chain, chosen, pairs
    give_back()
    squares = [np.zeros(len(used)), 0.0, np.zeros((2, 2))]
    active = np.zeros(len(used))
    scale = max(1, len(label))
    # Adagrad on the mean log-likelihood with a small decay of the weights.
    for _ in range(STEPS if label.any() else 0):
        odds = sum((active[spot] for spot in spots), np.full(len(label), bias))
        toxic, moved, _ = chains.marginals(odds, moves)
        gap = label - toxic
        pull = sum(np.bincount(spot, gap, minlength=len(used)) for spot in spots) / scale * 1e3
        steps = [pull - DECAY * active, gap.sum() / scale * 1e3, (seen_moves - moved) / scale * 1e3]
        squares = [s + g * g for s, g in zip(squares, steps, strict=True)]
        active = active + RATE * steps[0] / (np.sqrt(squares[0]) + 1e-8)
        bias = bias + RATE * steps[1] / (np.sqrt(squares[1]) + 1e-8)
        moves = moves + RATE * steps[2] / (np.sqrt(squares[2]) + 1e-8)
    weights[used] = active
    model = Model(weights.astype(np.float32), float(bias), moves, np.zeros(3))
    toxic = model.marginals(found) if len(labels) else np.zeros(0)
    if not toxic_text.any():
        # Without an example nothing is toxic.
        model.calibration = np.array([-3.0, 0.0, 0.0])
        return model
    model.calibration = _logistic(document_features(toxic, found.texts, len(toxic_text)), toxic_text)
    return model


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05) -> np.ndarray:
    """Weights of a logistic regression, by Newton's method."""
    w = np.zeros(x.shape[1])
    penalty = ridge * np.eye(x.shape[1])
    for _ in range(50 if len(x) else 0):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (p - y) + penalty @ w
        curve = (x * (p * (1 - p))[:, None]).T @ x + penalty
        w = w - np.clip(np.linalg.solve(curve, slope), -3, 3)
    return w


def train(docs: DataFrame, labels: DataFrame, texts: int = TEXTS) -> Model:
    """The model of docs(doc_id, text) and labels(doc_id, toxic), from at most ``texts`` documents
    of each class.

    Labels whose crc32(doc_id) modulo ``FOLDS`` is 0 are held out.  Of the chosen texts, taken in
    a fixed random order, as many whole ones reach the fitting task as fit into ``BYTES``.  Rows without
    text or label are ignored.
    """
    marked = labels.where(remainder(F.col("doc_id").cast("long"), FOLDS) != 0).select(
        "doc_id", (F.col("toxic") == 1).alias("toxic")
    )
    chosen = saved(
        labelled_texts(docs, marked, "toxic", texts)[0]
        .withColumn("size", F.octet_length("text"))
        .withColumn("at", F.xxhash64(F.lit("order"), "doc_id"))
    )
    picked, room = [], BYTES
    for at, size in sorted((r["at"], r["size"]) for r in chosen.select("at", "size").collect()):
        if size <= room:
            room -= size
            picked.append(at)
    # At most ``texts`` numbers of each class.
    taken = F.broadcast(docs.sparkSession.createDataFrame([(at,) for at in picked], "at long"))
    # One task holds the texts, ``BYTES`` at most, and fits; the driver gets the model only.
    sample = chosen.join(taken, "at", "left_semi").repartition(1).sortWithinPartitions("at", "doc_id")
    found = sample.select("text", "toxic").mapInArrow(_fitted, _MODEL).toArrow().to_pylist()
    if not found:
        return fit(pa.array([], pa.string()), np.zeros(0, bool))
    weights, moves = np.frombuffer(found[0]["weights"], np.float32), np.array(found[0]["moves"])
    return Model(weights, found[0]["bias"], moves.reshape(2, 2), np.array(found[0]["calibration"]))


_MODEL = "weights binary, bias double, moves array<double>, calibration array<double>"


@lean
def _fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    table = pa.Table.from_batches(list(batches), pa.schema([("text", pa.string()), ("toxic", pa.bool_())]))
    texts, toxic = table.column("text").combine_chunks(), np.array(table.column("toxic").to_pylist(), bool)
    del table
    model = fit(texts, toxic)
    yield pa.RecordBatch.from_pydict(
        {
            "weights": pa.array([model.weights.tobytes()], pa.binary()),
            "bias": pa.array([float(model.bias)]),
            "moves": pa.array([model.moves.ravel().tolist()]),
            "calibration": pa.array([model.calibration.tolist()]),
        }
    )


def _characters(data: np.ndarray, offsets: np.ndarray, owner, position) -> np.ndarray:
    """Code points before byte positions of their texts."""
    low = int(offsets[0])
    heads = np.concatenate([[0], np.cumsum((data[low : int(offsets[-1])] & 0xC0) != 0x80)])
    begin = offsets[owner] - low
    return heads[begin + position] - heads[begin]


@lean
def _score(batches: Iterator[pa.RecordBatch], model: Model, row: str | None) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            part = batch.slice(at, 500)
            texts, rest, names = text_beside(part, row)
            found = tokens(texts)
            toxic = model.marginals(found) if len(found.texts) else np.zeros(0)
            x = document_features(toxic, found.texts, len(texts)) @ model.calibration
            score = 1 / (1 + np.exp(-np.clip(x, -30, 30)))
            bad = np.flatnonzero(toxic >= 0.5)
            owner = found.texts[bad]
            data, offsets = text_bytes(texts)
            spans = pa.StructArray.from_arrays(
                [
                    pa.array(_characters(data, offsets, owner, found.starts[bad]), pa.int64()),
                    pa.array(_characters(data, offsets, owner, found.ends[bad]), pa.int64()),
                    pa.array(toxic[bad]),
                ],
                ["start", "end", "marginal"],
            )
            counts = np.bincount(owner, minlength=len(texts))
            borders = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    *rest,
                    pa.array(score),
                    pa.ListArray.from_arrays(pa.array(borders), spans),
                ],
                [*names, "score", "spans"],
            )


_SPAN = StructType(
    [StructField("start", LongType()), StructField("end", LongType()), StructField("marginal", DoubleType())]
)


def score(
    docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",), row: str | None = None
) -> DataFrame:
    """The kept columns with score and spans for every row of docs, whose text is the column
    ``text`` or, if row is given, that field of the kept struct.

    spans are the code-point offsets of tokens whose toxic marginal is at least 0.5.  Null and
    empty texts have the score of a text without toxic tokens.  Repeated rows are scored alike;
    an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        return _score(batches, shared.value, row)

    schema = StructType(
        [
            *docs.select(*keep).schema.fields,
            StructField("score", DoubleType()),
            StructField("spans", ArrayType(_SPAN)),
        ]
    )
    scored = [] if row else [F.col("text").alias("_scored")]
    return docs.select(*keep, *scored).mapInArrow(run, schema)


def detect(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted and spans for every row of docs(doc_id, text).

    Learns from labels whose crc32(doc_id) modulo ``FOLDS`` is not 0.  Rows without doc_id are
    scored but never learned from.
    """
    model = train(docs, labels)
    return score(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model).select(
        "doc_id",
        F.coalesce(remainder(F.col("doc_id"), FOLDS) == 0, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
        "spans",
    )
