"""Document quality from Bradley-Terry preferences.

Of a pair of training documents, the one labelled good is preferred.  A document's strength is a
linear function of features of its whole text; a pair's preference has the logistic probability
of the difference of strengths, so fitting is logistic regression on feature differences.  The
pairs are all pairs of a good and a bad training document.  None is ever written down: the loss
depends on two strengths through a smooth function of their difference, which polynomials through
``NODES`` points of each unit of strength give to 1e-8.  So sums over documents at these points,
gathered in one pass of thin rows, hold what all pairs contribute to a Newton step.
Strengths become scores by a logistic curve that passes through ``CUT`` at the strength that
leaves the labelled share of bad documents below: thresholding a score is cutting at a quantile.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from stepwise.llm.labelled import class_sizes, remainder
from stepwise.llm.shared import saved
from stepwise.llm.textscan import mix, text_bytes, word_blocks

FOLDS, HELD = 4, 2
CUT = 0.7
# Points of each unit of strength; Newton steps at most; ridge on the weights.
NODES, STEPS, RIDGE = 8, 30, 1e-3
# Ranges of strengths that one pass towards a quantile tells apart.
RANGES = 1024
NAMES = (
    "capitals", "signs", "exclamations", "bars", "digits", "other_bytes", "breaks",
    "word_bytes", "long_words", "signed_words", "capital_words", "log_words", "repeats", "same_pairs",
    "distinct_words", "distinct_triples",
)
_CLASSES = np.zeros((256, 7), np.float32)
_CLASSES[65:91, 0] = 1
for _low, _high in ((35, 39), (42, 44), (60, 63), (64, 65), (91, 97), (123, 127)):
    _CLASSES[_low:_high, 1] = 1
_CLASSES[33, 2] = 1
_CLASSES[124, 3] = 1
_CLASSES[48:58, 4] = 1
_CLASSES[128:, 5] = 1
_CLASSES[10, 6] = 1
_KIND = np.zeros(256, np.uint8)
for _i in range(7):
    _KIND[_CLASSES[:, _i] > 0] = _i + 1


def _distinct_share(keys: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Share of a text's keys that differ; 1 for texts without keys."""
    count = np.bincount(owner, minlength=n)
    order = np.lexsort((keys, owner))
    new = np.ones(len(keys), bool)
    new[1:] = (keys[order][1:] != keys[order][:-1]) | (owner[order][1:] != owner[order][:-1])
    distinct = np.bincount(owner[order][new], minlength=n)
    return np.where(count, distinct / np.maximum(count, 1), 1.0)


def features(texts: pa.Array) -> np.ndarray:
    """One row of NAMES for each text; null and empty texts are equal."""
    n = len(texts)
    data, offsets = text_bytes(texts)
    low = int(offsets[0])
    size = np.maximum(np.diff(offsets), 1)
    out = np.zeros((n, len(NAMES)))
    kinds = _KIND[data[low : int(offsets[-1])]]
    for i in range(7):
        marks = np.concatenate([[0], np.cumsum(kinds == i + 1, dtype=np.int64)])
        out[:, i] = (marks[offsets[1:] - low] - marks[offsets[:-1] - low]) / size
    parts = []
    for block in word_blocks(data, offsets):
        if len(block.starts):
            raw = data[block.at : block.at + len(block.bytes)]
            first, last = raw[block.starts], raw[block.ends - 1]
            parts.append(
                (
                    block.hashes(block.starts, block.ends),
                    block.texts,
                    block.ends - block.starts,
                    (_KIND[last] >= 2) & (_KIND[last] <= 4),
                    (_KIND[first] == 1) & (_KIND[last] == 1),
                )
            )
    if not parts:
        out[:, 14:] = 1
        return out
    words, owner, length, signed, capital = (np.concatenate(x) for x in zip(*parts, strict=True))
    count = np.bincount(owner, minlength=n)
    each = np.maximum(count, 1)
    same = np.zeros(len(words), bool)
    same[1:] = (words[1:] == words[:-1]) & (owner[1:] == owner[:-1])
    apart = np.zeros(len(words), bool)
    apart[2:] = (words[2:] == words[:-2]) & (owner[2:] == owner[:-2])
    out[:, 7] = np.bincount(owner, length, minlength=n) / each / 10
    out[:, 8] = np.bincount(owner, length > 20, minlength=n) / each
    out[:, 9] = np.bincount(owner, signed, minlength=n) / each
    out[:, 10] = np.bincount(owner, capital, minlength=n) / each
    out[:, 11] = np.log1p(count) / 10
    out[:, 12] = np.bincount(owner, same, minlength=n) / each
    out[:, 13] = np.bincount(owner, apart, minlength=n) / each
    out[:, 14] = _distinct_share(words, owner, n)
    if len(words) > 2:
        whole = owner[2:] == owner[:-2]
        triples = mix(words[2:] + mix(words[1:-1] + mix(words[:-2])))
        out[:, 15] = _distinct_share(triples[whole], owner[2:][whole], n)
    else:
        out[:, 15] = 1
    return out


@dataclass
class Model:
    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    scale: float
    shift: float

    def strengths(self, x: np.ndarray) -> np.ndarray:
        return (self.standard(x) * self.weights).sum(axis=1)

    def standard(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.spread, -5, 5)

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * self.strengths(x) + self.shift, -30, 30)))


# Where polynomials of a unit interval pass through a function, and their upper triangle of products.
_POINTS = (1 - np.cos((2 * np.arange(NODES) + 1) * np.pi / (2 * NODES))) / 2
_UPPER = np.triu_indices(len(NAMES))
# Documents whose products are in memory at once.
_TOGETHER = 4096


def _shares(s: np.ndarray) -> np.ndarray:
    """How much each point of its unit counts for a strength: Lagrange's polynomials there."""
    out = np.ones((len(s), NODES))
    inside = s - np.floor(s)
    for i in range(NODES):
        for j in range(NODES):
            if i != j:
                out[:, i] *= (inside - _POINTS[j]) / (_POINTS[i] - _POINTS[j])
    return out


def _moments(z: np.ndarray, s: np.ndarray) -> dict[int, np.ndarray]:
    """For each unit of strength and point, the shares' sums with 1, z and the products of z."""
    total: dict[int, np.ndarray] = {}
    for at in range(0, len(z), _TOGETHER):
        part = z[at : at + _TOGETHER]
        values = np.concatenate([np.ones((len(part), 1)), part, part[:, _UPPER[0]] * part[:, _UPPER[1]]], 1)
        unit, shares = np.floor(s[at : at + _TOGETHER]).astype(np.int64), _shares(s[at : at + _TOGETHER])
        for u in np.unique(unit).tolist():
            here = unit == u
            total[u] = total.get(u, 0.0) + shares[here].T @ values[here]
    return total


def _table(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    x = batch.column("x").flatten().to_numpy().reshape(-1, len(NAMES))
    return x, batch.column("good").to_numpy(zero_copy_only=False).astype(bool)


_SUMS = "good boolean, unit long, sums binary"


def _sums(total: dict[tuple[bool, int], np.ndarray]) -> pa.RecordBatch:
    keys = sorted(total)
    return pa.RecordBatch.from_arrays(
        [
            pa.array([k[0] for k in keys], pa.bool_()),
            pa.array([k[1] for k in keys], pa.int64()),
            pa.array([total[k].tobytes() for k in keys], pa.binary()),
        ],
        ["good", "unit", "sums"],
    )


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[tuple[bool, int], np.ndarray] = {}
    for batch in batches:
        for good, unit, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            total[good, unit] = total.get((good, unit), 0.0) + np.frombuffer(raw)
    yield _sums(total)


def _totals(rows: DataFrame, sums) -> dict[tuple[bool, int], np.ndarray]:
    """The sums of ``sums(x)``, arrays by a number, over the rows of each class.

    Every task adds up its rows, some tasks add up those, and the driver the rest: what it gets
    follows the span of the numbers, not the rows.
    """

    def run(batches):
        total: dict[tuple[bool, int], np.ndarray] = {}
        for batch in batches:
            x, good = _table(batch)
            for kind in (False, True):
                for unit, more in sums(x[good == kind]).items():
                    total[kind, unit] = total.get((kind, unit), 0.0) + more
        yield _sums(total)

    some = rows.mapInArrow(run, _SUMS).repartition(8).mapInArrow(_added, _SUMS).toArrow()
    total: dict[tuple[bool, int], np.ndarray] = {}
    for good, unit, raw in sorted(zip(*(c.to_pylist() for c in some.columns), strict=True)):
        total[good, unit] = total.get((good, unit), 0.0) + np.frombuffer(raw)
    return total


def _size_and_squares(x: np.ndarray) -> dict[int, np.ndarray]:
    return {0: np.concatenate([[len(x)], x.sum(axis=0), (x * x).sum(axis=0)])} if len(x) else {}


def _all_pairs(total: dict[tuple[bool, int], np.ndarray], weights: np.ndarray) -> np.ndarray:
    """The Newton step of the mean loss of all pairs and the ridge, from the moments."""
    width = len(weights)
    at, ones, first, second = {}, {}, {}, {}
    for kind in (False, True):
        units = sorted(u for good, u in total if good == kind)
        values = np.concatenate([total[kind, u].reshape(NODES, -1) for u in units])
        at[kind] = (np.array(units)[:, None] + _POINTS).ravel()
        ones[kind], first[kind] = values[:, 0], values[:, 1 : width + 1]
        second[kind] = np.zeros((len(values), width, width))
        second[kind][:, _UPPER[0], _UPPER[1]] = second[kind][:, _UPPER[1], _UPPER[0]] = values[:, width + 1 :]
    pairs = ones[True].sum() * ones[False].sum()
    # P(the bad one is preferred) and its slope at the points.
    wrong = 1 / (1 + np.exp(np.clip(at[True][:, None] - at[False], -500, 500)))
    curved = wrong * (1 - wrong)
    slope = RIDGE * weights - (first[True].T @ (wrong @ ones[False]) - first[False].T @ (wrong.T @ ones[True])) / pairs
    cross = first[True].T @ curved @ first[False]
    curve = np.tensordot(curved @ ones[False], second[True], 1) + np.tensordot(curved.T @ ones[True], second[False], 1)
    return np.linalg.solve((curve - cross - cross.T) / pairs + RIDGE * np.eye(width), slope)


def _cut(strengths: DataFrame, bad_share: float, sizes: dict[bool, int]) -> float:
    """The strength that leaves the share of bad below, each class weighing as its share.

    Passes over ever smaller ranges end where the range that holds the quantile is one number.
    """
    weight = {True: (1 - bad_share) / sizes[True], False: bad_share / sizes[False]}
    wanted = bad_share * (1 + 1e-9)
    low, high = strengths.agg(F.min("s"), F.max("s")).first()
    below, before = 0.0, low
    while True:
        place = F.least(F.floor((F.col("s") - low) / max(high - low, 1e-300) * RANGES), F.lit(RANGES - 1))
        found = (
            strengths.where(F.col("s").between(low, high))
            .groupBy(place.alias("place"))
            .agg(
                F.min("s").alias("low"),
                F.max("s").alias("high"),
                F.count(F.when(F.col("good"), 1)).alias("good"),
                F.count(F.when(~F.col("good"), 1)).alias("bad"),
            )
            .orderBy("low")
            .collect()
        )
        for r in found:
            inside = r["good"] * weight[True] + r["bad"] * weight[False]
            if below + inside > wanted or r is found[-1]:
                break
            below, before = below + inside, r["high"]
        low, high = r["low"], r["high"]
        if low == high:
            first = weight[False] if r["bad"] else weight[True]
            return (before + low) / 2 if below + first > wanted else low


def fit(rows: DataFrame, bad_share: float) -> Model:
    """Weights by the logistic loss of all pairs of rows(good, x), and the curve through CUT.

    Every row counts in the means, the weights, the quantile and the scale.  Sums depend on the
    order of their rows in the last digits only, so what is fitted is rounded before these.
    """
    width = len(NAMES)
    model = Model(np.zeros(width), np.ones(width), np.zeros(width), 1.0, 0.0)
    total = _totals(rows, _size_and_squares)
    if len(total) < 2:
        model.shift = 3.0 if (True, 0) in total else 0.0
        return model
    sizes = {kind: int(total[kind, 0][0]) for kind in (False, True)}
    both = (total[False, 0] + total[True, 0]) / sum(sizes.values())
    mean, square = both[1 : width + 1], both[width + 1 :]
    model.mean = np.round(mean, 9)
    model.spread = np.round(np.sqrt(np.maximum(square - mean * mean, 0)), 9) + 1e-6
    for _ in range(STEPS):
        now = model
        step = _all_pairs(_totals(rows, lambda x: _moments(now.standard(x), now.strengths(x))), model.weights)
        model.weights = model.weights - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-7:
            break
    model.weights = np.round(model.weights, 9)

    def run(batches):
        for batch in batches:
            x, _ = _table(batch)
            yield pa.RecordBatch.from_arrays([batch.column("good"), pa.array(model.strengths(x))], ["good", "s"])

    strengths = saved(rows.select("good", "x").mapInArrow(run, "good boolean, s double"))
    spread = strengths.agg(F.stddev_pop("s")).first()[0]
    model.scale = round(4 / (spread + 1e-6), 9)
    model.shift = float(np.log(CUT / (1 - CUT)) - model.scale * _cut(strengths, bad_share, sizes))
    return model


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            part = batch.slice(at, 500)
            x = features(part.column("_measured"))
            borders = np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)
            kept = [i for i, name in enumerate(part.schema.names) if name != "_measured"]
            yield pa.RecordBatch.from_arrays(
                [*(part.column(i) for i in kept), pa.ListArray.from_arrays(pa.array(borders), pa.array(x.ravel()))],
                [*(part.schema.names[i] for i in kept), "x"],
            )


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, whether there is a text, and the features x of every row of docs(doc_id, text)."""
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("text").isNotNull().alias("written"),
        F.col("text").alias("_measured"),
    )
    return rows.mapInArrow(_features, "doc_id long, written boolean, x array<double>")


def learn(rows: DataFrame, labels: DataFrame) -> Model:
    """The model of all measured rows(doc_id, written, x) with a label that is not held out."""
    marked = (
        labels.where(remainder(F.col("doc_id").cast("long"), FOLDS) != HELD)
        .select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("quality") == 1).alias("good"))
        .where("doc_id is not null and good is not null")
    )
    sizes = class_sizes(marked, "good")
    chosen = saved(rows.where("written").join(marked, "doc_id").select("good", "x"))
    return fit(chosen, sizes.get(False, 0) / max(1, sum(sizes.values())))


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """The model of docs(doc_id, text) and labels(doc_id, quality), from all labelled documents.

    Labels whose crc32(doc_id) modulo ``FOLDS`` is ``HELD`` are held out.  Only sums of features
    reach the driver.  Rows without text or label are ignored.
    """
    return learn(saved(measured(docs)), labels)


def _score(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            part = batch.slice(at, 500)
            scores = model.scores(features(part.column(part.num_columns - 1)))
            yield pa.RecordBatch.from_arrays(
                [*(part.column(i) for i in range(part.num_columns - 1)), pa.array(scores)],
                [*part.schema.names[:-1], "score"],
            )


def score(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns and the score of every row of docs, from its whole text."""

    def run(batches):
        return _score(batches, model)

    schema = StructType([*docs.select(*keep).schema.fields, StructField("score", DoubleType())])
    return docs.select(*keep, F.col("text").alias("_scored")).mapInArrow(run, schema)


def rank(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of docs(doc_id, text).

    Learns from labels whose crc32(doc_id) modulo ``FOLDS`` is not ``HELD``.  Null and empty
    texts score alike.  Rows without doc_id are scored but never learned from; repeated rows are
    scored alike; an empty table gives no rows.
    """
    # Every text is read once; what is learned and scored are its features.
    rows = saved(measured(docs))
    model = learn(rows, labels)

    def run(batches):
        for batch in batches:
            x = batch.column("x").flatten().to_numpy().reshape(-1, len(NAMES))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(model.scores(x))], ["doc_id", "score"]
            )

    return rows.select("doc_id", "x").mapInArrow(run, "doc_id long, score double").select(
        "doc_id",
        F.coalesce(remainder(F.col("doc_id"), FOLDS) == HELD, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= CUT).cast("int").alias("predicted"),
    )
