"""Approximate nearest neighbours by learned partitions.

A nearest-neighbour graph of a bounded sample of vectors is cut into parts of equal size that few
edges leave: parts start from a recursive halving along directions of largest spread, and then
vertices swap to the part in which most of their neighbours lie, while sizes stay balanced.  A
small softmax classifier learns the part of a vector from the vector.  It gives every row one
part and sends every query to its most probable parts, where exact inner products rerank.

Parts may still hold very different numbers of rows, so rows and queries of a part are dealt into
chunks of bounded size, and each task compares one chunk of queries with one of rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stepwise.llm.shared import saved

NEAREST = 20
# Sampled vectors, and rows that a part should have; the number of parts lies between bounds.
SAMPLE = 4096
ROWS_OF_PART = 800
FEWEST, MOST = 32, 256
GRAPH = 10
# Queries are sent to their most probable parts until these hold enough of the probability: few
# where vectors form clusters, and most where they do not.  Enough is what finds this share of
# the nearest for sampled vectors that the parts were not learned from.
AIM = 0.94
MASSES = (0.0, 0.5, 0.8, 0.9, 0.95, 0.98, 0.99, 0.995, 0.998, 0.999, 0.9995, 0.9999)
TESTED = 2048
CHUNK = 4096


@dataclass
class Router:
    weights: np.ndarray
    mass: float = 2.0

    def parts(self, x: np.ndarray, mass: float = 0.0) -> list[list[int]]:
        """The most probable parts of each row that together hold the mass, one at least."""
        odds = np.column_stack([x, np.ones(len(x))]) @ self.weights
        p = np.exp(odds - odds.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        order = np.argsort(-p, axis=1, kind="stable")
        count = (np.cumsum(np.take_along_axis(p, order, 1), axis=1) < mass).sum(axis=1) + 1
        count = np.minimum(count, p.shape[1])
        return [row[:n].tolist() for row, n in zip(order, count, strict=True)]


def graph(x: np.ndarray, neighbours: int) -> np.ndarray:
    """Indices of each vector's nearest others by inner product."""
    out = np.zeros((len(x), min(neighbours, len(x) - 1)), np.int64)
    for at in range(0, len(x), 1024):
        near = x[at : at + 1024] @ x.T
        near[np.arange(len(near)), at + np.arange(len(near))] = -np.inf
        out[at : at + 1024] = np.argpartition(-near, out.shape[1] - 1, axis=1)[:, : out.shape[1]]
    return out


def halved(x: np.ndarray, parts: int) -> np.ndarray:
    """parts groups of nearly equal size, by halving along the direction of largest spread."""
    part = np.zeros(len(x), np.int64)
    todo = [(np.arange(len(x)), parts, 0)]
    while todo:
        rows, n, first = todo.pop()
        if n == 1 or len(rows) < 2:
            part[rows] = first
            continue
        centred = x[rows] - x[rows].mean(axis=0)
        _, axes = np.linalg.eigh(centred.T @ centred)
        order = rows[np.argsort(centred @ axes[:, -1], kind="stable")]
        low = n // 2
        cut = len(rows) * low // n
        todo += [(order[:cut], low, first), (order[cut:], n - low, first + low)]
    return part


def balanced_partition(near: np.ndarray, part: np.ndarray, parts: int, rounds: int = 6) -> np.ndarray:
    """Refine a balanced partition of a graph: pairs of vertices that both gain swap parts."""
    n = len(part)
    part = part.copy()
    source = np.repeat(np.arange(n), near.shape[1])
    target = near.ravel()
    for _ in range(rounds):
        links = np.zeros((n, parts))
        np.add.at(links, (source, part[target]), 1)
        np.add.at(links, (target, part[source]), 1)
        best = links.argmax(axis=1)
        gain = links[np.arange(n), best] - links[np.arange(n), part]
        moving = np.flatnonzero(gain > 0)
        waiting: dict[tuple[int, int], list[int]] = {}
        swaps = 0
        for v in moving[np.argsort(-gain[moving], kind="stable")].tolist():
            here, there = int(part[v]), int(best[v])
            back = waiting.get((there, here))
            if back:
                other = back.pop()
                part[v], part[other] = there, here
                swaps += 1
            else:
                waiting.setdefault((here, there), []).append(v)
        if not swaps:
            break
    return part


def classifier(x: np.ndarray, part: np.ndarray, parts: int, steps: int = 150) -> Router:
    """Softmax regression of the part on the vector, by gradient steps with momentum."""
    z = np.column_stack([x, np.ones(len(x))])
    goal = np.zeros((len(x), parts))
    goal[np.arange(len(x)), part] = 1
    w = np.zeros((z.shape[1], parts))
    speed = np.zeros_like(w)
    size = max(np.square(z).sum(axis=1).mean(), 1e-9)
    for _ in range(steps):
        odds = z @ w
        p = np.exp(odds - odds.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        speed = 0.9 * speed + z.T @ (goal - p) / len(x) * (40 / size)
        w += speed
    return Router(w)


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and v (doubles) of the rows that take part."""
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return (
        vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
        .where("vec_id is not null and v is not null")
        .where(finite & F.exists("v", lambda x: x != 0))
    )


def train(rows: DataFrame, count: int) -> Router | None:
    """The router of usable rows, from at most ``SAMPLE`` of them; None for none."""
    share = min(1.0, 2 * (SAMPLE + TESTED) / max(count, 1))
    place = F.pmod(F.xxhash64(F.lit("sample"), "vec_id"), F.lit(1 << 30))
    picked = rows.where(place < int(share * (1 << 30)) + 1).orderBy(place, "vec_id").limit(SAMPLE + TESTED)
    found = picked.select("v").toArrow().column("v").to_pylist()
    if not found:
        return None
    width = max(len(v) for v in found)
    x = np.array([v + [0.0] * (width - len(v)) for v in found])
    x = np.unique(x, axis=0)
    x = x[np.random.default_rng(1).permutation(len(x))]
    learned = x[: len(x) - min(TESTED, len(x) // 3)]
    parts = max(1, min(MOST, max(FEWEST, count // ROWS_OF_PART), len(learned) // 16))
    if parts == 1:
        return Router(np.zeros((width + 1, 1)))
    near = graph(learned, GRAPH)
    router = classifier(learned, balanced_partition(near, halved(learned, parts), parts), parts)
    router.mass = enough(router, x[len(learned) :])
    return router


def enough(router: Router, unseen: np.ndarray, neighbours: int = NEAREST, queries: int = 256) -> float:
    """The least of MASSES that finds enough of the nearest among unseen vectors; 2, which is
    all parts, if none does or too few are there to tell."""
    if len(unseen) < 8 * neighbours:
        return 2.0
    part = np.array([p[0] for p in router.parts(unseen)])
    near = graph(unseen, neighbours)[:queries]
    for mass in MASSES:
        probed = router.parts(unseen[:queries], mass)
        hits = [np.isin(part[n], p).mean() for n, p in zip(near, probed, strict=True)]
        if np.mean(hits) >= AIM:
            return mass
    return 2.0


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.array([v[:width] + [0.0] * (width - len(v)) for v in column.to_pylist()]).reshape(-1, width)


def routed(rows: DataFrame, router: Router, mass: float = 0.0) -> DataFrame:
    """rows with an array of their most probable parts."""
    shared = rows.sparkSession.sparkContext.broadcast(router)

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            width = len(shared.value.weights) - 1
            parts = shared.value.parts(_matrix(batch.column("v"), width), mass)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(parts, pa.list_(pa.int32()))],
                [*batch.schema.names, "parts"],
            )

    kinds = ", ".join(f"{n} {k}" for n, k in rows.dtypes)
    return rows.mapInArrow(run, f"{kinds}, parts array<int>")


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of equally many rows, in double precision, summed in order."""
    out = np.zeros(len(q))
    for j in range(q.shape[1]):
        out += q[:, j] * x[:, j]
    return out


_FOUND = {"query_id": "int64", "vec_id": "int64", "score": "float64"}


def _nearest(nearest: int):
    # Matrix products round otherwise than the sums in order.  Every row at or above the last
    # product asked for, less what rounding can make of it, is compared in the exact order.

    def compare(queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({name: pd.Series(dtype=kind) for name, kind in _FOUND.items()})]
        lengths = rows["v"].map(len)
        for width in lengths.unique():
            # Only vectors of one length can be compared.
            some, asked = rows[lengths == width], queries[queries["v"].map(len) == width]
            ids, x = some["vec_id"].to_numpy(), np.stack(some["v"].tolist())
            for at in range(0, len(asked), 256):
                part = asked.iloc[at : at + 256]
                names, q = part["vec_id"].to_numpy(), np.stack(part["v"].tolist())
                near = q @ x.T
                near[names[:, None] == ids] = -np.inf
                keep = np.ones(near.shape, bool)
                if len(ids) > nearest:
                    border = -np.partition(-near, nearest - 1, axis=1)[:, nearest - 1 : nearest]
                    longest = np.linalg.norm(q, axis=1, keepdims=True) * np.linalg.norm(x, axis=1).max()
                    keep = ~(near < border - 4 * width * np.finfo(float).eps * longest)
                who, what = np.nonzero(keep)
                other = names[who] != ids[what]
                who, what = who[other], what[other]
                score = products(q[who], x[what])
                order = np.lexsort((ids[what], -score, who))
                who, what, score = who[order], what[order], score[order]
                first = np.searchsorted(who, who)
                best = np.arange(len(who)) - first < nearest
                out.append(pd.DataFrame({"query_id": names[who[best]], "vec_id": ids[what[best]], "score": score[best]}))
        return pd.concat(out)

    return compare


def search(vectors: DataFrame, queries: DataFrame, nearest: int = NEAREST) -> DataFrame:
    """query_id, rank, vec_id and score: for every usable row of queries(vec_id, embedding), the
    nearest rows of vectors found, by inner product, ties to the smaller vec_id.

    Null, zero and non-finite vectors, and rows without vec_id, take no part; a query is never
    its own neighbour.  Where many rows share one vector, only its ``nearest + 1`` smallest ids can
    be among the nearest of anything, so the others are indexed but leave before comparison.
    Vectors of other lengths are no candidates of a query.  Rows that repeat a vec_id and a vector
    count once; an empty table gives no rows.
    """
    rows = saved(usable(vectors).distinct())
    count = rows.count()
    router = train(rows, count)
    if router is None:
        return rows.select(
            F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0.0).alias("score")
        ).limit(0)
    index = saved(routed(rows, router).select("vec_id", "v", F.element_at("parts", 1).alias("part")))
    same = Window.partitionBy("v").orderBy("vec_id")
    index = index.withColumn("copy", F.row_number().over(same)).where(F.col("copy") <= nearest + 1)
    index = saved(index.select("vec_id", "v", "part"))
    asked = saved(
        routed(usable(queries).distinct(), router, router.mass).select("vec_id", "v", F.explode("parts").alias("part"))
    )
    # Chunks of a part, on either side.
    sizes = (
        index.groupBy("part").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("row_chunks"))
        .join(
            asked.groupBy("part").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("query_chunks")),
            "part",
        )
    )
    dealt = lambda n: F.pmod(F.xxhash64("vec_id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = (
        asked.join(sizes, "part")
        .withColumn("a", dealt("query_chunks"))
        .select("part", "a", every("row_chunks").alias("b"), "vec_id", "v")
    )
    right = (
        index.join(sizes, "part")
        .withColumn("b", dealt("row_chunks"))
        .select("part", every("query_chunks").alias("a"), "b", "vec_id", "v")
    )
    key = ["part", "a", "b"]
    found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(
        _nearest(nearest), "query_id long, vec_id long, score double"
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= nearest)
        .select("query_id", "rank", "vec_id", "score")
    )
