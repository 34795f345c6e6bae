"""Periodic runs of words, by a suffix automaton whose link tree is accessed word by word.

A run is a stretch of words with smallest period q (words q apart are equal), at least
``EXPONENT`` periods and ``LEAST`` words long, that no neighbouring word continues.

The states of a suffix automaton form a tree by their suffix links; the path from the state of a
prefix to the root holds all suffixes of that prefix.  A link-cut forest keeps, for each path that
was last coloured as a whole, the place at which its suffixes ended last.  Appending word i means
an *access* of its prefix's state: the path from the root becomes one preferred path of colour i,
and on the way every older segment is met once, with its colour c and the length L of its longest
suffix on the path.  That suffix ended at c before and ends at i now, so with d = i - c the words
from i - d - L + 1 to i have period d, and for d <= L they hold a square.  d is the smallest
period there, and the stretch cannot go on to the left, as a longer suffix would belong to the
segment; it is a run if it does not go on to the right either.  All accesses of a text of n words
meet O(n log n) segments.

Only stretches that can hold a run are given to the automaton: every three words in a row of a run
occur three times or more in it, so words outside such triples are passed over, and again within
what is left until nothing more falls away.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from stepwise.llm.textscan import text_bytes

# The passing over of stretches rests on these being at least 6 and 4.
LEAST, EXPONENT = 6, 4
TRIPLE, TIMES = 3, 3
# Bytes of collapsed text in one batch that goes back to Spark, roughly.
BATCH = 8 << 20


class Automaton:
    """States of the suffix automaton of a sequence: longest lengths, links, and the state of
    each prefix.  State 0 is none and 1 the root."""

    def __init__(self, sequence: list[int]):
        self.length, self.link, self.prefixes = [0, 0], [0, 0], []
        moves: list[dict[int, int]] = [{}, {}]
        length, link = self.length, self.link
        last = 1
        for letter in sequence:
            new = len(length)
            length.append(length[last] + 1)
            link.append(1)
            moves.append({})
            at = last
            while at and letter not in moves[at]:
                moves[at][letter] = new
                at = link[at]
            if at:
                goal = moves[at][letter]
                if length[goal] == length[at] + 1:
                    link[new] = goal
                else:
                    twin = len(length)
                    length.append(length[at] + 1)
                    link.append(link[goal])
                    moves.append(moves[goal].copy())
                    while at and moves[at].get(letter) == goal:
                        moves[at][letter] = twin
                        at = link[at]
                    link[goal] = link[new] = twin
            self.prefixes.append(new)
            last = new


class Forest:
    """Preferred paths of a rooted tree as splay trees ordered by depth; the root of a splay tree
    carries the colour of its path, and its parent is the tree parent of the path's top."""

    def __init__(self, parents: list[int]):
        self.parent = parents
        self.shallow = [0] * len(parents)
        self.deep = [0] * len(parents)
        self.colour = [-1] * len(parents)

    def _rise(self, x: int) -> None:
        """Rotate x above its parent in the same splay tree."""
        parent, shallow, deep = self.parent, self.shallow, self.deep
        p = parent[x]
        g = parent[p]
        if shallow[p] == x:
            inner = shallow[p] = deep[x]
            deep[x] = p
        else:
            inner = deep[p] = shallow[x]
            shallow[x] = p
        if inner:
            parent[inner] = p
        parent[p] = x
        parent[x] = g
        if g:
            if shallow[g] == p:
                shallow[g] = x
            elif deep[g] == p:
                deep[g] = x

    def splay(self, x: int) -> None:
        """Make x the root of its splay tree, with the path's colour."""
        parent, shallow, deep = self.parent, self.shallow, self.deep
        while True:
            p = parent[x]
            if not p or (shallow[p] != x and deep[p] != x):
                return
            g = parent[p]
            if not g or (shallow[g] != p and deep[g] != p):
                self.colour[x] = self.colour[p]
                self._rise(x)
                return
            if shallow[g] == p:
                same = shallow[p] == x
            else:
                same = deep[p] == x
            # x may become the root by the second rotation.
            self.colour[x] = self.colour[g]
            self._rise(p if same else x)
            self._rise(x)

    def access(self, node: int, colour: int) -> Iterator[tuple[int, int]]:
        """Give the path from the root to node this colour.  Yields each segment that it had
        before: its colour (-1: none yet) and its deepest node on the path."""
        parent, deep, colours = self.parent, self.deep, self.colour
        below, x = 0, node
        while x:
            self.splay(x)
            was = colours[x]
            yield was, x
            rest = deep[x]
            if rest:
                colours[rest] = was
            deep[x] = below
            below, x = x, parent[x]
        self.splay(node)
        colours[node] = colour


def stretch_runs(words: list[int], least: int = LEAST, exponent: int = EXPONENT) -> list[tuple[int, int, int]]:
    """Start, length and period of all runs of a sequence, by start and period."""
    automaton = Automaton(words)
    forest, length = Forest(automaton.link), automaton.length
    found, n = [], len(words)
    for i, state in enumerate(automaton.prefixes):
        for ended, deepest in forest.access(state, i):
            if ended < 0:
                continue
            period, size = i - ended, length[deepest]
            if period > size or size + period < max(least, exponent * period):
                continue
            if i + 1 == n or words[i + 1] != words[i + 1 - period]:
                found.append((ended - size + 1, size + period, period))
    found.sort(key=lambda run: (run[0], run[2]))
    return found


def live_stretches(words: np.ndarray) -> list[tuple[int, int]]:
    """Start and end of the stretches that can hold a run of ``EXPONENT`` periods and ``LEAST``
    words: all their words lie in triples that occur ``TIMES`` times in the stretch.

    Triples are compared by numbers that may coincide beyond two million different words, which
    only leaves more stretches.
    """
    n = len(words)
    if n < LEAST:
        return []
    base = np.uint64(int(words.max()) + 1)
    code = words.astype(np.uint64)
    triples = np.unique((code[:-2] * base + code[1:-1]) * base + code[2:], return_inverse=True)[1]
    at = np.arange(n - 2)
    owner = np.zeros(n - 2, np.int64)
    live = n
    while True:
        _, back, times = np.unique(owner * n + triples[at], return_inverse=True, return_counts=True)
        often = at[times[back] >= TIMES]
        if not len(often):
            return []
        # Triples that overlap or touch in the same stretch make one stretch.
        far = np.flatnonzero(np.diff(often) > 1)
        starts = often[np.concatenate([[0], far + 1])]
        ends = often[np.concatenate([far, [len(often) - 1]])] + TRIPLE
        starts, ends = _joined(starts, ends)
        long = ends - starts >= LEAST
        starts, ends = starts[long], ends[long]
        left = int((ends - starts).sum())
        if left == live or not left:
            return list(zip(starts.tolist(), ends.tolist(), strict=True))
        live = left
        counts = ends - starts - TRIPLE + 1
        owner = np.repeat(np.arange(len(starts)), counts)
        at = np.arange(int(counts.sum())) + np.repeat(starts - np.cumsum(counts) + counts, counts)


def _joined(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stretches with those that touch or overlap as one."""
    new = np.ones(len(starts), bool)
    new[1:] = starts[1:] > ends[:-1]
    first = np.flatnonzero(new)
    return starts[first], np.append(ends[first[1:] - 1], ends[-1])


def runs(words: list) -> list[tuple[int, int, int]]:
    """Start, length and period of all runs of a list of words, by start and period."""
    known: dict = {}
    numbered = [known.setdefault(word, len(known)) for word in words]
    # A run repeats at least five of its words.
    if len(words) - len(known) < LEAST - 1:
        return []
    found = []
    for start, end in live_stretches(np.array(numbered, np.int64)):
        found += [(start + s, size, q) for s, size, q in stretch_runs(numbered[start:end])]
    return found


def collapsed(words: list[bytes], found: list[tuple[int, int, int]]) -> bytes:
    """The words joined by spaces, without those that a run holds after its first period."""
    if found:
        drop = np.zeros(len(words) + 1, np.int64)
        for start, size, period in found:
            drop[start + period] += 1
            drop[start + size] -= 1
        words = [w for w, gone in zip(words, np.cumsum(drop).tolist()) if not gone]
    return b" ".join(words)


_RUN = StructType([StructField(name, LongType()) for name in ("start", "length", "period")])


def _batch(ids: pa.Array, found: list[list], texts: list[bytes]) -> pa.RecordBatch:
    flat = np.array([run for one in found for run in one], np.int64).reshape(-1, 3)
    borders = np.concatenate([[0], np.cumsum([len(one) for one in found])]).astype(np.int32)
    fields = pa.StructArray.from_arrays([pa.array(flat[:, i]) for i in range(3)], ["start", "length", "period"])
    return pa.RecordBatch.from_arrays(
        [ids, pa.ListArray.from_arrays(pa.array(borders), fields), pa.array(texts, pa.binary()).cast(pa.string())],
        ["doc_id", "runs", "collapsed"],
    )


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = text_bytes(batch.column(1))
        low, held, found, texts = 0, 0, [], []
        for i in range(batch.num_rows):
            words = data[offsets[i] : offsets[i + 1]].tobytes().split()
            found.append(runs(words))
            texts.append(collapsed(words, found[-1]))
            held += len(texts[-1])
            if held >= BATCH or i == batch.num_rows - 1:
                yield _batch(batch.column(0).slice(low, len(texts)), found, texts)
                low, held, found, texts = i + 1, 0, [], []


def find_runs(docs: DataFrame) -> DataFrame:
    """doc_id, runs and collapsed for every row of docs(doc_id, text), further columns ignored.

    Words are runs of characters other than white space (``\\x20`` and ``\\x09-\\x0D``), compared
    byte by byte.  runs are (start, length, period) in words, by start and period; collapsed is
    the text's words joined by single spaces without those that a run repeats, that is all but
    its first period.  Null, empty and wordless texts have no runs and collapse to an empty text.
    Rows stay as many as they are: repeated rows are treated alike, a null doc_id stays null, an
    empty table gives none.  A text is held whole in its task, and a stretch that the automaton
    reads takes some 500 bytes a word.
    """
    schema = StructType(
        [StructField("doc_id", LongType()), StructField("runs", ArrayType(_RUN)), StructField("collapsed", StringType())]
    )
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_scan, schema)


def with_periods(docs: DataFrame) -> DataFrame:
    """doc_id and text of docs, where some texts, chosen by id, repeat a part of themselves to
    their end.

    With h = crc32(doc_id) and g = h div 10: if h mod 10 = 0, then each of the n words from
    a = g mod n on becomes word a + (i - a) mod p, with p = 1 + (n - a) div (3 + g mod 8); such
    texts' words are joined by single spaces.  Texts without words or without an id stay.
    """
    h = F.crc32(F.col("doc_id").cast("string"))
    words = F.regexp_extract_all("text", F.lit("([^\\x20\\x09-\\x0D]+)"), 1)
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.floor(h / 10).alias("g"), (h % 10 == 0).alias("chosen"))
    found = found.withColumn("words", F.when(F.col("chosen"), words)).withColumn("n", F.size("words"))
    found = found.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")).cast("int"))
    found = found.withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))
    tail = F.transform(
        F.sequence(F.lit(0), F.col("n") - F.col("a") - 1),
        lambda i: F.get(F.col("words"), (F.col("a") + i % F.col("p")).cast("int")),
    )
    made = F.array_join(F.concat(F.slice("words", F.lit(1), F.col("a")), tail), " ")
    return found.select("doc_id", F.when(F.col("n") > 0, made).otherwise(F.col("text")).alias("text"))


def digests(found: DataFrame) -> DataFrame:
    """For each row of ``find_runs``: the number of runs, the longest one (the first of equals, of
    those the one of the smallest period), and SHA-256 of all runs and of the collapsed text."""
    best = F.array_max(
        F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("early"), (-r["period"]).alias("short")))
    )
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    length, period = F.col("best.length"), -F.col("best.short")
    return found.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best.early")).alias("start"),
        length.alias("length"),
        period.alias("period"),
        F.expr("1000 * best.length div -best.short").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
