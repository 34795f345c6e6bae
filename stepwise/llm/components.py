"""Connected components of a table of links, by rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepwise.llm.shared import saved


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of links(a, b): the smallest node it reaches.

    Large-star and small-star rounds: the edges of a node move to its smallest neighbour until
    nothing changes, which takes a number of rounds logarithmic in the number of nodes.  Each
    round is two aggregates and two joins of thin rows, written to the shared folder.  Null and
    self links are ignored; no links give no rows.
    """
    edges = saved(
        links.where("a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct()
    )
    state = _state(edges)
    while state["n"]:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Large star: neighbours above a node go to the smallest of its neighbourhood.
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = (
            both.join(least, "u")
            .where("v > u")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .distinct()
        )
        # Small star: what remains below a node, and the node, go to the smallest below it.
        down = large.where("u > v")
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        joined = down.join(least, "u")
        edges = saved(
            joined.select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(joined.select("u", F.col("m").alias("v")))
            .where("u > v")
            .distinct()
        )
        before, state = state, _state(edges)
        if state == before:
            break
    roots = edges.groupBy("u").agg(F.min("v").alias("root"))
    return roots.select(F.col("u").alias("node"), "root").union(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root"))
        .distinct()
        .join(roots.select(F.col("u").alias("node")), "node", "left_anti")
    )


def _state(edges: DataFrame) -> dict:
    """Number of edges and a sum over their hashes: equal states are equal edge tables."""
    code = F.xxhash64("u", "v").cast("decimal(20,0)")
    return edges.agg(F.count("*").alias("n"), F.sum(code).alias("code")).first().asDict()
