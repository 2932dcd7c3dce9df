"""Connected components of a link table by repeated contraction, all in tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from studyspark.operators.lineage import cut


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of `links` (a, b); root is the smallest node reachable.

    In each round every node moves to its smallest neighbour, and links between nodes that met
    vanish. Minima combine before the shuffle, so a node with very many links is no burden. Rounds
    grow with the logarithm of a component's width; each is a written table, which survives lost
    executors. Self links are allowed; an empty table gives no rows.
    """
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges = cut(both.distinct())
    roots = None
    while not edges.isEmpty():
        move = cut(
            edges.groupBy("a").agg(F.min("b").alias("low")).select(
                F.col("a").alias("node"), F.least("a", "low").alias("to")
            )
        )
        if roots is None:
            roots = move.select("node", F.col("to").alias("root"))
        else:
            roots = cut(
                roots.join(move.select(F.col("node").alias("root"), "to"), "root", "left").select(
                    "node", F.coalesce("to", "root").alias("root")
                )
            )
        left = move.select(F.col("node").alias("a"), F.col("to").alias("x"))
        right = move.select(F.col("node").alias("b"), F.col("to").alias("y"))
        edges = cut(
            edges.join(left, "a")
            .join(right, "b")
            .where(F.col("x") != F.col("y"))
            .select(F.col("x").alias("a"), F.col("y").alias("b"))
            .distinct()
        )
    if roots is None:
        return links.select(F.col("a").alias("node"), F.col("b").alias("root")).limit(0)
    return roots
