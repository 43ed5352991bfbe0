"""Connected components of many small or large graphs held in one edge table."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradearea.sources.scratch import cut


def _ordered(edges: DataFrame, key: list[str], a: str, b: str) -> DataFrame:
    """Each edge once, smaller end first, without loops."""
    return (
        edges.filter(F.col(a) != F.col(b))
        .select(*key, F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
        .distinct()
    )


def connected(edges: DataFrame, key: Sequence[str], a: str, b: str,
              step: Callable[[DataFrame, str], DataFrame] = cut) -> DataFrame:
    """Node -> root (key, node, root) for every node that has an edge.

    Each round every node moves to its smallest neighbour, two jumps shorten the chains, and the
    edges are rewritten between the nodes they moved to. Merged nodes leave the edge table, so later
    rounds read ever fewer rows. Only the test "any edge left?" comes back to the driver. `step` writes the rounds.
    """
    key = list(key)
    left = step(_ordered(edges, key, a, b), "edges")
    rounds: list[DataFrame] = []
    while not left.isEmpty():
        both = left.unionByName(left.select(*key, F.col("b").alias("a"), F.col("a").alias("b")))
        up = both.groupBy(*key, "a").agg(F.min("b").alias("b")).select(
            *key, F.col("a").alias("node"), F.least("a", "b").alias("up"))
        for _ in range(2):
            further = up.select(*key, F.col("node").alias("up"), F.col("up").alias("_next"))
            up = up.join(further, [*key, "up"]).select(*key, "node", F.col("_next").alias("up"))
        up = step(up, "moves")
        rounds.append(up)
        moved = (
            left.join(up.select(*key, F.col("node").alias("a"), F.col("up").alias("_a")), [*key, "a"])
            .join(up.select(*key, F.col("node").alias("b"), F.col("up").alias("_b")), [*key, "b"])
        )
        left = step(_ordered(moved, key, "_a", "_b"), "edges")
    if not rounds:
        return left.select(*key, F.col("a").alias("node"), F.col("b").alias("root"))
    roots = rounds[0].withColumnRenamed("up", "root")
    for up in rounds[1:]:
        later = up.select(*key, F.col("node").alias("root"), F.col("up").alias("_up"))
        roots = roots.join(later, [*key, "root"], "left").select(
            *key, "node", F.coalesce("_up", "root").alias("root"))
    return roots
