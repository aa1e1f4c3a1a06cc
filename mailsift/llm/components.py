"""Connected components of a link table by alternating star operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailsift.llm.common import Workspace


def _least(edges: DataFrame) -> DataFrame:
    """For each node the smallest of itself and its neighbours (pre-aggregated before the shuffle)."""
    return edges.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Larger neighbours of a node are linked to the smallest node around it."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return (
        both.join(_least(both), "a").filter("b > a")
        .select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the smallest of them. Needs a > b."""
    least = _least(edges)
    return (
        edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        .union(least.select("a", F.col("m").alias("b"))).filter("a > b").distinct()
    )


def components(links: DataFrame, work: Workspace, most_rounds: int = 60) -> DataFrame:
    """``node, root`` for every node of ``links(a, b)`` (long): the root is the smallest node reachable.

    Each round shuffles the links a few times and is written to the shared folder; nothing reaches
    the driver but two sums, by which it sees that a round changed nothing. The number of rounds
    grows with the logarithm of the longest chain. A self-link or a repeated link changes nothing,
    links with a null end are left out, an empty table gives an empty one.
    """
    edges = work.keep(
        links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    )
    before = None
    for _ in range(most_rounds):
        edges = work.keep(_small_star(_large_star(edges)))
        state = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"no stable components after {most_rounds} rounds")
    roots = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.union(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
