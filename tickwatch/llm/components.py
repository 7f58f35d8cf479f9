"""Connected components of a graph given as pairs of long ids."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickwatch.session import stage


def _smallest(edges: DataFrame, node: str, other: str) -> DataFrame:
    return edges.groupBy(F.col(node).alias("node")).agg(F.min(other).alias("least"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is tied to the smallest node of its neighbourhood."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = _smallest(both, "a", "b").select("node", F.least("node", "least").alias("least"))
    return (both.join(least, both["a"] == least["node"]).filter(F.col("b") > F.col("a"))
            .select(F.col("least").alias("a"), "b").distinct())


def _small_star(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node itself, are tied to the smallest of them."""
    least = _smallest(edges, "b", "a")
    tied = edges.join(least, edges["b"] == least["node"]).select(F.col("least").alias("a"), F.col("a").alias("b"))
    return tied.union(least.select(F.col("least").alias("a"), F.col("node").alias("b"))).filter(
        F.col("a") < F.col("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root: the smallest node each node of `edges` (columns a, b) is linked with.

    Alternating large and small stars (Kiveris et al. 2014): a few rounds, each
    with edges no more than before, so a node linked with a third of all others
    is never gathered in one task. Each round is written before the next, so a
    lost executor costs one round. Loops and repeated pairs are allowed.
    """
    now = stage(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
                .filter(F.col("a") < F.col("b")).distinct(), "edges")
    mark = None
    while True:
        found = now.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("h")).first()
        if (found["n"], found["h"]) == mark:
            return now.select(F.col("b").alias("node"), F.col("a").alias("root"))
        mark = (found["n"], found["h"])
        now = stage(_small_star(_large_star(now)), "edges")
