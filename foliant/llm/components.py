"""Connected components of a graph that need not fit on any machine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.session import cut_lineage, union_all

#: Rounds after which something must be wrong: they grow with the logarithm of the longest path.
MAX_ROUNDS = 60


def _oriented(edges: DataFrame) -> DataFrame:
    """(a, b) with a > b."""
    return edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b")


def _star(edges: DataFrame, centre: str, other: str) -> DataFrame:
    """Every neighbour of a node is linked to the smallest node among the node and these neighbours. The smallest is a grouped
    minimum, so a node with many neighbours costs one row per task there, and its rows in the join can be split."""
    lowest = edges.groupBy(F.col(centre).alias("_c")).agg(F.min(other).alias("_low"))
    joined = edges.join(lowest, F.col(centre) == F.col("_c")).select(
        F.col(centre).alias("_c"), F.col(other).alias("_o"), F.least("_low", centre).alias("_low"))
    return joined


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node reachable from every node that has an edge.

    Rounds of large-star (link larger neighbours to the smallest neighbour) and small-star (the same for smaller ones), each
    written to the checkpoint folder, until edges no longer change; then every edge leads to its component. Loops, repeated
    and both-way edges are allowed; edges with a null end are ignored; without edges there are no rows.
    """
    now = cut_lineage(_oriented(edges.select(F.col(a).alias("a"), F.col(b).alias("b"))).distinct())
    before = None
    for _ in range(MAX_ROUNDS):
        both = union_all(now, now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _star(both, "a", "b").where("_o > _c").select(F.col("_o").alias("a"), F.col("_low").alias("b")).where("a > b").distinct()
        stars = _star(large, "a", "b")
        small = union_all(stars.select(F.col("_o").alias("a"), F.col("_low").alias("b")), stars.select(F.col("_c").alias("a"), F.col("_low").alias("b")))
        now = cut_lineage(small.where("a > b").distinct())
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return union_all(now.select(F.col("a").alias("node"), F.col("b").alias("component")), roots)
