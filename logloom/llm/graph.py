"""Connected components of an edge table, by alternating large-star and small-star steps (Kiveris et al., 2014).

Every step is a group minimum (combined before the shuffle) and a join; no node's neighbours are ever listed. Each step
is written to the shared folder, so lineage stays short and a lost executor costs one step.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

#: More steps than any graph needs: they number about the logarithm squared of its nodes.
MOST_STEPS = 200


def components(edges: DataFrame) -> DataFrame:
    """edges(a, b): undirected, of one sortable type, without nulls. Returns node, component (the smallest node that it
    reaches) for each node with an edge to another node. An empty table gives an empty result."""
    pairs = stored(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    before = _digest(pairs)
    for _ in range(MOST_STEPS):
        large = _star(pairs, whole=True)
        pairs = stored(_star(large, whole=False), "star")
        after = _digest(pairs)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(pairs.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()


def _digest(pairs: DataFrame) -> tuple:
    """What tells one set of pairs from another without comparing rows: their number and 128 bits over them."""
    return tuple(pairs.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u", F.lit(1)))).first())


def _star(pairs: DataFrame, whole: bool) -> DataFrame:
    """pairs(u, v), u > v. Large-star links each larger neighbour of a node to the smallest of its neighbourhood;
    small-star does so with the node itself and its smaller neighbours."""
    down = pairs.select(F.col("u").alias("n"), F.col("v").alias("x"))
    around = down.unionByName(pairs.select(F.col("v").alias("n"), F.col("u").alias("x"))) if whole else down
    least = around.groupBy("n").agg(F.least(F.min("x"), F.first("n")).alias("m"))
    moved = around.where("x > n") if whole else around.unionByName(around.select("n", F.col("n").alias("x")))
    return moved.join(least, "n").select(F.col("x").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
