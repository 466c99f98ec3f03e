"""Connected components in DataFrame operations, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.llm.common import checkpoint


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node that an edge (a, b) touches, but for the roots: root is the component's least node.

    Each round sends the larger neighbours of every node to its least neighbour (large star), then the smaller
    ones (small star), until the edges no longer change; rounds grow with the logarithm of the longest path. Edges
    are pre-aggregated by node. The edges of one node meet in one task, as thin rows that are sorted on disk where they
    don't fit: Spark doesn't split these joins, since their other side is an aggregate.
    Loops and repeated edges may occur; no rows give no rows.
    """
    here = checkpoint(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    sign = _sign(here)
    while sign[0]:
        both = here.unionByName(here.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = here.select(F.col("b").alias("u"), F.col("a").alias("v")).join(least.withColumnRenamed("a", "u"), "u").where("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b"))
        large = large.distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        here = checkpoint(small)
        before, sign = sign, _sign(here)
        if sign == before:
            break
    return here.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _sign(edges: DataFrame) -> tuple:
    """Count and order-free hash of the edges."""
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())
