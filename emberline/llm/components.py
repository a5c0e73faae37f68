"""Connected components by alternating star contraction on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.llm.common import stored


#: Parts that the edges of one node are dealt into where they meet the node's row.
SALT = 8


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One contraction: each node's (larger or smaller) neighbours are linked to the least of them."""
    both = edges.select("u", "v")
    if large:
        both = both.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    salted = least.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    joined = both.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALT)).cast("int")).join(salted.hint("merge"), ["u", "salt"])
    out = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")) if large else None
    if out is None:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u > v").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """Rows ``(u, v)`` of one integer type -> ``(node, root)`` with the least node of each component as root.

    Nodes without an edge aren't listed. Stars are aggregated before they are joined back; the rounds (about the
    logarithm of the longest chain) are written out, and each deletes what it read. An empty table gives an empty result.
    """
    edges, drop = stored(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v").distinct())
    seen = None
    while True:
        before = drop
        edges, drop = stored(_stars(_stars(edges, True), False))
        before()
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
