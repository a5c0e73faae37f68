"""Shards of the order, sliding windows, samples and repairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberline.functions.hashing import draw
from emberline.operators.order import filled_between, numbered


#: Rows of a block in which windows are made, about.
BLOCK = 100_000


def seq_shards(df: DataFrame, key: str, shards: int, position: str | None = None) -> DataFrame:
    """Adds ``_shard``: contiguous runs of ceil(n / shards) rows by the key; also the row's number, if named."""
    size = max(1, -(-df.count() // shards))
    rows = numbered(df, key, position or "_rn").withColumn("_shard", F.floor((F.col(position or "_rn") - 1) / F.lit(size)).cast("int"))
    return rows if position else rows.drop("_rn")


def windows(df: DataFrame, key: str, columns: list[str], size: int, shard: str = "_shard", position: str | None = None, block: int = BLOCK) -> DataFrame:
    """Adds ``window``: the last ``size`` rows of the shard up to this one, as arrays; null where there are fewer.

    Windows are made in blocks of consecutive rows, however few shards there are. The last ``size - 1`` rows of a block
    are also sent to the next one, where windows begin with them. ``position`` names the row's number over the whole
    table, if there is one, and goes.
    """
    block, at = max(block, size), F.col(position or "_at") - 1
    rows = df if position else numbered(df, key, "_at")
    own = F.floor(at / F.lit(block)).cast("long")
    blocks = F.when(at % block >= block - (size - 1), F.array(own, own + 1)).otherwise(F.array(own))
    rows = rows.withColumns({"_own": own, "_x": F.struct(F.col(shard).alias("shard"), F.array(*columns).alias("x"))}).withColumn("_block", F.explode(blocks))
    w = Window.partitionBy("_block").orderBy(position or "_at").rowsBetween(1 - size, 0)
    got = F.filter(F.collect_list("_x").over(w), lambda s: s["shard"].eqNullSafe(F.col(shard)))
    rows = rows.withColumn("window", got).where("_block = _own")
    full = F.when(F.size("window") == size, F.transform("window", lambda s: s["x"]))
    return rows.withColumn("window", full).drop("_own", "_x", "_block", position or "_at")


def row_shards(df: DataFrame, key: str, shards: int, seed: int = 42) -> DataFrame:
    """Adds ``_shard`` by a hash of the key."""
    return df.withColumn("_shard", F.pmod(draw(f"shard{seed}", F.col(key)), F.lit(shards)).cast("int"))


def hash_sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows that depend on the keys and the seed alone."""
    return df.orderBy(draw(f"sample{seed}", F.col(key)), key).limit(n)


def missing(df: DataFrame, columns: list[str]) -> DataFrame:
    """``(feature, n_missing)``."""
    one = df.agg(*(F.count_if(F.col(c).isNull()).alias(c) for c in columns))
    return one.select(F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).alias("n_missing")) for c in columns))).alias("m")).select("m.*")


def repair(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Fills gaps by straight lines; raises if a column has no value at all."""
    n, *gone = df.agg(F.count("*"), *(F.count_if(F.col(c).isNull()) for c in columns)).first()
    dead = [c for c, k in zip(columns, gone) if n and k == n]
    if dead:
        raise ValueError(f"no value to reconstruct from in {', '.join(dead)}")
    return filled_between(df, key, columns) if any(gone) else df
