"""Randomness that depends on the row alone, and is the same in any engine that has MD5."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def draw(seed: str, key: Column) -> Column:
    """A whole number from 0 to 2**32 - 1."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")).cast("binary")), 1, 8), 16, 10).cast("long")


def uniform(seed: str, key: Column) -> Column:
    return draw(seed, key) / F.lit(4294967296.0)


def draw_sql(seed: str, key: str) -> str:
    """The same in DuckDB."""
    return f"('0x' || substr(md5('{seed}:' || {key}), 1, 8))::BIGINT"


def uniform_sql(seed: str, key: str) -> str:
    return f"({draw_sql(seed, key)} / 4294967296.0)"
