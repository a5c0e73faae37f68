"""Scoring of a stream with pinned parameters (an extension: the batch engine has no streams)."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.spec import FeatureSpec


def pinned(moments: dict[str, dict[str, float]], spec: FeatureSpec, limit: float = 3.0):
    """A row-wise function from a stream of features to the same rows with ``static_flag``; moments are from a batch."""
    far = [F.abs((F.col(c) - F.lit(moments[c]["mean"])) / F.lit(max(moments[c]["pop"], 1e-10))) for c in spec.features]
    return lambda df: df.withColumn("static_flag", reduce(or_, (z > F.lit(limit) for z in far)).cast("int"))


def flag_rates(flagged: DataFrame, at: str = "ts", width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Flagged rows of each tumbling window; rows later than the watermark are dropped, as streams must."""
    return flagged.withWatermark(at, late).groupBy(F.window(at, width)).agg(F.count("*").alias("n"), F.sum("static_flag").alias("flagged"))
