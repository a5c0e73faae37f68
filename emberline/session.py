"""Sessions, and how Python workers find this package."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)


def get_spark(master: str = "local[*]", name: str = "emberline", **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; keyword underscores stand for dots."""
    builder = SparkSession.builder.master(master).appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    for k, v in conf.items():
        builder = builder.config(k.replace("_", "."), v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("WARN")
    return spark


def workers_find_package(spark: SparkSession) -> None:
    """Workers that share this machine's folders import the package from where the driver did; elsewhere it is installed."""
    env = spark.sparkContext.environment
    paths = env.get("PYTHONPATH", "").split(os.pathsep) if env.get("PYTHONPATH") else []
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])


def work_folder(spark: SparkSession) -> str:
    """A new folder within spark.checkpoint.dir; where that is unset a temporary one, but on this machine alone, as in tests."""
    shared = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if shared is None and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{shared or tempfile.mkdtemp(prefix='emberline-')}/work-{uuid.uuid4().hex}"
