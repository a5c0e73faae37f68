"""Readers, generators and sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberline.functions.hashing import uniform
from emberline.spec import FeatureSpec

TRAFFIC = ("packet_size", "connection_time", "failed_logins")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A file with a header and fixed columns; blanks are nulls, a malformed row fails the read."""
    return spark.read.csv(path, header=True, schema=schema, mode="FAILFAST")


def read_csv_inferred(spark: SparkSession, path: str, id_col: str = "ID") -> DataFrame:
    """Types from the data and a made-up key, unique but not consecutive."""
    return spark.read.csv(path, header=True, inferSchema=True).withColumn(id_col, F.monotonically_increasing_id())


def parse_positional(lines: DataFrame, line: str, columns: list[str]) -> DataFrame:
    """Fields by their position between commas, without quoting; a blank field is null and moves no other."""
    parts = F.split(line, ",", -1)
    return lines.withColumns({c: F.nullif(F.trim(F.get(parts, F.lit(i))), F.lit("")).try_cast("double") for i, c in enumerate(columns)})


def parse_by_pattern(lines: DataFrame, line: str, columns: list[str]) -> DataFrame:
    """The older reading: the n-th run of characters that aren't commas, so that fields after a blank one move left."""
    found = F.regexp_extract_all(line, F.lit("([^,]+)"), F.lit(1))
    return lines.withColumns({c: F.get(found, F.lit(i)).try_cast("double") for i, c in enumerate(columns)})


def read_jdbc(spark: SparkSession, url: str, name: str, key: str | None = None, lower: int = 0, upper: int = 0, parts: int = 1, **options: str) -> DataFrame:
    """A relational table; with a numeric key it is read in so many ranges at once."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", name).options(**options)
    if key:
        reader = reader.option("partitionColumn", key).option("lowerBound", lower).option("upperBound", upper).option("numPartitions", parts)
    return reader.load()


def clean_schema(spec: FeatureSpec) -> T.StructType:
    return T.StructType([T.StructField(spec.id, T.LongType()), *(T.StructField(c, T.DoubleType()) for c in spec.features)])


def literal_traffic(spark: SparkSession) -> DataFrame:
    """Three ordinary rows and an outlier."""
    return spark.createDataFrame([(1, 500.0, 12.0, 0.0), (2, 512.0, 14.0, 0.0), (3, 490.0, 11.0, 0.0), (4, 9500.0, 120.0, 5.0)], "id long, " + ", ".join(f"{c} double" for c in TRAFFIC))


def synthetic_traffic(spark: SparkSession, rows: int = 5000, anomalous: int = 250) -> DataFrame:
    """The ranges of ordinary and of the first, anomalous rows, and the least values."""
    bounds = {"packet_size": ((6000, 10000), (400, 600), 10), "connection_time": ((60, 140), (5, 25), 1), "failed_logins": ((3, 8), (0, 1), 0)}
    df = spark.range(1, rows + 1)
    for c, ((lo, hi), (a, b), least) in bounds.items():
        u = uniform(c, F.col("id"))
        odd = F.col("id") <= anomalous
        df = df.withColumn(c, F.greatest(F.floor(F.when(odd, lo + u * (hi - lo)).otherwise(a + u * (b - a)) + 0.5), F.lit(least)).cast("double"))
    return df


def telemetry(events: DataFrame) -> DataFrame:
    """Events as telemetry: value, seconds since the previous event, overall and of the user, and the number in props."""
    from pyspark.sql import Window

    from emberline.operators.order import previous

    at = F.unix_micros(F.col("ts").cast("timestamp"))
    rows = events.select(F.col("event_id").alias("id"), "user_id", "value", at.alias("at"), F.get_json_object("props", "$.k").cast("double").alias("k"))
    rows = previous(rows, "id", "at", "before")
    of_user = F.lag("at").over(Window.partitionBy("user_id").orderBy("id"))
    seconds = lambda a: F.coalesce((F.col("at") - a) / F.lit(1e6), F.lit(0.0))
    return rows.select("id", F.col("value").cast("double").alias("value"), seconds(F.col("before")).alias("gap_s"), seconds(of_user).alias("ugap_s"), "k")


def sink(df: DataFrame, path: str, partition_by: str | None = None) -> str:
    """Writes parquet to a folder beside, which then takes the place of ``path``.

    Between the two renames ``path`` doesn't exist for a moment; readers see old rows or new ones, never both. If a
    rename fails the old rows are put back, and an error is raised.
    """
    spark = df.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path
    beside, old = f"{path}.{uuid.uuid4().hex}", f"{path}.old.{uuid.uuid4().hex}"
    writer = df.write.partitionBy(partition_by) if partition_by else df.write
    writer.parquet(beside)
    fs = at(path).getFileSystem(spark._jsc.hadoopConfiguration())
    had = fs.exists(at(path))
    if had and not fs.rename(at(path), at(old)):
        fs.delete(at(beside), True)
        raise OSError(f"could not move {path} away")
    if not fs.rename(at(beside), at(path)):
        if had:
            fs.rename(at(old), at(path))
        raise OSError(f"could not put {beside} in the place of {path}")
    if had:
        fs.delete(at(old), True)
    return path


def read_shard(spark: SparkSession, path: str, shard: int) -> DataFrame:
    """One shard of a table written by ``_shard``; the other folders aren't read."""
    return spark.read.parquet(path).where(F.col("_shard") == shard)
