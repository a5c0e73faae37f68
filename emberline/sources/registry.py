"""Named tables in a folder: scores of detectors, models, final tables. Saving again replaces the table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from emberline.sources.tables import sink


def _path(folder: str, name: str) -> str:
    if not name or "/" in name or name.startswith((".", "_")):
        raise ValueError(f"not a name of a table: {name!r}")
    return f"{folder}/{name}"


def save(df: DataFrame, folder: str, name: str) -> DataFrame:
    """Writes the table and gives it back as it is read."""
    spark = df.sparkSession
    files = _files(spark, folder)
    files.mkdirs(_at(spark, folder))
    return spark.read.parquet(sink(df, _path(folder, name)))


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    if not saved(spark, folder, name):
        raise KeyError(f"no table {name} in {folder}")
    return spark.read.parquet(_path(folder, name))


def saved(spark: SparkSession, folder: str, name: str) -> bool:
    """True where the table has been written as a whole."""
    return _files(spark, folder).exists(_at(spark, f"{_path(folder, name)}/_SUCCESS"))


def names(spark: SparkSession, folder: str) -> list[str]:
    files = _files(spark, folder)
    if not files.exists(_at(spark, folder)):
        return []
    found = (s.getPath().getName() for s in files.listStatus(_at(spark, folder)))
    return sorted(n for n in found if "." not in n and not n.startswith("_"))


def _at(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _files(spark: SparkSession, path: str):
    return _at(spark, path).getFileSystem(spark._jsc.hadoopConfiguration())
