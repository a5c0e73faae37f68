"""Small tables with every awkward case."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use inside.
CLASH = ("size", "key", "fp", "bucket", "n", "weight", "score", "slot", "part", "rank", "target", "root", "anchor", "place", "spans", "model", "quality", "toxic", "guard", "source_size", "h", "u", "v")


def words(r: random.Random, n: int) -> str:
    return " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7))) for _ in range(n))


def rows(seed: int = 0) -> list[tuple]:
    r = random.Random(seed)
    base = [words(r, 60) for _ in range(6)]
    shared = words(r, 80)
    texts = [
        *base,
        base[0],  # an exact copy
        base[1].replace(" ", "\n", 3),  # nearly
        base[2] + " " + shared,
        shared + " " + base[3],
        None,
        "",
        " \t\n",
        "one",
        "x" * 700,
        "ab" * 400,
        words(r, 40_000),  # very long
        "Ünï cödé 漢字 🙂 " * 30,
        "a b c <|endoftext|> d",
    ]
    out = [(i, t, ("en", "de", None)[i % 3], ("s1", "s2", None, "s3")[i % 4], len(t) if t else 0) for i, t in enumerate(texts)]
    return [*out, out[0], out[0], (None, base[4], "en", "s1", 1), (None, None, None, None, None)]


def docs(spark, seed: int = 0, empty: bool = False):
    df = spark.createDataFrame([] if empty else rows(seed), COLUMNS)
    return df.withColumns({c: F.lit("x") for c in CLASH}).repartition(3)


def labels(spark, empty: bool = False):
    got = [(i, i % 2, int(i % 5 == 0)) for i in range(12)] + [(0, 1, 1), (None, 1, 1), (3, None, None)]
    return spark.createDataFrame([] if empty else got, "doc_id long, quality int, toxic int").withColumn("text", F.lit("clash")).withColumn("weight", F.lit(3))
