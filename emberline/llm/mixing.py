"""Mixing of sources to target weights by Efraimidis-Spirakis sampling (DataFrame operations only).

A document's key is -ln(u) / quality weight for a reproducible uniform u; a source's documents in order of their keys
are a weighted sample without replacement of any length. A source's target is met by complete epochs of all its
documents first, and by a prefix of that order for the fraction that is left. What a prefix of whole documents can't
fill is offered once more, in the same order, to the documents that still fit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberline.llm.common import WORD, cut, text_or_empty

WEIGHTS = (5, 2, 1)
#: Rows of a key bucket, about: a source is sorted in so many tasks as it has times that.
ROWS = 20_000


def quality_weights(labels: DataFrame) -> DataFrame:
    """``(doc_id, weight)``: 1 for good quality, 0.25 for bad; of several labels the best counts."""
    return labels.where("doc_id is not null").groupBy("doc_id").agg(F.when(F.max("quality") == 1, 1.0).when(F.max("quality") == 0, 0.25).alias("weight"))


def targets(sizes: DataFrame, total_share: float = 1.5, most: float = 2.0, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """``(source, source_size)`` -> also ``target``: shares by weight, none above ``most`` times its source's size.

    With sources sorted by size over weight, the first ones are capped and all others are at one level times their
    weight, which prefix sums give without iteration. This table has one row per source.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    t = sizes.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(most))
    t = t.withColumn("ratio", F.col("cap") / F.col("weight"))
    by_ratio = Window.orderBy("ratio", F.col("source").isNull(), "source")
    capped = F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    open_weight = F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing))
    whole = Window.partitionBy()
    t = t.withColumn("level", (F.sum("source_size").over(whole) * F.lit(total_share) - capped) / open_weight)
    t = t.withColumn("level", F.min(F.when(F.col("ratio") >= F.col("level"), F.struct("ratio", F.col("source").isNull().alias("n"), "source", "level"))).over(whole)["level"])
    return t.select("source", "source_size", F.least("cap", F.col("weight") * F.col("level")).alias("target"))


def _before(rows: DataFrame, order: list) -> DataFrame:
    """Adds ``before``: sizes of the same source's rows with lesser keys. Buckets are ranges of the key's order."""
    part = rows.groupBy("source", "bucket").agg(F.sum("size").alias("in_bucket"))
    w = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    part = part.select(F.col("source").alias("s"), F.col("bucket").alias("b"), F.coalesce(F.sum("in_bucket").over(w), F.lit(0)).alias("head"))
    within = Window.partitionBy("source", "bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("before", F.coalesce(F.sum("size").over(within), F.lit(0)))
    return rows.join(part, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b"))).withColumn("before", F.col("before") + F.col("head")).drop("s", "b", "head")


def mix(docs: DataFrame, weights: DataFrame | None = None, total_share: float = 1.5, most: float = 2.0, seed: int = 9, rows_each: int = ROWS) -> DataFrame:
    """One row per document: ``doc_id, size, source_size, target, taken`` (words; ``source`` follows).

    ``weights`` has one ``weight`` > 0 per doc_id; documents without one weigh 0.5. Sources without a word have target
    0. Null texts have no words, null sources are one source, the last. Equal keys are ordered by doc_id and size;
    repeated rows count as documents of their own, and of rows alike in both which is taken isn't defined. Texts may
    have any length; they don't move. Other columns are ignored. An empty table gives an empty result. Targets are made
    in one task, of one row for each source.
    """
    rows = docs.select("doc_id", F.regexp_count(text_or_empty(), F.lit(WORD)).cast("long").alias("size"), "source")
    rows = rows.join(weights.withColumnRenamed("doc_id", "weighted"), F.col("doc_id") == F.col("weighted"), "left").drop("weighted") if weights is not None else rows.withColumn("weight", F.lit(None).cast("double"))
    digits = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("doc_id").cast("string")).cast("binary")), 1, 12), 16, 10).cast("double")
    rows = rows.withColumn("key", -F.log((digits + 0.5) / float(1 << 48)) / F.coalesce("weight", F.lit(0.5)))
    rows = cut(rows.drop("weight"))
    sizes = cut(rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows")).withColumnRenamed("source", "of_source"))
    parts = F.ceil(F.col("rows") / F.lit(rows_each))
    bucket = F.floor(parts * (1 - F.exp(-F.col("key") / 2))).cast("int").alias("bucket")
    rows = rows.join(sizes, F.col("source").eqNullSafe(F.col("of_source"))).select("doc_id", "size", "source", "key", bucket)
    order = ["key", "doc_id", "size"]
    goal = targets(sizes.select(F.col("of_source").alias("source"), "source_size"), total_share, most)
    goal = goal.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)).withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
    goal = cut(goal.withColumnRenamed("source", "of_source"))
    of = F.col("source").eqNullSafe(F.col("of_source"))
    first = _before(rows, order).join(goal, of).drop("of_source").withColumn("chosen", F.col("before") + F.col("size") <= F.col("rest"))
    first = cut(first)
    left = first.groupBy("source").agg((F.first("rest") - F.coalesce(F.sum(F.when(F.col("chosen"), F.col("size"))), F.lit(0))).alias("gap")).withColumnRenamed("source", "of_source")
    first = first.drop("before").join(left, of).drop("of_source")
    open_ = _before(first.where(~F.col("chosen") & (F.col("size") <= F.col("gap"))), order)
    open_ = open_.withColumn("chosen", F.col("before") + F.col("size") / 2 <= F.col("gap")).drop("before")
    out = open_.unionByName(first.where(F.col("chosen") | (F.col("size") > F.col("gap"))))
    return out.select("doc_id", "size", "source_size", "target", (F.col("epochs") * F.col("size") + F.when(F.col("chosen"), F.col("size")).otherwise(0)).cast("long").alias("taken"), "source")


#: The same in DuckDB's SQL, for the whole table of documents and the quality weights of ``labels``.
MIX_SQL = """
WITH q AS (SELECT doc_id, CASE max(quality) WHEN 1 THEN 1.0 WHEN 0 THEN 0.25 END::DOUBLE AS weight FROM {labels} WHERE doc_id IS NOT NULL GROUP BY doc_id),
d AS (
  SELECT d.doc_id, d.source, len(regexp_extract_all(coalesce(d.text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
    -ln((('0x' || substr(md5('9:' || d.doc_id), 1, 12))::BIGINT::DOUBLE + 0.5) / 281474976710656.0) / coalesce(q.weight, 0.5) AS key
  FROM {documents} d LEFT JOIN q ON d.doc_id = q.doc_id),
s AS (SELECT source, sum(size)::DOUBLE AS source_size FROM d GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END::DOUBLE AS weight FROM s),
l AS (
  SELECT *, 2 * source_size / weight AS ratio,
    (1.5 * sum(source_size) OVER () - coalesce(sum(2 * source_size) OVER (ORDER BY 2 * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
      / sum(weight) OVER (ORDER BY 2 * source_size / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM w),
t AS (
  SELECT source, source_size, least(2 * source_size, weight * (SELECT level FROM l WHERE ratio >= level ORDER BY ratio, source NULLS LAST LIMIT 1)) AS target FROM l),
g AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS epochs FROM t),
r AS (SELECT *, target - epochs * source_size AS rest FROM g),
a AS (
  SELECT d.*, r.source_size, r.target, r.epochs, r.rest,
    sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id, d.size ROWS UNBOUNDED PRECEDING) <= r.rest AS chosen
  FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source),
p AS (SELECT *, rest - coalesce(sum(CASE WHEN chosen THEN size END) OVER (PARTITION BY source), 0) AS gap FROM a),
b AS (
  SELECT *, chosen OR (size <= gap AND
    coalesce(sum(CASE WHEN NOT chosen AND size <= gap THEN size END) OVER (PARTITION BY source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + size / 2.0 <= gap) AS pick
  FROM p)
SELECT doc_id, size, source_size::BIGINT AS source_size, target, (epochs * size + CASE WHEN pick THEN size ELSE 0 END)::BIGINT AS taken, source FROM b
"""
