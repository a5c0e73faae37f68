"""Order over the whole table without a single-task window.

Rows are put in ranges of the key with about equal numbers of rows; a window runs in each range, and what it needs
from the ranges before or after comes from a table with one row per range. There are at most ``RANGES`` of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RANGES, ROWS = 16_384, 100_000
#: Ends that are compared with a key one by one; of more, every so manyth is looked at first.
STEP = 128
BUCKET = "_range"


def with_ranges(df: DataFrame, key: str, rows: int = ROWS) -> DataFrame:
    """Adds the number of the row's range, rising with the key; a null key is in the first."""
    n = df.count()
    parts = max(1, min(RANGES, -(-n // rows)))
    if parts == 1:
        return df.withColumn(BUCKET, F.lit(0))
    ends = df.agg(F.percentile_approx(key, [i / parts for i in range(1, parts)], max(10_000, 10 * parts))).first()[0]
    return df.withColumn(BUCKET, F.coalesce(_below(sorted(set(ends)), F.col(key)), F.lit(0)))


def _below(ends: list, key: Column) -> Column:
    """How many of the sorted ends are less than the key."""
    counted = lambda a: F.size(F.filter(a, lambda e: e < key))
    if len(ends) <= STEP:
        return counted(F.array(*(F.lit(e) for e in ends)))
    full = counted(F.array(*(F.lit(e) for e in ends[STEP - 1 :: STEP])))
    return full * STEP + counted(F.slice(F.array(*(F.lit(e) for e in ends)), full * STEP + 1, F.lit(STEP)))


def _in_range(key: str) -> Window:
    return Window.partitionBy(BUCKET).orderBy(key)


def numbered(df: DataFrame, key: str, name: str = "rn") -> DataFrame:
    """Row number from 1 by the key, over the whole table."""
    df = with_ranges(df, key)
    per = df.groupBy(BUCKET).agg(F.count("*").alias("_n"))
    before = per.select(BUCKET, F.coalesce(F.sum("_n").over(Window.orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    df = df.join(F.broadcast(before), BUCKET)  # at most RANGES rows
    return df.withColumn(name, (F.row_number().over(_in_range(key)) + F.col("_before")).cast("long")).drop("_before", BUCKET)


def previous(df: DataFrame, key: str, column: str, name: str) -> DataFrame:
    """Adds the column's value in the row before, by the key, over the whole table; null for the first."""
    df = with_ranges(df, key)
    last = df.groupBy(BUCKET).agg(F.max_by(column, key).alias("_last"))
    carried = last.select(BUCKET, F.lag("_last").over(Window.orderBy(BUCKET)).alias("_carried"))
    df = df.join(F.broadcast(carried), BUCKET)
    first = F.row_number().over(_in_range(key)) == 1
    return df.withColumn(name, F.when(first, F.col("_carried")).otherwise(F.lag(column).over(_in_range(key)))).drop("_carried", BUCKET)


def filled_between(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Nulls become the straight line, by row position, between the nearest values; at the ends, the nearest value."""
    df = with_ranges(numbered(df, key, "_rn"), key)
    point = {c: F.when(F.col(c).isNotNull(), F.struct(F.col("_rn").alias("at"), F.col(c).alias("x"))) for c in columns}
    per = df.groupBy(BUCKET).agg(*(F.max_by(point[c], F.when(F.col(c).isNotNull(), F.col("_rn"))).alias(f"_hi_{c}") for c in columns), *(F.min_by(point[c], F.when(F.col(c).isNotNull(), F.col("_rn"))).alias(f"_lo_{c}") for c in columns))
    order = Window.orderBy(BUCKET)
    carried = per.select(
        BUCKET,
        *(F.last(f"_hi_{c}", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1)).alias(f"_b_{c}") for c in columns),
        *(F.first(f"_lo_{c}", ignorenulls=True).over(order.rowsBetween(1, Window.unboundedFollowing)).alias(f"_a_{c}") for c in columns),
    )
    df = df.join(F.broadcast(carried), BUCKET)
    so_far = (Window.unboundedPreceding, 0)  # frames that only grow: both directions take one pass
    up, down = (Window.partitionBy(BUCKET).orderBy(o).rowsBetween(*so_far) for o in ("_rn", F.desc("_rn")))
    new: dict[str, Column] = {}
    for c in columns:
        before = F.coalesce(F.last(point[c], ignorenulls=True).over(up), F.col(f"_b_{c}"))
        after = F.coalesce(F.last(point[c], ignorenulls=True).over(down), F.col(f"_a_{c}"))
        line = before["x"] + (after["x"] - before["x"]) * (F.col("_rn") - before["at"]) / (after["at"] - before["at"])
        new[c] = F.when(F.col(c).isNotNull(), F.col(c)).when(before.isNull(), after["x"]).when(after.isNull(), before["x"]).otherwise(line)
    keep = [x for x in df.columns if x not in (BUCKET, "_rn") and not x.startswith(("_b_", "_a_"))]
    return df.select(*(new[x].alias(x) if x in new else F.col(x) for x in keep))
