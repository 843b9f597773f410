"""The three ranks that scoring needs, which differ on ties, and places in an order.

A window over a class would hold the class's rows in one task.  Ranks come from counts of distinct values instead.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WINDOW_ROWS = 5_000_000


def place_rank(order: list, by: list) -> Column:
    """Place in the given order over n - 1, ties apart; 0.5 for a lone row."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*by))
    return F.when(n == 1, F.lit(0.5)).otherwise((F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1) / (n - 1))


def value_ranks(df: DataFrame, by: list[str], value: str, window_rows: int = WINDOW_ROWS) -> DataFrame:
    """(by, value, below, tied, n) for each distinct value; nulls count as the lowest.

    Rows are reduced to counts of equal values before they are dealt.  Up to ``window_rows`` distinct values a group are
    summed in one window; beyond, they are dealt by value range, and no task holds a whole group.
    """
    from strandlight.session import kept

    counts = kept(df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("tied")))
    largest = counts.groupBy(*by).count().agg(F.max("count")).first()[0] or 0
    if largest <= window_rows:
        w = Window.partitionBy(*by)
        below = F.sum("tied").over(w.orderBy(value).rowsBetween(Window.unboundedPreceding, -1))
        return counts.select(*by, value, F.coalesce(below, F.lit(0)).alias("below"), "tied", F.sum("tied").over(w).alias("n"))
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # kept, so that both branches below see the same ranges even if an executor is lost between them
    dealt = kept(counts.repartitionByRange(ranges, *by, value).withColumn("_part", F.spark_partition_id()))
    starts = dealt.groupBy("_part", *by).agg(F.sum("tied").alias("_sum"))  # ranges x groups rows
    before = F.coalesce(F.sum("_sum").over(Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = starts.select("_part", *by, before.alias("_before"), F.sum("_sum").over(Window.partitionBy(*by)).alias("n"))
    inside = F.sum("tied").over(Window.partitionBy("_part", *by).orderBy(value).rowsBetween(Window.unboundedPreceding, -1))
    own = dealt.select("*", F.coalesce(inside, F.lit(0)).alias("_inside"))
    starts = starts.select(*[F.col(c).alias(f"_s{k}") for k, c in enumerate(["_part", *by])], "_before", "n")
    same = reduce(Column.__and__, (F.col(c).eqNullSafe(F.col(f"_s{k}")) for k, c in enumerate(["_part", *by])))
    return own.join(starts, same).select(*by, value, (F.col("_before") + F.col("_inside")).alias("below"), "tied", "n")


def with_ranks(df: DataFrame, metrics: list[str], by: str, rank: Callable[[Column, Column, Column], Column], name: str = "_rank_{}", window_rows: int = WINDOW_ROWS) -> DataFrame:
    """``df`` with ``rank(below, tied, n)`` of each metric among the rows of its group.

    The values of all metrics are counted in one pass; each metric's ranks are then joined on group and value.
    """
    if not metrics:
        return df
    listed = F.array(*[F.struct(F.lit(k).alias("_m"), F.col(m).cast("double").alias("_v")) for k, m in enumerate(metrics)])
    found = value_ranks(df.select(F.col(by).alias("_by"), F.explode(listed).alias("_x")).select("_by", "_x._m", "_x._v"), ["_by", "_m"], "_v", window_rows)
    ranked = found.select("_by", "_m", "_v", rank(F.col("below"), F.col("tied"), F.col("n")).alias("_rank"))
    out = df
    for k, m in enumerate(metrics):
        own = ranked.where(F.col("_m") == k).select(F.col("_by").alias(f"_by{k}"), F.col("_v").alias(f"_v{k}"), F.col("_rank").alias(name.format(m)))
        out = out.join(own, F.col(by).eqNullSafe(F.col(f"_by{k}")) & F.col(m).cast("double").eqNullSafe(F.col(f"_v{k}")), "left").drop(f"_by{k}", f"_v{k}")
    return out


def average_rank(below: Column, tied: Column, n: Column) -> Column:
    """Mean rank of ties over n - 1; 0.5 for a lone row."""
    return F.when(n == 1, F.lit(0.5)).otherwise((below + (tied - 1) / 2.0) / (n - 1))


def low_rank(below: Column, tied: Column, n: Column) -> Column:
    """Share of rows below over n - 1; 0.5 for a lone row."""
    return F.when(n == 1, F.lit(0.5)).otherwise(below / (n - 1))


def numbered(df: DataFrame, order: list, name: str, start: int = 0, ranges: int = 0) -> DataFrame:
    """``df`` with its rows' places in a total order, from ``start``: rows are dealt by range, counted in each, and each range's
    start is added.  No task holds more than a range; only the ranges' counts are summed together."""
    from strandlight.session import kept

    ranges = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = kept(df.repartitionByRange(ranges, *order).withColumn("_part", F.spark_partition_id()))
    sums = dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = F.broadcast(sums.select("_part", (before + start).alias("_before")))  # a row for each range
    place = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    return dealt.withColumn("_place", place).join(starts, "_part").withColumn(name, (F.col("_before") + F.col("_place")).cast("long")).drop("_part", "_place", "_before")
