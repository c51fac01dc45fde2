"""Running sums and ranks for keys of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..lineage import cut


def running_sum(rows: DataFrame, key: str, order: list[str], value: Column, out: str) -> DataFrame:
    """``rows`` with ``out``: the sum of ``value`` over the rows of ``key`` up to each row in ``order``.

    Two levels: rows are dealt to ranges of key and order, which split a key of
    any size, and stored; sums run within a range, and what the key's earlier
    ranges hold is added, one number per key and range. No task sees more of a
    key than a range. Rows equal in key and order follow one another in any
    order; null keys and nulls in the order are values like others.
    """
    ranged = cut(rows.repartitionByRange(key, *order).withColumn("_range", F.spark_partition_id()))
    sums = ranged.groupBy("_range", key).agg(F.sum(value).alias("_sum"))
    earlier = Window.partitionBy(key).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select(F.col("_range").alias("_of"), F.col(key).alias("_key"), F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_range", key).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = ranged.withColumn("_own", F.sum(value).over(inside))
    joined = own.join(before, (F.col("_range") == F.col("_of")) & F.col(key).eqNullSafe(F.col("_key")))
    return joined.withColumn(out, F.col("_before") + F.col("_own")).drop("_range", "_of", "_key", "_before", "_own")


def ranked(rows: DataFrame, key: str, order: list[str], out: str) -> DataFrame:
    """``rows`` with ``out``: the rank, from 1, of each row within ``key``, keys of any size split.

    As ``running_sum`` of ones, but rows are numbered in order as the ranges are
    stored, so no window deals them again: a row's rank is its distance from the
    first of its key in the range, and what earlier ranges hold.
    """
    sorted_ranges = rows.repartitionByRange(key, *order).sortWithinPartitions(key, *order)
    numbered = cut(sorted_ranges.withColumn("_row", F.monotonically_increasing_id()).withColumn("_range", F.spark_partition_id()))
    firsts = numbered.groupBy("_range", key).agg(F.min("_row").alias("_first"), F.count("*").alias("_n"))
    earlier = Window.partitionBy(key).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first") + 1).alias("_shift")
    shifts = firsts.select(F.col("_range").alias("_of"), F.col(key).alias("_key"), before)
    joined = numbered.join(shifts, (F.col("_range") == F.col("_of")) & F.col(key).eqNullSafe(F.col("_key")))
    return joined.withColumn(out, F.col("_row") + F.col("_shift")).drop("_range", "_row", "_of", "_key", "_shift")
