"""Global positions of values without a window over one partition.

Values are counted first, so a value held by a third of all rows is one row here. The
distinct values are dealt out in ranges, as many as their number asks for; each range is
numbered on its own and shifted by the totals of the ranges before it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch_path, shared_dir
from . import sizes

VALUES_PER_RANGE = 100_000


def value_positions(df: DataFrame, column: str, weight: str | None = None, ranges: int | None = None) -> DataFrame:
    """`(column, n, rows_before, values_before)` for every distinct non-null value."""
    amount = F.sum(weight) if weight else F.count(F.lit(1))
    values = df.where(F.col(column).isNotNull()).groupBy(column).agg(amount.cast("bigint").alias("n"))
    # Far smaller than the rows it counts; counted, then cut.
    shared_dir(df.sparkSession)
    values = values.checkpoint()
    ranges = ranges or 1 + values.count() // VALUES_PER_RANGE
    # Written with its range, so that all readings see the same borders.
    path = scratch_path(df.sparkSession, "ranges")
    values.repartitionByRange(ranges, column).withColumn("_range", F.spark_partition_id()).write.parquet(path)
    cut = df.sparkSession.read.parquet(path)

    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = cut.groupBy("_range").agg(F.sum("n").alias("_rows"), F.count(F.lit(1)).alias("_values"))
    # One row per range: a hundred-thousandth of the distinct values.
    starts = totals.select(
        "_range",
        F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_rows_start"),
        F.coalesce(F.sum("_values").over(before), F.lit(0)).alias("_values_start"),
    )
    inside = Window.partitionBy("_range").orderBy(column)
    running = inside.rowsBetween(Window.unboundedPreceding, -1)
    return (
        cut.join(sizes.broadcast_within(starts), "_range")
        .withColumn("rows_before", F.col("_rows_start") + F.coalesce(F.sum("n").over(running), F.lit(0)))
        .withColumn("values_before", F.col("_values_start") + F.row_number().over(inside) - 1)
        .select(column, "n", "rows_before", "values_before")
    )


def dense_codes(df: DataFrame, column: str) -> DataFrame:
    """`(column, code)`: distinct labels numbered 0, 1, 2 … in label order."""
    return value_positions(df, column).select(column, F.col("values_before").cast("int").alias("code"))


def average_ranks(df: DataFrame, column: str, weight: str | None = None) -> DataFrame:
    """`(column, average_rank)`, ties sharing the mean of their ranks."""
    return value_positions(df, column, weight).select(
        column, (F.col("rows_before") + (F.col("n") + 1) / 2).alias("average_rank")
    )
