"""Between nested review lists and flat review rows.

Flat rows are the working shape. A list is only built on the way out, and a group larger
than `max_elements` becomes several consecutive lists, numbered by `part`: part p holds the
elements from p * max_elements on.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch_path
from . import sizes

MAX_ELEMENTS = 20_000


def expand_reviews(df: DataFrame, array: str = "Reviews") -> DataFrame:
    """One row per element with its fields as columns; an empty list gives one row of nulls."""
    kept = [c for c in df.columns if c != array]
    return df.select(*kept, F.explode_outer(array).alias("_element")).select(*kept, "_element.*")


def explode_list(df: DataFrame, array: str, item: str) -> DataFrame:
    return df.select("*", F.explode_outer(array).alias(item))


def each(df: DataFrame, array: str | Column, item: str, *keep: str, position: str | None = None) -> DataFrame:
    """`(keep…, [position,] item)`, one row per non-null element.

    An inner explode makes the optimizer test the length of the array below the projection that
    computes it, that is, compute it twice; the outer one does not.
    """
    if position is None:
        return df.select(*keep, F.explode_outer(array).alias(item)).where(F.col(item).isNotNull())
    return df.select(*keep, F.posexplode_outer(array).alias(position, item)).where(F.col(item).isNotNull())


def long_form(df: DataFrame, array: str, position: str, value: str, *keep: str) -> DataFrame:
    """`(keep…, position, value)` of a vector column."""
    return df.select(*keep, F.posexplode(array).alias(position, value))


def array_to_columns(df: DataFrame, array: str, size: int, prefix: str) -> DataFrame:
    """First `size` values of a vector as columns next to the row they came from."""
    return df.select("*", *[F.get(array, F.lit(i)).alias(f"{prefix}{i}") for i in range(size)]).drop(array)


def nest_reviews(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    fields: Sequence[str],
    array: str = "Reviews",
    max_elements: int | None = None,
) -> DataFrame:
    """`(keys…, part, array)` with the elements of each list ordered by `order`."""
    keys, order, fields = list(keys), list(order), list(fields)
    max_elements = max_elements or MAX_ELEMENTS
    large = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_size")).where(F.col("_size") > max_elements)
    few = sizes.rows_within(large, sizes.BROADCAST_ROWS)
    if few != []:
        side = large if few is None else F.broadcast(large)
        side = side.select(*[F.col(k).alias(f"_{k}") for k in keys], "_size")
        same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
        sized = df.join(side, same, "left").drop(*[f"_{k}" for k in keys])
        small = sized.where(F.col("_size").isNull()).drop("_size").withColumn("part", F.lit(0))
        ranked = _ranked(sized.where(F.col("_size").isNotNull()).drop("_size"), keys, order)
        parts = F.floor(F.col("_rank") / F.lit(max_elements)).cast("int")
        numbered = small.unionByName(ranked.withColumn("part", parts).drop("_rank"))
    # A field of the order is held once.
    place = {o: f"_order{i}" for i, o in enumerate(order)}
    element = F.struct(*[F.col(o).alias(p) for o, p in place.items()], *[f for f in fields if f not in place])
    if few == []:
        # Grouped by the keys alone, the lists lie where a join on the keys looks for them.
        lists = df.groupBy(*keys).agg(F.array_sort(F.collect_list(element)).alias("_sorted")).withColumn("part", F.lit(0))
    else:
        lists = numbered.groupBy(*keys, "part").agg(F.array_sort(F.collect_list(element)).alias("_sorted"))
    return lists.select(
        *keys, "part", F.transform("_sorted", lambda e: F.struct(*[e[place.get(f, f)].alias(f) for f in fields])).alias(array)
    )


def _ranked(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Rank of every row within its key. The rows are cut into ranges of key and order, so a large
    key is ranked by many tasks; ranks are shifted by the counts of the ranges before."""
    path = scratch_path(df.sparkSession, "ranges")
    df.repartitionByRange(*keys, *order).withColumn("_range", F.spark_partition_id()).write.parquet(path)
    cut = df.sparkSession.read.parquet(path)
    counts = cut.groupBy(*keys, "_range").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("_range").alias("_of"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys], F.col("_range") == F.col("_of"))
    within = Window.partitionBy(*keys, "_range").orderBy(*order)
    ranked = cut.join(starts, same).withColumn("_rank", F.col("_start") + F.row_number().over(within) - 1)
    return ranked.drop("_range", "_of", "_start", *[f"_{k}" for k in keys])


def combine_parts(df: DataFrame, keys: Sequence[str], sums: Sequence[str]) -> DataFrame:
    """Add up per-list numbers over the parts of one key."""
    return df.groupBy(*keys).agg(*[F.sum(s).alias(s) for s in sums])
