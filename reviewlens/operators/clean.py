"""Row selection, de-duplication and lookups."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import columns as c

ALL = "All"


def keep_listed(df: DataFrame, first: str, second: str, names: Sequence[str]) -> DataFrame:
    """Rows where either column contains a dictionary name."""
    return df.where(c.contains_any(first, names) | c.contains_any(second, names))


def lookup(df: DataFrame, dimension: DataFrame, key: str, dimension_key: str, value: str, target: str) -> DataFrame:
    """Exact left lookup; a miss is null."""
    small = dimension.select(F.col(dimension_key).alias("_key"), F.col(value).alias(target))
    return df.join(small, F.col(key) == F.col("_key"), "left").drop("_key")


def dedupe_first(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """First row of every key by a unique order column.

    Only keys and the order column are aggregated, with partial minima before the shuffle; the
    rows come back by a semi join on the order column, so copies of one key never meet.
    """
    firsts = df.groupBy(*keys).agg(F.min(order).alias(order)).select(order)
    return df.join(firsts, order, "left_semi")


def dedupe_first_text(df: DataFrame, text: str, order: str) -> DataFrame:
    """`dedupe_first` for a long key, compared by its 256-bit digest."""
    digest = df.select(F.sha2(text, 256).alias("_digest"), order)
    firsts = digest.groupBy("_digest").agg(F.min(order).alias(order)).select(order)
    return df.join(firsts, order, "left_semi")


def drop_any_null(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    return df.dropna("any", subset=list(subset) if subset else None)


def drop_incomplete(df: DataFrame) -> DataFrame:
    """Drop rows holding an empty string, zero, false, null or empty list in any column."""

    def filled(field: T.StructField) -> Column:
        col = F.col(field.name)
        if isinstance(field.dataType, T.StringType):
            return col != ""
        if isinstance(field.dataType, T.NumericType):
            return col != 0
        if isinstance(field.dataType, T.BooleanType):
            return col
        if isinstance(field.dataType, (T.ArrayType, T.MapType)):
            return F.size(col) > 0
        return col.isNotNull()

    return df.where(reduce(lambda a, b: a & b, [F.coalesce(filled(f), F.lit(False)) for f in df.schema]))


def choose(df: DataFrame, always: Sequence[str] = (), **choices: str | Sequence[str]) -> DataFrame:
    """Keep rows whose column is among the chosen values; `All` switches that filter off.

    Columns in `always` are filtered even when `All` is among their values.
    """
    for column, wanted in choices.items():
        wanted = [wanted] if isinstance(wanted, str) else list(wanted)
        if column in always or ALL not in wanted:
            df = df.where(F.col(column).isin(wanted))
    return df


def in_order(df: DataFrame, column: str, labels: DataFrame) -> DataFrame:
    """Add `ord` of an ordered category; a label outside the list becomes null."""
    listed = labels.select("ord", F.col("label").alias("_label"))
    return (
        df.join(listed, F.col(column) == F.col("_label"), "left")
        .withColumn(column, F.col("_label"))
        .drop("_label")
    )


def first_match_join(df: DataFrame, column: str, dictionary: DataFrame) -> DataFrame:
    """Dictionary row whose name is a substring of the column, the lowest `ord` winning.

    Distinct values are cut into substrings of the lengths the dictionary has, which turns the
    substring test into an equality join that works for a dictionary of any size.
    """
    lengths = [r[0] for r in dictionary.select(F.length("name")).distinct().collect()]
    values = df.select(F.col(column).alias("_value")).where(F.col(column).isNotNull()).distinct()

    def substrings(length: int) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.length("_value") - length + 1, F.lit(1)))
        return F.transform(starts, lambda i: F.substring(F.col("_value"), i, F.lit(length)))

    pieces = F.array_distinct(F.flatten(F.array(*[substrings(n) for n in sorted(lengths)])))
    found = (
        values.select("_value", F.explode(pieces).alias("name"))
        .join(dictionary, "name")
        .groupBy("_value")
        .agg(F.min(F.struct("ord", "name", "family")).alias("_hit"))
        .select("_value", F.col("_hit.name").alias("matched_name"), F.col("_hit.family").alias("matched_family"))
    )
    return df.join(found, F.col(column) == F.col("_value"), "left").drop("_value")
