"""Counts, distributions, box statistics and correlations behind the reports."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import columns as c
from ..functions import text as x
from ..session import shared_dir
from . import nested, ordering, sizes


def count_by(df: DataFrame, *keys: str) -> DataFrame:
    """Rows per key; rows with a null key are left out."""
    return df.dropna("any", subset=list(keys)).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def means_by(df: DataFrame, key: str, measures: Sequence[str], order: str) -> DataFrame:
    """Means per key (the null key kept), highest first, missing means last."""
    means = df.groupBy(key).agg(*[F.avg(m).alias(m) for m in measures])
    return means.orderBy(F.col(order).desc_nulls_last(), key)


def _long_values(df: DataFrame, columns: Sequence[str], *keys: str) -> DataFrame:
    measures = df.select(*keys, *[F.col(m).cast("double").alias(m) for m in columns])
    return measures.unpivot(list(keys), list(columns), "measure", "value").where(F.col("value").isNotNull())


def value_shares(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """`(measure, value, n, share)`: relative frequency of each value of each column."""
    return shares_of_counts(value_counts(_long_values(df, columns), ["measure"], "value"))


def shares_of_counts(counts: DataFrame) -> DataFrame:
    """The same from `(measure, value, n)`, of which there are few."""
    total = F.sum("n").over(Window.partitionBy("measure"))
    return counts.withColumn("share", F.col("n") / total).orderBy("measure", "value")


def ordered_counts(df: DataFrame, column: str, labels: DataFrame) -> DataFrame:
    """Rows per listed label in list order, zero counts included, unlisted labels left out."""
    counts = df.groupBy(F.col(column).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    return counts_in_order(counts, labels)


def counts_in_order(counts: DataFrame, labels: DataFrame) -> DataFrame:
    """The same from `(label, n)`."""
    listed = F.broadcast(labels)
    counted = counts.join(listed.select("label"), "label", "left_semi")
    return (
        listed.join(counted, "label", "left")
        .select("ord", "label", F.coalesce("n", F.lit(0)).alias("n"))
        .orderBy("ord")
    )


def top_and_other(
    df: DataFrame, column: str, top: int = 20, longer_than: int = 20, keep: int = 28, other: str = "Other"
) -> DataFrame:
    """Rows per value for the `top` most frequent values, the rest summed up as one label."""
    return top_of_counts(count_by(df, column).withColumnRenamed(column, "label"), top, longer_than, keep, other)


def top_of_counts(counts: DataFrame, top: int = 20, longer_than: int = 20, keep: int = 28, other: str = "Other") -> DataFrame:
    """The same from `(label, n)`."""
    leaders = counts.orderBy(F.desc("n"), "label").limit(top)
    # `leaders` has at most `top` rows.
    rest = counts.join(F.broadcast(leaders.select("label")), "label", "left_anti")
    rest = rest.groupBy().agg(F.sum("n").alias("n")).where(F.col("n").isNotNull()).select(F.lit(other).alias("label"), "n")
    both = leaders.unionByName(rest).withColumn("label", c.truncate_label("label", longer_than, keep))
    return both.groupBy("label").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "label")


def length_counts(df: DataFrame, text: str, shortest: int = 30) -> DataFrame:
    """Rows per word count for the shortest lengths."""
    counts = df.select(x.word_count(text).alias("words")).groupBy("words").agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy("words").limit(shortest)


def length_bin(text: str, width: int) -> Column:
    return (F.floor(x.word_count(text) / width) * width).cast("bigint")


def length_histogram(df: DataFrame, text: str, label: str, width: int) -> DataFrame:
    return df.select(length_bin(text, width).alias("bin"), label).groupBy("bin", label).agg(F.count(F.lit(1)).alias("n"))


# --- quartiles ----------------------------------------------------------------------------
# Values are counted per group before the percentile is taken, so its state is one entry per
# distinct value: ratings on a scale and scores of two decimals have a few hundred of them,
# however many rows there are.


def value_counts(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    return (
        df.select(*keys, F.col(value).cast("double").alias("value"))
        .where(F.col("value").isNotNull())
        .groupBy(*keys, "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def _quartiles() -> Column:
    return F.percentile("value", [0.25, 0.5, 0.75], F.col("n"))


def box_stats(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Quartiles, extremes, whiskers at 1.5 interquartile ranges and points outside them."""
    keys = list(keys)
    # Read twice; one row per distinct value.
    shared_dir(counts.sparkSession)
    counts = counts.checkpoint()
    boxes = (
        counts.groupBy(*keys)
        .agg(
            F.sum("n").alias("n"), F.min("value").alias("low"), F.max("value").alias("high"), _quartiles().alias("_q")
        )
        .select(
            *keys, "n", "low", "high",
            F.col("_q")[0].alias("q1"), F.col("_q")[1].alias("median"), F.col("_q")[2].alias("q3"),
        )
    )
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    inside = F.col("value").between(F.col("q1") - reach, F.col("q3") + reach)
    bounds = boxes.select(*[F.col(k).alias(f"_{k}") for k in keys], "q1", "q3")
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    whiskers = (
        counts.join(bounds, same)
        .groupBy(*keys)
        .agg(
            F.min(F.when(inside, F.col("value"))).alias("whisker_low"),
            F.max(F.when(inside, F.col("value"))).alias("whisker_high"),
            F.sum(F.when(inside, F.lit(0)).otherwise(F.col("n"))).alias("outliers"),
        )
        .select(*[F.col(k).alias(f"_{k}") for k in keys], "whisker_low", "whisker_high", "outliers")
    )
    return boxes.join(whiskers, same).drop(*[f"_{k}" for k in keys])


def box_by(df: DataFrame, key: str, value: str, places: int = 2) -> DataFrame:
    """Box statistics of a score per rating, both rounded first; rows without either left out."""
    rounded = df.select(
        c.round_half_even(key, places).alias(key), c.round_half_even(value, places).alias(value)
    )
    return box_stats(value_counts(rounded.dropna(subset=[key]), [key], value), [key])


def box_measures(df: DataFrame, key: str, measures: Sequence[str], places: int = 2) -> DataFrame:
    """The same for several measures by one rating."""
    rounded = df.select(c.round_half_even(key, places).alias(key), *[
        c.round_half_even(m, places).alias(m) for m in measures
    ])
    long = _long_values(rounded.dropna(subset=[key]), measures, key)
    return box_stats(value_counts(long, ["measure", key], "value"), ["measure", key])


def box_by_each(df: DataFrame, keys: Sequence[str], value: str, places: int = 2) -> DataFrame:
    """The same for one score by each of several ratings."""
    rounded = df.select(c.round_half_even(value, places).alias("score"), *[
        c.round_half_even(k, places).alias(k) for k in keys
    ])
    long = rounded.unpivot(["score"], list(keys), "rating", "level").dropna(subset=["level"])
    return box_stats(value_counts(long, ["rating", "level"], "score"), ["rating", "level"])


def describe_ratings(df: DataFrame, columns: Sequence[str], places: int = 2) -> DataFrame:
    """One row per statistic (mean, 25%, 50%, 75%), one column per measure."""
    return describe_counts(value_counts(_long_values(df, columns), ["measure"], "value"), columns, places)


def describe_counts(counts: DataFrame, columns: Sequence[str], places: int = 2) -> DataFrame:
    """The same from `(measure, value, n)`."""
    stats = counts.groupBy("measure").agg(
        (F.sum(F.col("value") * F.col("n")) / F.sum("n")).alias("_mean"), _quartiles().alias("_q")
    )
    named = stats.select(
        "measure",
        F.explode(
            F.array(
                F.struct(F.lit("mean").alias("Statistic"), F.col("_mean").alias("v")),
                F.struct(F.lit("25%").alias("Statistic"), F.col("_q")[0].alias("v")),
                F.struct(F.lit("50%").alias("Statistic"), F.col("_q")[1].alias("v")),
                F.struct(F.lit("75%").alias("Statistic"), F.col("_q")[2].alias("v")),
            )
        ).alias("_s"),
    ).select("measure", "_s.*")
    return named.groupBy("Statistic").pivot("measure", list(columns)).agg(F.first(c.round_half_even("v", places)))


def round_numeric(df: DataFrame, places: int = 2) -> DataFrame:
    """Half-even rounding of every floating column."""
    floating = (T.DoubleType, T.FloatType)
    return df.select(
        *[c.round_half_even(f.name, places).alias(f.name) if isinstance(f.dataType, floating) else F.col(f.name) for f in df.schema]
    )


# --- shares and matrices ------------------------------------------------------------------


def share_by_group(df: DataFrame, group: str, items: str) -> DataFrame:
    """Rows of a group that list an item, over all rows of the group."""
    listed = nested.each(df, items, "item", group)
    counts = count_by(listed, group, "item")
    totals = df.dropna("any", subset=[group]).groupBy(group).agg(F.count(F.lit(1)).alias("group_size"))
    return counts.join(totals, group).withColumn("share", F.col("n") / F.col("group_size")).orderBy(group, "item")


def one_hot(df: DataFrame, column: str, known: Sequence | None = None) -> DataFrame:
    """One 0/1 column per level; a null gives zeros."""
    known = sizes.levels(df, column) if known is None else known
    return df.select(
        "*", *[F.coalesce((F.col(column) == F.lit(v)).cast("int"), F.lit(0)).alias(str(v)) for v in known]
    )


def pivot_matrix(df: DataFrame, rows: str, columns: str, value: Column, known: Sequence | None = None) -> DataFrame:
    known = sizes.levels(df, columns) if known is None else known
    return df.groupBy(rows).pivot(columns, list(known)).agg(value)


def distinct_choices(df: DataFrame, column: str) -> DataFrame:
    """`(position, choice)` of a filter list: `All` first, then the sorted distinct values."""
    codes = ordering.dense_codes(df, column)
    rows = codes.select((F.col("code") + 1).alias("position"), F.col(column).cast("string").alias("choice"))
    head = df.sparkSession.range(1).select(F.lit(0).alias("position"), F.lit("All").alias("choice"))
    return head.unionByName(rows)


# --- correlations -------------------------------------------------------------------------


def topic_group_correlation(df: DataFrame, probabilities: str, group: str) -> DataFrame:
    """Point-biserial correlation of every topic probability with every level of a group.

    One summary per level (count, means, variances of the whole vector) is all that leaves a
    task; the correlations follow from pooling those. Null when a side does not vary. A row
    with a null group counts as having none of the levels.
    """
    vector = array_to_vector(F.col(probabilities).cast("array<double>"))
    summary = Summarizer.metrics("count", "mean", "variance", "min", "max").summary(F.col("_v"))
    per_level = df.select(F.col(group).alias("level"), vector.alias("_v")).groupBy("level").agg(summary.alias("s"))
    per_topic = per_level.select(
        "level",
        F.col("s.count").cast("double").alias("n"),
        F.posexplode(
            F.arrays_zip(
                vector_to_array("s.mean").alias("mean"),
                vector_to_array("s.variance").alias("variance"),
                vector_to_array("s.min").alias("low"),
                vector_to_array("s.max").alias("high"),
            )
        ).alias("topic", "m"),
    ).select("level", "n", "topic", "m.*")
    everyone = Window.partitionBy("topic")
    pooled = per_topic.withColumn("total", F.sum("n").over(everyone)).withColumn(
        "grand", F.sum(F.col("n") * F.col("mean")).over(everyone) / F.col("total")
    )
    spread = F.col("variance") * (F.col("n") - 1) + F.col("n") * F.pow(F.col("mean") - F.col("grand"), F.lit(2))
    pooled = (
        pooled.withColumn("deviation", F.sqrt(F.sum(spread).over(everyone) / F.col("total")))
        .withColumn("varies", F.min("low").over(everyone) < F.max("high").over(everyone))
        .withColumn("rest", F.col("total") - F.col("n"))
    )
    rest_mean = F.try_divide(F.col("total") * F.col("grand") - F.col("n") * F.col("mean"), F.col("rest"))
    weight = F.sqrt(F.col("n") * F.col("rest")) / F.col("total")
    r = F.try_divide((F.col("mean") - rest_mean) * weight, F.col("deviation"))
    return pooled.where(F.col("level").isNotNull()).select(
        "topic", "level", F.when(F.col("varies"), r).alias("correlation")
    )


def flag_correlation(df: DataFrame, topic: str, group: str) -> DataFrame:
    """Correlation of the 0/1 columns of every topic with those of every level, from counts."""
    counts = df.groupBy(F.col(topic).alias("topic"), F.col(group).alias("level")).agg(F.count(F.lit(1)).alias("n"))
    total = df.agg(F.count(F.lit(1)).cast("double").alias("total"))
    names = sizes.levels(counts, "level")
    per_topic = counts.where(F.col("topic").isNotNull()).groupBy("topic").agg(F.sum("n").cast("double").alias("nt"))
    grid = per_topic.withColumn("level", F.explode(F.array(*[F.lit(v) for v in names])))
    per_level = counts.groupBy("level").agg(F.sum("n").cast("double").alias("nl"))
    full = grid.join(per_level, "level").join(counts, ["topic", "level"], "left")
    full = full.withColumn("n", F.coalesce("n", F.lit(0)).cast("double")).withColumn("total", total.scalar())
    top = F.col("total") * F.col("n") - F.col("nt") * F.col("nl")
    bottom = F.sqrt(F.col("nt") * (F.col("total") - F.col("nt")) * F.col("nl") * (F.col("total") - F.col("nl")))
    return full.select("topic", "level", F.try_divide(top, bottom).alias("correlation"))


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """Rank correlation of two columns with average ranks for ties, as one row."""
    pairs = (
        df.select(F.col(a).alias("a"), F.col(b).alias("b"))
        .dropna()
        .groupBy("a", "b")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    shared_dir(df.sparkSession)
    pairs = pairs.checkpoint()
    ranks_a = ordering.average_ranks(pairs, "a", "n").withColumnRenamed("average_rank", "ra")
    ranks_b = ordering.average_ranks(pairs, "b", "n").withColumnRenamed("average_rank", "rb")
    total = pairs.agg(F.sum("n").cast("double").alias("total")).scalar()
    ranked = pairs.join(ranks_a, "a").join(ranks_b, "b").withColumn("_middle", (total + 1) / 2)
    da, db, n = F.col("ra") - F.col("_middle"), F.col("rb") - F.col("_middle"), F.col("n")
    sums = ranked.agg(F.sum(n * da * db).alias("ab"), F.sum(n * da * da).alias("aa"), F.sum(n * db * db).alias("bb"))
    return sums.select(F.try_divide("ab", F.sqrt(F.col("aa") * F.col("bb"))).alias("spearman"))
