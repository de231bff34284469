"""Merge tree of topics by average linkage, and the cut that the tree itself suggests.

The similarity of two clusters is the mean cosine between their topics. That is the dot product of
the means of their unit vectors, so a cluster is one row whatever it holds. Pairs that are each
other's closest merge in the same round: with average linkage a merged cluster is never closer to a
third one than its closer part was, so the tree is that of merging one closest pair at a time.

Only candidate pairs are compared. Every topic has a signature, the signs of its vector along random
directions. Topics are put in order by several arrangements of these signs, and each is compared with
its next neighbours in every order: at most ORDERS * NEIGHBOURS pairs per topic, however many topics
are alike. Clusters take over the candidates of their topics. Up to NEIGHBOURS + 1 topics all pairs are
candidates and the tree is exact; beyond that a pair with a low cosine may be missed.
"""

from __future__ import annotations

import random

from pyspark.ml.feature import Normalizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import shared_dir
from . import ordering

DIRECTIONS = 64
ORDERS = 5
NEIGHBOURS = 9
SEED = 42


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, v: acc + v)


def unit_vectors(centres: DataFrame) -> DataFrame:
    """`(topic, u)` of the topics whose vector has a direction, that is, is not null, empty, zero or non-finite.
    Checkpointed, as the vectors are read within loops over their own values."""
    vector = F.col("vector").cast("array<double>")
    finite = F.forall(vector, lambda v: F.coalesce(F.abs(v) < float("inf"), F.lit(False)))
    sound = centres.select("topic", vector.alias("vector")).where(F.col("topic").isNotNull() & finite & F.exists("vector", lambda v: v != 0))
    points = sound.select("topic", array_to_vector("vector").alias("_v"))
    unit = Normalizer(p=2.0, inputCol="_v", outputCol="_u").transform(points)
    shared_dir(centres.sparkSession)
    return unit.select("topic", vector_to_array("_u").alias("u")).checkpoint()


def _signs(u: str) -> Column:
    """One sign per direction. The components of a direction are 1 or -1 by a hash of their place."""

    def sign(direction: Column) -> Column:
        places = F.transform(u, lambda v, i: F.when(F.xxhash64(direction, i, F.lit(SEED)) % 2 == 0, v).otherwise(-v))
        return F.aggregate(places, F.lit(0.0), lambda acc, v: acc + v) >= 0

    return F.transform(F.sequence(F.lit(1), F.lit(DIRECTIONS)), lambda d: F.when(sign(d), F.lit("1")).otherwise(F.lit("0")))


def candidate_pairs(units: DataFrame) -> DataFrame:
    """Distinct `(a, b)`, a < b, of topics that are neighbours in one of the orders."""
    dice = random.Random(SEED)
    arranged = [dice.sample(range(DIRECTIONS), DIRECTIONS) for _ in range(ORDERS)]
    # Written down first: the signs are read once per place of every order.
    signed = units.select("topic", _signs("u").alias("_signs")).checkpoint()
    orders = F.explode(F.array(*[F.array(*map(F.lit, a)) for a in arranged])).alias("_order")
    keys = signed.select("topic", "_signs", orders).select(
        F.struct(
            F.array_join("_order", ",").alias("o"),
            F.array_join(F.transform("_order", lambda i: F.get("_signs", i)), "").alias("s"),
            "topic",
        ).alias("key")
    )
    placed = ordering.value_positions(keys, "key").select(
        F.col("key.o").alias("o"), F.col("key.topic").alias("topic"), F.col("values_before").alias("place")
    )
    steps = F.explode(F.sequence(F.lit(1), F.lit(NEIGHBOURS)))
    left = placed.select("o", F.col("topic").alias("l"), "place", steps.alias("_step")).select("o", "l", (F.col("place") + F.col("_step")).alias("place"))
    near = left.join(placed, ["o", "place"])
    ends = F.struct(F.least("l", "topic").alias("a"), F.greatest("l", "topic").alias("b"))
    # Out of an array: deriving join conditions from the least and greatest of two columns takes the optimizer very long.
    return near.select(F.explode(F.array(ends)).alias("p")).select("p.*").distinct()


def _with_similarity(pairs: DataFrame, clusters: DataFrame) -> DataFrame:
    """`(a, b, similarity)`."""
    left = clusters.select(F.col("topic").alias("a"), F.col("u").alias("_ua"))
    right = clusters.select(F.col("topic").alias("b"), F.col("u").alias("_ub"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", _dot(F.col("_ua"), F.col("_ub")).alias("similarity"))


def merge_tree(centres: DataFrame, floor: float) -> DataFrame:
    """`(topic, into, height)`: each merge down to the mean cosine `floor`, with the higher number of the two
    clusters, the lower one, which names the merged cluster, and their similarity. A topic is at most once
    merged into a lower one. Among equally similar pairs the lower numbers go first.

    Each round is checkpointed to the shared folder.
    """
    clusters = unit_vectors(centres).select("topic", F.lit(1).cast("bigint").alias("size"), "u", F.lit(1.0).alias("low"))
    pairs = _with_similarity(candidate_pairs(clusters), clusters).checkpoint()
    tree = None
    while True:
        rank = F.struct("similarity", (-F.col("a")).alias("na"), (-F.col("b")).alias("nb"))
        ends = pairs.where(F.col("similarity") >= floor).select("a", "b", "similarity", rank.alias("rank"), F.explode(F.array("a", "b")).alias("end"))
        closest = ends.groupBy("end").agg(F.max_by(F.struct("a", "b", "similarity"), "rank").alias("p")).select("p.*")
        # A pair that is the closest of both its ends comes up twice.
        merges = closest.groupBy("a", "b").agg(F.count(F.lit(1)).alias("_ends"), F.max("similarity").alias("similarity")).where("_ends = 2")
        # Heights never rise towards the root, also where a missing candidate would make them.
        for end in ("a", "b"):
            merges = merges.join(clusters.select(F.col("topic").alias(end), F.col("low").alias(f"_low_{end}")), end)
        merges = merges.select("a", "b", F.least("similarity", "_low_a", "_low_b").alias("height")).checkpoint()
        if merges.isEmpty():
            break
        step = merges.select(F.col("b").alias("topic"), F.col("a").alias("into"), "height")
        tree = step if tree is None else tree.unionByName(step)
        renamed = step.unionByName(merges.select(F.col("a").alias("topic"), F.col("a").alias("into"), "height"))
        moved = clusters.join(renamed, "topic", "left").withColumn("into", F.coalesce("into", "topic"))
        clusters = _merged(moved).checkpoint()
        pairs = _contracted(pairs, moved, clusters).checkpoint()
    if tree is None:
        schema = clusters.select("topic", F.col("topic").alias("into"), F.col("low").alias("height")).schema
        return centres.sparkSession.createDataFrame([], schema)
    return tree


def _merged(moved: DataFrame) -> DataFrame:
    """One row per cluster after a round: at most two rows come together."""
    parts = F.array_sort(F.collect_list(F.struct("topic", "size", "u")))
    least = F.least(F.min("low"), F.min("height"))
    joined = moved.groupBy(F.col("into").alias("topic")).agg(parts.alias("_p"), least.alias("low"))
    first, second = F.col("_p")[0], F.get("_p", F.lit(1))
    size = first["size"] + F.coalesce(second["size"], F.lit(0))
    mean = F.zip_with(first["u"], second["u"], lambda x, y: (x * first["size"] + y * second["size"]) / size)
    return joined.select("topic", size.alias("size"), F.when(second.isNull(), first["u"]).otherwise(mean).alias("u"), "low")


def _contracted(pairs: DataFrame, moved: DataFrame, clusters: DataFrame) -> DataFrame:
    """The candidate pairs between the clusters after a round. Only those of a new cluster are compared."""
    side = moved.select("topic", "into", F.col("height").isNotNull().alias("_new"))
    left = side.select(F.col("topic").alias("a"), F.col("into").alias("_ia"), F.col("_new").alias("_na"))
    right = side.select(F.col("topic").alias("b"), F.col("into").alias("_ib"), F.col("_new").alias("_nb"))
    both = pairs.join(left, "a").join(right, "b").where(F.col("_ia") != F.col("_ib"))
    same = both.where(~F.col("_na") & ~F.col("_nb")).select("a", "b", "similarity")
    ends = F.struct(F.least("_ia", "_ib").alias("a"), F.greatest("_ia", "_ib").alias("b"))
    # Out of an array: deriving join conditions from the least and greatest of two columns takes the optimizer very long.
    new = both.where(F.col("_na") | F.col("_nb")).select(F.explode(F.array(ends)).alias("p")).select("p.*").distinct()
    return same.unionByName(_with_similarity(new, clusters))


def widest_gap(tree: DataFrame, floor: float) -> float:
    """The height in the middle of the widest gap between 1, the heights of the merges and `floor`; of equally
    wide gaps the highest."""
    ends = tree.sparkSession.createDataFrame([(1.0,), (float(floor),)], "height double")
    heights = ordering.value_positions(tree.select("height").unionByName(ends), "height").select("height", "values_before")
    above = heights.select(F.col("height").alias("upper"), (F.col("values_before") - 1).alias("values_before"))
    gaps = heights.join(above, "values_before").select(
        ((F.col("upper") + F.col("height")) / 2).alias("middle"), F.struct(F.round(F.col("upper") - F.col("height"), 9).alias("w"), "upper").alias("order")
    )
    widest = gaps.agg(F.max_by("middle", "order")).first()[0]
    return float(floor) if widest is None else widest


def auto_reduce_topics(centres: DataFrame, floor: float = 0.0) -> DataFrame:
    """`(topic, merged, height)`: every topic with the lowest topic of its cluster, and the height at which the tree
    merges it into a lower one (null for none). The clusters are those of the merges above the widest gap.

    A topic without a direction (null, zero or non-finite vector) stays alone; no topics give no rows.
    """
    tree = merge_tree(centres, floor)
    cut = widest_gap(tree, floor)
    taken = centres.select("topic").where("topic IS NOT NULL").join(tree, "topic", "left")
    parent = F.when(F.col("height") > cut, F.col("into")).otherwise(F.col("topic"))
    roots = taken.select("topic", parent.alias("merged"), "height").checkpoint()
    while True:
        upper = roots.select(F.col("topic").alias("merged"), F.col("merged").alias("_next"))
        after = roots.join(upper, "merged").select("topic", F.col("_next").alias("merged"), "height", (F.col("_next") != F.col("merged")).alias("_changed")).checkpoint()
        roots = after.select("topic", "merged", "height")
        if after.where("_changed").isEmpty():
            return roots
