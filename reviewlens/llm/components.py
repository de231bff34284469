"""Connected components by alternating large and small stars.

Every turn links each node's larger neighbours to the smallest of its neighbourhood, then its
smaller ones. The number of turns grows with the logarithm of the longest path. Hot nodes are
joined by broadcast of their one row, see `common.attach`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import attach, written


def _star(pairs: DataFrame, total: int) -> DataFrame:
    """Every `(u, v)` with `least`, the smallest of u and its neighbours."""
    least = pairs.groupBy("u").agg(F.min("v").alias("least"), F.count(F.lit(1)).alias("n"))
    return attach(pairs, least.withColumn("least", F.least("least", "u")), "u", "n", total)


def components(edges: DataFrame) -> DataFrame:
    """`(node, root)` for every node of the edges `(a, b)`; the root is the smallest node."""
    links = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).where("u != v").distinct()
    links = written(links, "links")
    state = None
    while True:
        now = links.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        if tuple(now) == state or not now["n"]:
            break
        state = tuple(now)
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _star(both, 2 * now["n"]).where("v > u").select(F.col("v").alias("u"), F.col("least").alias("v"))
        large = written(large.where("u != v").distinct(), "links")
        # Small star: each node keeps its smaller neighbours, all of them and itself under the least.
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        small = _star(down, now["n"]).select("u", "v", "least")
        small = small.select(F.col("v").alias("u"), F.col("least").alias("v")).unionByName(small.select("u", F.col("least").alias("v")))
        links = written(small.where("u != v").distinct(), "links")
    return links.select(F.col("u").alias("node"), F.col("v").alias("root"))
