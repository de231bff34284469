"""Consistent-hash ring with virtual nodes and bounded loads.

Each shard owns many points of a ring of 64-bit hashes. A key belongs to the first point
clockwise of its hash. All keys between two points share their way round the ring, so the
bounded loads are worked out on counts per arc: a shard takes the keys that reach it until it is
full, the rest go on clockwise to the next point of a shard with room. Rows then look up their
place by their rank within the arc. That rank follows from hashes of the rows alone, so a row's shard
does not depend on the files or partitions it came in.

With no slack, every shard is filled exactly to the floor or the ceiling of the mean: counts are
at most one apart. Null text has no bytes, a null id is a key of its own, repeated rows each get
a slot, an empty table gives an empty result.
"""

from __future__ import annotations

import bisect
import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import text_of, written

POINTS_PER_SHARD = 128
SLACK = 0.0
ROWS_PER_BUCKET = 100_000
_BIN_SHIFT = 52


def ring_points(spark: SparkSession, shards: int, points: int = POINTS_PER_SHARD) -> list[tuple[int, int]]:
    """Sorted `(hash, shard)` of the virtual nodes; their number is a parameter, not data."""
    df = spark.range(shards * points).select(
        F.xxhash64(F.lit("node"), "id").alias("hash"), (F.col("id") / points).cast("int").alias("shard")
    )
    return sorted((r["hash"], r["shard"]) for r in df.collect())


def capacities(total: int, shards: int, slack: float = SLACK) -> list[int]:
    if slack > 0:
        return [math.ceil((1 + slack) * total / shards)] * shards
    return [total // shards + (s < total % shards) for s in range(shards)]


def fill_ring(counts: dict[int, int], owners: list[int], room: list[int]) -> list[tuple[int, int, int, int, int]]:
    """`(arc, first, end, shard, first_slot)`: which ranks of an arc go to which shard.

    In rounds: what reaches a shard is taken in ring order while there is room; the rest goes on
    to the next point of a shard with room left. Every round with a rest fills a shard.
    """
    room, used = list(room), [0] * len(room)
    waiting = [(arc, arc, 0, n) for arc, n in sorted(counts.items()) if n]
    placed = []
    while waiting:
        rest = []
        for arc, point, first, end in waiting:
            shard = owners[point]
            take = min(room[shard], end - first)
            if take:
                placed.append((arc, first, first + take, shard, used[shard]))
                room[shard] -= take
                used[shard] += take
            if first + take < end:
                rest.append((arc, point, first + take, end))
        waiting = [(arc, _next_with_room(point, owners, room), first, end) for arc, point, first, end in rest]
    return placed


def _next_with_room(point: int, owners: list[int], room: list[int]) -> int:
    for step in range(1, len(owners) + 1):
        at = (point + step) % len(owners)
        if room[owners[at]]:
            return at
    raise ValueError("the shards have less room than there are rows")


def arc_bins(points: list[int]) -> list[tuple[int, int, int, int]]:
    """`(bin, low, high, arc)` with low < hash <= high: the arcs, cut at fixed steps of the hash so
    that a row finds its arc by an equality join."""
    lowest, highest = -(1 << 63), (1 << 63) - 1
    edges = [lowest - 1, *points, highest]
    rows = []
    for k in range(len(edges) - 1):
        low, high, arc = edges[k], edges[k + 1], k % len(points)
        for b in range((low + 1) >> _BIN_SHIFT, (high >> _BIN_SHIFT) + 1):
            rows.append((b, max(low, lowest), high, arc, low < lowest))
    return [r for r in rows if r[1] < r[2] or r[4]]


def place(rows: DataFrame, key: str, shards: int, slack: float = SLACK) -> DataFrame:
    """The rows with `shard` and `slot`. `rows` must be a written table: its ranks are used twice.

    Ranks within an arc are made per bucket, a range of the hash of whole rows, and shifted by the counts of
    the buckets before; a key that many rows share is spread over all buckets. Rows that are equal
    throughout, and too many for one, have buckets of their own: which of them is which makes no difference."""
    spark = rows.sparkSession
    total = rows.count()
    points = ring_points(spark, shards)
    bins = spark.createDataFrame(
        arc_bins([p for p, _ in points]), "_bin bigint, _low bigint, _high bigint, _arc int, _from_start boolean"
    )
    # At most one row per virtual node and per step of the hash.
    inside = (F.col("_hash") <= F.col("_high")) & ((F.col("_hash") > F.col("_low")) | F.col("_from_start"))
    hashed = rows.withColumn("_hash", F.xxhash64(key)).withColumn("_at", F.shiftright("_hash", _BIN_SHIFT))
    hashed = hashed.join(F.broadcast(bins), (F.col("_at") == F.col("_bin")) & inside)
    buckets = 1 + total // ROWS_PER_BUCKET
    hashed = hashed.withColumn("_row", F.xxhash64(F.lit("row"), *rows.columns))
    # At most one in ROWS_PER_BUCKET rows.
    many = hashed.groupBy("_row").agg(F.count(F.lit(1)).alias("_copies")).where(F.col("_copies") > ROWS_PER_BUCKET)
    hashed = hashed.join(F.broadcast(many), "_row", "left")
    salt = F.when(F.col("_copies").isNotNull(), F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(buckets)))
    ranged = F.shiftright("_row", 63 - buckets.bit_length())
    alone = F.when(F.col("_copies").isNotNull(), F.col("_row"))
    hashed = hashed.withColumn("_bucket", F.struct(ranged.alias("range"), alone.alias("copies"), salt.alias("salt"))).drop("_copies")
    hashed = written(hashed.drop("_at", "_bin", "_low", "_high", "_from_start"), "ring")

    counts = written(hashed.groupBy("_arc", "_bucket").agg(F.count(F.lit(1)).alias("_n")), "arc-counts")
    per_arc = {r["_arc"]: r["n"] for r in counts.groupBy("_arc").agg(F.sum("_n").alias("n")).collect()}
    plan = spark.createDataFrame(
        fill_ring(per_arc, [s for _, s in points], capacities(total, shards, slack)),
        "_arc int, _first bigint, _end bigint, shard int, _slot bigint",
    )
    before = Window.partitionBy("_arc").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_arc", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    within = Window.partitionBy("_arc", "_bucket").orderBy("_row", "_hash", *rows.columns)
    same = (F.col("_arc") == F.col("_a")) & F.col("_bucket").eqNullSafe(F.col("_b"))
    starts = starts.withColumnsRenamed({"_arc": "_a", "_bucket": "_b"})
    ranked = hashed.join(starts, same).withColumn("_rank", F.col("_start") + F.row_number().over(within) - 1)
    # At most one row per arc and shard.
    plan = F.broadcast(plan.withColumnRenamed("_arc", "_of"))
    here = (F.col("_arc") == F.col("_of")) & (F.col("_rank") >= F.col("_first")) & (F.col("_rank") < F.col("_end"))
    return ranked.join(plan, here).select(*rows.columns, "shard", (F.col("_slot") + F.col("_rank") - F.col("_first")).alias("slot"))


def shard_documents(docs: DataFrame, shards: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """`(doc_id, size, text_crc32, shard, slot)`, one row per row of `docs`."""
    slim = docs.select(
        F.col(doc_id).alias("doc_id"), (F.octet_length(text_of(text)) + 1).cast("bigint").alias("size"),
        F.crc32(F.encode(text_of(text), "UTF-8")).alias("text_crc32"),
    )
    return place(written(slim, "sizes"), "doc_id", shards)


def owner_of(hash_value: int, points: list[tuple[int, int]]) -> int:
    """Arc of a hash on the driver, for tests."""
    return bisect.bisect_left([p for p, _ in points], hash_value) % len(points)
