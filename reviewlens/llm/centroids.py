"""Clusters around centroids, every row assigned by Orchard's search.

Each centroid has the list of the others from the nearest on. A row starts at centroid 0, walks the
list of the centroid it is at, and moves to the list of any centroid that is nearer (or as near
with a smaller number). Centroids seen once are marked and never measured again. The walk stops at
the first entry strictly beyond twice the distance to the centroid the row is at: what follows
cannot be nearer, and at exactly twice it could still be as near.

All arithmetic is in whole numbers. The driver holds the centroids and the sums of a round, both
`k` x components numbers; sums are added up in the tasks first. Rows are written once and read by
every round.

Vectors that are null, have null or non-finite components or another number of components take no
part. Fewer rows than `k` are as many centroids; equal vectors may be centroids side by side, of
which the smaller number gets the rows. Null ids start a cluster only where there are fewer other
rows than `k`. An empty table gives an empty result. Distances beyond 64 bits are cut to the largest
such number.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .vectors import LONG, floored, longs, same_kind, with_vectors

COMPONENTS = 64
CLUSTERS = 16
ROUNDS = 3
_LIMB = 30


# --- search ---------------------------------------------------------------------------------


@dataclass
class Lists:
    """Centroids, and of each the others in order of distance, with the squared distances."""

    centroids: np.ndarray
    order: np.ndarray
    squared: np.ndarray

    @classmethod
    def of(cls, centroids: np.ndarray) -> Lists:
        k = len(centroids)
        squared = ((centroids[:, None, :] - centroids[None, :, :]) ** 2).sum(axis=2)
        rows = [sorted((t for t in range(k) if t != s), key=lambda t, s=s: (squared[s, t], t)) for s in range(k)]
        order = np.array(rows, np.int64).reshape(k, k - 1)
        return cls(centroids, order, np.take_along_axis(squared, order, axis=1))

    def nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of the nearest centroid and squared distance of every row."""
        points, centroids, squared = same_kind(points, self.centroids, self.squared)
        n, last = len(points), len(centroids) - 1
        at, place = np.zeros(n, np.int64), np.zeros(n, np.int64)
        best = ((points - centroids[0]) ** 2).sum(axis=1)
        seen = np.zeros((n, last + 1), bool)
        seen[:, 0] = True
        walking = np.arange(n) if last else np.zeros(0, np.int64)
        while len(walking):
            s, p = at[walking], place[walking]
            ended = p >= last
            p = np.minimum(p, last - 1)
            ended |= (squared[s, p] > 4 * best[walking]).astype(bool)
            target = self.order[s, p][~ended]
            walking = walking[~ended]
            place[walking] += 1
            new = ~seen[walking, target]
            rows, target = walking[new], target[new]
            seen[rows, target] = True
            found = ((points[rows] - centroids[target]) ** 2).sum(axis=1)
            nearer = ((found < best[rows]) | ((found == best[rows]) & (target < at[rows]))).astype(bool)
            rows, target = rows[nearer], target[nearer]
            at[rows], best[rows], place[rows] = target, found[nearer], 0
        return at, best


# --- rounds ---------------------------------------------------------------------------------


def _limbs(value: int) -> Iterator[tuple[int, int]]:
    """A whole number in pieces whose sums stay within 64 bits."""
    i = 0
    while not -(1 << _LIMB) < value < 1 << _LIMB:
        yield i, value & ((1 << _LIMB) - 1)
        value >>= _LIMB
        i += 1
    yield i, value


def _sums(lists: Lists, width: int):
    """Counts and sums of a task's rows by cluster, sent once at its end."""
    k = len(lists.centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, totals = np.zeros(k, np.int64), [[0] * width for _ in range(k)]
        for batch in batches:
            points = floored(batch.column("_v"), width)
            cluster, _ = lists.nearest(points)
            counts += np.bincount(cluster, minlength=k)
            for c in np.unique(cluster):
                totals[c] = [a + int(b) for a, b in zip(totals[c], points[cluster == c].sum(axis=0), strict=True)]
        rows = [(c, -1, 0, int(counts[c])) for c in range(k) if counts[c]]
        rows += [(c, i, limb, part) for c in range(k) if counts[c] for i in range(width) for limb, part in _limbs(totals[c][i])]
        columns = zip(*rows, strict=True) if rows else [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.int64()) for x in columns], ["cluster", "place", "limb", "part"])

    return run


def _moved(points: DataFrame, lists: Lists, width: int) -> np.ndarray:
    """Centroids after one round: floor of the mean, empty ones unchanged."""
    parts = points.select("_v").mapInArrow(_sums(lists, width), "cluster long, place long, limb long, part long")
    added = parts.groupBy("cluster", "place", "limb").agg(F.sum("part").alias("part"))
    totals: dict[tuple[int, int], int] = {}
    for cluster, place, limb, part in added.collect():  # at most k x (components + 1) x limbs rows
        totals[cluster, place] = totals.get((cluster, place), 0) + (part << (_LIMB * limb))
    after = [
        [totals[c, i] // totals[c, -1] for i in range(width)] if (c, -1) in totals else [int(x) for x in centroid]
        for c, centroid in enumerate(lists.centroids)
    ]
    return _centroids(after, width)


def _centroids(rows: list[list[int]], width: int) -> np.ndarray:
    small = all(abs(x) <= 1 << 25 for row in rows for x in row)
    return np.array(rows, np.int64 if small else object).reshape(len(rows), width)


def _assigned(lists: Lists, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cluster, distance = lists.nearest(floored(batch.column("_v"), width))
            yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(cluster, pa.int32()), longs(distance)], ["_id", "cluster", "distance"])

    return run


@dataclass
class Clusters:
    """The final centroids and every kept row `(_id, cluster, distance)`, as a written table."""

    centroids: np.ndarray
    rows: DataFrame


def cluster(df: DataFrame, key: str, vector: str, k: int = CLUSTERS, rounds: int = ROUNDS, components: int = COMPONENTS, seed: int = 1) -> Clusters:
    """`rounds` rounds of assignment and means, and a last assignment."""
    points = written(with_vectors(df, vector, key, components), "vectors")
    kind = points.schema["_id"].dataType.simpleString()
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("_id").cast("string")), 256)
    # Equal digests are equal ids, told apart by their vectors.
    first = points.orderBy(digest.asc_nulls_last(), "_v").limit(k).select("_v").toArrow()
    schema = f"_id {kind}, cluster int, distance long"
    if not first.num_rows:
        return Clusters(np.zeros((0, components), np.int64), df.sparkSession.createDataFrame([], schema))
    lists = Lists.of(floored(first.column("_v"), components))
    for _ in range(rounds):
        lists = Lists.of(_moved(points, lists, components))
    return Clusters(lists.centroids, written(points.mapInArrow(_assigned(lists, components), schema), "clusters"))


def membership(df: DataFrame, key: str = "vec_id", vector: str = "embedding", **options) -> DataFrame:
    """`(key, cluster, distance, cluster_inertia, inertia, centroid_sha256)` of every kept row."""
    found = cluster(df, key, vector, **options)
    digests = [hashlib.sha256(",".join(str(int(x)) for x in c).encode()).hexdigest() for c in found.centroids]
    total = F.sum(F.col("distance").cast("decimal(20,0)"))
    sums = {r["cluster"]: int(r["total"]) for r in found.rows.groupBy("cluster").agg(total.alias("total")).collect()}  # k rows
    everything = min(LONG, sum(sums.values()))
    described = [(c, min(LONG, sums.get(c, 0)), everything, digest) for c, digest in enumerate(digests)]
    table = df.sparkSession.createDataFrame(described, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    rows = found.rows.join(F.broadcast(table), "cluster")  # k rows
    return rows.select(F.col("_id").alias(key), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
