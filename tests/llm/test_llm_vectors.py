"""Clusters and top k against plain Python over whole numbers."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from reviewlens.llm import centroids, topk, vectors

CLASHING = "_id _v cluster distance rank score _row _cell _block _far query_id place part".split()


def whole(vector, width=None):
    out = [math.floor(64 * x) for x in vector]
    return out + [0] * ((width or len(out)) - len(out))


def valid(vector):
    return vector is not None and all(x is not None and math.isfinite(x) for x in vector)


def table(spark, rows):
    extra = ", ".join(f"{c} string" for c in CLASHING)
    data = [(i, v, *(f"{c}{n}" for c in CLASHING)) for n, (i, v) in enumerate(rows)]
    return spark.createDataFrame(data, f"vec_id long, embedding array<double>, {extra}").repartition(3)


def hard_rows(components):
    rng = random.Random(3)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(components)]) for i in range(120)]
    # A vector held by many rows, repeated rows and ids, ties.
    rows += [(200 + i, [0.5] * components) for i in range(80)]
    rows += [(300, [0.25] * components), (300, [0.25] * components), (300, [-0.25] * components), (None, [0.5] * components), (None, [0.0] * components)]
    bad = [None, [], [0.5] * (components - 1), [0.5] * (components + 1), [None] + [0.5] * (components - 1)]
    bad += [[x] + [0.5] * (components - 1) for x in (math.nan, math.inf, -math.inf)]
    return rows + [(400 + 20 * i, v) for i, v in enumerate(bad)]


# --- clusters -------------------------------------------------------------------------------


def clusters_expected(rows, components, k=16, rounds=3):
    kept = [(i, whole(v)) for i, v in rows if valid(v) and len(v) == components]
    known = [r for r in kept if r[0] is not None] + [r for r in kept if r[0] is None]
    starts = sorted(known, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    centres = [list(v) for _, v in starts[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(centres))

    for _ in range(rounds):
        members = {}
        for _, v in kept:
            members.setdefault(nearest(v)[1], []).append(v)
        for j, vs in members.items():
            centres[j] = [sum(c) // len(vs) for c in zip(*vs, strict=True)]
    found = [(i, *nearest(v)) for i, v in kept]
    inertia = {j: sum(d for _, d, c in found if c == j) for j in range(k)}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    every = sum(inertia.values())
    return sorted(((i, c, d, inertia[c], every, digest[c]) for i, d, c in found), key=repr)


def test_clusters_equal_brute_force(spark):
    rows = hard_rows(6)
    got = sorted((tuple(r) for r in centroids.membership(table(spark, rows), components=6).collect()), key=repr)
    assert got == clusters_expected(rows, 6)


def test_clusters_of_fewer_rows_and_of_none(spark):
    rows = [(i, [float(i)] * 3) for i in range(5)]
    got = sorted((tuple(r) for r in centroids.membership(table(spark, rows), components=3).collect()), key=repr)
    assert got == clusters_expected(rows, 3)
    none = centroids.membership(table(spark, rows), components=64)
    assert none.count() == 0 and none.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def test_very_large_components_are_exact(spark):
    rows = [(i, [x, float(i)]) for i, x in enumerate([1e30, -1e30, 1e30, 3e38, 0.5, -2.5])]
    found = {r["vec_id"]: r for r in centroids.membership(table(spark, rows), components=2).collect()}
    expected = {r[0]: r for r in clusters_expected(rows, 2)}
    for i, row in found.items():
        assert (row["cluster"], row["centroid_sha256"]) == (expected[i][1], expected[i][5])
        assert row["distance"] == min(expected[i][2], vectors.LONG)


def test_search_measures_few_centroids():
    """Rows near a centroid end their walk early: most centroids are never measured."""
    rng = np.random.default_rng(5)
    centres = rng.integers(-4000, 4000, (16, 8))
    points = np.repeat(centres, 50, axis=0) + rng.integers(-20, 20, (800, 8))
    measured = []

    class Counted(np.ndarray):
        def __getitem__(self, key):
            measured.append(1 if np.isscalar(key) else len(np.atleast_1d(key)))
            return np.asarray(self)[key]

    lists = centroids.Lists.of(centres)
    lists.centroids = centres.view(Counted)
    at, best = lists.nearest(points)
    plain = ((points[:, None, :] - centres[None]) ** 2).sum(axis=2)
    assert (at == plain.argmin(axis=1)).all() and (best == plain.min(axis=1)).all()
    assert sum(measured) < 0.8 * plain.size


def test_exactly_twice_the_distance_is_still_visited():
    # The row lies in the middle of centroids 1 and 0, and is as near to both.
    lists = centroids.Lists.of(np.array([[8, 0], [0, 0], [100, 0]]))
    assert lists.nearest(np.array([[4, 0]]))[0].tolist() == [0]
    lists = centroids.Lists.of(np.array([[100, 0], [8, 0], [0, 0]]))
    assert lists.nearest(np.array([[4, 0], [3, 0]]))[0].tolist() == [1, 2]


# --- top k ------------------------------------------------------------------------------------


def top_expected(rows, k=20, every=20):
    kept = [(n, i, v) for n, (i, v) in enumerate(rows) if valid(v)]
    width = max(len(v) for _, _, v in kept)
    kept = [(n, i, whole(v, width)) for n, i, v in kept]
    out = []
    for n, i, v in kept:
        if i is None or i % every:
            continue
        scored = [(-sum(a * b for a, b in zip(v, w, strict=True)), j is None, j or 0, j) for m, j, w in kept if m != n]
        out += [(i, rank + 1, j, -s) for rank, (s, _, _, j) in enumerate(sorted(scored, key=lambda x: x[:3])[:k])]
    return sorted(out, key=repr)


@pytest.mark.parametrize(("block_rows", "bundle_rows", "pivots"), [(16_384, 4_096, 32), (16, 4, 5), (40, 1, 1)])
def test_top_k_equals_brute_force(spark, block_rows, bundle_rows, pivots):
    rows = hard_rows(6)
    found = topk.search(table(spark, rows), F.col("vec_id") % 20 == 0, block_rows=block_rows, bundle_rows=bundle_rows, pivots=pivots)
    assert found.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted((tuple(r) for r in found.collect()), key=repr) == top_expected(rows)


def test_top_k_of_fewer_rows_and_of_none(spark):
    rows = [(20 * i, [float(i), -1.0]) for i in range(4)]
    found = topk.search(table(spark, rows), F.col("vec_id") % 20 == 0)
    assert sorted((tuple(r) for r in found.collect()), key=repr) == top_expected(rows)
    assert topk.search(table(spark, [(1, None), (20, [math.nan])]), F.col("vec_id") % 20 == 0).count() == 0
    assert topk.search(table(spark, [(1, [1.0]), (2, [1.0])]), F.col("vec_id") % 20 == 0).count() == 0


def test_large_scores_are_exact(spark):
    rows = [(i, [float(2**20 + i), float(i % 3), 2.0**24]) for i in range(40)]
    found = topk.search(table(spark, rows), F.col("vec_id") % 20 == 0, k=7)
    assert sorted((tuple(r) for r in found.collect()), key=repr) == top_expected(rows, 7)


def test_bounds_rule_out_most_candidates():
    """Clustered rows: few candidates are scored, none that belongs to the best is missed."""
    rng = np.random.default_rng(2)
    centres = rng.integers(-60, 60, (40, 16))
    points = np.repeat(centres, 100, axis=0) + rng.integers(-3, 4, (4000, 16))
    pivots = topk.pick_pivots(points[::4].astype(float), 32)
    far = np.stack([np.sqrt(((points - p) ** 2).sum(axis=1)) for p in pivots], axis=1)
    rows = np.arange(len(points))
    scored = []

    class Counted(np.ndarray):
        def __matmul__(self, other):
            scored.append(other.shape[1])
            return np.asarray(self) @ np.asarray(other)

    original = topk.same_kind
    topk.same_kind = lambda a, b: [a.view(Counted), b]
    try:
        for i in range(0, 4000, 400):
            own = slice(i, i + 1)
            ((_, place, score),) = topk._best((points[own], far[own], rows[own], np.array([-np.inf])), (points, far, rows), 20)
            every = points @ points[i]
            every[i] = -(10**9)
            assert sorted(score, reverse=True)[:20] == sorted(every, reverse=True)[:20] and i not in place
    finally:
        topk.same_kind = original
    assert sum(scored) < 0.6 * 10 * len(points)
