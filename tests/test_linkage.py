"""Merge tree of topics against a plain average linkage, and planted topics at size."""

import math

import numpy as np
import pytest

from reviewlens.operators import linkage


def table(spark, rows):
    return spark.createDataFrame(rows, "topic bigint, vector array<double>, extra string")


def plain_linkage(vectors, floor):
    """One closest pair at a time over all pairs of topics."""
    units = {t: v / np.linalg.norm(v) for t, v in vectors.items()}
    members = {t: [t] for t in units}
    tree = {}
    while len(members) > 1:
        names = sorted(members)
        scored = [
            (-np.mean([units[i] @ units[j] for i in members[a] for j in members[b]]), a, b)
            for n, a in enumerate(names) for b in names[n + 1 :]
        ]
        height, a, b = min(scored)
        if -height < floor:
            break
        members[a] += members.pop(b)
        tree[b] = (a, -height)
    return tree


@pytest.mark.parametrize("seed", [1, 2])
def test_tree_equals_plain_linkage(spark, seed):
    dice = np.random.default_rng(seed)
    heads = dice.normal(size=(3, 16))
    vectors = {t: heads[t % 3] + dice.normal(size=16) * 0.6 for t in range(10)}
    tree = linkage.merge_tree(table(spark, [(t, v.tolist(), "x") for t, v in vectors.items()]), -1.0).collect()
    expected = plain_linkage(vectors, -1.0)
    assert {r["topic"]: r["into"] for r in tree} == {t: into for t, (into, _) in expected.items()}
    assert all(math.isclose(r["height"], expected[r["topic"]][1], abs_tol=1e-9) for r in tree)


def planted(spark, topics, groups):
    dice = np.random.default_rng(7)
    heads = dice.normal(size=(groups, 32))
    rows = [(t, (heads[t % groups] + dice.normal(size=32) * 0.08).tolist(), "x") for t in range(topics)]
    return table(spark, rows).repartition(8)


def test_gap_finds_planted_groups(spark):
    merged = linkage.auto_reduce_topics(planted(spark, 240, 60), 0.5).collect()
    assert len(merged) == 240
    assert all(r["merged"] == r["topic"] % 60 for r in merged)


def test_few_pairs_are_compared(spark):
    pairs = linkage.candidate_pairs(linkage.unit_vectors(planted(spark, 10_000, 500)))
    assert pairs.count() < 10_000 * 50


def test_odd_vectors_stay_alone_and_copies_merge(spark):
    rows = [
        (1, [1.0, 0.0], "a"), (2, [1.0, 0.0], "b"), (3, [2.0, 0.0], None), (4, [0.0, 1.0], "c"),
        (5, None, "d"), (6, [0.0, 0.0], "e"), (7, [float("nan"), 1.0], "f"), (8, [], "g"), (None, [1.0, 0.0], "h"),
        (9, [None, 1.0], "i"),
    ]
    merged = {r["topic"]: (r["merged"], r["height"]) for r in linkage.auto_reduce_topics(table(spark, rows), 0.5).collect()}
    assert {t: m for t, (m, _) in merged.items()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 6, 7: 7, 8: 8, 9: 9}
    assert merged[2][1] == pytest.approx(1.0) and merged[4][1] is None


def test_no_topics_and_one_topic(spark):
    assert linkage.auto_reduce_topics(table(spark, []), 0.0).collect() == []
    one = linkage.auto_reduce_topics(table(spark, [(4, [1.0, 2.0], "x")]), 0.0).collect()
    assert [tuple(r) for r in one] == [(4, 4, None)]
