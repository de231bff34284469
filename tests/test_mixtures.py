"""Mixtures of topics on planted words."""

import random

import pytest
from pyspark.sql import functions as F

from reviewlens.operators import mixtures

THEMES = ["pain relief headache ache tablet fast dose".split(), "sleep night dream tired insomnia bed rest".split(), "skin rash cream itch dry red spot".split()]


@pytest.fixture(scope="module")
def planted(spark):
    rng = random.Random(2)
    rows = []
    for i in range(360):
        main, other = i % 3, (i + 1) % 3
        part = 1.0 if i < 180 else 0.7
        rows.append((i, main, other, part, " ".join(rng.choice(THEMES[main if rng.random() < part else other]) for _ in range(40))))
    return spark.createDataFrame(rows, "k int, main int, other int, part double, words string").repartition(4)


def test_planted_topics_are_recovered(planted):
    model = mixtures.fit_mixture(planted, "words", 3)
    found = [set(words) for words in mixtures.top_words(model, 7)]
    place = [max(range(3), key=lambda t, w=w: len(found[t] & set(w))) for w in THEMES]
    assert sorted(place) == [0, 1, 2] and all(len(found[p] & set(w)) >= 6 for p, w in zip(place, THEMES))
    rows = mixtures.add_mixture(planted, "words", model, 3).collect()
    for r in rows:
        assert sum(r["TopicShares"]) == pytest.approx(1.0)
        assert r["TopicShares"][place[r["main"]]] == pytest.approx(r["part"], abs=0.25)
    mixed, plain = mixtures.log_likelihood(mixtures.add_mixture(planted, "words", model, 3), "words", "TopicShares", model)
    assert mixed > plain + 1_000


def test_rows_without_known_words(spark, planted):
    model = mixtures.fit_mixture(planted, "words", 3)
    df = spark.createDataFrame([(0, "unknown"), (1, ""), (2, None)], "k int, words string")
    assert all(r["TopicShares"] == pytest.approx([1 / 3] * 3) for r in mixtures.add_mixture(df, "words", model, 3).collect())
    assert mixtures.fit_mixture(df.where("k = 2"), "words", 3) is None and mixtures.fit_mixture(df.limit(0), "words", 3) is None
    none = mixtures.add_mixture(df, "words", None, 4)
    assert none.select(F.size("TopicShares").alias("n")).distinct().collect() == [(4,)]


def test_words_are_bounded(planted):
    assert len(mixtures.fit_mixture(planted, "words", 2, words=5).words) == 5
