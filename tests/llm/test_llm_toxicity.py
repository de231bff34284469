"""Accuracy on held-out rows, and the hard cases."""

import zlib

import pytest

import __spark_entry__ as entry_point
from reviewlens.llm import toxicity


@pytest.fixture(scope="module")
def scored(spark):
    """The middle data set: the smallest has a dozen toxic texts only."""
    directory = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{directory}/labels.parquet")
    return entry_point.queries()["op7_toxicity"](spark, directory).join(labels, "doc_id", "left").toPandas()


def test_scores(scored):
    assert len(scored) == 1000 and scored["score"].between(0, 1).all()
    assert (scored["predicted"] == (scored["score"] >= 0.7)).all()
    assert (scored["held_out"] == [zlib.crc32(str(i).encode()) % 3 == 1 for i in scored["doc_id"]]).all()


def test_held_out_rows_are_told_apart(scored):
    held = scored[scored["held_out"] & scored["toxic"].notna()]
    ranks = held["score"].rank()
    toxic = held["toxic"] == 1
    n, m = toxic.sum(), (~toxic).sum()
    assert (ranks[toxic].sum() - n * (n + 1) / 2) / (n * m) > 0.7
    assert held[~toxic]["predicted"].mean() < 0.05


def test_scores_do_not_use_held_out_labels(spark, documents, data):
    from pyspark.sql import functions as F

    labels = spark.read.parquet(f"{data}/labels.parquet")
    turned = labels.withColumn("toxic", F.when(toxicity.fold_of() == 1, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    first, second = ({r["doc_id"]: r["score"] for r in toxicity.score(documents, x).collect()} for x in (labels, turned))
    assert first == second


def test_edge_rows(edge, rows, labels, empty):
    found = toxicity.score(edge, labels).collect()
    assert len(found) == len(rows)
    assert all(0 <= r["score"] <= 1 for r in found)
    assert toxicity.score(empty, labels).count() == 0
    assert {r["score"] for r in toxicity.score(edge, labels.where("toxic = 5")).collect()} == {0.0}


def test_features():
    import pyarrow as pa

    from reviewlens.llm import kernels

    texts = ["You are an idiot", "nothing here", "", "id10t! 1d1ot"]
    found = toxicity.measure(kernels.Texts(pa.array(texts)), texts, {"idiot": 2.0})
    names = {n: i for i, n in enumerate(toxicity.FEATURES)}
    assert found[0, names["lexicon_density"]] == 0.25 and found[0, names["second_person_near"]] == 0.25
    assert not found[2].any() and found[1, names["lexicon_most"]] == 0
    assert found[3, names["obfuscated_rate"]] > 0
