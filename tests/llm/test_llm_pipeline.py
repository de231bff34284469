"""Every stage of the pipeline on its own input."""

import re
from collections import Counter

import corpus_pipeline as pipeline
from reviewlens.llm import quality


def test_stages_keep_the_columns(spark, edge, data):
    docs = edge
    for name, stage in pipeline.STAGES[:-1]:
        docs = stage(spark, docs, data)
        assert docs.columns == edge.columns, name
    assert pipeline.STAGES[-1][1](spark, docs, data).columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]


def test_stages_pass_an_empty_table(spark, empty, data):
    for _, stage in pipeline.STAGES:
        assert stage(spark, empty, data).count() == 0


def test_run_equals_its_stages_by_brute_force(spark, data, documents):
    """Counts after every stage from plain Python, then the pieces of the last."""
    labels = spark.read.parquet(f"{data}/labels.parquet")
    kept = {r["doc_id"] for r in quality.judge(documents, labels).where("kept").collect()}
    first = pipeline.quality_rules(spark, documents, data)
    assert {r["doc_id"] for r in first.collect()} == kept

    second = pipeline.exact_duplicates(spark, first, data)
    normal = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t)
    least = {}
    for r in sorted(first.collect(), key=lambda r: r["doc_id"]):
        least.setdefault(normal(r["text"]), r["doc_id"])
    assert sorted(r["doc_id"] for r in second.collect()) == sorted(least.values())

    third = pipeline.near_duplicates(spark, second, data)
    from test_llm_repeats import near_expected

    expected = near_expected([(r["doc_id"], r["text"]) for r in second.collect()])
    assert sorted(r["doc_id"] for r in third.collect()) == sorted(k[0] for k in expected if k[3])

    fourth = pipeline.source_mix(spark, third, data)
    words = lambda df: sum(len(re.findall(r"[^\x20\x09-\x0D]+", r["text"])) for r in df.collect())
    assert abs(words(fourth) - 1.5 * words(third)) <= 20
    assert {r["doc_id"] for r in fourth.collect()} <= {r["doc_id"] for r in third.collect()}

    pieces = pipeline.packed_sequences(spark, fourth, data).collect()
    whole = pipeline.run(spark, data).collect()
    assert Counter(tuple(r)[:5] for r in whole) == Counter(tuple(r)[:5] for r in pieces)
