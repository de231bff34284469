"""Every registered query against its SQL, and invariants of the queries without SQL."""

import math

import duckdb
import pytest

import __spark_entry__ as entry_point
from reviewlens.operators import nested, topics

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


@pytest.fixture(scope="session")
def duck(data):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{data}/{name}.parquet'")
    return con


def normal(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    return repr(value)


def rows_of(table):
    names = sorted(table.schema.names)
    return sorted(tuple(normal(v) for v in row) for row in zip(*[table.column(n).to_pylist() for n in names]))


@pytest.mark.parametrize("name", sorted(entry_point.oracle_sql()))
def test_query_equals_sql(spark, duck, data, name):
    ours = entry_point.queries()[name](spark, data).toArrow()
    theirs = duck.execute(entry_point.oracle_sql()[name]).to_arrow_table()
    assert sorted(ours.schema.names) == sorted(theirs.schema.names)
    assert rows_of(ours) == rows_of(theirs)


@pytest.mark.parametrize(
    "name", ["nest_reviews", "xml_reviews", "expand_reviews", "decode_literal", "sink_items", "stage1_clean", "stage1_reviews", "nested_mean", "refresh_means", "array_count"]
)
def test_list_length_does_not_change_the_result(spark, duck, data, name, monkeypatch):
    monkeypatch.setattr(nested, "MAX_ELEMENTS", 2)
    ours = entry_point.queries()[name](spark, data).toArrow()
    assert rows_of(ours) == rows_of(duck.execute(entry_point.oracle_sql()[name]).to_arrow_table())


def test_entry_has_rows(spark):
    assert entry_point.entry(spark).count() > 0


def run(spark, data, name):
    return entry_point.queries()[name](spark, data)


def test_every_query_of_the_library_has_sql():
    own = set(entry_point.workload.QUERIES)
    assert own == set(entry_point.workload.ORACLES)


def test_failing_rows_have_null_scores(spark, data):
    scored = run(spark, data, "score_or_null")
    short = spark.read.parquet(f"{data}/documents.parquet").where("n_chars < 500").count()
    assert 0 < short == scored.where("neg is null and compound is null").count()


def test_fit_topics_is_repeatable(spark, data):
    vectors = spark.read.parquet(f"{data}/embeddings.parquet")
    first, second = (
        topics.assign_topics(vectors, "embedding", topics.fit_topics(vectors, "embedding", 10)).orderBy("vec_id").collect() for _ in range(2)
    )
    assert first == second
