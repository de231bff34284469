"""Scratch tables that pass."""

import os

from reviewlens import session


def test_passing_tables_are_deleted(spark):
    kept = session.scratch_path(spark, "kept")
    with session.passing_scratch(spark):
        inner = session.scratch_path(spark, "inner")
        spark.range(5).write.parquet(inner)
        with session.passing_scratch(spark):
            second = session.scratch_path(spark, "second")
            spark.range(2).write.parquet(second)
        assert not os.path.exists(second) and os.path.exists(inner)
        spark.read.parquet(inner).write.parquet(kept)
    assert not os.path.exists(inner) and spark.read.parquet(kept).count() == 5
    assert os.path.dirname(session.scratch_path(spark, "x")) == os.path.dirname(kept)


def test_batches_are_set_back(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    with session.arrow_batches(spark, 7):
        assert spark.conf.get(name) == "7"
    assert spark.conf.get(name) == before
