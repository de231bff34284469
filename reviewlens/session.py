"""Session settings and the shared scratch location."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app_name: str = "reviewlens", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators expect. Sizes stay with the caller."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by the cluster, also set as the checkpoint folder.

    Only a local session without the setting gets a folder of its own.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        base = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = base.get() if base.isDefined() else tempfile.mkdtemp(prefix="reviewlens-")
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


@contextmanager
def arrow_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """Batches of at most so many rows go to Python workers meanwhile: long texts fill memory by the batch."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


_folder: ContextVar[str] = ContextVar("folder", default="reviewlens")


def _delete(spark: SparkSession, folder: str) -> None:
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def passing_scratch(spark: SparkSession) -> Iterator[None]:
    """What is written to the scratch folder meanwhile is deleted at the end: for steps whose result is
    written to a path taken before. Tables of these steps cannot be read afterwards."""
    folder = f"{_folder.get()}/passing-{uuid.uuid4().hex}"
    token = _folder.set(folder)
    try:
        yield
    finally:
        _folder.reset(token)
        _delete(spark, f"{shared_dir(spark)}/{folder}")


def clear_scratch(spark: SparkSession) -> None:
    """Delete what this library wrote to the shared folder. Tables read from there are gone then."""
    _delete(spark, f"{shared_dir(spark)}/reviewlens")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder."""
    return f"{shared_dir(spark)}/{_folder.get()}/{name}-{uuid.uuid4().hex}"
