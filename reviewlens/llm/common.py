"""Helpers the operators of this folder share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path

WORD = r"[^\x20\x09-\x0D]+"
SPACE_RUN = r"[\x20\x09-\x0D]+"
# A group of fewer rows is never worth a plan of its own.
LEAST_HOT = 1000


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{directory}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(column), F.lit(""))


def written(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """The rows as a table in the shared folder: read several times, never computed again, and
    left whole when an executor is lost."""
    path = path or scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def attach(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int, shares: int = 1000) -> DataFrame:
    """Every row joined to the one row of its group; `size` counts the rows of a group.

    Fewer than `shares` groups can hold more than 1/shares of all rows: where there are any (and
    they are large at all), those are broadcast, so their rows stay where they are. The others are
    joined by shuffle, where no key is hot.
    """
    limit = max(total // shares, LEAST_HOT)
    hot = groups.where(F.col(size) > limit)
    if total <= limit or hot.isEmpty():
        return rows.join(groups, key)
    spread = rows.join(F.broadcast(hot.select(key)), key, "left_anti")
    return rows.join(F.broadcast(hot), key).unionByName(spread.join(groups.where(F.col(size) <= limit), key))


def orderable(df: DataFrame) -> list[str]:
    """Columns that can be compared, for a repeatable choice between rows."""
    return [f.name for f in df.schema if not any(t in f.dataType.simpleString() for t in ("map<", "variant"))]
