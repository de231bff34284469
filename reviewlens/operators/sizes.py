"""Size checks that stand before every broadcast or driver-side list of data-dependent rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

BROADCAST_ROWS = 100_000
LEVELS = 1_000


def rows_within(df: DataFrame, limit: int) -> list[Row] | None:
    """All rows when there are at most `limit`, else None. Never fetches more than limit + 1.

    A limit below an aggregate runs on all partitions at once; one at the top of a plan tries
    them one after the other.
    """
    rows = df.limit(limit + 1).agg(F.collect_list(F.struct("*")).alias("rows")).first()["rows"]
    return rows if len(rows) <= limit else None


def broadcast_within(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast when the rows are few; otherwise the planner keeps its own choice."""
    few = df.limit(limit + 1).count() <= limit
    return F.broadcast(df) if few else df


def levels(df: DataFrame, column: str, limit: int = LEVELS) -> list:
    """Sorted distinct non-null values of a category that becomes columns."""
    rows = rows_within(df.select(column).where(F.col(column).isNotNull()).distinct(), limit)
    if rows is None:
        raise ValueError(f"{column} has over {limit} levels; use the long form instead of columns")
    return sorted(r[0] for r in rows)
