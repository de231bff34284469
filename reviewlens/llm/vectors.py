"""Integer vectors: which rows of a table have one, and their exact arithmetic in Arrow tasks.

Components are floor(64 * x). They are whole numbers held in 64 bits as long as no square or sum
can overflow there, and Python's unbounded whole numbers otherwise, by the same expressions.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCALE = 64.0
# Sums of 2^10 squared differences of such components stay below 2^63.
EXACT = 1 << 25
LONG = (1 << 63) - 1


def finite(vector: str) -> Column:
    """Whether a vector is there and all its components are numbers."""
    infinite = F.lit(float("inf"))
    whole = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != infinite))
    return F.coalesce(F.col(vector).isNotNull() & whole, F.lit(False))


def with_vectors(df: DataFrame, vector: str, key: str, components: int | None = None) -> DataFrame:
    """`(_id, _v)` of the rows whose vector takes part."""
    rows = df.select(F.col(key).alias("_id"), F.col(vector).cast("array<double>").alias("_v")).where(finite("_v"))
    return rows if components is None else rows.where(F.size("_v") == components)


def floored(lists: pa.Array, width: int) -> np.ndarray:
    """The vectors of a batch as rows of whole numbers; shorter ones end in zeros."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    flat = np.floor(lists.flatten().to_numpy(zero_copy_only=False) * SCALE)
    offsets = lists.offsets.to_numpy()
    lengths = np.diff(offsets)
    if len(flat) and np.abs(flat).max() > EXACT:
        flat = np.array([int(x) if np.isfinite(x) else 0 for x in flat.tolist()], object)
    else:
        flat = flat.astype(np.int64)
    if (lengths == width).all():
        return flat.reshape(len(lengths), width)
    out = np.zeros((len(lengths), width), flat.dtype)
    out[np.repeat(np.arange(len(lengths)), lengths), np.arange(len(flat)) - np.repeat(offsets[:-1] - offsets[0], lengths)] = flat
    return out


def same_kind(*arrays: np.ndarray) -> list[np.ndarray]:
    """All arrays as 64-bit numbers, or all as unbounded ones."""
    return [a.astype(object) for a in arrays] if any(a.dtype == object for a in arrays) else list(arrays)


def longs(values: np.ndarray) -> pa.Array:
    """As 64-bit numbers; what is beyond them is cut to their ends."""
    if values.dtype == object:
        values = np.array([max(-LONG - 1, min(LONG, int(v))) for v in values], np.int64)
    return pa.array(values.astype(np.int64))
