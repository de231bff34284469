"""Best-fit packing by length patterns fitted with non-negative least squares.

Documents become token ids and a closing id; longer ones are cut into full pieces. The histogram
of piece lengths, at most `capacity` numbers, is all the driver sees. Patterns of one to three
lengths that fill a sequence exactly are fitted to it with non-negative repeat counts, the counts
are rounded within what is left of each length, and the residual pieces are packed best-fit from
the longest down, on counts as well. The plan says, per length and rank, which sequence and
place a piece takes; rows find theirs by their rank among the pieces of their length.

Null text is empty and still one piece (the closing id); repeated rows and null ids are packed
like any other; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import text_of, written
from .kernels import chunks
from .tokens import encoder

CAPACITY = 2048
CLOSING_ID = 0
CHUNK_BYTES = 4 << 20
FIT_STEPS = 200
ROWS_PER_BUCKET = 200_000
LEAST_BUCKETS = 16


# --- plan on the histogram ------------------------------------------------------------------


def patterns(capacity: int) -> np.ndarray:
    """All non-decreasing triples that sum to the capacity; 0 stands for no piece."""
    first = np.arange(capacity // 3 + 1)
    spans = (capacity - first) // 2 - first + 1
    a = np.repeat(first, spans)
    b = a + np.arange(len(a)) - np.repeat(np.cumsum(spans) - spans, spans)
    return np.stack([a, b, capacity - a - b], axis=1)


def fit_repeats(histogram: np.ndarray, triples: np.ndarray, steps: int = FIT_STEPS) -> np.ndarray:
    """Repeat counts >= 0 of the patterns, least squares against the histogram, by projected
    gradients with momentum. A length that is rare costs as much per piece as a frequent one."""
    size = len(histogram)
    present = (histogram > 0) | (np.arange(size) == 0)
    usable = present[triples].all(axis=1)
    out = np.zeros(len(triples))
    if not usable.any():
        return out
    chosen = triples[usable]
    goal = histogram.astype(float)
    goal[0] = 0

    def lengths(x: np.ndarray) -> np.ndarray:
        made = sum(np.bincount(chosen[:, i], weights=x, minlength=size) for i in range(3))
        made[0] = 0
        return made

    def gather(r: np.ndarray) -> np.ndarray:
        return r[chosen[:, 0]] + r[chosen[:, 1]] + r[chosen[:, 2]]

    probe = np.ones(len(chosen))
    for _ in range(12):
        probe = gather(lengths(probe))
        norm = np.linalg.norm(probe)
        probe /= norm
    x = y = np.zeros(len(chosen))
    momentum = 1.0
    for _ in range(steps):
        moved = np.maximum(0, y - gather(lengths(y) - goal) / (1.05 * norm))
        following = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        y = moved + (momentum - 1) / following * (moved - x)
        x, momentum = moved, following
    out[usable] = x
    return out


def plan_sequences(histogram: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """`(lengths, number of sequences)` that hold every piece of the histogram (index: length)."""
    capacity = len(histogram) - 1
    left = [int(v) for v in histogram]
    left[0] = 0
    groups = []
    triples = patterns(capacity)
    repeats = np.rint(fit_repeats(np.asarray(histogram), triples)).astype(np.int64)
    for i in np.argsort(-repeats, kind="stable")[: int((repeats > 0).sum())]:
        lengths = tuple(int(v) for v in triples[i] if v)
        copies = min([int(repeats[i])] + [left[v] // lengths.count(v) for v in set(lengths)])
        if copies:
            groups.append((lengths, copies))
            for v in lengths:
                left[v] -= copies
    return groups + _best_fit(left)


def _best_fit(left: list[int]) -> list[tuple[tuple[int, ...], int]]:
    """Longest first, each into the smallest gap that holds it; equal pieces at once."""
    capacity = len(left) - 1
    gaps: list[list[tuple[tuple[int, ...], int]]] = [[] for _ in range(capacity + 1)]
    for length in range(capacity, 0, -1):
        rest, gap = left[length], length
        while rest:
            while gap <= capacity and not gaps[gap]:
                gap += 1
            if gap > capacity:
                per = capacity // length
                if rest >= per:
                    gaps[capacity - per * length].append(((length,) * per, rest // per))
                if rest % per:
                    gaps[capacity - rest % per * length].append(((length,) * (rest % per), 1))
                break
            lengths, n = gaps[gap].pop()
            take = min(n, rest)
            if take < n:
                gaps[gap].append((lengths, n - take))
            gaps[gap - length].append((lengths + (length,), take))
            rest -= take
            gap = length if gap - length >= length else gap
    return [group for gap in gaps for group in gap]


@dataclass
class Places:
    """For every length, runs of ranks with the sequence of the first and the offset of all."""

    begin: np.ndarray
    first_rank: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray

    def find(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        low, high = self.begin[length].copy(), self.begin[length + 1] - 1
        while (low < high).any():
            middle = (low + high + 1) // 2
            before = self.first_rank[middle] <= rank
            low, high = np.where(before, middle, low), np.where(before, high, middle - 1)
        return self.sequence[low] + rank - self.first_rank[low], self.offset[low]


def places(groups: list[tuple[tuple[int, ...], int]], capacity: int) -> Places:
    runs = []
    sequence = 0
    for lengths, n in groups:
        offset = 0
        for length in lengths:
            runs.append((length, sequence, offset, n))
            offset += length
        sequence += n
    length, first, offset, n = (np.array(c, np.int64) for c in (zip(*runs, strict=True) if runs else [()] * 4))
    order = np.argsort(length, kind="stable")
    length, first, offset, n = length[order], first[order], offset[order], n[order]
    begin = np.searchsorted(length, np.arange(capacity + 2))
    before = np.cumsum(n) - n
    return Places(begin, before - before[np.minimum(begin[length], max(len(n) - 1, 0))], first, offset)


# --- rows -----------------------------------------------------------------------------------


def _pieces(capacity: int, path: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode
        for batch in batches:
            for part, _ in chunks(batch, "text", CHUNK_BYTES):
                ids, begins = encode(part.column("text"))
                # The closing id is 0, which `encode` puts behind every text.
                sizes = np.diff(begins)
                count = -(-sizes // capacity)
                source = np.repeat(np.arange(len(sizes)), count)
                piece = np.arange(len(source)) - np.repeat(np.cumsum(count) - count, count)
                start = piece * capacity
                length = np.minimum(sizes[source] - start, capacity)
                at = begins[source] + start
                crc = [zlib.crc32(ids[a:b]) for a, b in zip(at.tolist(), (at + length).tolist(), strict=True)]
                columns = [
                    part.column("doc_id").take(pa.array(source)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def pieces(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None) -> DataFrame:
    """`(doc_id, piece, start, length, ids_crc32)`: documents as ids, cut at the capacity."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long"
    return docs.select("doc_id", text_of("text").alias("text")).mapInArrow(_pieces(capacity, vocabulary), schema)


def _place(found: Places, columns: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "_rank"))
            sequence, offset = found.find(length, rank)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in columns), pa.array(sequence), pa.array(offset)], [*columns, "sequence_id", "offset"]
            )

    return run


def pack(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None) -> DataFrame:
    """The pieces with `sequence_id` and `offset`."""
    cut = pieces(docs, capacity, vocabulary)
    columns = cut.columns
    # The salt spreads pieces of one length; it is written, so it is the same in every reading.
    cut = written(cut.withColumn("_salt", F.xxhash64(F.monotonically_increasing_id())), "pieces")
    sums = cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).toPandas()  # at most `capacity` rows
    histogram = np.zeros(capacity + 1, np.int64)
    histogram[sums["length"]] = sums["n"]
    found = places(plan_sequences(histogram), capacity)

    buckets = max(LEAST_BUCKETS, int(histogram.sum()) // ROWS_PER_BUCKET)
    cut = cut.withColumn("_bucket", F.pmod("_salt", F.lit(buckets)))
    counts = cut.groupBy("length", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("length", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    within = Window.partitionBy("length", "_bucket").orderBy("_salt")
    ranked = cut.join(starts, ["length", "_bucket"]).withColumn("_rank", F.col("_start") + F.row_number().over(within) - 1)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cut.select(columns).schema)
    return ranked.select(*columns, "_rank").mapInArrow(_place(found, columns), f"{schema}, sequence_id long, offset long")
