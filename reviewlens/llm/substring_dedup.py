"""Removal of bytes covered by strings of LENGTH bytes that occur more than once.

Every string of LENGTH bytes has an anchor: the short byte string within it with the least hash,
the leftmost of equals. Equal strings have equal anchors at equal places, so the windows of a
text fall into runs that share an anchor, and only runs with equal anchors can share a string.
A run whose bytes occur twice in the corpus is covered as a whole. Runs that share their anchor
but not all bytes go, once each, to blocks by anchor, where the common prefixes of the suffixes
are found by interval expansion on a Burrows-Wheeler transform (`suffixes`). An anchor with more
different runs than a block should hold is split further: its windows are compared by hash.

Texts are UTF-8 bytes, null is empty; matches stay within a text and are judged on the input.
Repeated rows count as occurrences of their own; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.sizes import broadcast_within
from . import kernels as k
from .common import attach, written
from .suffixes import repeated_starts

LENGTH = 200
BLOCK_BYTES = 512 << 10
RUNS_PER_ANCHOR = 2048
TEXT_BYTES = 512 << 10
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 32 << 20
SEGMENT = 64 << 20
_PLACE_BITS = 28


def anchor_runs(texts: k.Texts, length: int) -> tuple[np.ndarray, ...]:
    """Text, begin, number of windows, anchor hash and hash of all bytes of every run."""
    size = max(length // 3, 1)
    window = length - size + 1
    if len(texts.data) > 1 << _PLACE_BITS:
        raise ValueError(f"{len(texts.data)} bytes at once; a place has {_PLACE_BITS} bits")
    running = texts.running()
    places = np.arange(max(len(texts.data) - size + 1, 0))
    if len(places) < window:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, k.U64, k.U64))
    hashes = texts.hashes(places, places + size, running)
    # Least hash first, then the leftmost; minima of sliding windows from both sides of blocks.
    key = (hashes >> k.U64(_PLACE_BITS) << k.U64(_PLACE_BITS)) | places.astype(k.U64)
    rows = np.append(key, np.full(-len(key) % window, np.iinfo(k.U64).max, k.U64)).reshape(-1, window)
    forward = np.minimum.accumulate(rows, axis=1).ravel()
    backward = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    count = len(key) - window + 1
    least = np.minimum(backward[:count], forward[window - 1 : window - 1 + count])
    begins = np.arange(count)
    of = texts.document_of(begins)
    inside = begins + length <= texts.offsets[of + 1]
    begins, of = begins[inside], of[inside]
    anchor = (least[inside] & k.U64((1 << _PLACE_BITS) - 1)).astype(np.int64)
    new = np.ones(len(begins), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (of[1:] != of[:-1])
    first = np.flatnonzero(new)
    windows = np.diff(np.append(first, len(begins)))
    low, at, of = begins[first], anchor[first], of[first]
    whole = texts.hashes(low, low + windows + length - 1, running)
    return of, low - texts.offsets[of], windows, hashes[at], k.mix(whole + (at - low).astype(k.U64))


def _signed(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64))


def _segments(data: bytes, length: int, segment: int) -> Iterator[tuple[int, bytes]]:
    """A very long text in overlapping parts, so that every window is in one of them."""
    for begin in range(0, max(len(data) - length + 1, 1), segment):
        yield begin, data[begin : begin + segment + length - 1]


def _runs(length: int, segment: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, texts in k.chunks(batch, "text", min(TEXT_BYTES, segment)):
                numbers = rows.column("row").to_numpy()
                parts = [(numbers, 0, texts)]
                if len(texts.data) > segment and texts.n == 1:
                    whole = texts.data.tobytes()
                    parts = [(numbers, b, k.Texts(pa.array([p], pa.large_binary()))) for b, p in _segments(whole, length, segment)]
                for owners, shift, part in parts:
                    of, low, windows, anchor, bytes_ = anchor_runs(part, length)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(owners[of]), pa.array((low + shift) * 256 * 256 + windows), _signed(anchor), _signed(bytes_)],
                        ["row", "span", "anchor", "bytes"],
                    )

    return run


def _cut(length: int):
    """The wanted runs of every text with their bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            wanted = batch.column("wanted")
            of = np.repeat(np.arange(batch.num_rows), np.diff(np.asarray(wanted.offsets)))
            flat = wanted.flatten()
            span = flat.field("span").to_numpy()
            begins, windows = span >> 16, span & 0xFFFF
            last, data, found = -1, b"", []
            for i, begin, n in zip(of.tolist(), begins.tolist(), windows.tolist(), strict=True):
                if i != last:
                    last, data = i, texts[i].as_py()
                found.append(data[begin : begin + n + length - 1])
            yield pa.RecordBatch.from_arrays(
                [batch.column("row").take(pa.array(of)), pa.array(span), flat.field("anchor"), flat.field("copies"), pa.array(found, pa.binary())],
                ["row", "span", "anchor", "copies", "body"],
            )

    return run


def _covered(rows: list[int], begins: list[int], ends: list[int]) -> pa.RecordBatch:
    columns = [pa.array(rows, pa.int64()), pa.array(begins, pa.int64()), pa.array(ends, pa.int64())]
    return pa.RecordBatch.from_arrays(columns, ["row", "begin", "end"])


def _spans(starts: np.ndarray, length: int) -> Iterator[tuple[int, int]]:
    """Covered ranges of sorted starts."""
    if len(starts):
        border = np.flatnonzero(np.diff(starts) > length) + 1
        for part in np.split(starts, border):
            yield int(part[0]), int(part[-1]) + length


def _compare(length: int):
    """Covered ranges of the runs of one block that occur once themselves."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        copies = table.column("copies").to_numpy()
        found = repeated_starts(table.column("body").to_pylist(), copies, length)
        rows, begins, ends = [], [], []
        for row, span, n, starts in zip(table.column("row").to_pylist(), table.column("span").to_pylist(), copies, found, strict=True):
            if n == 1:
                for a, b in _spans(starts, length):
                    rows.append(row)
                    begins.append((span >> 16) + a)
                    ends.append((span >> 16) + b)
        return pa.Table.from_batches([_covered(rows, begins, ends)])

    return run


def _window_hashes(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, texts in k.chunks(batch, "body", TEXT_BYTES):
                places = np.arange(max(len(texts.data) - length + 1, 0))
                of = texts.document_of(places)
                inside = places + length <= texts.offsets[of + 1]
                places, of = places[inside], of[inside]
                begin = (rows.column("span").to_numpy() >> 16)[of] + places - texts.offsets[of]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rows.column("row").to_numpy()[of]), pa.array(begin), pa.array(rows.column("copies").to_numpy()[of]),
                     rows.column("anchor").take(pa.array(of)), _signed(texts.hashes(places, places + length))],
                    ["row", "begin", "copies", "anchor", "window"],
                )

    return run


def covered_ranges(docs: DataFrame, length: int = LENGTH, runs_per_anchor: int = RUNS_PER_ANCHOR) -> DataFrame:
    """`(row, begin, end)`: byte ranges to remove, possibly overlapping, of the written `docs` (row, text)."""
    runs = written(docs.mapInArrow(_runs(length, SEGMENT), "row long, span long, anchor long, bytes long"), "runs")
    often = runs.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = written(attach(runs, often, "anchor", "n", runs.count()).drop("n"), "shared")
    total = shared.count()
    kinds = shared.groupBy("anchor", "bytes").agg(
        F.count(F.lit(1)).alias("copies"), F.min(F.struct("row", "span")).alias("first")
    )
    kinds = written(kinds, "kinds")
    # Runs that occur twice or more with all their bytes.
    twice = kinds.where("copies > 1").select(F.struct("anchor", "bytes").alias("kind"), "copies")
    rows = shared.select(F.struct("anchor", "bytes").alias("kind"), "row", "span")
    window_end = F.shiftright("span", 16) + F.col("span").bitwiseAND(0xFFFF) + (length - 1)
    whole = attach(rows, twice, "kind", "copies", total).select("row", F.shiftright("span", 16).alias("begin"), window_end.alias("end"))

    # Different runs under one anchor, one of each.
    per = kinds.groupBy("anchor").agg(F.count(F.lit(1)).alias("different"), F.max(F.col("copies") == 1).alias("single"))
    per = per.where("different > 1 and single")
    unlike = attach(kinds, per, "anchor", "different", kinds.count())
    wanted = unlike.select("first.row", F.struct("first.span", "anchor", "copies").alias("run"))
    wanted = written(wanted.groupBy("row").agg(F.collect_list("run").alias("wanted")), "wanted")
    schema = "row long, span long, anchor long, copies long, body binary"
    cut = docs.select("row", "text").join(broadcast_within(wanted, BROADCAST_ROWS), "row").mapInArrow(_cut(length), schema)
    cut = written(cut, "cut")
    hot = written(per.where(F.col("different") > runs_per_anchor).select("anchor"), "hot-anchors")
    size = cut.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    blocks = 1 + size // BLOCK_BYTES
    # Fewer rows than runs / runs_per_anchor: the planner broadcasts them where they are small.
    usual = cut.join(hot, "anchor", "left_anti").withColumn("block", F.pmod(F.xxhash64("anchor"), F.lit(blocks)))
    usual = usual.groupBy("block").applyInArrow(_compare(length), "row long, begin long, end long")

    windows = cut.join(hot, "anchor", "left_semi").mapInArrow(
        _window_hashes(length), "row long, begin long, copies long, anchor long, window long"
    )
    again = windows.groupBy("anchor", "window").agg(F.sum("copies").alias("copies"), F.count(F.lit(1)).alias("n")).where("copies > 1")
    windows = windows.where("copies = 1").select(F.struct("anchor", "window").alias("key"), "row", "begin")
    again = again.select(F.struct("anchor", "window").alias("key"), "n")
    often = attach(windows, again, "key", "n", total).select("row", "begin", (F.col("begin") + length).alias("end"))
    return whole.unionByName(usual).unionByName(often)


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The ranges of every row joined where they touch, as pairs of little-endian 64-bit numbers."""
    for batch in batches:
        out = []
        for ranges in batch.column("ranges"):
            merged: list[list[int]] = []
            for begin, end in sorted((r["begin"], r["end"]) for r in ranges.as_py()):
                if merged and begin <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], end)
                else:
                    merged.append([begin, end])
            out.append(np.array(merged, "<i8").tobytes())
        yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(out, pa.binary())], ["row", "spans"])


def _remove(texts_back: bool, rest: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_bytes, n_removed, n_spans, digests, kept_texts = [], [], [], [], []
            for text, spans in zip(batch.column("text"), batch.column("spans"), strict=True):
                data = text.as_py()
                kept, at, removed, count = [], 0, 0, 0
                for begin, end in np.frombuffer(spans.as_py() or b"", "<i8").reshape(-1, 2).tolist():
                    kept.append(data[at:begin])
                    removed, count, at = removed + end - begin, count + 1, end
                kept.append(data[at:])
                left = b"".join(kept)
                n_bytes.append(len(data))
                n_removed.append(removed)
                n_spans.append(count)
                digests.append(hashlib.sha256(left).hexdigest())
                if texts_back:
                    kept_texts.append(left.decode("utf-8", "ignore"))
            columns = [*(batch.column(c) for c in rest)]
            if texts_back:
                columns.append(pa.array(kept_texts, pa.string()))
            numbers = [pa.array(v, pa.int64()) for v in (n_bytes, n_removed, n_spans)]
            names = [*rest, *(["text"] if texts_back else []), "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            yield pa.RecordBatch.from_arrays([*columns, *numbers, pa.array(digests, pa.string())], names)

    return run


def remove_repeats(docs: DataFrame, length: int = LENGTH, runs_per_anchor: int = RUNS_PER_ANCHOR, texts: bool = False, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """`(doc_id, n_bytes, n_removed, n_spans, kept_sha256)`, one row per row of `docs`; with `texts`
    also what is left, less bytes of characters that were cut."""
    data = F.coalesce(F.encode(text, "UTF-8"), F.lit(b""))
    whole = written(docs.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).alias("doc_id"), data.alias("text")), "numbered")
    ranges = covered_ranges(whole.select("row", "text"), length, runs_per_anchor)
    ranges = ranges.groupBy("row").agg(F.collect_set(F.struct("begin", "end")).alias("ranges"))
    spans = written(ranges.mapInArrow(_merge, "row long, spans binary"), "spans")
    size = spans.agg(F.sum(F.octet_length("spans") + 16)).first()[0] or 0
    joined = whole.join(F.broadcast(spans) if size <= BROADCAST_BYTES else spans, "row", "left")
    kind = whole.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, {'text string, ' if texts else ''}n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    return joined.select("doc_id", "text", "spans").mapInArrow(_remove(texts, ["doc_id"]), schema)
