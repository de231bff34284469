"""Near duplicates by ProbMinHash over weighted word shingles, banding and verification.

A text is the bag of its runs of five words; a shingle weighs as often as it occurs. Every
shingle sends a Poisson process of arrivals, at a rate of its weight, to random registers; a
register keeps the shingle that arrived first. Two texts agree in a register with a probability
equal to their probability Jaccard similarity. The arrivals of a shingle come in blocks and stop
once they are later than all registers of the text.

Texts with the same words are one node. Nodes that agree in a band of registers meet in a bucket
and are compared with its centre, the node with most meetings, by the exact similarity of their
bags. Where the members of a centre are still in several groups, they are compared across the groups
in blocks, first by their registers. Classes are the connected components of the pairs at THRESHOLD
or more; a pair at the threshold misses all 32 bands with a probability of 3e-6.

Texts of one to four words have one shingle of all words; texts without words, null ones too, are
one class. Rows that repeat an id are rows of their own; of a class the smallest id stays (null
comes last) and of rows equal in words and id one. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.sizes import broadcast_within
from ..session import passing_scratch, scratch_path
from . import kernels as k
from .common import attach, text_of, written
from .components import components

WORDS = 5
THRESHOLD = 0.8
BANDS = 32
ROWS = 5
REGISTERS = BANDS * ROWS
# Registers agree in at least this share or a pair is not verified: over five standard deviations below the threshold.
LEAST_ESTIMATE = 0.62
BROADCAST_ROWS = 500_000
# Members of one centre compared with each other or with another block in one task.
BLOCK = 512
_FIRST_ROUNDS = 2
_LARGEST_BLOCK = 128
# Arrivals made at once, over all shingles of some texts.
POINTS = 1 << 18


def bags(texts: k.Texts, n: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text, hash and weight of the distinct shingles, by text; and the node of every text."""
    begins, ends = texts.word_spans()
    words, of = texts.hashes(begins, ends), texts.document_of(begins)
    shingles, shingle_of = k.grams(words, of, n)
    whole = k.sequence_hashes(words, of, texts.n)
    second = k.sequence_hashes(k.mix(words + k.U64(0xD1B54A32D192ED03)), of, texts.n)
    n_words = np.bincount(of, minlength=texts.n)
    short = np.flatnonzero((n_words > 0) & (n_words < n))
    hashes, owner = np.concatenate([shingles, whole[short]]), np.concatenate([shingle_of, short])
    order, new = k.first_of_group(k.with_text(hashes, owner))
    first = np.flatnonzero(new)
    weight = np.diff(np.append(first, len(order)))
    hashes, owner = hashes[order[first]], owner[order[first]]
    by_text = np.argsort(owner, kind="stable")
    return owner[by_text], hashes[by_text], weight[by_text], np.stack([whole, second], axis=1)


def signatures(owner: np.ndarray, hashes: np.ndarray, weight: np.ndarray, n: int, registers: int = REGISTERS) -> np.ndarray:
    """ProbMinHash of every text: per register 16 bits of the shingle that arrives first."""
    earliest = np.full(n * registers, np.inf)
    winner = np.zeros(n * registers, np.uint16)
    alive = np.arange(len(hashes))
    now = np.zeros(len(hashes))
    point, block, rounds = 0, 1, 0
    while len(alive):
        seed = hashes[alive]
        steps = (np.arange(point, point + block, dtype=k.U64) + k.U64(1)) * k.U64(0x9E3779B97F4A7C15)
        random = k.mix(seed[:, None] + steps[None, :])
        uniform = ((random >> k.U64(24)).astype(float) + 0.5) * 2.0**-40
        gaps = -np.log(uniform) / weight[alive][:, None]
        times = now[alive][:, None] + np.cumsum(gaps, axis=1)
        slots = owner[alive][:, None] * registers + ((random & k.U64(0xFFFFFF)) % k.U64(registers)).astype(np.int64)
        flat, at = times.ravel(), slots.ravel()
        sooner = flat < earliest[at]
        flat, at, item = flat[sooner], at[sooner], np.repeat(alive, block)[sooner]
        np.minimum.at(earliest, at, flat)
        won = flat == earliest[at]
        winner[at[won]] = (hashes[item[won]] >> k.U64(17)).astype(np.uint16)
        now[alive] = times[:, -1]
        latest = earliest.reshape(n, registers).max(axis=1)
        alive = alive[now[alive] < latest[owner[alive]]]
        point += block
        rounds += 1
        if rounds >= _FIRST_ROUNDS:
            block = min(block * 2, _LARGEST_BLOCK, max(1, POINTS // max(len(alive), 1)))
    return winner.reshape(n, registers)


def similarity(x: tuple[np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray]) -> float:
    """Probability Jaccard similarity of two bags (sorted hashes, weights)."""
    if not len(x[0]) or not len(y[0]):
        return 0.0
    j = np.minimum(np.searchsorted(y[0], x[0]), len(y[0]) - 1)
    i = np.flatnonzero(y[0][j] == x[0])
    j = j[i]
    if not len(i):
        return 0.0
    if x[1].max() == y[1].max() == 1:
        return len(i) / (len(x[0]) + len(y[0]) - len(i))  # all weights equal: plain Jaccard
    a, b = x[1].astype(float), y[1].astype(float)
    rest_a, rest_b = a.sum() - a[i].sum(), b.sum() - b[j].sum()
    pairs, times = np.unique(np.stack([a[i], b[j]], axis=1), axis=0, return_counts=True)
    total = 0.0
    for (p, q), n in zip(pairs, times, strict=True):
        total += n / (rest_a / p + rest_b / q + (np.maximum(pairs[:, 0] / p, pairs[:, 1] / q) * times).sum())
    return total


# --- rows -----------------------------------------------------------------------------------


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows, texts in k.chunks(batch, "text"):
            owner, hashes, weight, nodes = bags(texts)
            found = signatures(owner, hashes, weight, texts.n)
            empty = np.bincount(owner, minlength=texts.n) == 0
            signs = [None if e else found[i].tobytes() for i, e in enumerate(empty)]
            yield pa.RecordBatch.from_arrays(
                [rows.column("row"), rows.column("doc_id"), pa.array([v.tobytes() for v in nodes], pa.binary()), pa.array(signs, pa.binary())],
                ["row", "doc_id", "node", "signature"],
            )


def _bag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows, texts in k.chunks(batch, "text"):
            owner, hashes, weight, _ = bags(texts)
            borders = np.searchsorted(owner, np.arange(texts.n + 1))
            found = []
            for a, b in zip(borders[:-1], borders[1:], strict=True):
                order = np.argsort(hashes[a:b])
                plain = (weight[a:b] == 1).all()
                found.append((hashes[a:b][order].tobytes(), b"" if plain else weight[a:b][order].astype("<u4").tobytes()))
            yield pa.RecordBatch.from_arrays(
                [rows.column("node"), pa.array([h for h, _ in found], pa.binary()), pa.array([w for _, w in found], pa.binary())],
                ["node", "hashes", "weights"],
            )


def _read_bag(hashes: bytes, weights: bytes) -> tuple[np.ndarray, np.ndarray]:
    found = np.frombuffer(hashes, k.U64)
    return found, np.frombuffer(weights, "<u4") if weights else np.ones(len(found))


def _estimate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            a, b = (np.array([np.frombuffer(v.as_py(), np.uint16) for v in batch.column(c)]) for c in ("signature_a", "signature_b"))
            near = (a == b).mean(axis=1) >= LEAST_ESTIMATE
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(near))


def _verify(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = []
            for row in zip(*(batch.column(f"{c}_{s}") for s in "ab" for c in ("hashes", "weights")), strict=True):
                ha, wa, hb, wb = (v.as_py() for v in row)
                near.append(similarity(_read_bag(ha, wa), _read_bag(hb, wb)) >= threshold - 1e-12)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(near, pa.bool_()))

    return run


def _both_ends(pairs: DataFrame, nodes: DataFrame, columns: list[str], total: int) -> DataFrame:
    """The pairs with the named columns of both nodes; an end that many pairs share is attached
    by broadcast of its one row."""
    for end in "ab":
        per = pairs.groupBy(end).agg(F.count(F.lit(1)).alias("_n"))
        side = nodes.select(F.col("node").alias(end), *[F.col(c).alias(f"{c}_{end}") for c in columns])
        pairs = attach(pairs, side.join(per, end), end, "_n", total).drop("_n")
    return pairs


def near_pairs(pairs: DataFrame, nodes: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """The pairs of nodes `(a, b)` whose exact similarity reaches the threshold."""
    pairs = written(pairs, "pairs")
    likely = _both_ends(pairs, nodes, ["signature"], pairs.count()).mapInArrow(_estimate, "a binary, b binary")
    likely = written(likely, "likely")
    ends = likely.select(F.col("a").alias("node")).union(likely.select("b")).distinct()
    # Bags of the nodes that are compared, and of no other.
    found = _bags_of(written(nodes.select("node", "row").join(ends, "node"), "ends"), texts)
    whole = _both_ends(likely, found, ["hashes", "weights"], likely.count())
    return written(whole.mapInArrow(_verify(threshold), "a binary, b binary"), "near")


def _links_in_block(threshold: float):
    """Links between the members of one block pair that are in different groups."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        left, block = (table.column(c).to_numpy() for c in ("i", "block"))
        signs = np.array([np.frombuffer(v, np.uint16) for v in table.column("signature").to_pylist()])
        groups = np.unique(np.array([r.hex() for r in table.column("root").to_pylist()]), return_inverse=True)[1]
        hashes, weights, nodes = (table.column(c) for c in ("hashes", "weights", "node"))
        read: dict[int, tuple[np.ndarray, np.ndarray]] = {}

        def bag(x: int) -> tuple[np.ndarray, np.ndarray]:
            if x not in read:
                read[x] = _read_bag(hashes[x].as_py(), weights[x].as_py())
            return read[x]

        same_block = table.column("j")[0].as_py() == left[0]
        found = []
        for x in np.flatnonzero(block == left[0]):
            others = np.arange(x + 1, len(block)) if same_block else np.flatnonzero(block != left[0])
            others = others[groups[others] != groups[x]]
            likely = others[(signs[others] == signs[x]).mean(axis=1) >= LEAST_ESTIMATE]
            for y in likely:
                # Members linked on the way are in one group from then on.
                if groups[y] != groups[x] and similarity(bag(x), bag(y)) >= threshold - 1e-12:
                    found.append((nodes[int(x)].as_py(), nodes[int(y)].as_py()))
                    groups[groups == groups[y]] = groups[x]
        ends = [pa.array([f[k] for f in found], pa.binary()) for k in range(2)]
        return pa.Table.from_arrays(ends, ["a", "b"])

    return run


def _links_between_groups(stars: DataFrame, roots: DataFrame, nodes: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """Links `(a, b)` that join further groups. Nodes that share a bucket share its centre, so the
    members of a centre are compared where they are in several groups. They are dealt into blocks
    of BLOCK and compared block with block in tasks of their own: a pair is looked at by its
    registers, verified where those agree, and only links come out."""
    members = stars.join(roots, "node", "left").select("centre", "node", F.coalesce("root", "node").alias("root"))
    members = written(members, "members")
    per = members.groupBy("centre").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count(F.lit(1)).alias("n"))
    per = per.where("low != high").select("centre", "n")
    members = written(attach(members, per, "centre", "n", members.count()), "open")
    ends = written(nodes.select("node", "row").join(members.select("node").distinct(), "node"), "ends")
    found = _bags_of(ends, texts)
    whole = members.join(nodes.select("node", "signature"), "node").join(found, "node")
    blocks = F.ceil(F.col("n") / F.lit(float(BLOCK))).cast("int")
    whole = whole.withColumn("block", F.pmod(F.xxhash64("node"), blocks).cast("int"))
    whole = whole.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    whole = whole.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))
    whole = whole.select("centre", "i", "j", "block", "node", "root", "signature", "hashes", "weights")
    return written(whole.groupBy("centre", "i", "j").applyInArrow(_links_in_block(threshold), "a binary, b binary"), "more")


def _bags_of(ends: DataFrame, texts: DataFrame) -> DataFrame:
    """`(node, hashes, weights)` of the nodes `(node, row)`: one text per node, found by its row."""
    chosen = texts.select("row", "text").join(broadcast_within(ends, BROADCAST_ROWS), "row")
    return written(chosen.mapInArrow(_bag, "node binary, hashes binary, weights binary"), "bags")


def classes(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """`(row, doc_id, node, root, class_id, class_size)` for every row of the written `docs` (row, doc_id, text)."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    read = docs.select("row", "doc_id", text_of("text").alias("text"))
    signed = written(read.mapInArrow(_sign, f"row long, doc_id {kind}, node binary, signature binary"), "signatures")
    total = signed.count()
    nodes = signed.groupBy("node").agg(
        F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("least"), F.min("row").alias("row"), F.first("signature").alias("signature")
    )
    nodes = written(nodes, "nodes")

    band = F.explode(F.array(*[F.xxhash64(F.lit(b), F.substring("signature", 1 + 2 * ROWS * b, 2 * ROWS)) for b in range(BANDS)]))
    members = nodes.where("signature is not null").select(band.alias("bucket"), "node")
    sizes = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    met = written(members.join(sizes, "bucket"), "met")
    n_met = met.count()
    meetings = met.groupBy("node").agg(F.sum("size").alias("meetings"))
    centres = met.join(meetings, "node").groupBy("bucket").agg(
        F.max(F.struct("meetings", "node"))["node"].alias("centre"), F.first("size").alias("size")
    )
    stars = attach(met.drop("size"), centres, "bucket", "size", n_met).where("node != centre")
    stars = written(stars.select("node", "centre").distinct(), "stars")
    pairs = stars.select(F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b")).distinct()
    near = near_pairs(pairs, nodes, read, threshold)

    roots = written(components(near), "roots")
    more = _links_between_groups(stars, roots, nodes, read, threshold)
    if not more.isEmpty():
        roots = written(components(near.unionByName(more)), "roots")

    grouped = nodes.select("node", "copies", "least").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    grouped = written(grouped, "grouped")
    per = grouped.groupBy("root").agg(
        F.min("least").alias("class_id"), F.sum("copies").alias("class_size"), F.count(F.lit(1)).alias("n")
    )
    per_node = attach(grouped, per, "root", "n", grouped.count()).select("node", "root", "copies", "class_id", "class_size")
    return attach(signed.select("row", "doc_id", "node"), per_node, "node", "copies", total).drop("copies")


def numbered(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))


def _staying(found: DataFrame) -> DataFrame:
    """The row of every class that stays: the smallest id, of rows that repeat it the first."""
    return found.where(F.col("doc_id").eqNullSafe(F.col("class_id"))).groupBy("root").agg(F.min("row").alias("row"))


def membership(docs: DataFrame, threshold: float = THRESHOLD, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """`(doc_id, class_id, class_size, kept)`, one row per row of `docs`."""
    path = scratch_path(docs.sparkSession, "classes")
    with passing_scratch(docs.sparkSession):
        found = written(classes(written(numbered(docs, doc_id, text), "numbered"), threshold), "classes", path)
    kept = _staying(found).select("row", F.lit(True).alias("kept"))
    return found.join(kept, "row", "left").select("doc_id", "class_id", "class_size", F.coalesce("kept", F.lit(False)).alias("kept"))


def deduplicate(docs: DataFrame, threshold: float = THRESHOLD, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per class, with all columns. The rows that go are few: they are taken out by
    broadcast up to a fixed number, by a join beyond it."""
    columns = docs.columns
    whole = written(docs.select(F.monotonically_increasing_id().alias("row"), F.struct(*[F.col(f"`{c}`") for c in columns]).alias("doc")), "numbered")
    slim = whole.select("row", F.col(f"doc.`{doc_id}`").alias("doc_id"), F.col(f"doc.`{text}`").alias("text"))
    path = scratch_path(docs.sparkSession, "gone")
    with passing_scratch(docs.sparkSession):
        found = written(classes(slim, threshold), "classes")
        gone = written(found.select("row").join(_staying(found).select("row"), "row", "left_anti"), "gone", path)
    return whole.join(broadcast_within(gone, BROADCAST_ROWS), "row", "left_anti").select("doc.*")
