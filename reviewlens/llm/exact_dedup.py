"""Exact duplicates by two-pass Bloom filtering.

Pass one counts, per position of two hash functions, how many rows fall on it and keeps the
positions hit twice or more as bitmaps. Pass two tests every row: a text that occurs twice hits
two such positions, so a row that misses one is unique and goes straight through. Only the
rows left, possibly repeated, are shuffled and compared by the SHA-256 of their text.

Null text counts as empty. Texts are equal when their runs of ASCII white space are made one
space. The smallest id stays; a null id comes after every other. Of rows equal in text and id one
stays. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_RUN, attach, orderable, text_of, written

BITS_PER_ROW = 16
BITMAP_BITS = 32_768
BROADCAST_BYTES = 32 << 20


def text_digest(text: str = "text") -> Column:
    """SHA-256 of the text with every run of white space made one space."""
    return F.sha2(F.regexp_replace(text_of(text), SPACE_RUN, " "), 256)


def _positions(digest: Column, n_bits: int) -> list[Column]:
    return [F.pmod(F.xxhash64(F.lit(seed), digest), F.lit(n_bits).cast("bigint")) + 1 for seed in (1, 2)]


def repeated_positions(digests: DataFrame, n_bits: int) -> DataFrame:
    """Pass one: `(bucket, bits)`, bitmaps of the positions that two or more hashes fall on."""
    hits = digests.select(F.explode(F.array(*_positions(F.col("digest"), n_bits))).alias("position"))
    twice = hits.groupBy("position").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return twice.groupBy(F.bitmap_bucket_number("position").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("position")).alias("bits")
    )


def possibly_repeated(rows: DataFrame, bitmaps: DataFrame, n_bits: int) -> DataFrame:
    """Pass two: the rows with `_maybe`, false only where the digest occurs once.

    The bitmaps are broadcast while they stay below a fixed size. Beyond it they are joined by
    bucket; pass slim rows then."""
    small = n_bits // 8 + 4096 <= BROADCAST_BYTES
    flags = []
    for k, position in enumerate(_positions(F.col("digest"), n_bits)):
        side = bitmaps.select(F.col("bucket").alias(f"_bucket{k}"), F.col("bits").alias(f"_bits{k}"))
        rows = rows.withColumn(f"_bucket{k}", F.bitmap_bucket_number(position))
        rows = rows.join(F.broadcast(side) if small else side, f"_bucket{k}", "left")
        bit = F.bitmap_bit_position(position)
        byte = F.conv(F.hex(F.substring(F.col(f"_bits{k}"), (bit / 8).cast("int") + 1, F.lit(1))), 16, 10)
        flags.append(F.coalesce(F.getbit(byte.cast("bigint"), (bit % 8).cast("int")) == 1, F.lit(False)))
        rows = rows.withColumn(f"_flag{k}", flags.pop()).drop(f"_bucket{k}", f"_bits{k}")
    return rows.withColumn("_maybe", F.col("_flag0") & F.col("_flag1")).drop("_flag0", "_flag1")


def _bits(n_rows: int) -> int:
    return (n_rows * BITS_PER_ROW // BITMAP_BITS + 1) * BITMAP_BITS


def membership(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """`(doc_id, keep_id, group_size, kept, text_sha256)`, one row per row of `docs`."""
    slim = written(docs.select(F.col(doc_id).alias("doc_id"), text_digest(text).alias("digest")), "digests")
    total = slim.count()
    n_bits = _bits(total)
    bitmaps = written(repeated_positions(slim, n_bits), "bitmaps")
    tested = written(possibly_repeated(slim, bitmaps, n_bits), "tested")

    unique = tested.where("not _maybe").select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("bigint").alias("group_size"),
        F.lit(True).alias("kept"), "digest",
    )
    copies = tested.where("_maybe").groupBy("digest", "doc_id").agg(F.count(F.lit(1)).alias("copies"))
    groups = copies.groupBy("digest").agg(
        F.min("doc_id").alias("keep_id"), F.sum("copies").cast("bigint").alias("group_size")
    )
    grouped = attach(copies, groups, "digest", "group_size", total)
    # A row per copy again; of rows equal in text and id the first stays.
    grouped = grouped.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies"))))
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)
    grouped = grouped.select("doc_id", "keep_id", "group_size", kept.alias("kept"), "digest")
    return unique.unionByName(grouped).withColumnRenamed("digest", "text_sha256")


def deduplicate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows that stay, with all their columns. Unique rows are not shuffled."""
    slim = written(docs.select(text_digest(text).alias("digest")), "digests")
    n_bits = _bits(slim.count())
    bitmaps = written(repeated_positions(slim, n_bits), "bitmaps")
    columns = docs.columns
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), text_digest(text).alias("digest"))
    tested = possibly_repeated(whole, bitmaps, n_bits)
    order = [F.col(f"row.`{doc_id}`").isNull(), F.col(f"row.`{doc_id}`")]
    order += [F.col(f"row.`{c}`") for c in orderable(docs) if c != doc_id]
    first = tested.where("_maybe").groupBy("digest").agg(
        F.min_by("row", F.struct(*[o.alias(f"o{k}") for k, o in enumerate(order)])).alias("row")
    )
    return tested.where("not _maybe").select("row.*").unionByName(first.select("row.*"))
