"""Mixing sources to target weights by a low-discrepancy schedule.

Every source's documents are shuffled by hash and laid end to end; the stream is cut into blocks
of equal size. The schedule has one slot per block to take. Slot j of K belongs to the source
whose share of the cumulative weights holds j/K; the slots are served in van der Corput order
(the bits of j reversed), so every stretch of the schedule holds the sources near their shares
and, over the whole, each exactly. The slots of a source are ranked in that order and take its
blocks one after the other, going round a second time where the target is above the size. A document
has the positions of the slots that take its words; the mixed documents come in the order of the first of
them, so every stretch of the output holds the sources near their shares.

Null text has no words, null sources are one source and come last, repeated rows are documents
of their own, empty texts take nothing, an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ordering import dense_codes
from ..session import passing_scratch, scratch_path
from .common import WORD, attach, text_of, written

# Weights of the sources in turn, share of all sizes, most rounds of a source.

WEIGHTS = (5, 2, 1)
BUDGET = 1.5
ROUNDS = 2

# End of the fixed values.

BLOCK_WORDS = 1024
SEED = "mix"
_KEY_BITS = 60
_CHUNK = 4096
_ROWS_PER_BUCKET = 1000


def targets(sources: DataFrame, budget: float = BUDGET, rounds: int = ROUNDS) -> DataFrame:
    """`sources` (source_size, weight) with `target`: the budget shared by weight, no target above
    `rounds` times its source, the excess shared again until none is above.

    Each turn sums two numbers over the sources; a source that was full stays full."""
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    most = F.col("source_size") * rounds
    level, full_before = None, -1
    while True:
        full = F.lit(False) if level is None else most <= F.lit(level) * F.col("weight")
        sums = sources.agg(
            F.sum(F.when(full, most).otherwise(0)).alias("full"), F.sum(F.when(full, 0).otherwise(F.col("weight"))).alias("open"),
            F.count(F.when(full, 1)).alias("n"),
        ).first()
        if sums["n"] == full_before or not sums["open"]:
            break
        level, full_before = (budget * total - sums["full"]) / sums["open"], sums["n"]
    target = F.lit(0.0) if level is None else F.least(most.cast("double"), F.lit(level) * F.col("weight"))
    return sources.withColumn("target", target)


def reversed_bits(value: Column, bits: int) -> Column:
    return F.conv(F.reverse(F.lpad(F.bin(value), bits, "0")), 2, 10).cast("bigint")


def schedule(sources: DataFrame, block: int = BLOCK_WORDS) -> DataFrame:
    """`(code, position, rank)`: the slots of every source (code, quota) in van der Corput order.

    `rank` counts the slots of a source by position. Ranks are made per stretch of the schedule
    and shifted by the counts of the stretches before, so no task holds a source."""
    spark = sources.sparkSession
    k = sources.agg(F.sum("quota")).first()[0] or 0
    bits = max(1, int(k).bit_length())
    # Sources side by side on 0..K-1. Stretches of codes first: no window over all sources.
    part = sources.where("quota > 0").withColumn("_part", (F.col("code") / _CHUNK).cast("bigint"))
    sums = part.groupBy("_part").agg(F.sum("quota").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    inner = Window.partitionBy("_part").orderBy("code").rowsBetween(Window.unboundedPreceding, -1)
    spans = part.join(sums, "_part").select(
        "code", "quota", (F.col("_base") + F.coalesce(F.sum("quota").over(inner), F.lit(0))).alias("low")
    ).withColumn("high", F.col("low") + F.col("quota"))
    chunk = lambda c: F.floor(c / _CHUNK)
    spans = spans.withColumn("_chunk", F.explode(F.sequence(chunk(F.col("low")), chunk(F.col("high") - 1))))
    slots = spark.range(k).withColumn("_chunk", chunk(F.col("id")))
    slots = slots.join(spans, "_chunk").where("id >= low and id < high")
    slots = slots.select("code", reversed_bits(F.col("id"), bits).alias("position"))
    slots = slots.withColumn("_stretch", chunk(F.col("position")))

    counts = slots.groupBy("code", "_stretch").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("code").orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("code", "_stretch", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    within = Window.partitionBy("code", "_stretch").orderBy("position")
    ranked = slots.join(starts, ["code", "_stretch"])
    return ranked.select("code", "position", (F.col("_start") + F.row_number().over(within) - 1).alias("rank"))


def numbered(docs: DataFrame, doc_id: str, text: str, source: str) -> DataFrame:
    return docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(source).alias("source")
    )


def streams(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (row, doc_id, text, source) with their place in the shuffled stream of their source,
    and the sources."""
    key = F.conv(F.substring(F.md5(F.concat(F.lit(SEED), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), 1, 15), 16, 10)
    slim = docs.select(
        "row", "doc_id", "source",
        # A key that is never null: null is a source of its own.
        F.when(F.col("source").isNull(), "0").otherwise(F.concat(F.lit("1"), F.col("source"))).alias("_source"),
        F.regexp_count(text_of("text"), F.lit(WORD)).cast("bigint").alias("size"), key.cast("bigint").alias("_key"),
    )
    slim = written(slim, "word-counts")
    sources = slim.groupBy("_source").agg(
        F.first("source").alias("source"), F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs")
    )
    sources = written(sources, "sources")
    codes = dense_codes(sources.select("source"), "source").withColumnRenamed("source", "_name")
    n_codes = codes.count()
    sources = sources.join(codes, sources["source"] == codes["_name"], "left").drop("_name")
    sources = sources.withColumn("code", F.coalesce("code", F.lit(n_codes)))
    sources = sources.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), F.col("code") % len(WEIGHTS) + 1))
    sources = written(sources, "sources")
    sources = targets(sources).withColumn("words", F.floor(F.col("target") + 0.5).cast("bigint"))

    total = slim.count()
    docs = attach(slim, sources.select("_source", "code", "source_size", "target", "n_docs"), "_source", "n_docs", total)
    # A source is cut into buckets of about equal numbers of documents, by ranges of the key.
    docs = docs.withColumn("_buckets", F.col("n_docs") / _ROWS_PER_BUCKET + 1)
    docs = docs.withColumn("_bucket", F.floor(F.col("_key") / F.lit(float(1 << _KEY_BITS)) * F.floor("_buckets")))
    docs = docs.drop("_buckets", "_source", "n_docs")
    sums = docs.groupBy("code", "_bucket").agg(F.sum("size").alias("_words"))
    before = Window.partitionBy("code").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("code", "_bucket", F.coalesce(F.sum("_words").over(before), F.lit(0)).alias("_base"))
    inner = Window.partitionBy("code", "_bucket").orderBy("_key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = docs.join(sums, ["code", "_bucket"])
    placed = placed.withColumn("start", F.col("_base") + F.coalesce(F.sum("size").over(inner), F.lit(0)))
    return placed.drop("_bucket", "_base", "_key"), sources


def mixture(docs: DataFrame, sources: DataFrame, block: int = BLOCK_WORDS) -> DataFrame:
    """Every document cut at the block ends of its source's stream, once per round, joined to the
    slot that takes the block: `(code, start, …, round, from_word, to_word, position)`. `position`
    is null and the range empty where no slot takes the block. A document without words has one
    empty piece."""
    slots = schedule(sources.withColumn("quota", F.ceil(F.col("words") / block).cast("bigint")), block)
    # The last block of a source ends at its target.
    slots = slots.join(sources.select("code", "words"), "code").select(
        "code", F.col("rank").alias("block"), "position", F.least(F.col("words"), (F.col("rank") + 1) * block).alias("_slot_end")
    )
    lap = F.explode(F.sequence(F.lit(0), F.lit(ROUNDS - 1))).alias("round")
    pieces = docs.select("*", lap).withColumn("_low", F.col("start") + F.col("round") * F.col("source_size"))
    pieces = pieces.withColumn("_high", F.col("_low") + F.col("size"))
    last = F.floor((F.greatest(F.col("_high") - 1, F.col("_low"))) / block)
    pieces = pieces.withColumn("block", F.explode(F.sequence(F.floor(F.col("_low") / block), last)))
    joined = pieces.join(slots, ["code", "block"], "left")
    low = F.greatest(F.col("_low"), F.col("block") * block)
    high = F.least(F.col("_high"), (F.col("block") + 1) * block, F.coalesce(F.col("_slot_end"), F.lit(0)))
    offset = F.col("_low")
    return joined.select(
        *docs.columns, "round", "position", (low - offset).alias("from_word"),
        (F.greatest(high, low) - offset).alias("to_word"),
    )


def taken_words(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """`(doc_id, size, source_size, target, taken, first_position, last_position)`, one row per row of
    `docs`; the positions of the schedule are null where nothing is taken."""
    placed, sources = streams(numbered(docs, doc_id, text, source))
    mixed = mixture(written(placed, "streams"), written(sources, "targets"))
    position = F.when(F.col("to_word") > F.col("from_word"), F.col("position"))
    return (
        mixed.groupBy("row", "doc_id", "size", "source_size", "target")
        .agg(
            F.sum(F.col("to_word") - F.col("from_word")).cast("bigint").alias("taken"),
            F.min(position).alias("first_position"), F.max(position).alias("last_position"),
        )
        .drop("row")
    )


def mix_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The mix as documents: the columns of `docs`, one row per round that takes words of it, in the order of
    the schedule (partitions are ranges of it). A document taken in part keeps those words, joined by a space;
    one taken in full its text."""
    columns = docs.columns
    whole = written(docs.select(F.monotonically_increasing_id().alias("row"), F.struct(*[F.col(f"`{c}`") for c in columns]).alias("doc")), "numbered")
    names = {"doc_id": doc_id, "text": text, "source": source}
    path = scratch_path(docs.sparkSession, "runs")
    with passing_scratch(docs.sparkSession):
        placed, sources = streams(whole.select("row", *[F.col(f"doc.`{c}`").alias(n) for n, c in names.items()]))
        mixed = mixture(written(placed, "streams"), written(sources, "targets")).where("to_word > from_word")
        # What a round takes of a document is one run of its words.
        runs = mixed.groupBy("row", "round", "size").agg(
            F.min("from_word").alias("first"), F.max("to_word").alias("end"), F.min("position").alias("position")
        )
        runs = written(runs, "runs", path)
    joined = whole.join(runs, "row").repartitionByRange("position", "row").sortWithinPartitions("position", "row")
    words = F.regexp_extract_all(F.col(f"doc.`{text}`"), F.lit(f"({WORD})"), F.lit(1))
    part = F.array_join(F.slice(words, F.col("first").cast("int") + 1, (F.col("end") - F.col("first")).cast("int")), " ")
    full = (F.col("first") == 0) & (F.col("end") == F.col("size"))
    kept = F.when(full, F.col(f"doc.`{text}`")).otherwise(part)
    out = joined.select(*[(kept if c == text else F.col(f"doc.`{c}`")).alias(c) for c in columns])
    return out.withColumn("n_chars", F.length(text).cast(docs.schema["n_chars"].dataType)) if "n_chars" in columns else out
