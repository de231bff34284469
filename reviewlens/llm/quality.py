"""Quality rules by importance: how much likelier a text is in a trusted target than in the raw
corpus, under multinomials over hashed words and word pairs.

Raw counts cover every document. Target counts cover the trusted documents, those that `labels`
marks as good; of more than TRUSTED_ROWS the ones with the smallest hash count. The score is the
mean log-likelihood ratio per n-gram; a document is kept where it reaches THRESHOLD and passes
the base rules. Every document is judged by the same fixed thresholds, without sampling.

Null text has no words and fails the base rules; null ids and repeated rows are judged like any
other; without trusted rows or on an empty table the score is 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as k

BUCKETS = 1 << 16
TRUSTED_ROWS = 1_000_000
PSEUDO_COUNT = 20.0
THRESHOLD = -0.08
LEAST_WORDS = 50

_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[list(b"#*$%&|<>")] = True


def features(texts: k.Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all words and word pairs with their text; hash and text of the words."""
    begins, ends = texts.word_spans()
    words, of = texts.hashes(begins, ends), texts.document_of(begins)
    pairs, pair_of = k.grams(words, of, 2)
    buckets = np.concatenate([words, pairs]) >> k.U64(64 - BUCKETS.bit_length() + 1)
    return buckets.astype(np.int64), np.concatenate([of, pair_of]), words, of


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for batch in batches:
        for rows, texts in k.chunks(batch, "text"):
            buckets, of, _, _ = features(texts)
            raw += np.bincount(buckets, minlength=BUCKETS)
            trusted = np.asarray(rows.column("trusted").to_numpy(zero_copy_only=False), bool)
            target += np.bincount(buckets[trusted[of]], minlength=BUCKETS)
    some = np.flatnonzero(raw)
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(raw[some]), pa.array(target[some])], ["bucket", "raw", "target"])


def log_ratios(docs: DataFrame, labels: DataFrame) -> np.ndarray:
    """Log of target over raw probability for every bucket. BUCKETS rows reach the driver.

    Both sides of the ratio get the same pseudo-count, so a bucket with little evidence is near 0."""
    trusted = labels.where("quality = 1 and doc_id is not null").select("doc_id").distinct()
    # Bounded by TRUSTED_ROWS, so it may be broadcast.
    trusted = trusted.orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRUSTED_ROWS).withColumn("trusted", F.lit(True))
    flagged = docs.select("doc_id", "text").join(F.broadcast(trusted), "doc_id", "left")
    flagged = flagged.select("text", F.coalesce("trusted", F.lit(False)).alias("trusted"))
    counted = flagged.mapInArrow(_count, "bucket long, raw long, target long")
    sums = counted.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toPandas()
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    raw[sums["bucket"]], target[sums["bucket"]] = sums["raw"], sums["target"]
    if not target.sum():
        return np.zeros(BUCKETS)
    expected = target.sum() * raw / raw.sum()
    return np.log((target + PSEUDO_COUNT) / (expected + PSEUDO_COUNT))


def measures(texts: k.Texts, ratios: np.ndarray) -> dict[str, np.ndarray]:
    """The measured columns of some texts."""
    n = texts.n
    buckets, feature_of, words, of = features(texts)
    n_words = np.bincount(of, minlength=n)
    leading = (texts.data & 0xC0) != 0x80

    running = texts.running()
    begins, ends, line_of = texts.line_spans()
    in_words = np.concatenate([[0], np.cumsum(texts.is_word(), dtype=np.int64)])
    full = in_words[ends] > in_words[begins]
    lines = k.with_text(texts.hashes(begins[full], ends[full], running), line_of[full])
    order, new = k.first_of_group(lines)
    n_dup_lines = np.bincount(line_of[full][order[~new]], minlength=n)

    threes = k.grams(words, of, 3)
    order, new = k.first_of_group(k.with_text(*threes))
    alone = new & np.append(new[1:], True)
    places = np.flatnonzero(of[:-2] == of[2:]) if len(of) > 2 else np.zeros(0, np.int64)
    again = places[order[~alone]]
    covered = np.zeros(len(words), bool)
    for shift in range(3):
        covered[again + shift] = True

    total = np.bincount(feature_of, weights=ratios[buckets], minlength=n)
    grams = np.bincount(feature_of, minlength=n)
    score = np.divide(total, grams, out=np.zeros(n), where=grams > 0)
    n_repeat = np.bincount(of[covered], minlength=n)
    failed = (n_words < LEAST_WORDS) | (100 * n_repeat > 50 * n_words)
    return {
        "n_words": n_words, "word_chars": texts.per_text(texts.is_word() & leading),
        "n_symbols": texts.per_text(_SYMBOLS[texts.data]), "n_dup_lines": n_dup_lines, "n_repeat_words": n_repeat,
        "base_failed": failed, "score": score, "kept": ~failed & (score >= THRESHOLD),
    }


MEASURED = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, score double, kept boolean"
)


def _judge(ratios: np.ndarray, rest: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, texts in k.chunks(batch, "text"):
                found = measures(texts, ratios)
                kept = [rows.column(c) for c in rest]
                yield pa.RecordBatch.from_arrays([*kept, *(pa.array(v) for v in found.values())], [*rest, *found])

    return run


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """`(doc_id, measured columns…)`, one row per row of `docs` (doc_id, text)."""
    ratios = log_ratios(docs, labels)
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {MEASURED}"
    return docs.select("doc_id", "text").mapInArrow(_judge(ratios, ["doc_id"]), schema)


def good_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents kept, with all their columns and in place: no join, no shuffle."""
    ratios = log_ratios(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, texts in k.chunks(batch, "text"):
                yield rows.filter(pa.array(measures(texts, ratios)["kept"]))

    return docs.mapInArrow(run, docs.schema)
