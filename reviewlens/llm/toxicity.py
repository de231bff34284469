"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

A lexicon is learned from the labelled training rows: words that occur in far more toxic texts
than their share allows. The features are densities and weights of lexicon words, their distance
to words of the second person, capitals, punctuation and obfuscated spellings. Features of a
training row use the lexicon learned from the other half of the rows, as a new text would see it.

Lexicon, trees and calibration are fitted on at most TRAIN_ROWS labelled rows with distinct
texts, those with the smallest hashes. Scores cover every whole text. Null or empty text has
all features 0; a null id belongs to the training side but is never a label row; without labels
of both kinds every score is the share of toxic labels; repeated rows get equal scores.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernels as k
from .common import text_of, written

FOLDS = 3
HELD_OUT = 1
TRAIN_ROWS = 30_000
LEXICON_TERMS = 2_000
LEAST_TOXIC_TEXTS = 3
LEAST_EVIDENCE = 17.0
TOXIC_AT = 0.7

# Words of the second person, and letters that digits and signs stand for.

SECOND_PERSON = (
    "you your yours yourself u ur du dich dir dein deine ihr euch "
    "tu te toi ton ta vous votre tú ti usted ustedes vosotros"
).split()
STANDS_FOR = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "*": "", "|": "l"})

# End of the fixed values.

FEATURES = (
    "lexicon_density lexicon_log_count lexicon_weight lexicon_most lexicon_distinct second_person_near second_person_density "
    "capital_share shouted_share loud_rate punctuation_rate digit_rate obfuscated_rate log_words"
).split()
_LETTERS = re.compile(r"[^\W\d_]+")
_MASKED = re.compile(r"[^\W\d_]+[0-9@$!*|]+[^\W\d_][\w@$!*|]*|[0-9@$]+[^\W\d_]{2,}[\w@$!*|]*")


def fold_of(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")), F.lit(0)) % FOLDS


def training_rows(docs: DataFrame, labels: DataFrame, limit: int = TRAIN_ROWS) -> DataFrame:
    """`(text, toxic, fold)`: at most `limit` labelled rows outside the held-out fold."""
    chosen = labels.where("toxic is not null and doc_id is not null").where(fold_of() != HELD_OUT)
    chosen = chosen.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    # Bounded by `limit`, so it may be broadcast.
    rows = docs.select("doc_id", text_of("text").alias("text")).join(F.broadcast(chosen), "doc_id")
    rows = rows.select("text", "toxic", fold_of().cast("int").alias("fold"))
    # One row per text: copies would make all words of a text look like evidence.
    return rows.groupBy(F.sha2("text", 256).alias("_same")).agg(
        F.min_by("text", F.struct("toxic", "fold")).alias("text"), F.min(F.struct("toxic", "fold")).alias("_first")
    ).select("text", "_first.toxic", "_first.fold")


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts per word, toxic label and fold, summed over the partition."""
    counts: Counter = Counter()
    for batch in batches:
        for text, toxic, fold in zip(*(batch.column(c).to_pylist() for c in ("text", "toxic", "fold")), strict=True):
            counts.update((word, toxic, fold) for word in set(_LETTERS.findall(text.lower())))
            counts[("", toxic, fold)] += 1  # the empty word counts texts
    keys = list(counts)
    term, toxic, fold = zip(*keys, strict=True) if keys else ((), (), ())
    yield pa.RecordBatch.from_arrays(
        [pa.array(term, pa.string()), pa.array(toxic, pa.int32()), pa.array(fold, pa.int32()), pa.array([counts[x] for x in keys], pa.int64())],
        ["term", "toxic", "fold", "n"],
    )


def lexicons(rows: DataFrame) -> tuple[dict[int | None, dict[str, float]], dict[int, int]]:
    """Word weights learned without a fold, by fold, and from all rows under None; texts by label."""
    terms = rows.mapInArrow(_count_terms, "term string, toxic int, fold int, n long")
    terms = written(terms.groupBy("term", "toxic", "fold").agg(F.sum("n").alias("n")), "term-counts")
    texts = {(r["toxic"], r["fold"]): r["n"] for r in terms.where("term = ''").collect()}
    found: dict[int | None, dict[str, float]] = {}
    for left_out in (None, *(f for f in range(FOLDS) if f != HELD_OUT)):
        n = [sum(v for (t, f), v in texts.items() if t == y and f != left_out) for y in (0, 1)]
        if not all(n):
            found[left_out] = {}
            continue
        part = terms.where("term != ''") if left_out is None else terms.where((F.col("term") != "") & (F.col("fold") != left_out))
        a, b = F.col("a"), F.col("b")
        share = n[1] / (n[0] + n[1])
        per = part.groupBy("term").agg(
            F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("a"),
            F.sum(F.when(F.col("toxic") == 1, 0).otherwise(F.col("n"))).alias("b"),
        )
        # Twice the log-likelihood ratio of the word's own toxic share against the overall one.
        gain = lambda x, p: F.when(x > 0, x * F.log(x / (a + b) / F.lit(p))).otherwise(0.0)
        weight = F.log((a + 0.5) / (n[1] + 1)) - F.log((b + 0.5) / (n[0] + 1))
        per = per.withColumn("evidence", 2 * (gain(a, share) + gain(b, 1 - share))).withColumn("weight", weight)
        per = per.where((a >= LEAST_TOXIC_TEXTS) & (F.col("weight") > 1.5) & (F.col("evidence") >= LEAST_EVIDENCE))
        best = per.orderBy(F.desc("evidence"), "term").limit(LEXICON_TERMS).collect()
        found[left_out] = {r["term"]: r["weight"] for r in best}
    by_label = {y: sum(v for (t, _), v in texts.items() if t == y) for y in (0, 1)}
    return found, by_label


def _byte_set(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_UPPER, _LOWER, _DIGIT = _byte_set(bytes(range(65, 91))), _byte_set(bytes(range(97, 123))), _byte_set(b"0123456789")
_LOUD, _POINTS = _byte_set(b"!?"), _byte_set(b".,;:'\"()-*#%&$@|<>")


def measure(texts: k.Texts, words_of: list[str], lexicon: dict[str, float]) -> np.ndarray:
    """FEATURES of some texts, one row each."""
    n = texts.n
    size = np.maximum(texts.lengths, 1)
    upper, lower = texts.per_text(_UPPER[texts.data]), texts.per_text(_LOWER[texts.data])
    begins, ends = texts.word_spans()
    of = texts.document_of(begins)
    running = [np.concatenate([[0], np.cumsum(flag[texts.data], dtype=np.int64)]) for flag in (_UPPER, _LOWER)]
    up, low = (r[ends] - r[begins] for r in running)
    out = np.zeros((n, len(FEATURES)))
    n_words = np.bincount(of, minlength=n)
    out[:, 7] = upper / np.maximum(upper + lower, 1)
    out[:, 8] = np.bincount(of[(up >= 2) & (low == 0)], minlength=n) / np.maximum(n_words, 1)
    out[:, 9] = texts.per_text(_LOUD[texts.data]) / size
    out[:, 10] = texts.per_text(_POINTS[texts.data]) / size
    out[:, 11] = texts.per_text(_DIGIT[texts.data]) / size
    out[:, 13] = np.log1p(n_words)
    listed = set(lexicon) | set(SECOND_PERSON)
    for i, text in enumerate(words_of):
        words = _LETTERS.findall(text.lower())
        hits, near = [], []
        if not listed.isdisjoint(words):
            hits = [(p, w) for p, w in enumerate(words) if w in lexicon]
            near = [p for p, w in enumerate(words) if w in SECOND_PERSON]
        masked = [m.rstrip("!*|@$").lower().translate(STANDS_FOR) for m in _MASKED.findall(text)]
        hidden = [m for m in masked if m in lexicon]
        weights = [lexicon[w] for _, w in hits] + [lexicon[w] for w in hidden]
        count = max(len(words), 1)
        out[i, 0] = len(weights) / count
        out[i, 1] = math.log1p(len(weights))
        out[i, 2] = sum(weights) / math.sqrt(count)
        out[i, 3] = max(weights, default=0)
        out[i, 4] = len({w for _, w in hits} | set(hidden))
        if hits and near:
            at = np.array([p for p, _ in hits])
            you = np.array(near)
            right = np.searchsorted(you, at)
            gap = np.minimum(np.abs(at - you[np.minimum(right, len(you) - 1)]), np.abs(at - you[np.maximum(right - 1, 0)]))
            out[i, 5] = 1 / (1 + float(gap.min()))
        out[i, 6] = len(near) / count
        out[i, 12] = len(hidden) / count
    return out


def _features(lexicon_of: dict[int | None, dict[str, float]], rest: list[str], by_fold: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, texts in k.chunks(batch, "text"):
                words = rows.column("text").to_pylist()
                if by_fold:
                    folds = rows.column("fold").to_pylist()
                    found = np.zeros((texts.n, len(FEATURES)))
                    for fold in set(folds):
                        found = np.where(np.array([f == fold for f in folds])[:, None], measure(texts, words, lexicon_of.get(fold, {})), found)
                else:
                    found = measure(texts, words, lexicon_of[None])
                lists = pa.ListArray.from_arrays(pa.array(np.arange(texts.n + 1, dtype=np.int32) * len(FEATURES)), pa.array(found.ravel()))
                yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in rest), lists], [*rest, "values"])

    return run


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """`(doc_id, held_out, score, predicted)`, one row per row of `docs` (doc_id, text)."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = written(training_rows(docs, labels), "toxic-rows")
    lexicon_of, texts = lexicons(rows)
    values = docs.select("doc_id", text_of("text").alias("text")).mapInArrow(
        _features(lexicon_of, ["doc_id"], False), f"doc_id {kind}, values array<double>"
    )
    if all(texts.get(y) for y in (0, 1)):
        trained = rows.mapInArrow(_features(lexicon_of, ["toxic"], True), "toxic int, values array<double>")
        trained = trained.withColumn("part", F.pmod(F.xxhash64("values"), F.lit(4)))
        trained = written(trained.select(array_to_vector("values").alias("features"), F.col("toxic").cast("double").alias("label"), "part"), "toxic-features")
        trees = GBTClassifier(maxIter=20, maxDepth=3, stepSize=0.25, maxBins=32, seed=7)
        # Trees see three quarters of the rows, the calibration the rest.
        few = trained.coalesce(8)
        part = few.where("part != 0")
        trees = trees.fit(part if part.select("label").distinct().count() == 2 else few)
        raw = vector_to_array("probability")[1].alias("raw")
        held = few.where("part = 0")
        calibration = trees.transform(held if held.select("label").distinct().count() == 2 else few).select(raw, "label")
        curve = IsotonicRegression(featuresCol="raw", labelCol="label", predictionCol="score").fit(calibration)
        scored = trees.transform(values.select("doc_id", array_to_vector("values").alias("features"))).select("doc_id", raw)
        scored = curve.transform(scored)
    else:
        known = sum(texts.values())
        scored = values.withColumn("score", F.lit(texts.get(1, 0) / known if known else 0.0))
    bounded = F.least(F.greatest(F.col("score"), F.lit(0.0)), F.lit(1.0))
    return scored.select(
        "doc_id", (fold_of() == HELD_OUT).alias("held_out"), bounded.alias("score"), (bounded >= TOXIC_AT).cast("int").alias("predicted")
    )
