"""Texts as mixtures of topics: latent Dirichlet allocation over word counts.

The fit is the distributed online variational one: every step reads a part of the rows and
updates one matrix of words by topics, which is what the driver and each task hold. Its size is bounded: words
lie in the usual range of document shares and the most frequent `WORDS` of them are taken. Words are
found and counted as in `segments`, in Arrow batches of texts that are split at white space.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.clustering import LDA, LDAModel
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import dims
from ..session import scratch_path
from . import segments

WORDS = 20_000
STEPS = 40
# Of the rows a step reads; small inputs are read whole.
STEP_ROWS = 2_000


def word_counts(words: list[str], text: str) -> Column:
    """Counts of the words in a text as a sparse vector."""
    known = pa.array(words, pa.string())

    @F.arrow_udf(VectorUDT())
    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            rows, places, counts = [], [], []
            for _, own, some in segments._slices(pa.array(np.zeros(len(texts), np.int32)), texts):
                flat, of = segments._split(some)
                place = pc.index_in(flat, value_set=known).fill_null(-1).to_numpy(zero_copy_only=False)
                there = place >= 0
                both, n = np.unique(of[there].astype(np.int64) * len(words) + place[there], return_counts=True)
                rows.append(own[both // len(words)])
                places.append(both % len(words))
                counts.append(n)
            row, place, n = (np.concatenate(v) if v else np.zeros(0, np.int64) for v in (rows, places, counts))
            offsets = pa.array(np.searchsorted(row, np.arange(len(texts) + 1)), pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(v)) for v in (place.astype(np.int32), n.astype(float))]
            kind, size = pa.array(np.zeros(len(texts), np.int8)), pa.array(np.full(len(texts), len(words), np.int32))
            yield pa.StructArray.from_arrays([kind, size, *lists], ["type", "size", "indices", "values"])
            pa.default_memory_pool().release_unused()

    return count(text)


@dataclass
class Mixture:
    """Known words, and the topics over them."""

    words: list[str]
    topics: LDAModel

    def term_shares(self) -> np.ndarray:
        """A row per topic: the share of every word."""
        matrix = np.maximum(self.topics.topicsMatrix().toArray().T, 1e-300)
        return matrix / matrix.sum(axis=1, keepdims=True)


def usual_words(df: DataFrame, text: str, most: int, min_share: float, max_share: float) -> list[str]:
    """The most frequent words whose share of the texts is in range, in order."""
    rows = df.select(F.lit(0).alias("_seg"), F.col(text).alias("_text")).where(F.col("_text").isNotNull())
    total = rows.count()
    named = rows.mapInArrow(segments._candidates(1), segments.CHUNK_TERMS).where("term is not null").select("term").distinct()
    # A few hundred words for each of a mean text, as all were frequent in some chunk.
    candidates = sorted(r["term"] for r in named.collect())
    if not candidates:
        return []
    every = rows.select(word_counts(candidates, "_text").alias("_vector"))
    found = segments.add_up(every.withColumn("_seg", F.lit(0)), ["_seg", "_vector"], _documents(len(candidates))).get(0, np.zeros(len(candidates)))
    chosen = [(-n, word) for n, word in zip(found, candidates, strict=True) if total * min_share <= n <= total * max_share]
    return [word for _, word in sorted(chosen)[:most]]


def _documents(size: int):
    def sums(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
        yield 0, np.bincount(batch.column("_vector").field("indices").flatten().to_numpy(), minlength=size)

    return sums


def fit_mixture(
    df: DataFrame, text: str, topics: int, words: int = WORDS, steps: int = STEPS, seed: int = 42,
    min_share: float = dims.NGRAM_MIN_DF, max_share: float = dims.NGRAM_MAX_DF,
) -> Mixture | None:
    """The model of the texts, or None where no word is in range. `topics` is at least 2."""
    chosen = usual_words(df, text, words, min_share, max_share)
    if not chosen:
        return None
    # Written: read once per step, and not counted again.
    path = scratch_path(df.sparkSession, "word-counts")
    df.where(F.col(text).isNotNull()).select(word_counts(chosen, text).alias("_counts")).write.parquet(path)
    counts = df.sparkSession.read.parquet(path)
    part = min(1.0, STEP_ROWS / max(counts.count(), 1))
    lda = LDA(k=topics, seed=seed, maxIter=steps, optimizer="online", subsamplingRate=max(part, 1e-6), featuresCol="_counts", optimizeDocConcentration=True)
    return Mixture(chosen, lda.fit(counts))


def add_mixture(df: DataFrame, text: str, model: Mixture | None, topics: int, target: str = "TopicShares") -> DataFrame:
    """Adds the shares of the topics, in all 1. A row without a known word, or any row without a model, has equal shares."""
    equal = F.array(*[F.lit(1.0 / topics)] * topics)
    if model is None:
        return df.withColumn(target, equal)
    shared = model.topics.setTopicDistributionCol("_shares").transform(df.withColumn("_counts", word_counts(model.words, text)))
    total = F.aggregate("_list", F.lit(0.0), lambda a, v: a + v)
    listed = shared.withColumn("_list", vector_to_array("_shares")).withColumn("_total", total)
    shares = F.when(F.col("_total") > 0, F.transform("_list", lambda v: v / F.col("_total"))).otherwise(equal)
    return listed.withColumn(target, shares).drop("_counts", "_shares", "_list", "_total")


def top_words(model: Mixture, top: int = 10) -> list[list[str]]:
    """The words of the greatest share in every topic."""
    shares, words = model.term_shares(), model.words
    return [[words[i] for i in np.argsort(-row, kind="stable")[:top]] for row in shares]


def log_likelihood(df: DataFrame, text: str, shares: str, model: Mixture) -> tuple[float, float]:
    """Of all known words: under the mixtures of their rows, and under one topic for all rows."""
    topics = model.term_shares()
    sums = df.select(word_counts(model.words, text).alias("_counts"), F.col(shares).alias("_mix"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mixed, frequency = 0.0, np.zeros(topics.shape[1])
        for batch in batches:
            vectors, mix = batch.column(0), batch.column(1).flatten().to_numpy().reshape(batch.num_rows, -1)
            words, counts = vectors.field("indices"), vectors.field("values")
            of = np.repeat(np.arange(batch.num_rows), np.diff(words.offsets.to_numpy()))
            flat, n = words.flatten().to_numpy(), counts.flatten().to_numpy()
            for a in range(0, len(flat), 50_000):
                part = slice(a, a + 50_000)
                mixed += float(n[part] @ np.log(np.einsum("ij,ji->i", mix[of[part]], topics[:, flat[part]])))
            frequency += np.bincount(flat, n, topics.shape[1])
        parts = pa.ListArray.from_arrays(pa.array([0, len(frequency)], pa.int32()), pa.array(frequency))
        yield pa.RecordBatch.from_arrays([pa.array([mixed]), parts], ["mixed", "frequency"])

    found = sums.mapInArrow(run, "mixed double, frequency array<double>")
    path = scratch_path(df.sparkSession, "likelihood")
    found.write.parquet(path)  # a row per task, read twice
    found = df.sparkSession.read.parquet(path)
    each = found.select(F.posexplode("frequency").alias("word", "n"))
    frequency = np.array([r["n"] for r in each.groupBy("word").agg(F.sum("n").alias("n")).collect()])  # a row per known word
    mixed = float(found.agg(F.sum("mixed")).first()[0] or 0.0)
    used = frequency[frequency > 0]
    return mixed, float(used @ np.log(used / used.sum())) if len(used) else 0.0
