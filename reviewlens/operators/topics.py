"""Topics of reviews: fitting, labels, similarity, merging and positions.

A topic model here is a list of centres in a vector space. What comes to the driver is one centre
per topic and two axes. Models of reviews with text only are in `segments`.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import dims
from ..functions import arrays as a
from ..functions import columns as c
from ..session import shared_dir
from . import nested, ordering, sizes

OUTLIER = -1
OUTLIER_DEVIATIONS = 3.0
# Up to so many dimensions the axes come from a covariance matrix, beyond that from passes over
# the vectors with a few columns.
COVARIANCE_COLUMNS = 1_000
AXIS_COLUMNS, AXIS_PASSES, AXIS_CHANGE = 10, 20, 1e-4
_BLOCK = 4_096
_ENTRIES = 200_000


# --- fitting ------------------------------------------------------------------------------


def _features(df: DataFrame, vector: str) -> Column:
    """A vector column as it is, an array as a vector."""
    if isinstance(df.schema[vector].dataType, VectorUDT):
        return F.col(vector)
    return array_to_vector(F.col(vector).cast("array<double>"))


@dataclass
class TopicModel:
    """Centres from the largest to the smallest topic, and what the scores are measured by."""

    centres: np.ndarray
    scale: float
    limit: float
    axes: np.ndarray


SCORES = "distance double, probabilities array<double>, x double, y double"


@dataclass
class _Rows:
    """Vectors of a batch, none of them null: where each row starts, its entries and its length."""

    starts: np.ndarray
    indices: np.ndarray
    values: np.ndarray
    lengths: np.ndarray

    @classmethod
    def of(cls, vectors: pa.StructArray) -> _Rows:
        kind, values = vectors.field("type").to_numpy(zero_copy_only=False), vectors.field("values")
        lengths = pc.list_value_length(values).to_numpy(zero_copy_only=False).astype(np.int64)
        starts = np.cumsum(lengths) - lengths
        flat = values.flatten().to_numpy(zero_copy_only=False)
        # A dense vector has its entries in order.
        indices = np.arange(len(flat)) - np.repeat(starts, lengths)
        indices[np.repeat(kind == 0, lengths)] = vectors.field("indices").flatten().to_numpy(zero_copy_only=False)
        return cls(starts, indices, flat, lengths)

    def pieces(self) -> Iterator[tuple[slice, slice]]:
        """Rows and their entries, a bounded number of entries at a time or one row."""
        at = 0
        while at < len(self.starts):
            to = max(at + 1, int(np.searchsorted(self.starts + self.lengths, self.starts[at] + _ENTRIES, "right")))
            yield slice(at, to), slice(int(self.starts[at]), int(self.starts[to - 1] + self.lengths[to - 1]))
            at = to

    def times(self, matrix: np.ndarray) -> np.ndarray:
        out = np.zeros((len(self.starts), matrix.shape[1]))
        for rows, entries in self.pieces():
            filled = np.flatnonzero(self.lengths[rows])
            if len(filled):
                products = matrix[self.indices[entries]] * self.values[entries, None]
                out[rows.start + filled] = np.add.reduceat(products, self.starts[rows][filled] - entries.start)
        return out

    def transposed_times(self, columns: np.ndarray, size: int) -> np.ndarray:
        out = np.zeros((size, columns.shape[1]))
        for rows, entries in self.pieces():
            weights = np.repeat(columns[rows], self.lengths[rows], axis=0) * self.values[entries, None]
            for i in range(columns.shape[1]):
                out[:, i] += np.bincount(self.indices[entries], weights[:, i], size)
        return out


def _present(vectors: pa.Array) -> tuple[np.ndarray, pa.StructArray]:
    present = vectors.is_valid()
    return present.to_numpy(zero_copy_only=False), vectors.filter(present)


def _scorer(model: TopicModel):
    """Distance to the nearest centre, topic probabilities and coordinates, by batches."""
    count, scale = len(model.centres), model.scale
    matrix = np.hstack([model.centres.T, model.axes])
    norms = (model.centres**2).sum(axis=1)

    @F.arrow_udf(SCORES)
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for every in batches:
            present, vectors = _present(every)
            rows = _Rows.of(vectors)
            products = rows.times(matrix)
            own = np.bincount(np.repeat(np.arange(len(rows.starts)), rows.lengths), rows.values**2, len(rows.starts))
            squared = np.maximum(own[:, None] - 2 * products[:, :count] + norms, 0.0)
            logits = -squared / scale
            weights = np.exp(logits - logits.max(axis=1, keepdims=True))
            weights /= weights.sum(axis=1, keepdims=True)
            shares = pa.ListArray.from_arrays(pa.array(np.arange(len(weights) + 1) * count, pa.int32()), pa.array(weights.ravel()))
            found = [pa.array(np.sqrt(squared.min(axis=1))), shares, pa.array(products[:, count].copy()), pa.array(products[:, count + 1].copy())]
            # A row without a vector has no scores.
            place = pa.array(np.cumsum(present) - 1, mask=~present)
            yield pa.StructArray.from_arrays([f.take(place) for f in found], ["distance", "probabilities", "x", "y"])

    return score


def _covariance_times(points: DataFrame, mean: np.ndarray, n: int, columns: np.ndarray) -> np.ndarray:
    """The covariance matrix of `features` times a few columns, in one pass; sums are sent in blocks."""
    size, width = columns.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, width))
        for batch in batches:
            rows = _Rows.of(batch.column(0))
            total += rows.transposed_times(rows.times(columns), size)
        flat = np.concatenate([total.ravel(), np.zeros(-total.size % _BLOCK)])
        blocks = len(flat) // _BLOCK
        sums = pa.ListArray.from_arrays(pa.array(np.arange(blocks + 1) * _BLOCK, pa.int32()), pa.array(flat))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(blocks)), sums], ["block", "sums"])

    parts = points.select("features").mapInArrow(run, "block long, sums array<double>")
    added = parts.groupBy("block").agg(Summarizer.metrics("sum").summary(array_to_vector("sums")).alias("s"))
    rows = sorted(added.select("block", "s.sum").collect())
    flat = np.concatenate([r["sum"].toArray() for r in rows])[: size * width]
    return flat.reshape(size, width) / n - np.outer(mean, mean @ columns)


def principal_axes(points: DataFrame, size: int, seed: int = 42) -> np.ndarray:
    """The two leading principal components of `features`, a column each.

    Beyond `COVARIANCE_COLUMNS` dimensions the covariance matrix is never made: a few columns are
    multiplied by it, pass by pass, until the leading variances settle."""
    if size <= COVARIANCE_COLUMNS:
        return PCA(k=2, inputCol="features", outputCol="_xy").fit(points).pc.toArray()
    known = points.agg(F.count(F.lit(1)).alias("n"), Summarizer.metrics("mean").summary(F.col("features")).alias("s")).first()
    mean, n = known["s"]["mean"].toArray(), known["n"]
    columns = np.linalg.qr(np.random.default_rng(seed).standard_normal((size, AXIS_COLUMNS)))[0]
    before = np.zeros(2)
    for _ in range(AXIS_PASSES):
        product = _covariance_times(points, mean, n, columns)
        small = columns.T @ product
        variances, turned = np.linalg.eigh((small + small.T) / 2)
        axes = columns @ turned[:, :-3:-1]
        leading = variances[:-3:-1]
        if np.abs(leading - before).max() <= AXIS_CHANGE * max(leading[0], 1e-300):
            break
        before = leading
        columns = np.linalg.qr(product)[0]
    # The sign is free: the largest entry of an axis is positive.
    return axes * np.sign(axes[np.abs(axes).argmax(axis=0), [0, 1]])


def fit_topics(df: DataFrame, vector: str, topics: int, seed: int = 42, min_size: int = 2) -> TopicModel:
    """Cluster the vectors; clusters below `min_size` are left out of the model.

    The vectors are kept (memory, then disk) while the passes over them run.
    """
    points = df.where(F.col(vector).isNotNull()).select(_features(df, vector).alias("features"))
    points.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        # The row solver also copes with fewer distinct vectors than topics.
        fitted = KMeans(k=topics, seed=seed, maxIter=20, solver="row").fit(points)
        members = np.array(fitted.summary.clusterSizes)
        centres = np.array(fitted.clusterCenters())
        large = [i for i in np.argsort(-members, kind="stable") if members[i] >= min_size]
        centres = centres[large or [int(members.argmax())]]
        axes = np.zeros((centres.shape[1], 2))
        if centres.shape[1] >= 2 and members.sum() >= 2:
            axes = principal_axes(points, centres.shape[1], seed)
        model = TopicModel(centres, 1.0, float("inf"), axes)
        spread = points.select(_scorer(model)("features")["distance"].alias("d")).agg(
            F.avg("d").alias("mean"), F.stddev_pop("d").alias("deviation"), F.avg(F.col("d") * F.col("d")).alias("square")
        ).first()
    finally:
        points.unpersist()
    model.scale = float(spread["square"] or 1.0)
    model.limit = float((spread["mean"] or 0.0) + OUTLIER_DEVIATIONS * (spread["deviation"] or 0.0))
    return model


def assign_topics(df: DataFrame, vector: str, model: TopicModel) -> DataFrame:
    """Add Topic, TopicProbability and coordinates. A review farther from every centre than the
    mean distance plus three deviations is an outlier, topic -1."""
    scored = df.withColumn("_s", _scorer(model)(F.when(F.col(vector).isNotNull(), _features(df, vector))))
    best = F.array_position(F.col("_s.probabilities"), F.array_max("_s.probabilities")) - 1
    return scored.withColumns(
        {
            "Topic": F.when(c.nan_to_null("_s.distance") > model.limit, OUTLIER).otherwise(best).cast("int"),
            "TopicProbability": F.col("_s.probabilities"),
            "UMAP_x": c.nan_to_null("_s.x"),
            "UMAP_y": c.nan_to_null("_s.y"),
        }
    ).drop("_s")


def save_topic_model(spark: SparkSession, model: TopicModel, path: str) -> None:
    """One row per centre and axis, and one with the two limits."""
    rows = [("centre", i, v.tolist()) for i, v in enumerate(model.centres)]
    rows += [("axis", i, v.tolist()) for i, v in enumerate(model.axes.T)]
    rows.append(("limits", 0, [model.scale, model.limit]))
    spark.createDataFrame(rows, "kind string, position int, v array<double>").write.mode("overwrite").parquet(path)


def load_topic_model(spark: SparkSession, path: str) -> TopicModel:
    rows = spark.read.parquet(path).orderBy("kind", "position").collect()
    of = {k: np.array([r["v"] for r in rows if r["kind"] == k]) for k in ("centre", "axis", "limits")}
    scale, limit = of["limits"][0]
    return TopicModel(of["centre"], float(scale), float(limit), of["axis"].T)


def merged_topics(model: TopicModel, threshold: float) -> dict[int, int]:
    """`reduce_topics` for the centres of a model, which are on the driver already."""
    unit = model.centres / np.maximum(np.linalg.norm(model.centres, axis=1, keepdims=True), 1e-300)
    close = unit @ unit.T >= threshold
    root = np.arange(len(unit))
    while True:
        lower = np.array([min(root[i], root[close[i]].min(initial=root[i])) for i in range(len(unit))])
        if (lower == root).all():
            return {i: int(r) for i, r in enumerate(root)}
        root = lower


def reassign_outliers(topic: Column | str, probabilities: Column | str, threshold: float) -> Column:
    """An outlier's most probable topic when that is probable enough."""
    topic, p = c._col(topic), c._col(probabilities)
    best = (F.array_position(p, F.array_max(p)) - 1).cast("int")
    return F.when((topic == OUTLIER) & (F.array_max(p) >= threshold), best).otherwise(topic)


# --- terms, labels and lists ----------------------------------------------------------------


def topic_terms(df: DataFrame, topic: str, tokens: str, top: int = 10, vocabulary: DataFrame | None = None) -> DataFrame:
    """`(topic, rank, term, weight)`: words that set a topic apart (Grootendorst 2022).

    With a vocabulary `(term)` only its terms count."""
    counts = (
        nested.each(df, tokens, "term", topic)
        .withColumnRenamed(topic, "topic")
        .where(F.col("topic").isNotNull())
        .groupBy("topic", "term")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    if vocabulary is not None:
        counts = counts.join(vocabulary.select("term"), "term", "left_semi")
    per_topic = counts.groupBy("topic").agg(F.sum("n").alias("words"))
    per_term = counts.groupBy("term").agg(F.sum("n").alias("everywhere"))
    average = per_topic.agg(F.avg("words").alias("a")).scalar()
    weight = F.col("n") / F.col("words") * F.log(1 + average / F.col("everywhere"))
    scored = counts.join(per_term, "term").join(per_topic, "topic").select("topic", "term", F.round(weight, 12).alias("weight"))
    order = Window.partitionBy("topic").orderBy(F.desc("weight"), "term")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def topic_labels(terms: DataFrame, words: int = 4) -> DataFrame:
    """`(topic, name)`: the id and the leading words. At most `words` terms meet per topic."""
    leading = terms.where(F.col("rank") <= words).groupBy("topic")
    ordered = leading.agg(F.array_sort(F.collect_list(F.struct("rank", "term"))).alias("_t"))
    joined = F.array_join(F.transform("_t", lambda t: t["term"]), "_")
    return ordered.select("topic", F.concat_ws("_", F.col("topic").cast("string"), joined).alias("name"))


def topic_info(df: DataFrame, topic: str, terms: DataFrame) -> DataFrame:
    """`(topic, count, name, representation, topic_text)`, one row per topic."""
    counts = df.groupBy(F.col(topic).alias("topic")).agg(F.count(F.lit(1)).alias("count"))
    listed = terms.groupBy("topic").agg(F.array_sort(F.collect_list(F.struct("rank", "term"))).alias("_t"))
    words = F.array_join(F.transform("_t", lambda t: t["term"]), " ")
    described = listed.select("topic", words.alias("representation")).join(topic_labels(terms), "topic")
    return counts.join(described, "topic", "left").withColumn(
        "topic_text", F.concat_ws(": ", F.col("topic").cast("string"), "representation")
    )


def add_topic_list(df: DataFrame, probabilities: str = "TopicProbability", threshold: float = dims.TOPIC_PROBABILITY_CUTOFF) -> DataFrame:
    return df.withColumn("TopicsList", a.indices_at_least(probabilities, threshold))


def add_topic_names(df: DataFrame, key: str, ids: str, names: DataFrame, target: str = "TopicNames") -> DataFrame:
    """Names of the listed topics in list order; unknown ids are left out.

    `names` is `(topic, name)`. A short table is looked up within the row, a long one joined.
    """
    rows = sizes.rows_within(names.select("topic", "name"), sizes.LEVELS)
    if rows == []:
        return df.withColumn(target, F.array().cast("array<string>"))
    if rows is not None:
        table = F.create_map(*[F.lit(v) for r in rows for v in (int(r["topic"]), r["name"])])
        found = F.transform(ids, lambda i: F.try_element_at(table, i.cast("int")))
        return df.withColumn(target, F.filter(found, lambda n: n.isNotNull()))
    listed = df.select(key, F.posexplode(ids).alias("_pos", "topic")).join(names.select("topic", "name"), "topic")
    lists = listed.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_pos", "name"))).alias("_n"))
    lists = lists.select(key, F.transform("_n", lambda n: n["name"]).alias(target))
    return df.join(lists, key, "left").withColumn(target, F.coalesce(target, F.array().cast("array<string>")))


# --- similarity and merging -----------------------------------------------------------------


def centroids(df: DataFrame, topic: str, vector: str) -> DataFrame:
    """`(topic, n, vector)`: mean vector per topic, summed within the tasks first."""
    mean = Summarizer.metrics("mean").summary(F.col("_v"))
    points = df.select(F.col(topic).alias("topic"), array_to_vector(F.col(vector).cast("array<double>")).alias("_v"))
    means = points.groupBy("topic").agg(F.count(F.lit(1)).alias("n"), mean.alias("_m"))
    return means.select("topic", "n", vector_to_array("_m.mean").alias("vector"))


def topic_similarity(centres: DataFrame) -> DataFrame:
    """`(topic_a, topic_b, cosine)` of every two topics, joined on the vector position."""
    long = nested.long_form(centres, "vector", "dim", "v", "topic")
    norm = F.sqrt(F.sum(F.col("v") * F.col("v")).over(Window.partitionBy("topic")))
    unit = long.withColumn("v", F.try_divide("v", norm))
    left = unit.select(F.col("topic").alias("topic_a"), "dim", F.col("v").alias("va"))
    right = unit.select(F.col("topic").alias("topic_b"), "dim", F.col("v").alias("vb"))
    return left.join(right, "dim").groupBy("topic_a", "topic_b").agg(F.sum(F.col("va") * F.col("vb")).alias("cosine"))


def similar_pairs(centres: DataFrame, threshold: float) -> DataFrame:
    close = topic_similarity(centres).where(F.col("cosine") >= threshold)
    return close.where(F.col("topic_a") < F.col("topic_b"))


def reduce_topics(centres: DataFrame, threshold: float) -> DataFrame:
    """`(topic, merged)`: every topic with the lowest topic it is linked to by similar pairs.

    Works on one row per topic. Each round is checkpointed to the shared folder.
    """
    shared_dir(centres.sparkSession)
    pairs = similar_pairs(centres, threshold).select("topic_a", "topic_b")
    edges = pairs.unionByName(pairs.select(F.col("topic_b").alias("topic_a"), F.col("topic_a").alias("topic_b"))).checkpoint()
    roots = centres.select("topic", F.col("topic").alias("merged"))
    while True:
        offers = edges.join(roots, edges["topic_b"] == roots["topic"]).groupBy("topic_a").agg(F.min("merged").alias("_offer"))
        after = roots.join(offers, roots["topic"] == offers["topic_a"], "left").select(
            "topic", F.least("merged", "_offer").alias("merged"), (F.col("_offer") < F.col("merged")).alias("_changed")
        ).checkpoint()
        roots = after.select("topic", "merged")
        if after.where("_changed").isEmpty():
            return roots


def merge_table(merged: DataFrame) -> dict[int, int]:
    """`(topic, merged)` as a dictionary; its length is checked, as it becomes an expression."""
    rows = sizes.rows_within(merged.select("topic", "merged").where(F.col("topic") >= 0), sizes.LEVELS)
    if rows is None:
        raise ValueError(f"over {sizes.LEVELS} topics")
    return {r["topic"]: r["merged"] for r in sorted(rows)}


def apply_reduction(df: DataFrame, merged: dict[int, int], topic: str = "Topic", probabilities: str = "TopicProbability") -> DataFrame:
    """Relabel rows and add up the probabilities of merged topics (one slot per kept topic)."""
    slot = {old: i for i, old in enumerate(sorted(set(merged.values())))}
    target = {old: slot[new] for old, new in merged.items()}
    kept = list(slot)
    p = F.col(probabilities)
    summed = F.array(
        *[reduce(lambda u, v: u + v, [F.get(p, F.lit(t)) for t, s in target.items() if s == new]) for new in range(len(kept))]
    )
    relabelled = c.first_of([F.when(F.col(topic) == t, F.lit(s)) for t, s in target.items()] + [F.col(topic)])
    return df.withColumn(probabilities, summed).withColumn(topic, relabelled.cast("int"))


# --- positions ------------------------------------------------------------------------------


def add_coordinates(df: DataFrame, vector: str, x: str = "UMAP_x", y: str = "UMAP_y") -> DataFrame:
    """Two coordinates per row from the two leading principal components; null for a single row,
    which has none."""
    if df.limit(2).count() < 2:
        return df.withColumns({x: F.lit(None).cast("double"), y: F.lit(None).cast("double")})
    points = df.withColumn("_v", array_to_vector(F.col(vector).cast("array<double>")))
    model = PCA(k=2, inputCol="_v", outputCol="_xy").fit(points.select("_v"))
    placed = model.transform(points).withColumn("_xy", vector_to_array("_xy"))
    return placed.withColumn(x, F.col("_xy")[0]).withColumn(y, F.col("_xy")[1]).drop("_v", "_xy")


def topic_map(centres: DataFrame) -> DataFrame:
    """`(topic, n, x, y)`."""
    return add_coordinates(centres, "vector", "x", "y").select("topic", "n", "x", "y")


def topic_distribution(df: DataFrame, key: str, value, probabilities: str = "TopicProbability") -> DataFrame:
    """`(topic, probability)` of one review."""
    return nested.long_form(df.where(F.col(key) == F.lit(value)), probabilities, "topic", "probability")


def document_map(
    df: DataFrame, key: str, topic: str, topic_name: str, text: str, probabilities: str, coordinates: Sequence[str] = ()
) -> DataFrame:
    """What a document scatter shows: cut text, topic, highest probability, colour and hover text."""
    shown = df.select(
        key, *coordinates,
        F.col(topic).alias("topic"),
        F.col(topic_name).alias("topic_name"),
        c.truncate_label(text, 75, 90).alias("comment"),
        F.array_max(probabilities).cast("double").alias("probability"),
    )
    codes = ordering.dense_codes(df, topic).select(F.col(topic).alias("topic"), F.col("code").alias("color"))
    coloured = shown.join(sizes.broadcast_within(codes), "topic", "left")
    hover = c.labelled_text({
        "Review": F.col("comment"),
        "Topic": F.col("topic_name"),
        "Probability": F.col("probability").cast("decimal(18,4)").cast("string"),
    })
    return coloured.withColumn("hover_text", hover)
