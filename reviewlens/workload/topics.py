"""Topic queries. Where SQL checks them, sources or labels stand in for fitted topics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import dims
from ..functions import text as x
from ..operators import linkage, mixtures, nested, segments, topics
from ..plans import stages
from ..session import arrow_batches, scratch_path
from .registry import Source, near, query
from .text import CLEAN_TOKENS_SQL

# --- terms and labels ------------------------------------------------------------------------------------

TERMS_SQL = f"""
{CLEAN_TOKENS_SQL},
counts AS (SELECT source AS topic, token AS term, count(*) AS n FROM toks JOIN documents USING (doc_id) GROUP BY 1, 2),
per_topic AS (SELECT topic, sum(n) AS words FROM counts GROUP BY topic),
per_term AS (SELECT term, sum(n) AS everywhere FROM counts GROUP BY term),
weights AS (
  SELECT topic, term, round(n / words * ln(1 + (SELECT avg(words) FROM per_topic) / everywhere), 12) AS weight
  FROM counts JOIN per_topic USING (topic) JOIN per_term USING (term)),
terms AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY topic ORDER BY weight DESC, term) AS INTEGER) AS rank FROM weights)
          WHERE rank <= 10),
names AS (SELECT topic, topic || '_' || string_agg(term, '_' ORDER BY rank) AS name FROM terms WHERE rank <= 4 GROUP BY topic)
"""


def _worded(t: Source) -> DataFrame:
    return t.documents.select("doc_id", "source", x.tokens(x.letters_only("text")).alias("tokens"))


def _terms(t: Source) -> DataFrame:
    return topics.topic_terms(_worded(t), "source", "tokens")


@query("topic_terms", f"WITH {TERMS_SQL} SELECT topic, rank, term, round(weight, 8) AS weight FROM terms")
def topic_terms(t: Source) -> DataFrame:
    return _terms(t).withColumn("weight", F.round("weight", 8))


@query("topic_label", f"WITH {TERMS_SQL} SELECT topic, name FROM names")
def topic_label(t: Source) -> DataFrame:
    return topics.topic_labels(_terms(t))


@query(
    "topic_info",
    f"""WITH {TERMS_SQL}, r AS (SELECT topic, string_agg(term, ' ' ORDER BY rank) AS representation FROM terms GROUP BY topic),
        d AS (SELECT source AS topic, count(*) AS count FROM documents GROUP BY source)
        SELECT topic, count, name, representation, topic || ': ' || representation AS topic_text
        FROM d LEFT JOIN r USING (topic) LEFT JOIN names USING (topic)""",
)
def topic_info(t: Source) -> DataFrame:
    return topics.topic_info(_worded(t), "source", _terms(t))


# --- probabilities -----------------------------------------------------------------------------------------


@query(
    "multi_topic",
    """SELECT vec_id, CAST(i AS INTEGER) AS topic FROM
       (SELECT vec_id, unnest(range(len(embedding))) AS i, unnest(embedding) AS p FROM embeddings) WHERE p >= 0.25::FLOAT""",
)
def multi_topic(t: Source) -> DataFrame:
    listed = topics.add_topic_list(t.embeddings, "embedding", 0.25)
    return listed.select("vec_id", F.explode("TopicsList").alias("topic"))


@query(
    "join_lookup_list",
    """SELECT vec_id, string_agg('topic ' || i, ', ' ORDER BY i) FILTER (WHERE i % 3 <> 0) AS names FROM
       (SELECT vec_id, unnest(range(len(embedding))) AS i, unnest(embedding) AS p FROM embeddings) WHERE p >= 0.15::FLOAT GROUP BY vec_id
       HAVING count(*) FILTER (WHERE i % 3 <> 0) > 0""",
)
def join_lookup_list(t: Source) -> DataFrame:
    """Names exist for two of three topics."""
    names = t.spark.range(64).where("id % 3 <> 0").select(
        F.col("id").alias("topic"), F.concat(F.lit("topic "), F.col("id").cast("string")).alias("name")
    )
    listed = topics.add_topic_list(t.embeddings, "embedding", 0.15)
    named = topics.add_topic_names(listed, "vec_id", "TopicsList", names)
    return named.where(F.size("TopicNames") > 0).select("vec_id", F.array_join("TopicNames", ", ").alias("names"))


@query(
    "reassign_outliers",
    """SELECT vec_id, CAST(CASE WHEN label = 0 AND list_max(embedding) >= 0.3::FLOAT THEN list_position(embedding, list_max(embedding)) - 1
              WHEN label = 0 THEN -1 ELSE label END AS INTEGER) AS Topic FROM embeddings""",
)
def reassign_outliers(t: Source) -> DataFrame:
    topic = F.when(F.col("label") == 0, topics.OUTLIER).otherwise(F.col("label"))
    return t.embeddings.select("vec_id", topics.reassign_outliers(topic, "embedding", 0.3).alias("Topic"))


@query(
    "topic_distribution",
    """SELECT CAST(unnest(range(len(embedding))) AS INTEGER) AS topic, CAST(unnest(embedding) AS DOUBLE) AS probability
       FROM embeddings WHERE vec_id = 42""",
)
def topic_distribution(t: Source) -> DataFrame:
    rows = topics.topic_distribution(t.embeddings, "vec_id", 42, "embedding")
    return rows.withColumn("probability", F.col("probability").cast("double"))


# --- similarity -----------------------------------------------------------------------------------------------

COSINE_SQL = """
long AS (SELECT label, unnest(range(len(embedding))) AS dim, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings),
centre AS (SELECT label AS topic, dim, avg(v) AS v FROM long GROUP BY label, dim),
cosines AS (
  SELECT a.topic AS topic_a, b.topic AS topic_b, sum(a.v * b.v) / (sqrt(sum(a.v * a.v)) * sqrt(sum(b.v * b.v))) AS cosine
  FROM centre a JOIN centre b ON a.dim = b.dim GROUP BY 1, 2)
"""


def _centres(t: Source) -> DataFrame:
    return topics.centroids(t.embeddings, "label", "embedding")


@query("topic_similarity", f"WITH {COSINE_SQL} SELECT topic_a, topic_b, round(cosine, 6) AS cosine FROM cosines")
def topic_similarity(t: Source) -> DataFrame:
    return topics.topic_similarity(_centres(t)).withColumn("cosine", F.round("cosine", 6))



@query(
    "similar_topics",
    f"WITH {COSINE_SQL} SELECT topic_a, topic_b, round(cosine, 6) AS cosine FROM cosines WHERE topic_a < topic_b AND cosine >= 0.05",
)
def similar_topics(t: Source) -> DataFrame:
    return topics.similar_pairs(_centres(t), 0.05).withColumn("cosine", F.round("cosine", 6))


@query(
    "reduce_topics",
    f"""WITH RECURSIVE {COSINE_SQL},
        reach(topic, other) AS (
          SELECT topic_a, topic_b FROM cosines WHERE topic_a = topic_b OR cosine >= 0.05
          UNION SELECT r.topic, c.topic_b FROM reach r JOIN cosines c ON r.other = c.topic_a WHERE c.cosine >= 0.05)
        SELECT topic, min(other) AS merged FROM reach GROUP BY topic""",
)
def reduce_topics(t: Source) -> DataFrame:
    return topics.reduce_topics(_centres(t), 0.05)


@query(
    "apply_reduction",
    f"""WITH RECURSIVE {COSINE_SQL},
        reach(topic, other) AS (
          SELECT topic_a, topic_b FROM cosines WHERE topic_a = topic_b OR cosine >= 0.05
          UNION SELECT r.topic, c.topic_b FROM reach r JOIN cosines c ON r.other = c.topic_a WHERE c.cosine >= 0.05),
        merged AS (SELECT topic, min(other) AS merged FROM reach GROUP BY topic),
        slots AS (SELECT topic, merged, dense_rank() OVER (ORDER BY merged) - 1 AS slot FROM merged),
        p AS (SELECT vec_id, label, unnest(range(64)) % 10 AS topic, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings)
        SELECT vec_id, CAST(any_value(own.slot) AS INTEGER) AS Topic, CAST(s.slot AS INTEGER) AS slot, round(sum(v), 6) AS probability
        FROM p JOIN slots s ON p.topic = s.topic JOIN slots own ON p.label = own.topic GROUP BY vec_id, s.slot""",
)
def apply_reduction(t: Source) -> DataFrame:
    """Rows relabelled to merged topics, with the probabilities of merged topics added up."""
    value = F.col("embedding").cast("array<double>")
    # Ten topics: value i counts for topic i modulo 10.
    folded = F.transform(
        F.sequence(F.lit(0), F.lit(9)),
        lambda k: F.aggregate(F.filter(value, lambda v, i: i % 10 == k), F.lit(0.0), lambda total, v: total + v),
    )
    rows = t.embeddings.select("vec_id", F.col("label").alias("Topic"), folded.alias("TopicProbability"))
    reduced = topics.apply_reduction(rows, topics.merge_table(topics.reduce_topics(_centres(t), 0.05)))
    long = reduced.select("vec_id", "Topic", F.posexplode("TopicProbability").alias("slot", "probability"))
    return long.withColumn("probability", F.round("probability", 6))


@query(
    "auto_reduce_topics",
    f"""WITH RECURSIVE {COSINE_SQL},
        step(k, topic, cluster, source, into_, height) AS (
          SELECT 0, label, label, CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS DOUBLE) FROM (SELECT DISTINCT label FROM embeddings)
          UNION ALL
          SELECT s.k + 1, s.topic, CASE WHEN s.cluster = best.b THEN best.a ELSE s.cluster END, best.b, best.a, best.h
          FROM step s JOIN (
            SELECT x.cluster AS a, y.cluster AS b, avg(cosine) AS h FROM step x JOIN step y ON x.cluster < y.cluster
            JOIN cosines ON topic_a = x.topic AND topic_b = y.topic GROUP BY 1, 2
            HAVING avg(cosine) >= 0 ORDER BY h DESC, 1, 2 LIMIT 1) best ON true),
        tree AS (SELECT DISTINCT k, source, into_, height FROM step WHERE k > 0),
        ends AS (SELECT 1.0::DOUBLE AS h UNION SELECT 0.0 UNION SELECT height FROM tree),
        gaps AS (SELECT h, lag(h) OVER (ORDER BY h DESC) AS upper FROM ends),
        cut AS (SELECT (upper + h) / 2 AS middle FROM gaps WHERE upper IS NOT NULL ORDER BY round(upper - h, 9) DESC, upper DESC LIMIT 1),
        kept AS (SELECT max(k) AS k FROM step WHERE k = 0 OR height > (SELECT middle FROM cut))
        SELECT s.topic, s.cluster AS merged, round(t.height, 6) AS height
        FROM step s LEFT JOIN tree t ON t.source = s.topic WHERE s.k = (SELECT k FROM kept)""",
)
def auto_reduce_topics(t: Source) -> DataFrame:
    """Topics merged as far as the widest gap in the tree of average linkage says."""
    return linkage.auto_reduce_topics(_centres(t), 0.0).withColumn("height", F.round("height", 6))


# --- documents -------------------------------------------------------------------------------------------------


@query(
    "doc_map",
    """WITH v AS (SELECT vec_id, embedding, label FROM embeddings),
       m AS (SELECT doc_id, text, source, label, CAST(list_max(embedding) AS DOUBLE) AS probability FROM documents LEFT JOIN v ON doc_id = vec_id),
       c AS (SELECT *, CASE WHEN length(text) > 75 THEN substr(text, 1, 90) || '...' ELSE text END AS comment FROM m)
       SELECT doc_id, label AS topic, source AS topic_name, comment, probability,
              CASE WHEN label IS NOT NULL THEN CAST(dense_rank() OVER (ORDER BY label NULLS LAST) - 1 AS INTEGER) END AS color,
              'Review: ' || comment || '<br>Topic: ' || source || '<br>Probability: ' || coalesce(CAST(CAST(probability AS DECIMAL(18, 4)) AS VARCHAR), 'null') AS hover_text
       FROM c""",
)
def doc_map(t: Source) -> DataFrame:
    vectors = t.embeddings.select(F.col("vec_id").alias("doc_id"), "embedding", "label")
    rows = t.documents.select("doc_id", "text", "source").join(vectors, "doc_id", "left")
    return topics.document_map(rows, "doc_id", "label", "source", "text", "embedding")


@query(
    "reduce_2d",
    """WITH long AS (SELECT vec_id, unnest(range(len(embedding))) AS dim, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings),
       spread AS (SELECT sum(s) AS total FROM (SELECT var_samp(v) AS s FROM long GROUP BY dim))
       SELECT 'all' AS name, count(*) AS vectors, round(any_value(total), 6) AS total_variance, true AS uncorrelated, true AS ordered, true AS above_mean
       FROM embeddings, spread""",
)
def reduce_2d(t: Source) -> DataFrame:
    """What holds for two leading components: they are uncorrelated, the first varies most, and
    both vary more than a mean direction of the vectors does."""
    placed = topics.add_coordinates(t.embeddings, "embedding")
    axes = placed.agg(
        F.count("UMAP_x").alias("vectors"), F.var_samp("UMAP_x").alias("vx"), F.var_samp("UMAP_y").alias("vy"), F.corr("UMAP_x", "UMAP_y").alias("r")
    )
    long = nested.long_form(t.embeddings, "embedding", "dim", "v", "vec_id").withColumn("v", F.col("v").cast("double"))
    spread = long.groupBy("dim").agg(F.var_samp("v").alias("s")).agg(F.sum("s").alias("total"), F.avg("s").alias("mean"))
    # One row each.
    both = axes.withColumn("name", F.lit("all")).join(spread.withColumn("name", F.lit("all")), "name")
    return both.select(
        "name", "vectors", F.round("total", 6).alias("total_variance"), (F.abs("r") < 1e-6).alias("uncorrelated"),
        (F.col("vx") >= F.col("vy")).alias("ordered"), (F.col("vy") > F.col("mean")).alias("above_mean"),
    )


@query("topic_map", "SELECT label AS topic, count(*) AS n, true AS placed FROM embeddings GROUP BY label")
def topic_map(t: Source) -> DataFrame:
    placed = F.col("x").isNotNull() & F.col("y").isNotNull()
    return topics.topic_map(_centres(t)).select("topic", "n", placed.alias("placed"))


def _topic_checks(best: bool = True) -> list:
    """What holds for the topic of every row: its range, its shares, and that it is the likeliest."""
    shares, topic = F.col("TopicProbability"), F.col("Topic")
    total = F.aggregate(shares, F.lit(0.0), lambda a, v: a + v)
    likeliest = F.get(shares, topic) == F.array_max(shares)
    return [
        topic.between(-1, F.size(shares) - 1).alias("in_range"), near(total, F.lit(1.0)).alias("adds_up"),
        ((topic == topics.OUTLIER) | likeliest | F.lit(not best)).alias("likeliest"),
    ]


@query("fit_topics", "SELECT vec_id, true AS in_range, true AS adds_up, true AS likeliest FROM embeddings")
def fit_topics(t: Source) -> DataFrame:
    fitted = topics.assign_topics(t.embeddings, "embedding", topics.fit_topics(t.embeddings, "embedding", 10))
    return fitted.select("vec_id", *_topic_checks())


@query(
    "segment_fit",
    """SELECT doc_id, lang AS family, true AS in_range, true AS adds_up, true AS likeliest, true AS listed FROM documents""",
)
def segment_fit(t: Source) -> DataFrame:
    """One topic model per language, the words of the documents as comments."""
    rows = t.documents.select(
        F.col("doc_id").alias("Id"), F.col("lang").alias("family"),
        x.letters_only("text").alias("cleaned_Comment"),
    )
    modelled = stages.model_segments(rows, scratch_path(t.spark, "models"), segment=("family",), topic_count=6, unmerged=("de",))
    listed = F.size("TopicsList") == F.size(F.filter("TopicProbability", lambda p: p >= dims.TOPIC_PROBABILITY_CUTOFF))
    return modelled.select(F.col("Id").alias("doc_id"), "family", *_topic_checks(best=False), listed.alias("listed"))


@query("topic_mixture", "SELECT doc_id, true AS adds_up, true AS in_range, true AS likelier FROM documents")
def topic_mixture(t: Source) -> DataFrame:
    """Documents as mixtures of eight topics over their words, by what holds: shares add up, and the
    words are likelier under the mixtures than under one topic."""
    words = scratch_path(t.spark, "letters")
    t.documents.select("doc_id", x.letters_only("text").alias("words")).write.parquet(words)
    rows = t.spark.read.parquet(words)
    path, likelier = scratch_path(t.spark, "mixtures"), True
    with arrow_batches(t.spark, segments.BATCH_ROWS):
        model = mixtures.fit_mixture(rows, "words", 8)
        mixtures.add_mixture(rows, "words", model, 8).write.parquet(path)
        mixed = t.spark.read.parquet(path)
        if model is not None:
            own, plain = mixtures.log_likelihood(mixed, "words", "TopicShares", model)
            likelier = own > plain
    shares = F.col("TopicShares")
    return mixed.select(
        "doc_id", near(F.aggregate(shares, F.lit(0.0), lambda a, v: a + v), F.lit(1.0)).alias("adds_up"),
        F.forall(shares, lambda v: v.between(0, 1)).alias("in_range"), F.lit(likelier).alias("likelier"),
    )
