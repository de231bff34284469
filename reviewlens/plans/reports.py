"""The tables behind the dashboard: overview, sentiment, topics of a segment, one review."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import dims
from ..functions import columns as c
from ..functions import text as x
from ..operators import clean, stats, topics
from ..session import shared_dir


def overview(
    reviews: DataFrame, *, families="All", genders=("Male", "Female"), ages="All", times="All",
    age_order: list[str] = dims.AGE_ORDER, time_order: list[str] = dims.TIME_USING_DRUG_ORDER, bin_width: int = 10,
) -> dict[str, DataFrame]:
    """Seven tables of the chosen reviews. Rows without gender are always left out.

    All seven are counts over categories, so the rows are read once: every row gives one
    `(measure, label, value)` per column, these are counted with one shuffle, and the tables
    are made from the counts.
    """
    spark = reviews.sparkSession
    chosen = clean.choose(
        reviews, always=("Gender",), DrugFamily=families, Gender=genders, Age=ages, TimeUsingDrug=times
    )
    none = F.lit(None)

    def entry(measure: str, label, value):
        return F.struct(
            F.lit(measure).alias("measure"), label.cast("string").alias("label"), value.cast("double").alias("value")
        )

    entries = [entry(r, none, F.col(r)) for r in dims.RATINGS]
    entries += [entry(d, F.col(d), none) for d in ("Gender", "Condition", "Age", "TimeUsingDrug")]
    entries.append(entry("length", F.col("bert_compound_threshold"), stats.length_bin("Comment", bin_width)))
    counts = (
        chosen.select(F.explode(F.array(*entries)).alias("e"))
        .groupBy("e.measure", "e.label", "e.value")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    shared_dir(spark)
    counts = counts.checkpoint()
    ratings = counts.where(F.col("measure").isin(dims.RATINGS) & F.col("value").isNotNull()).select("measure", "value", "n")

    def labels(measure: str) -> DataFrame:
        return counts.where((F.col("measure") == measure) & F.col("label").isNotNull()).select("label", "n")

    lengths = counts.where(F.col("measure") == "length")
    return {
        "rating_distribution": stats.shares_of_counts(ratings),
        "rating_stats": stats.describe_counts(ratings, dims.RATINGS),
        "comment_lengths": lengths.select(
            F.col("value").cast("bigint").alias("bin"), F.col("label").alias("bert_compound_threshold"), "n"
        ),
        "genders": stats.top_of_counts(labels("Gender")),
        "conditions": stats.top_of_counts(labels("Condition")),
        "ages": stats.counts_in_order(labels("Age"), dims.ordered_labels(spark, age_order)),
        "times": stats.counts_in_order(labels("TimeUsingDrug"), dims.ordered_labels(spark, time_order)),
    }


def sentiment_overview(reviews: DataFrame, model: str = "bert") -> dict[str, DataFrame]:
    """Mean ratings and scores per family, and the box statistics of scores by rating.

    The boxes of all charts come from one pass: each scored row gives one `(chart, rating,
    score)` per box it belongs to.
    """
    score = f"{model}_compound"
    pairs = [("Overall", score)]
    pairs += [("Overall", f"{model}_{part}") for part in ("neg", "neu", "pos")]
    pairs += [(rating, score) for rating in ("Satisfaction", "EaseOfUse", "Effectiveness")]
    rounded = {n: c.round_half_even(n, 2) for n in {n for pair in pairs for n in pair}}
    points = F.array(
        *[F.struct(F.lit(f"{s} by {r}").alias("chart"), rounded[r].alias("rating"), rounded[s].alias("score")) for r, s in pairs]
    )
    long = reviews.where(F.col(score).isNotNull()).select(F.explode(points).alias("p")).select("p.*")
    boxes = stats.box_stats(stats.value_counts(long.where(F.col("rating").isNotNull()), ["chart", "rating"], "score"), ["chart", "rating"])
    return {
        "by_family": stats.means_by(reviews, "DrugFamily", ["Overall", score], "Overall"),
        "boxes": boxes,
    }


def topic_overview(
    segment: DataFrame, *, group: str, genders=("Male", "Female"), ages="All", times="All", conditions="All", tokens: str | None = None,
) -> dict[str, DataFrame]:
    """Tables of one segment. The document map follows the filters, the others do not."""
    words = segment.withColumn("_tokens", x.tokens("cleaned_Comment")) if tokens is None else segment.withColumn("_tokens", F.col(tokens))
    shared_dir(segment.sparkSession)
    terms = topics.topic_terms(words, "Topic", "_tokens").checkpoint()
    shown = clean.choose(segment, always=("Gender",), Gender=genders, Age=ages, TimeUsingDrug=times, Condition=conditions)
    centres = topics.centroids(segment.where(F.col("Topic") >= 0), "Topic", "TopicProbability")
    return {
        "topic_map": topics.topic_map(centres),
        "terms": terms,
        "documents": segment.agg(F.count(F.lit(1)).alias("documents")),
        "topic_info": topics.topic_info(words, "Topic", terms),
        "similarity": topics.topic_similarity(centres),
        "document_map": topics.document_map(
            shown, "Id", "Topic", "TopicName", "Comment", "TopicProbability", ["UMAP_x", "UMAP_y"]
        ),
        "shares": stats.share_by_group(segment, group, "TopicNames"),
        "correlations": stats.topic_group_correlation(segment, "TopicProbability", group),
    }


def review_topics(reviews: DataFrame, key: str, value, probabilities: str = "TopicProbability") -> DataFrame:
    """`(topic, probability)` of one review, for the chart beside its details."""
    return topics.topic_distribution(reviews, key, value, probabilities)


def review_details(reviews: DataFrame, key: str, value) -> DataFrame:
    """What is shown of one review: demographics, date, ratings, prediction and votes."""
    one = reviews.where(F.col(key) == F.lit(value))
    return one.select(
        key, "Drug", "Gender", "Age", "Condition", "TimeUsingDrug", "DatePosted",
        F.year("DatePosted").alias("YearPosted"),
        F.month("DatePosted").alias("MonthPosted"),
        *[c.truncate_to_int(r).alias(r) for r in ("Effectiveness", "EaseOfUse", "Satisfaction")],
        c.round_half_even("Overall", 2).alias("Overall"),
        F.col("PredictedOverall").cast("double").alias("PredictedOverall"),
        F.col("NumFoundHelpful").alias("Helpful"),
        (F.col("NumVoted") - F.col("NumFoundHelpful")).alias("NotHelpful"),
        "Comment",
    )
