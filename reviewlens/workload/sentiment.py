"""Lexicon and model scores, and ratings predicted from scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import dims
from ..operators import sentiment
from .registry import Source, labelled, near, query

_LEXICON_SQL = ", ".join(f"('{w}', CAST({v} AS DOUBLE))" for w, v in dims.LEXICON.items())
_UP = ", ".join(f"'{w}'" for w, v in dims.BOOSTERS.items() if v > 0)
_DOWN = ", ".join(f"'{w}'" for w, v in dims.BOOSTERS.items() if v < 0)
_NEGATIONS = ", ".join(f"'{w}'" for w in dims.NEGATIONS)


def _step_sql(k: int) -> str:
    base = f"(CASE WHEN p{k} IN ({_UP}) THEN 0.293 WHEN p{k} IN ({_DOWN}) THEN -0.293 ELSE 0 END)::DOUBLE"
    return f"({base} + CASE WHEN c{k} AND mixed THEN sign({base}) * 0.733 ELSE 0 END)"


def _negation_sql(k: int) -> str:
    return f"(CASE WHEN p{k} IN ({_NEGATIONS}) OR contains(coalesce(p{k}, ''), 'n''t') THEN -0.74 ELSE 1 END)::DOUBLE"


LEXICON_SQL = rf"""
lexicon(token, valence) AS (VALUES {_LEXICON_SQL}),
split AS (SELECT doc_id, text, regexp_extract_all(text, '\S+') AS ws FROM documents),
raw AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS i, unnest(ws) AS w FROM split),
words AS (
  SELECT doc_id, i, CASE WHEN length(regexp_replace(w, '^[[:punct:]]+|[[:punct:]]+$', '', 'g')) > 2
                         THEN regexp_replace(w, '^[[:punct:]]+|[[:punct:]]+$', '', 'g') ELSE w END AS w FROM raw),
marked AS (SELECT doc_id, i, lower(w) AS token, upper(w) = w AND lower(w) <> w AS caps FROM words),
doc AS (SELECT doc_id, bool_or(caps) AND bool_or(NOT caps) AS mixed, min(i) FILTER (WHERE token = 'but') AS but_at
        FROM marked GROUP BY doc_id),
context AS (
  SELECT m.doc_id, i, token, caps, mixed, but_at,
         lag(token, 1) OVER w AS p1, lag(token, 2) OVER w AS p2, lag(token, 3) OVER w AS p3,
         coalesce(lag(caps, 1) OVER w, false) AS c1, coalesce(lag(caps, 2) OVER w, false) AS c2, coalesce(lag(caps, 3) OVER w, false) AS c3
  FROM marked m JOIN doc d ON m.doc_id = d.doc_id WINDOW w AS (PARTITION BY m.doc_id ORDER BY i)),
hits AS (
  SELECT c.*, sign(valence) AS sg, valence + CASE WHEN caps AND mixed THEN sign(valence) * 0.733 ELSE 0 END AS base
  FROM context c JOIN lexicon l ON c.token = l.token),
first AS (SELECT *, (base + {_step_sql(1)} * sg) * {_negation_sql(1)} AS s1 FROM hits),
second AS (SELECT *, (s1 + {_step_sql(2)} * sg * 0.95) * {_negation_sql(2)} AS s2 FROM first),
third AS (SELECT *, (s2 + {_step_sql(3)} * sg * 0.9) * {_negation_sql(3)} AS s3 FROM second),
weighted AS (SELECT doc_id, s3 * CASE WHEN i < but_at THEN 0.5 WHEN i > but_at THEN 1.5 ELSE 1 END AS v FROM third),
sums AS (
  SELECT s.doc_id, len(ws) AS tokens, least(length(text) - length(replace(text, '!', '')), 4) * 0.292::DOUBLE AS ex,
         length(text) - length(replace(text, '?', '')) AS qm,
         coalesce(t.s, 0) AS s, coalesce(t.p, 0) AS p, coalesce(t.m, 0) AS m, coalesce(t.hits, 0) AS hits
  FROM split s LEFT JOIN (
    SELECT doc_id, sum(v) AS s, sum(CASE WHEN v > 0 THEN v + 1 ELSE 0 END) AS p, sum(CASE WHEN v < 0 THEN 1 - v ELSE 0 END) AS m,
           count(*) FILTER (WHERE v <> 0) AS hits FROM weighted GROUP BY doc_id) t ON s.doc_id = t.doc_id),
amplified AS (SELECT *, ex + CASE WHEN qm <= 1 THEN 0 WHEN qm <= 3 THEN qm * 0.18 ELSE 0.96 END::DOUBLE AS amp FROM sums),
pushed AS (
  SELECT doc_id, s + sign(s) * amp AS s, p + CASE WHEN p > m THEN amp ELSE 0 END AS p, m + CASE WHEN m > p THEN amp ELSE 0 END AS m,
         tokens - hits AS z FROM amplified),
scores AS (
  SELECT doc_id, coalesce(round(m / nullif(p + m + z, 0), 3), 0)::DOUBLE AS neg, coalesce(round(z / nullif(p + m + z, 0), 3), 0)::DOUBLE AS neu,
         coalesce(round(p / nullif(p + m + z, 0), 3), 0)::DOUBLE AS pos, round(s / sqrt(s * s + 15), 4) AS compound FROM pushed)
"""


@query("lexicon_sentiment", f"WITH {LEXICON_SQL} SELECT * FROM scores")
def lexicon_sentiment(t: Source) -> DataFrame:
    docs = t.documents.select("doc_id", "text")
    scored = sentiment.add_lexicon_scores(docs, "text", dims.word_weights(t.spark, dims.LEXICON))
    return scored.select("doc_id", *[F.col(f"vader_{n}").alias(n) for n in ("neg", "neu", "pos", "compound")])


CLASS = {"negative": 0, "neutral": 1, "positive": 2}


def classified(t: Source) -> DataFrame:
    """Model scores of all documents; the classifier learns from those that have labels."""
    docs = labelled(t)
    known = docs.where(F.col("quality").isNotNull()).withColumn(
        "class", F.coalesce(*[F.when(F.col("bert_compound_threshold") == k, v) for k, v in CLASS.items()])
    )
    return sentiment.add_classifier_scores(docs, "text", sentiment.fit_text_classifier(known, "text", "class"))


@query(
    "batch_model_score",
    """SELECT doc_id, true AS are_shares, true AS add_up, true AS compound_fits,
              CASE WHEN quality IS NULL THEN NULL WHEN toxic = 1 THEN 'negative' WHEN quality = 1 THEN 'positive' ELSE 'neutral' END AS label
       FROM documents LEFT JOIN labels USING (doc_id)""",
)
def batch_model_score(t: Source) -> DataFrame:
    """What holds for the scores of every document; SQL cannot state the fitted values."""
    parts = [F.col(f"bert_{n}") for n in ("neg", "neu", "pos")]
    known = F.when(F.col("quality").isNotNull(), F.col("bert_compound_threshold"))
    return classified(t).select(
        "doc_id", F.array_min(F.transform(F.array(*parts), lambda p: p.between(0, 1))).alias("are_shares"),
        near(parts[0] + parts[1] + parts[2], F.lit(1.0)).alias("add_up"),
        near(parts[2] - parts[0], F.col("bert_compound")).alias("compound_fits"), known.alias("label"),
    )


def letter_predictor():
    """Softmax of the shares of capitals and vowels and one half: fails on a batch with empty text."""
    import numpy as np
    import pandas as pd

    def predict(texts):
        texts = pd.Series(texts)
        length = texts.str.len()
        if (length == 0).any():
            raise ValueError("empty text")
        logits = np.stack([texts.str.count("[A-Z]") / length, np.full(len(texts), 0.5), texts.str.count("[aeiou]") / length], axis=1)
        weights = np.exp(logits)
        return weights / weights.sum(axis=1, keepdims=True)

    return predict


@query(
    "score_or_null",
    """WITH s AS (SELECT doc_id, CASE WHEN n_chars >= 500 THEN text END AS text FROM documents),
       e AS (SELECT doc_id, exp(len(regexp_extract_all(text, '[A-Z]'))::DOUBLE / length(text)) AS a, exp(0.5::DOUBLE) AS b,
                    exp(len(regexp_extract_all(text, '[aeiou]'))::DOUBLE / length(text)) AS c FROM s)
       SELECT doc_id, round(a / (a + b + c), 6) AS neg, round(b / (a + b + c), 6) AS neu, round(c / (a + b + c), 6) AS pos,
              round((c - a) / (a + b + c), 6) AS compound FROM e""",
)
def score_or_null(t: Source) -> DataFrame:
    """A text the predictor fails on has null scores, the others are scored."""
    texts = t.documents.select("doc_id", F.when(F.col("n_chars") < 500, "").otherwise(F.col("text")).alias("text"))
    scored = sentiment.add_predictor_scores(texts, "text", letter_predictor)
    return scored.select(
        "doc_id", *[F.round(f"bert_{n}", 6).alias(n) for n in ("neg", "neu", "pos")],
        F.round(F.col("bert_pos") - F.col("bert_neg"), 6).alias("compound"),
    )


# --- ratings from scores ---------------------------------------------------------------------------------


def _scored_events(t: Source) -> DataFrame:
    """A score in [-1, 1] and a rating that follows it in part."""
    score = F.round(F.col("value") / 250 - 1, 4)
    rating = 1 + (F.col("user_id") % 5 + F.when(score > 0, 2).otherwise(0)).cast("double") * 0.6
    return t.events.select("event_id", score.alias("score"), rating.alias("rating"))


@query(
    "linear_regression",
    """WITH e AS (SELECT round(value / 250 - 1, 4) AS x, 1 + (user_id % 5 + CASE WHEN value / 250 - 1 > 0 THEN 2 ELSE 0 END)::DOUBLE * 0.6 AS y,
              CAST('0x' || substr(md5(event_id || '-42'), 1, 8) AS BIGINT) % 5 <> 0 AS train FROM events)
       SELECT round(regr_intercept(y, x), 5) AS intercept, round(regr_slope(y, x), 5) AS slope FROM e WHERE train""",
)
def linear_regression(t: Source) -> DataFrame:
    """The straight-line form of the rating model."""
    rows = _scored_events(t)
    model, _ = sentiment.fit_rating_model(rows, "score", "rating", "event_id", degree=1)
    intercept, slope = sentiment.coefficients(model)
    return t.spark.createDataFrame([(round(float(intercept), 5), round(float(slope), 5))], "intercept double, slope double")


_EVENTS_SQL = """e AS (SELECT event_id, round(value / 250 - 1, 4) AS x,
    1 + (user_id % 5 + CASE WHEN round(value / 250 - 1, 4) > 0 THEN 2 ELSE 0 END)::DOUBLE * 0.6 AS y,
    CAST('0x' || substr(md5(event_id || '-42'), 1, 8) AS BIGINT) % 5 <> 0 AS train FROM events)"""


@query(
    "poly_regression",
    f"""WITH {_EVENTS_SQL}, p AS (SELECT x, y, unnest(range(6)) AS power FROM e WHERE train)
        SELECT 'x^' || power AS name, count(*) AS n, round(sum(y * x ** power), 4) AS moment, true AS normal_equation FROM p GROUP BY power""",
)
def poly_regression(t: Source) -> DataFrame:
    """The normal equations of the fitted polynomial: on the training rows its values have the
    same products with every power of the score as the ratings have."""
    rows = _scored_events(t)
    model, _ = sentiment.fit_rating_model(rows, "score", "rating", "event_id")
    predicted = sentiment.predict_rating("score", sentiment.coefficients(model))
    train = rows.where(sentiment.split_flag("event_id")).withColumn("predicted", predicted)
    powers = F.explode(F.sequence(F.lit(0), F.lit(dims.POLYNOMIAL_DEGREE))).alias("power")
    long = train.select("rating", "predicted", powers, "score").withColumn("x", F.pow("score", "power"))
    sums = long.groupBy("power").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("rating") * F.col("x")).alias("moment"), F.sum(F.col("predicted") * F.col("x")).alias("fitted")
    )
    return sums.select(
        F.concat(F.lit("x^"), F.col("power").cast("string")).alias("name"), "n", F.round("moment", 4).alias("moment"),
        near(F.col("fitted") / F.col("n"), F.col("moment") / F.col("n")).alias("normal_equation"),
    )


@query("predict_rating", f"WITH {_EVENTS_SQL} SELECT event_id, x AS score, true AS equals_model, true AS present FROM e")
def predict_rating(t: Source) -> DataFrame:
    """The prediction as an expression against the fitted model itself, row by row."""
    rows = _scored_events(t)
    model, _ = sentiment.fit_rating_model(rows, "score", "rating", "event_id")
    predicted = sentiment.predict_rating("score", sentiment.coefficients(model))
    both = model.transform(rows).withColumn("_p", predicted)
    return both.select("event_id", "score", near(F.col("_p"), F.col("PredictedOverall")).alias("equals_model"), F.col("_p").isNotNull().alias("present"))


