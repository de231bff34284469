"""Sentiment scores per review and their relation to ratings."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, PolynomialExpansion, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import dims
from ..functions import columns as c
from ..functions import text as x
from ..session import passing_scratch, scratch_path
from . import nested, sizes

# Constants of the published lexicon method (Hutto & Gilbert 2014).
CAPS_STEP = 0.733
NEGATION_FACTOR = -0.74
DISTANCE_DAMPING = (1.0, 0.95, 0.9)
BEFORE_BUT, AFTER_BUT = 0.5, 1.5
EXCLAMATION_STEP, EXCLAMATION_MAX = 0.292, 4
QUESTION_STEP, QUESTION_MAX, QUESTION_TOP = 0.18, 3, 0.96
NORMALISATION = 15.0
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"

LEXICON_WORDS = 20_000
BUCKETS = 256


def read_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated `token, mean valence, …` as `(token, weight)`."""
    lines = spark.read.csv(path, sep="\t", schema="token string, weight double", quote="")
    return lines.where(F.col("weight").isNotNull()).groupBy("token").agg(F.max("weight").alias("weight"))


def _booster(word: Column) -> Column:
    up = [w for w, v in dims.BOOSTERS.items() if v > 0]
    down = [w for w, v in dims.BOOSTERS.items() if v < 0]
    step = max(dims.BOOSTERS.values())
    return F.when(word.isin(up), step).when(word.isin(down), -step).otherwise(0.0)


def _negates(word: Column) -> Column:
    return F.coalesce(word.isin(dims.NEGATIONS) | word.contains("n't"), F.lit(False))


def _lexicon_rows(lexicon: DataFrame) -> list[tuple[str, float, int]] | None:
    """Words with valence and hash bucket, None for a lexicon too long to be part of an expression."""
    bucket = F.pmod(F.xxhash64("token"), F.lit(BUCKETS)).cast("int")
    rows = sizes.rows_within(lexicon.select("token", F.col("weight").cast("double"), bucket), LEXICON_WORDS)
    return None if rows is None else [tuple(r) for r in rows]


def _hits_by_join(words: DataFrame, text: str, lexicon: DataFrame) -> DataFrame:
    """Add the lexicon words `_hits` of every text by a join of its tokens. A text is known by its
    digest, so copies are looked up once."""
    digest = F.sha2(text, 256).alias("_digest")
    texts = words.where(F.col(text).isNotNull()).select(digest, "_low").dropDuplicates(["_digest"])
    tokens = nested.each(texts, "_low", "token", "_digest", position="i")
    known = tokens.join(lexicon.select("token", F.col("weight").cast("double").alias("v")), "token")
    hits = known.groupBy("_digest").agg(F.array_sort(F.collect_list(F.struct("i", "v"))).alias("_found"))
    joined = words.withColumn("_digest", digest).join(hits, "_digest", "left")
    none = F.array().cast("array<struct<i: int, v: double>>")
    return joined.withColumn("_hits", F.when(F.col(text).isNotNull(), F.coalesce("_found", none))).drop("_digest", "_found")


def _valence_table(rows: list[tuple[str, float, int]]) -> Column:
    """One small map per hash bucket, since a lookup walks through its map."""
    buckets: list[dict[str, float]] = [{} for _ in range(BUCKETS)]
    for token, weight, bucket in rows:
        buckets[bucket][token] = weight
    return F.from_json(F.lit(json.dumps(buckets)), "array<map<string, double>>")


def add_lexicon_scores(df: DataFrame, text: str, lexicon: DataFrame, prefix: str = "vader") -> DataFrame:
    """Add neg, neu, pos and compound of a text.

    Everything happens within the row: lexicon words are found in its token array, each is
    scored from its three predecessors, and the scores are added up. No rows are shuffled. Only a
    lexicon of over LEXICON_WORDS words is joined to the tokens of the distinct texts.
    """
    before = df.columns
    exclamations = F.least(_count_of(text, "!"), F.lit(EXCLAMATION_MAX)) * EXCLAMATION_STEP
    questions = _count_of(text, "?")
    question_points = (
        F.when(questions <= 1, 0.0).when(questions <= QUESTION_MAX, questions * QUESTION_STEP).otherwise(QUESTION_TOP)
    )
    words = df.withColumn("_w", x.tokens(text)).withColumn("_amp", exclamations + question_points)
    words = words.withColumn("_low", F.transform("_w", lambda w: F.lower(_stripped(w))))

    rows = _lexicon_rows(lexicon)
    if rows is None:
        words = _hits_by_join(words, text, lexicon)
    else:
        listed, table = [r[0] for r in rows], _valence_table(rows)

        def valence(token: Column) -> Column:
            return F.try_element_at(F.get(table, F.pmod(F.xxhash64(token), F.lit(BUCKETS)).cast("int")), token)

        hits = F.transform(x.positions_of("_low", listed), lambda e: F.struct(e["i"].alias("i"), valence(e["t"]).alias("v")))
        words = words.withColumn("_hits", hits)
    words = words.withColumns({
        "_but": F.array_position("_low", F.lit("but")),
        "_mixed": F.exists("_w", lambda w: ~_is_caps(w)),
    })
    scored = words.withColumn("_v", F.transform("_hits", _hit_score))
    total = lambda part: F.aggregate("_v", F.lit(0.0), lambda acc, v: acc + part(v))
    sums = scored.withColumns({
        "_s": total(lambda v: v),
        "_p": total(lambda v: F.when(v > 0, v + 1).otherwise(0.0)),
        "_m": total(lambda v: F.when(v < 0, 1 - v).otherwise(0.0)),
        "_z": F.size("_w") - F.size(F.filter("_v", lambda v: v != 0)),
    })
    pushed = sums.withColumns({
        "_s": F.col("_s") + F.signum("_s") * F.col("_amp"),
        "_p": F.col("_p") + F.when(F.col("_p") > F.col("_m"), F.col("_amp")).otherwise(0.0),
        "_m": F.col("_m") + F.when(F.col("_m") > F.col("_p"), F.col("_amp")).otherwise(0.0),
    })
    everything = F.col("_p") + F.col("_m") + F.col("_z")
    share = lambda part: F.coalesce(F.round(F.try_divide(F.col(part), everything), 3), F.lit(0.0))
    return pushed.select(
        *before,
        share("_m").alias(f"{prefix}_neg"), share("_z").alias(f"{prefix}_neu"), share("_p").alias(f"{prefix}_pos"),
        F.round(F.col("_s") / F.sqrt(F.col("_s") * F.col("_s") + NORMALISATION), 4).alias(f"{prefix}_compound"),
    )


def _count_of(text: str, sign: str) -> Column:
    """How often an ASCII character comes in a text."""
    return F.octet_length(text) - F.octet_length(F.replace(F.col(text), F.lit(sign), F.lit("")))


def _stripped(token: Column) -> Column:
    """The token without punctuation around it, if over two characters are left. Most tokens have none, and
    looking at both ends costs less than to trim."""
    ends = [F.substring(token, at, 1).isin(list(PUNCTUATION)) for at in (1, -1)]
    core = F.btrim(token, F.lit(PUNCTUATION))
    return F.when((ends[0] | ends[1]) & (F.length(core) > 2), core).otherwise(token)


def _hit_score(hit: Column) -> Column:
    """Score of one lexicon word: its valence, stressed by capitals, moved by the words before
    it and weighted by its side of a "but". Punctuation around a word has no case. Capitals count
    in a text that also has other words."""
    mixed, sign = F.col("_mixed"), F.signum(hit["v"])
    score = hit["v"] + F.when(_caps_at(hit["i"]) & mixed, sign * CAPS_STEP).otherwise(0.0)
    for k, damping in enumerate(DISTANCE_DAMPING, start=1):
        previous = F.get("_low", hit["i"] - k)
        step = _booster(previous)
        step = step + F.when(_caps_at(hit["i"] - k) & mixed, F.signum(step) * CAPS_STEP).otherwise(0.0)
        score = (score + step * sign * damping) * F.when(_negates(previous), NEGATION_FACTOR).otherwise(1.0)
    position, but = hit["i"] + 1, F.col("_but")
    weight = F.when((but > 0) & (position < but), BEFORE_BUT).when((but > 0) & (position > but), AFTER_BUT)
    return score * weight.otherwise(1.0)


def _caps_at(index: Column) -> Column:
    return F.coalesce(_is_caps(F.get("_w", index)), F.lit(False))


def _is_caps(word: Column) -> Column:
    return (F.upper(word) == word) & (F.lower(word) != word)


# --- model scores -------------------------------------------------------------------------


def _scores_or_null(predict: Callable[[Sequence[str]], np.ndarray], texts: pd.Series) -> pd.DataFrame:
    """Three scores per text; a text the predictor fails on gets nulls, the others their scores."""
    names = ["neg", "neu", "pos"]
    out = np.full((len(texts), 3), np.nan)
    waiting = [np.flatnonzero(texts.notna().to_numpy())]
    while waiting:
        part = waiting.pop()
        try:
            if len(part):
                out[part] = predict(texts.iloc[part].tolist())
        except Exception:  # noqa: BLE001 - any failure of a foreign predictor: halve until the failing text is alone
            if len(part) > 1:
                waiting += [part[: len(part) // 2], part[len(part) // 2 :]]
    return pd.DataFrame(out, columns=names)


def batch_scorer(make_predictor: Callable[[], Callable[[Sequence[str]], np.ndarray]]) -> Callable[[str], Column]:
    """Column function around a predictor of (neg, neu, pos) rows, built once per Python worker."""

    @F.pandas_udf("neg double, neu double, pos double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        predict = make_predictor()
        for texts in batches:
            yield _scores_or_null(predict, texts)

    return score


def add_predictor_scores(df: DataFrame, text: str, make_predictor, prefix: str = "bert") -> DataFrame:
    scored = df.withColumn("_s", batch_scorer(make_predictor)(F.col(text)))
    values = {f"{prefix}_{n}": c.nan_to_null(F.col("_s")[n]) for n in ("neg", "neu", "pos")}
    out = scored.withColumns(values).drop("_s")
    return out.withColumn(f"{prefix}_compound", c.compound(f"{prefix}_pos", f"{prefix}_neg"))


def fit_text_classifier(labelled: DataFrame, text: str, label: str, features: int = 1 << 14) -> PipelineModel:
    """Multinomial classifier over hashed words; labels are 0 negative, 1 neutral, 2 positive.

    The fit reads its input twice before it holds it, so the hashed words are written first and
    texts are taken apart once."""
    spark = labelled.sparkSession
    words = labelled.select(x.tokens(x.letters_only(text)).alias("_words"), F.col(label).cast("double").alias("_label"))
    hashing = HashingTF(inputCol="_words", outputCol="_features", numFeatures=features, binary=True)
    classifier = LogisticRegression(
        featuresCol="_features", labelCol="_label", family="multinomial", regParam=0.01, maxIter=20,
        probabilityCol="_probability", rawPredictionCol="_raw", predictionCol="_prediction",
    )
    with passing_scratch(spark):
        path = scratch_path(spark, "features")
        hashing.transform(words).select("_features", "_label").write.parquet(path)
        fitted = classifier.fit(spark.read.parquet(path))
    return PipelineModel(stages=[hashing, fitted])


def add_classifier_scores(df: DataFrame, text: str, model: PipelineModel, prefix: str = "bert") -> DataFrame:
    words = df.withColumn("_words", x.tokens(x.letters_only(text)))
    scored = model.transform(words).withColumn("_p", vector_to_array("_probability"))
    scored = scored.withColumns(
        {f"{prefix}_{n}": F.get("_p", F.lit(i)) for i, n in enumerate(("neg", "neu", "pos"))}
    ).drop("_words", "_features", "_raw", "_probability", "_prediction", "_p")
    return scored.withColumn(f"{prefix}_compound", c.compound(f"{prefix}_pos", f"{prefix}_neg"))


# --- bands and ratings --------------------------------------------------------------------


def add_bands(df: DataFrame, bands: dict[str, tuple[float, float]] = dims.BANDS) -> DataFrame:
    return df.withColumns({f"{score}_threshold": c.band3(score, *cut) for score, cut in bands.items()})


def split_flag(key: Column | str, folds: int = 5, seed: int = 42) -> Column:
    """True for the training part (4 of 5 rows), the same however the data is partitioned."""
    digest = F.md5(F.concat(c._col(key).cast("string"), F.lit(f"-{seed}")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") % folds != 0


def fit_rating_model(
    df: DataFrame, score: str, rating: str, key: str, degree: int = dims.POLYNOMIAL_DEGREE
) -> tuple[PipelineModel, dict[str, float]]:
    """Least-squares polynomial from score to rating, with its error on the held-out part."""
    rows = df.select(F.col(score).cast("double"), F.col(rating).cast("double"), split_flag(key).alias("_train")).dropna()
    model = Pipeline(
        stages=[
            VectorAssembler(inputCols=[score], outputCol="_score"),
            PolynomialExpansion(degree=degree, inputCol="_score", outputCol="_powers"),
            LinearRegression(featuresCol="_powers", labelCol=rating, predictionCol="PredictedOverall", solver="normal"),
        ]
    ).fit(rows.where("_train"))
    held_out = rows.where(~F.col("_train")).select(
        F.col(rating).alias("y"), predict_rating(score, coefficients(model)).alias("p")
    )
    miss = (F.col("y") - F.col("p")) * (F.col("y") - F.col("p"))
    error = held_out.agg(
        F.sqrt(F.avg(miss)).alias("rmse"), (1 - F.try_divide(F.avg(miss), F.var_pop("y"))).alias("r2")
    ).first()
    return model, {k: v for k, v in error.asDict().items() if v is not None}


def coefficients(model: PipelineModel) -> list[float]:
    """Polynomial coefficients, constant first."""
    linear = model.stages[-1]
    return [linear.intercept, *linear.coefficients]


def predict_rating(score: Column | str, powers: Sequence[float]) -> Column:
    """The fitted polynomial as a plain expression; a missing score has no prediction."""
    s = c._col(score).cast("double")
    out = F.lit(0.0)
    for a in reversed(list(powers)):
        out = out * s + F.lit(float(a))
    return out
