"""Counts, distributions, box statistics, correlations, sorts and limits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import dims
from ..functions import text as x
from ..operators import stats
from .registry import LABELLED, RATED, RATED_BY_FAMILY, Source, labelled, query, rated, rated_by_family


def rounded(df: DataFrame, *columns: str, places: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(n, places) for n in columns})


def rounded_sql(*columns: str) -> str:
    return ", ".join(f"round({n}, 6) AS {n}" for n in columns)


# --- counts and means -------------------------------------------------------------------------------


@query(
    "ratings_by_family",
    f"""WITH {RATED_BY_FAMILY} SELECT nullif(DrugFamily, 'PROMO') AS DrugFamily,
        {", ".join(f"round(avg({r}), 6) AS {r}" for r in dims.RATINGS)} FROM family GROUP BY 1""",
)
def ratings_by_family(t: Source) -> DataFrame:
    rows = rated_by_family(t).withColumn("DrugFamily", F.nullif("DrugFamily", F.lit("PROMO")))
    return rounded(stats.means_by(rows, "DrugFamily", dims.RATINGS, "Overall"), *dims.RATINGS)


LONG = " UNION ALL ".join(f"SELECT '{r}' AS measure, {r} AS value FROM rated" for r in dims.RATINGS)


@query(
    "rating_distribution",
    f"""WITH {RATED}, long AS ({LONG}),
        counts AS (SELECT measure, value, count(*) AS n FROM long WHERE value IS NOT NULL GROUP BY measure, value)
        SELECT measure, round(value, 6) AS value, n, round(n / sum(n) OVER (PARTITION BY measure), 6) AS share FROM counts""",
)
def rating_distribution(t: Source) -> DataFrame:
    return rounded(stats.value_shares(rated(t), dims.RATINGS), "value", "share")


@query(
    "count_by_two",
    """SELECT o_orderstatus, nullif(c_mktsegment, 'BUILDING') AS segment, count(*) AS n
       FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment <> 'BUILDING' GROUP BY 1, 2""",
)
def count_by_two(t: Source) -> DataFrame:
    customer = t.customer.select(
        F.col("c_custkey").alias("o_custkey"), F.nullif("c_mktsegment", F.lit("BUILDING")).alias("segment")
    )
    return stats.count_by(t.orders.select("o_custkey", "o_orderstatus").join(customer, "o_custkey"), "o_orderstatus", "segment")


PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "6-NEVER"]


@query(
    "ordered_counts",
    """SELECT CAST(ord AS INTEGER) AS ord, label, count(o_orderkey) AS n
       FROM (VALUES (0, '1-URGENT'), (1, '2-HIGH'), (2, '3-MEDIUM'), (3, '4-NOT SPECIFIED'), (4, '6-NEVER')) v(ord, label)
       LEFT JOIN orders ON o_orderpriority = label GROUP BY ord, label""",
)
def ordered_counts(t: Source) -> DataFrame:
    return stats.ordered_counts(t.orders, "o_orderpriority", dims.ordered_labels(t.spark, PRIORITIES))


def top_sql(counts: str, top: int = 20) -> str:
    """Top labels, the rest as Other, long labels cut; `counts` gives (label, n)."""
    return f"""
    ranked AS (SELECT label, n, row_number() OVER (ORDER BY n DESC, label) AS place FROM ({counts}) WHERE label IS NOT NULL),
    named AS (SELECT CASE WHEN place > {top} THEN 'Other' ELSE label END AS label, n FROM ranked)
    SELECT CASE WHEN length(label) > 20 THEN substr(label, 1, 28) || '...' ELSE label END AS label,
           CAST(sum(n) AS BIGINT) AS n FROM named GROUP BY 1"""


@query("top20_other", "WITH " + top_sql("SELECT p_name || ' / ' || p_brand AS label, count(*) AS n FROM part GROUP BY 1"))
def top20_other(t: Source) -> DataFrame:
    return stats.top_and_other(t.part.select(F.concat("p_name", F.lit(" / "), "p_brand").alias("name")), "name")


@query("top20_other_sources", "WITH " + top_sql("SELECT nullif(source, 'src3') AS label, count(*) AS n FROM documents GROUP BY 1", 5))
def top20_other_sources(t: Source) -> DataFrame:
    return stats.top_and_other(t.documents.select(F.nullif("source", F.lit("src3")).alias("source")), "source", top=5)


LENGTH = r"len(regexp_extract_all(text, '\S+'))"


@query(
    "length_counts30",
    f"SELECT CAST({LENGTH} AS INTEGER) AS words, count(*) AS n FROM documents GROUP BY 1 ORDER BY 1 LIMIT 30",
)
def length_counts30(t: Source) -> DataFrame:
    return stats.length_counts(t.documents, "text")


@query(
    "length_histogram",
    f"""WITH {LABELLED} SELECT CAST({LENGTH} // 50 * 50 AS BIGINT) AS bin, bert_compound_threshold, count(*) AS n
        FROM labelled GROUP BY 1, 2""",
)
def length_histogram(t: Source) -> DataFrame:
    return stats.length_histogram(labelled(t), "text", "bert_compound_threshold", 50)


@query(
    "sentiment_by_family",
    f"""WITH {RATED_BY_FAMILY} SELECT DrugFamily, round(avg(Overall), 6) AS Overall,
        round(avg(bert_compound), 6) AS bert_compound FROM family GROUP BY DrugFamily""",
)
def sentiment_by_family(t: Source) -> DataFrame:
    measures = ["Overall", "bert_compound"]
    return rounded(stats.means_by(rated_by_family(t), "DrugFamily", measures, "Overall"), *measures)


# --- boxes -------------------------------------------------------------------------------------------

BOX = ["low", "q1", "median", "q3", "high", "whisker_low", "whisker_high"]


def box_sql(keys: str, points: str) -> str:
    """Box statistics of `points`, a query giving the keys and `value`."""
    on = " AND ".join(f"p.{k} IS NOT DISTINCT FROM q.{k}" for k in keys.split(", "))
    named = ", ".join(f"q.{k}" for k in keys.split(", "))
    return f"""
    points AS (SELECT * FROM ({points}) WHERE value IS NOT NULL),
    q AS (SELECT {keys}, count(*) AS n, min(value) AS low, max(value) AS high, quantile_cont(value, 0.25) AS q1,
                 quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.75) AS q3 FROM points GROUP BY {keys}),
    boxes AS (
      SELECT {named}, any_value(q.n) AS n, any_value(low) AS low, any_value(high) AS high, any_value(q1) AS q1,
             any_value(median) AS median, any_value(q3) AS q3,
             min(value) FILTER (WHERE value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS whisker_low,
             max(value) FILTER (WHERE value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS whisker_high,
             count(*) FILTER (WHERE NOT value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS outliers
      FROM points p JOIN q ON {on} GROUP BY {named})
    """


@query(
    "box_by_rating",
    f"""WITH {RATED}, {box_sql("Overall", "SELECT round_even(Overall, 2) AS Overall, round_even(bert_compound, 2) AS value FROM rated WHERE Overall IS NOT NULL")}
        SELECT Overall, n, outliers, {rounded_sql(*BOX)} FROM boxes""",
)
def box_by_rating(t: Source) -> DataFrame:
    return rounded(stats.box_by(rated(t), "Overall", "bert_compound"), *BOX)


@query(
    "box_by_event",
    f"""WITH {box_sql("event_type", "SELECT event_type, CASE WHEN value < 40 THEN value * value ELSE value END AS value FROM events")}
        SELECT event_type, n, outliers, {rounded_sql(*BOX)} FROM boxes""",
)
def box_by_event(t: Source) -> DataFrame:
    value = F.when(F.col("value") < 40, F.col("value") * F.col("value")).otherwise(F.col("value"))
    points = stats.value_counts(t.events.select("event_type", value.alias("value")), ["event_type"], "value")
    return rounded(stats.box_stats(points, ["event_type"]), *BOX)


PARTS = ["bert_neg", "bert_neu", "bert_pos"]


@query(
    "box_components",
    f"""WITH {RATED}, {box_sql("measure, Overall", " UNION ALL ".join(
        f"SELECT '{m}' AS measure, round_even(Overall, 2) AS Overall, round_even({m}, 2) AS value FROM rated WHERE Overall IS NOT NULL" for m in PARTS))}
        SELECT measure, Overall, n, outliers, {rounded_sql(*BOX)} FROM boxes""",
)
def box_components(t: Source) -> DataFrame:
    return rounded(stats.box_measures(rated(t), "Overall", PARTS), *BOX)


CATEGORIES = ["Satisfaction", "EaseOfUse", "Effectiveness"]


@query(
    "box_by_categories",
    f"""WITH {RATED}, {box_sql("rating, level", " UNION ALL ".join(
        f"SELECT '{m}' AS rating, round_even({m}, 2) AS level, round_even(bert_compound, 2) AS value FROM rated WHERE {m} IS NOT NULL" for m in CATEGORIES))}
        SELECT rating, level, n, outliers, {rounded_sql(*BOX)} FROM boxes""",
)
def box_by_categories(t: Source) -> DataFrame:
    return rounded(stats.box_by_each(rated(t), CATEGORIES, "bert_compound"), *BOX)


def describe_sql(source: str) -> str:
    def row(name: str, make: str) -> str:
        return f"SELECT '{name}' AS Statistic, " + ", ".join(
            f"round_even({make.format(r)}, 2) AS {r}" for r in dims.RATINGS
        ) + f" FROM {source}"

    return " UNION ALL ".join(
        [row("mean", "avg({})")] + [row(f"{p}%", f"quantile_cont({{}}, {p / 100})") for p in (25, 50, 75)]
    )


@query("describe_quartiles", f"WITH {RATED} {describe_sql('rated')}")
def describe_quartiles(t: Source) -> DataFrame:
    return stats.describe_ratings(rated(t), dims.RATINGS)


# --- shares and matrices --------------------------------------------------------------------------------


@query(
    "topic_share_by_group",
    r"""WITH w AS (SELECT lang, unnest(list_distinct(regexp_extract_all(lower(text), '\S+'))) AS item FROM documents),
        s AS (SELECT lang, count(*) AS group_size FROM documents GROUP BY lang)
        SELECT w.lang, item, count(*) AS n, any_value(group_size) AS group_size,
               round(count(*) / any_value(group_size), 6) AS share
        FROM w JOIN s ON w.lang = s.lang GROUP BY w.lang, item""",
)
def topic_share_by_group(t: Source) -> DataFrame:
    listed = t.documents.select("lang", F.array_distinct(x.tokens(F.lower("text"))).alias("words"))
    return rounded(stats.share_by_group(listed, "lang", "words"), "share")


@query("row_count", "SELECT count(*) AS documents FROM documents")
def row_count(t: Source) -> DataFrame:
    return t.documents.agg(F.count(F.lit(1)).alias("documents"))


@query(
    "distinct_sorted",
    """SELECT 0 AS position, 'All' AS choice UNION ALL
       SELECT CAST(dense_rank() OVER (ORDER BY p_name) AS INTEGER), p_name FROM (SELECT DISTINCT p_name FROM part WHERE p_name IS NOT NULL)""",
)
def distinct_sorted(t: Source) -> DataFrame:
    return stats.distinct_choices(t.part, "p_name")


@query("distinct_values", "SELECT DISTINCT p_name, p_type FROM part")
def distinct_values(t: Source) -> DataFrame:
    return t.part.select("p_name", "p_type").distinct()


@query("value_counts", "SELECT quality, toxic, count(*) AS n FROM labels GROUP BY quality, toxic")
def value_counts(t: Source) -> DataFrame:
    return t.labels.groupBy("quality", "toxic").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "quality", "toxic")


@query(
    "pivot_matrix",
    """SELECT user_id, count(*) FILTER (WHERE event_type = 'click') AS click, count(*) FILTER (WHERE event_type = 'error') AS error,
              count(*) FILTER (WHERE event_type = 'purchase') AS purchase, count(*) FILTER (WHERE event_type = 'signup') AS signup,
              count(*) FILTER (WHERE event_type = 'view') AS view FROM events GROUP BY user_id""",
)
def pivot_matrix(t: Source) -> DataFrame:
    return stats.pivot_matrix(t.events, "user_id", "event_type", F.count(F.lit(1))).fillna(0)


@query(
    "one_hot",
    """SELECT event_id, (event_type = 'click')::INTEGER AS click, (event_type = 'error')::INTEGER AS error,
              (event_type = 'purchase')::INTEGER AS purchase, (event_type = 'signup')::INTEGER AS signup,
              (event_type = 'view')::INTEGER AS view FROM events""",
)
def one_hot(t: Source) -> DataFrame:
    return stats.one_hot(t.events.select("event_id", "event_type"), "event_type").drop("event_type")


# --- correlations -----------------------------------------------------------------------------------------


@query(
    "corr_topic_group",
    """WITH l AS (SELECT DISTINCT label FROM embeddings WHERE label <> 3),
       p AS (SELECT vec_id, nullif(label, 3) AS label, CAST(unnest(range(len(embedding))) AS INTEGER) AS topic,
                    CAST(unnest(embedding) AS DOUBLE) AS p FROM embeddings),
       f AS (SELECT topic, l.label AS level, coalesce((p.label = l.label)::INTEGER, 0)::DOUBLE AS f, p FROM p, l)
       SELECT topic, level, round(covar_pop(f, p) / nullif(stddev_pop(f) * stddev_pop(p), 0), 6) AS correlation
       FROM f GROUP BY topic, level""",
)
def corr_topic_group(t: Source) -> DataFrame:
    rows = t.embeddings.select(F.nullif("label", F.lit(3)).alias("label"), "embedding")
    return rounded(stats.topic_group_correlation(rows, "embedding", "label"), "correlation")


@query(
    "spearman",
    f"""WITH {RATED}, v AS (SELECT Overall AS a, l_quantity + bert_compound AS b FROM rated WHERE Overall IS NOT NULL),
        r AS (SELECT rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2 AS ra,
                     rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2 AS rb FROM v)
        SELECT round(covar_pop(ra, rb) / nullif(stddev_pop(ra) * stddev_pop(rb), 0), 6) AS spearman FROM r""",
)
def spearman(t: Source) -> DataFrame:
    rows = rated(t).select("Overall", (F.col("l_quantity") + F.col("bert_compound")).alias("b"))
    return rounded(stats.spearman(rows, "Overall", "b"), "spearman")


@query(
    "corr_hard_topic",
    """WITH g AS (SELECT DISTINCT user_id % 7 AS topic FROM events), l AS (SELECT DISTINCT event_type AS level FROM events WHERE event_type <> 'error'),
       f AS (SELECT g.topic, l.level, (user_id % 7 = g.topic)::INTEGER::DOUBLE AS a, (event_type = l.level)::INTEGER::DOUBLE AS b FROM events, g, l)
       SELECT topic, level, round(covar_pop(a, b) / nullif(stddev_pop(a) * stddev_pop(b), 0), 6) AS correlation FROM f GROUP BY topic, level""",
)
def corr_hard_topic(t: Source) -> DataFrame:
    rows = t.events.select((F.col("user_id") % 7).alias("topic"), F.nullif("event_type", F.lit("error")).alias("level"))
    return rounded(stats.flag_correlation(rows, "topic", "level"), "correlation")


# --- sorts and limits ----------------------------------------------------------------------------------------


@query("sort_desc_nulls_last", "SELECT event_id, nullif(value, 100) AS value FROM events ORDER BY value DESC NULLS LAST, event_id")
def sort_desc_nulls_last(t: Source) -> DataFrame:
    rows = t.events.select("event_id", F.nullif("value", F.lit(100.0)).alias("value"))
    return rows.orderBy(F.col("value").desc_nulls_last(), "event_id")


@query("sort_asc", "SELECT l_quantity, count(*) AS n FROM lineitem GROUP BY l_quantity ORDER BY l_quantity")
def sort_asc(t: Source) -> DataFrame:
    return t.lineitem.groupBy("l_quantity").agg(F.count(F.lit(1)).alias("n")).orderBy("l_quantity")


@query("sort_multi", "SELECT lang, source, doc_id FROM documents ORDER BY lang, source, doc_id")
def sort_multi(t: Source) -> DataFrame:
    return t.documents.select("lang", "source", "doc_id").orderBy("lang", "source", "doc_id")


@query("head_n", "SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 30")
def head_n(t: Source) -> DataFrame:
    return t.documents.select("doc_id", "n_chars").orderBy(F.desc("n_chars"), "doc_id").limit(30)
