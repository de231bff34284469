"""Projections, filters and scalar functions, flat and nested."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import dims
from ..functions import arrays as a
from ..functions import columns as c
from ..functions import text as x
from ..operators import clean, nested, ordering, sentiment, stats
from .registry import (
    LABELLED, PART_FAMILY, PART_NAMES, RATED, REVIEW_KEY, Source, any_name_sql, labelled, query, rated, simplified_sql,
)

KEY_SQL = ", ".join(REVIEW_KEY)
PART_FAMILY_SQL = "CASE name " + " ".join(f"WHEN '{n}' THEN '{f}'" for n, f in PART_FAMILY.items()) + " END"


@query(
    "blank_to_double",
    """SELECT event_id, CASE WHEN event_type = 'error' THEN NULL ELSE value END AS value,
              CASE WHEN event_type = 'click' THEN NULL ELSE user_id END AS user_id,
              CAST(NULL AS DOUBLE) AS not_a_number FROM events""",
)
def blank_to_double(t: Source) -> DataFrame:
    written = t.events.select(
        "event_id", F.when(F.col("event_type") == "error", " ").otherwise(F.col("value").cast("string")).alias("value"),
        F.when(F.col("event_type") == "click", " ").otherwise(F.col("user_id").cast("string")).alias("user_id"),
        F.when(F.col("event_type") == "view", "NaN").otherwise(F.col("event_type")).alias("word"),
    )
    return written.select(
        "event_id", c.to_double("value").alias("value"), c.to_long("user_id").alias("user_id"),
        c.to_double("word").alias("not_a_number"),
    )


@query(
    "row_mean_skipna",
    f"""WITH {RATED} SELECT {KEY_SQL}, round((coalesce(Effectiveness, 0) + EaseOfUse + coalesce(nullif(Satisfaction, 5), 0))
        / ((Effectiveness IS NOT NULL)::INT + 1 + (Satisfaction <> 5)::INT), 6) AS mean FROM rated""",
)
def row_mean_skipna(t: Source) -> DataFrame:
    rows = rated(t).withColumn("Satisfaction", F.nullif("Satisfaction", F.lit(5.0)))
    return rows.select(*REVIEW_KEY, F.round(c.row_mean("Effectiveness", "EaseOfUse", "Satisfaction"), 6).alias("mean"))


def nested_ratings(t: Source) -> DataFrame:
    """Order lines as review lists of text fields, one space where a value is missing."""
    rows = rated(t).select(
        *REVIEW_KEY,
        *[F.coalesce(F.col(r).cast("string"), F.lit(" ")).alias(r) for r in ("Effectiveness", "EaseOfUse", "Satisfaction")],
        F.when(F.col("l_returnflag") == "A", "True").when(F.col("l_returnflag") == "N", "False").otherwise(" ").alias("IsMale"),
        F.col("bert_compound"),
    )
    fields = ["l_partkey", "l_suppkey", "l_linenumber", "Effectiveness", "EaseOfUse", "Satisfaction", "IsMale", "bert_compound"]
    return nested.nest_reviews(rows, ["l_orderkey"], REVIEW_KEY[1:], fields)


def numeric_ratings(t: Source) -> DataFrame:
    typed = a.numbers_from_text("Reviews", "Effectiveness", "EaseOfUse", "Satisfaction")
    return nested_ratings(t).withColumn("Reviews", typed)


@query(
    "nested_bool_map",
    """SELECT conv_id, turn, CASE role WHEN 'user' THEN true WHEN 'assistant' THEN false END AS IsMale FROM conversations""",
)
def nested_bool_map(t: Source) -> DataFrame:
    rows = t.conversations.withColumn(
        "IsMale", F.when(F.col("role") == "user", "True").when(F.col("role") == "assistant", "False").otherwise(" ")
    )
    lists = nested.nest_reviews(rows, ["conv_id"], ["turn"], ["turn", "IsMale"])
    typed = lists.select("conv_id", a.flags_from_text("Reviews", "IsMale").alias("Reviews"))
    return nested.expand_reviews(typed)


@query(
    "nested_float_cast",
    f"WITH {RATED} SELECT {KEY_SQL}, Effectiveness, EaseOfUse, Satisfaction FROM rated",
)
def nested_float_cast(t: Source) -> DataFrame:
    flat = nested.expand_reviews(numeric_ratings(t).drop("part"))
    return flat.select(*REVIEW_KEY, "Effectiveness", "EaseOfUse", "Satisfaction")


@query("nested_row_mean", f"WITH {RATED} SELECT {KEY_SQL}, round(Overall, 6) AS Overall FROM rated")
def nested_row_mean(t: Source) -> DataFrame:
    mean = a.strict_mean_field("Reviews", "Overall", "Effectiveness", "EaseOfUse", "Satisfaction")
    flat = nested.expand_reviews(numeric_ratings(t).select("l_orderkey", mean.alias("Reviews")))
    return flat.select(*REVIEW_KEY, F.round("Overall", 6).alias("Overall"))


@query(
    "nested_date_parse",
    """SELECT event_id, CASE WHEN event_type <> 'error' THEN date_trunc('second', ts) END AS DatePosted FROM events""",
)
def nested_date_parse(t: Source) -> DataFrame:
    """Dates are written as posted, then parsed in lists of one user each."""
    written = t.events.select(
        "user_id", "event_id",
        F.when(F.col("event_type") == "error", " ").otherwise(F.date_format("ts", dims.DATE_POSTED_FORMAT)).alias("DatePosted"),
    )
    lists = nested.nest_reviews(written, ["user_id"], ["event_id"], ["event_id", "DatePosted"])
    flat = nested.expand_reviews(lists.select(a.dates_from_text("Reviews", "DatePosted").alias("Reviews")))
    return flat.select("event_id", F.col("DatePosted").cast("timestamp_ntz").alias("DatePosted"))


# --- names ----------------------------------------------------------------------------------------

GENERIC_SQL = "CASE WHEN p_size % 3 = 0 THEN NULL ELSE p_name END"
BACKFILLED_SQL = f"CASE WHEN p_size % 3 = 0 AND {any_name_sql('p_name')} THEN p_name WHEN p_size % 3 = 0 THEN NULL ELSE p_name END"


def _parts(t: Source) -> DataFrame:
    """Parts as drugs; a third of the generic names are blank."""
    return t.part.withColumn("generic", F.when(F.col("p_size") % 3 == 0, " ").otherwise(F.col("p_name")))


@query("simplify_name", f"SELECT p_partkey, {simplified_sql('p_name')} AS name FROM part")
def simplify_name(t: Source) -> DataFrame:
    return t.part.select("p_partkey", c.simplify_name("p_name", PART_NAMES).alias("name"))


@query("backfill_name", f"SELECT p_partkey, {BACKFILLED_SQL} AS name FROM part")
def backfill_name(t: Source) -> DataFrame:
    return _parts(t).select("p_partkey", c.blank_to_null(c.backfill_name("generic", "p_name", PART_NAMES)).alias("name"))


@query(
    "update_genname",
    f"WITH b AS (SELECT p_partkey, {BACKFILLED_SQL} AS g FROM part) SELECT p_partkey, {simplified_sql('g')} AS name FROM b",
)
def update_genname(t: Source) -> DataFrame:
    return _parts(t).select(
        "p_partkey", c.generic_name(c.blank_to_null("generic"), "p_name", PART_NAMES).alias("name")
    )


@query(
    "filter_any_key",
    f"SELECT p_partkey, p_name FROM part WHERE {any_name_sql('p_name')} OR {any_name_sql('p_brand')}",
)
def filter_any_key(t: Source) -> DataFrame:
    return clean.keep_listed(t.part, "p_name", "p_brand", PART_NAMES).select("p_partkey", "p_name")


def _with_family(t: Source) -> DataFrame:
    named = t.part.select("p_partkey", c.simplify_name("p_name", PART_NAMES).alias("name"))
    dictionary = dims.dictionary_table(t.spark, {f: [n for n in PART_NAMES if PART_FAMILY[n] == f] for f in dict.fromkeys(PART_FAMILY.values())})
    return clean.lookup(named, dictionary, "name", "name", "family", "family")


@query(
    "map_family",
    f"WITH n AS (SELECT p_partkey, {simplified_sql('p_name')} AS name FROM part) SELECT *, {PART_FAMILY_SQL} AS family FROM n",
)
def map_family(t: Source) -> DataFrame:
    return _with_family(t)


@query(
    "not_null_filter",
    f"""WITH n AS (SELECT p_partkey, {simplified_sql('p_name')} AS name FROM part)
        SELECT * FROM (SELECT *, {PART_FAMILY_SQL} AS family FROM n) WHERE family IS NOT NULL""",
)
def not_null_filter(t: Source) -> DataFrame:
    return _with_family(t).where(F.col("family").isNotNull())


@query(
    "dropna_any",
    """SELECT d.doc_id, lang, quality, toxic FROM documents d JOIN labels l ON d.doc_id = l.doc_id
       WHERE quality IS NOT NULL AND toxic IS NOT NULL AND lang IS NOT NULL""",
)
def dropna_any(t: Source) -> DataFrame:
    return clean.drop_any_null(t.documents.join(t.labels, "doc_id", "left").select("doc_id", "lang", "quality", "toxic"))


# --- review lists -----------------------------------------------------------------------------------


def _conversation_lists(t: Source) -> DataFrame:
    return nested.nest_reviews(t.conversations, ["conv_id"], ["turn"], ["turn", "role", "text"])


@query("filter_elements", "SELECT conv_id, turn, text FROM conversations WHERE length(text) > 100")
def filter_elements(t: Source) -> DataFrame:
    kept = _conversation_lists(t).select("conv_id", a.longer_than("Reviews", "text", 100).alias("Reviews"))
    return nested.expand_reviews(kept.where(F.size("Reviews") > 0)).select("conv_id", "turn", "text")


def _kept_counts(t: Source) -> DataFrame:
    counts = _conversation_lists(t).select("conv_id", F.size(a.longer_than("Reviews", "text", 400)).cast("bigint").alias("n"))
    return nested.combine_parts(counts, ["conv_id"], ["n"])


@query(
    "array_count",
    "SELECT conv_id, count(*) FILTER (WHERE length(text) > 400) AS n FROM conversations GROUP BY conv_id",
)
def array_count(t: Source) -> DataFrame:
    return _kept_counts(t)


@query(
    "non_empty_filter",
    "SELECT conv_id, count(*) AS n FROM conversations WHERE length(text) > 400 GROUP BY conv_id",
)
def non_empty_filter(t: Source) -> DataFrame:
    return _kept_counts(t).where(F.col("n") > 0)


MEANS_SQL = ", ".join(f"round(avg({r}), 6) AS Mean{r}" for r in ("Effectiveness", "EaseOfUse", "Satisfaction", "Overall"))


def _list_means(lists: DataFrame) -> DataFrame:
    """Means per order over all parts of its list."""
    numbers = {}
    for r in dims.RATINGS:
        numbers[f"s_{r}"] = a.field_sum("Reviews", r)
        numbers[f"n_{r}"] = a.field_count("Reviews", r)
    numbers["n"] = F.size("Reviews").cast("bigint")
    sums = nested.combine_parts(lists.select("l_orderkey", *[v.alias(k) for k, v in numbers.items()]), ["l_orderkey"], list(numbers))
    return sums.select(
        "l_orderkey", F.col("n").alias("ScrapedReviews"),
        *[F.round(F.try_divide(f"s_{r}", f"n_{r}"), 6).alias(f"Mean{r}") for r in dims.RATINGS],
    )


def _rating_lists(t: Source) -> DataFrame:
    return numeric_ratings(t).withColumn(
        "Reviews", a.strict_mean_field("Reviews", "Overall", "Effectiveness", "EaseOfUse", "Satisfaction")
    )


@query(
    "nested_mean",
    f"WITH {RATED} SELECT l_orderkey, count(*) AS ScrapedReviews, {MEANS_SQL} FROM rated GROUP BY l_orderkey",
)
def nested_mean(t: Source) -> DataFrame:
    return _list_means(_rating_lists(t))


@query(
    "refresh_means",
    f"""WITH {RATED} SELECT l_orderkey, count(*) AS ScrapedReviews, {MEANS_SQL} FROM rated
        WHERE bert_compound BETWEEN -0.5 AND 0.5 GROUP BY l_orderkey""",
)
def refresh_means(t: Source) -> DataFrame:
    kept = _rating_lists(t).withColumn("Reviews", a.within("Reviews", "bert_compound", -0.5, 0.5))
    return _list_means(kept.where(F.size("Reviews") > 0))


@query(
    "range_filter_elements",
    f"WITH {RATED} SELECT {KEY_SQL}, bert_compound FROM rated WHERE bert_compound BETWEEN -0.25 AND 0.75",
)
def range_filter_elements(t: Source) -> DataFrame:
    kept = nested_ratings(t).select("l_orderkey", a.within("Reviews", "bert_compound", -0.25, 0.75).alias("Reviews"))
    return nested.expand_reviews(kept.where(F.size("Reviews") > 0)).select(*REVIEW_KEY, "bert_compound")


# --- columns and labels ---------------------------------------------------------------------------------


@query("drop_rename", "SELECT p_partkey, p_name AS Drug, p_brand AS DrugCondition FROM part")
def drop_rename(t: Source) -> DataFrame:
    return t.part.drop("p_type", "p_size", "p_retailprice").withColumnsRenamed({"p_name": "Drug", "p_brand": "DrugCondition"})


@query(
    "label_remap",
    """SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN '01-URGENT' WHEN '2-HIGH' THEN '02-HIGH'
              ELSE o_orderpriority END AS Age FROM orders""",
)
def label_remap(t: Source) -> DataFrame:
    return t.orders.select(
        "o_orderkey", c.remap("o_orderpriority", {"1-URGENT": "01-URGENT", "2-HIGH": "02-HIGH"}).alias("Age")
    )


@query(
    "label_suffix",
    "SELECT o_orderkey, nullif(o_orderpriority, '5-LOW') || ' yrs' AS Age FROM orders",
)
def label_suffix(t: Source) -> DataFrame:
    return t.orders.select(
        "o_orderkey", c.with_suffix(F.nullif("o_orderpriority", F.lit("5-LOW")), dims.AGE_SUFFIX).alias("Age")
    )


def band_sql(score: str, low: float, high: float) -> str:
    return f"CASE WHEN {score} IS NULL THEN 'neutral' WHEN {score} <= {low} THEN 'negative' WHEN {score} >= {high} THEN 'positive' ELSE 'neutral' END"


@query(
    "band3",
    f"SELECT event_id, {band_sql('nullif(value, 100)', 50, 200)} AS band FROM events",
)
def band3(t: Source) -> DataFrame:
    return t.events.select("event_id", c.band3(F.nullif("value", F.lit(100.0)), 50, 200).alias("band"))


@query(
    "sentiment_bands",
    f"""WITH {RATED}, s AS (SELECT {KEY_SQL}, Overall, bert_compound, nullif(bert_compound, -0.5) AS vader_compound FROM rated)
        SELECT {KEY_SQL}, {band_sql('Overall', 2.5, 4)} AS Overall_threshold,
               {band_sql('vader_compound', -0.75, -0.2)} AS vader_compound_threshold,
               {band_sql('bert_compound', -0.79, -0.2)} AS bert_compound_threshold FROM s""",
)
def sentiment_bands(t: Source) -> DataFrame:
    scored = rated(t).withColumn("vader_compound", F.nullif("bert_compound", F.lit(-0.5)))
    return sentiment.add_bands(scored).select(*REVIEW_KEY, *[f"{s}_threshold" for s in dims.BANDS])


@query(
    "date_parts",
    """SELECT event_id, date_trunc('millisecond', ts) AS DatePosted, CAST(year(ts) AS INTEGER) AS YearPosted,
              CAST(month(ts) AS INTEGER) AS MonthPosted, year(ts) || '-' || month(ts) AS YearMonthPosted FROM events""",
)
def date_parts(t: Source) -> DataFrame:
    parts = c.posted_parts("posted")
    dated = t.events.select("event_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("posted"))
    out = dated.select("event_id", *[v.alias(k) for k, v in parts.items()])
    return out.withColumn("DatePosted", F.col("DatePosted").cast("timestamp_ntz"))


@query(
    "bool_label",
    """SELECT d.doc_id, CASE toxic WHEN 1 THEN 'Male' WHEN 0 THEN 'Female' END AS Gender
       FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
)
def bool_label(t: Source) -> DataFrame:
    return t.documents.select("doc_id").join(t.labels, "doc_id", "left").select("doc_id", c.bool_label("toxic").alias("Gender"))


@query("word_count", r"SELECT doc_id, CAST(len(regexp_extract_all(text, '\S+')) AS INTEGER) AS words FROM documents")
def word_count(t: Source) -> DataFrame:
    return t.documents.select("doc_id", x.word_count("text").alias("words"))


@query(
    "truncate_label",
    """SELECT doc_id, CASE WHEN length(text) > 75 THEN substr(text, 1, 90) || '...' ELSE text END AS comment,
              CASE WHEN length(lang || ' document from ' || source) > 20
                   THEN substr(lang || ' document from ' || source, 1, 28) || '...'
                   ELSE lang || ' document from ' || source END AS label FROM documents""",
)
def truncate_label(t: Source) -> DataFrame:
    label = F.concat("lang", F.lit(" document from "), "source")
    return t.documents.select(
        "doc_id", c.truncate_label("text", 75, 90).alias("comment"), c.truncate_label(label, 20, 28).alias("label")
    )


@query(
    "hover_text",
    """SELECT doc_id, 'Review: ' || text || '<br>Topic: ' || source || '<br>Probability: '
              || CAST(n_chars // 100 AS VARCHAR) AS hover_text FROM documents""",
)
def hover_text(t: Source) -> DataFrame:
    probability = F.floor(F.col("n_chars") / 100).cast("string")
    parts = {"Review": F.col("text"), "Topic": F.col("source"), "Probability": probability}
    return t.documents.select("doc_id", c.labelled_text(parts).alias("hover_text"))


@query("array_max", "SELECT vec_id, CAST(list_max(embedding) AS DOUBLE) AS probability FROM embeddings")
def array_max(t: Source) -> DataFrame:
    return t.embeddings.select("vec_id", F.array_max("embedding").cast("double").alias("probability"))


@query(
    "round_numeric",
    """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, round_even(l_extendedprice / 8, 2) AS price,
              round_even(l_discount / 8, 2) AS discount FROM lineitem""",
)
def round_numeric(t: Source) -> DataFrame:
    return stats.round_numeric(
        t.lineitem.select(*REVIEW_KEY, (F.col("l_extendedprice") / 8).alias("price"), (F.col("l_discount") / 8).alias("discount"))
    )


@query(
    "fill_and_exclude",
    """SELECT d.doc_id, quality FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE quality IS NOT NULL""",
)
def fill_and_exclude(t: Source) -> DataFrame:
    joined = t.documents.join(t.labels, "doc_id", "left").select("doc_id", "quality")
    return joined.where(F.col("quality").isNotNull())


PRIORITIES = ["5-LOW", "3-MEDIUM", "2-HIGH", "0-NEVER"]


@query(
    "ordered_category",
    """SELECT o_orderkey, CAST(CASE o_orderpriority WHEN '5-LOW' THEN 0 WHEN '3-MEDIUM' THEN 1 WHEN '2-HIGH' THEN 2 END AS INTEGER) AS ord,
              CASE WHEN o_orderpriority IN ('5-LOW', '3-MEDIUM', '2-HIGH') THEN o_orderpriority END AS o_orderpriority FROM orders""",
)
def ordered_category(t: Source) -> DataFrame:
    labels = dims.ordered_labels(t.spark, PRIORITIES)
    return clean.in_order(t.orders.select("o_orderkey", "o_orderpriority"), "o_orderpriority", labels)


@query(
    "dense_code",
    """SELECT event_id, event_type, CAST(dense_rank() OVER (ORDER BY event_type) - 1 AS INTEGER) AS code FROM events""",
)
def dense_code(t: Source) -> DataFrame:
    codes = ordering.dense_codes(t.events, "event_type")
    return t.events.select("event_id", "event_type").join(codes, "event_type")


@query(
    "int_truncate",
    f"SELECT {KEY_SQL}, CAST(trunc(l_extendedprice) AS INTEGER) AS whole, round(l_discount + l_tax, 2) AS overall FROM lineitem",
)
def int_truncate(t: Source) -> DataFrame:
    return t.lineitem.select(
        *REVIEW_KEY, c.truncate_to_int("l_extendedprice").alias("whole"), F.round(F.col("l_discount") + F.col("l_tax"), 2).alias("overall")
    )


@query("diff_column", f"SELECT {KEY_SQL}, l_quantity - l_linenumber AS NotHelpful FROM lineitem")
def diff_column(t: Source) -> DataFrame:
    return t.lineitem.select(*REVIEW_KEY, (F.col("l_quantity") - F.col("l_linenumber")).alias("NotHelpful"))


@query(
    "multi_isin",
    """SELECT o_orderkey, o_orderstatus, o_orderpriority, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey
       WHERE o_orderstatus IN ('F', 'O') AND c_mktsegment IN ('BUILDING', 'MACHINERY')""",
)
def multi_isin(t: Source) -> DataFrame:
    customer = t.customer.select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    joined = t.orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority").join(customer, "o_custkey")
    chosen = clean.choose(
        joined, always=("o_orderstatus",), o_orderstatus=["F", "O"], o_orderpriority="All",
        c_mktsegment=["BUILDING", "MACHINERY"],
    )
    return chosen.drop("o_custkey")


@query("point_lookup", "SELECT * FROM orders WHERE o_orderkey = 1234")
def point_lookup(t: Source) -> DataFrame:
    return t.orders.where(F.col("o_orderkey") == F.lit(1234))


@query(
    "family_sentiment_filter",
    f"""WITH {LABELLED} SELECT doc_id, lang, bert_compound_threshold FROM labelled
        WHERE DrugFamily = 'fr' AND bert_compound_threshold = 'positive'""",
)
def family_sentiment_filter(t: Source) -> DataFrame:
    segment = (F.col("DrugFamily") == "fr") & (F.col("bert_compound_threshold") == "positive")
    return labelled(t).where(segment).select("doc_id", "lang", "bert_compound_threshold")


@query(
    "scored_rows",
    """SELECT event_id FROM events WHERE nullif(event_type, 'error') IS NOT NULL AND (value < 400) AND value IS NOT NULL""",
)
def scored_rows(t: Source) -> DataFrame:
    scored = t.events.select(
        "event_id", F.nullif("event_type", F.lit("error")).alias("vader"), F.when(F.col("value") < 400, F.col("value")).alias("bert")
    )
    return clean.drop_any_null(scored, ["vader", "bert"]).select("event_id")


@query(
    "dedupe_first",
    """SELECT doc_id, lang, source, n_chars FROM documents
       QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1""",
)
def dedupe_first(t: Source) -> DataFrame:
    return clean.dedupe_first_text(t.documents, "text", "doc_id").select("doc_id", "lang", "source", "n_chars")


@query(
    "dedupe_first_keys",
    """SELECT event_id, user_id, event_type, value FROM events
       QUALIFY row_number() OVER (PARTITION BY user_id, nullif(event_type, 'error') ORDER BY event_id) = 1""",
)
def dedupe_first_keys(t: Source) -> DataFrame:
    events = t.events.withColumn("kind", F.nullif("event_type", F.lit("error")))
    return clean.dedupe_first(events, ["user_id", "kind"], "event_id").select("event_id", "user_id", "event_type", "value")


@query(
    "softmax3",
    f"""WITH e AS (SELECT {KEY_SQL}, exp(l_discount * 10) a, exp(l_tax * 10) b, exp(l_quantity / 50) c FROM lineitem)
        SELECT {KEY_SQL}, round(a / (a + b + c), 6) AS neg, round(b / (a + b + c), 6) AS neu, round(c / (a + b + c), 6) AS pos FROM e""",
)
def softmax3(t: Source) -> DataFrame:
    scores = c.softmax(F.col("l_discount") * 10, F.col("l_tax") * 10, F.col("l_quantity") / 50)
    return t.lineitem.select(*REVIEW_KEY, *[F.round(s, 6).alias(n) for n, s in zip(("neg", "neu", "pos"), scores)])


@query(
    "compound",
    f"WITH {RATED} SELECT {KEY_SQL}, round(bert_pos - bert_neg, 6) AS bert_compound FROM rated",
)
def compound(t: Source) -> DataFrame:
    return rated(t).select(*REVIEW_KEY, F.round(c.compound("bert_pos", "bert_neg"), 6).alias("bert_compound"))


@query(
    "train_test_split",
    """SELECT event_id, CAST('0x' || substr(md5(event_id || '-42'), 1, 8) AS BIGINT) % 5 <> 0 AS train FROM events""",
)
def train_test_split(t: Source) -> DataFrame:
    return t.events.select("event_id", sentiment.split_flag("event_id").alias("train"))
