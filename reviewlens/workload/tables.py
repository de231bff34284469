"""Reading and writing, nesting, joins, set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as c
from ..functions import text as x
from ..operators import clean, nested, sentiment
from ..session import scratch_path
from ..sources import files
from .registry import LABELLED, Source, labelled, query

EVENT_FIELDS = "event_id bigint, posted bigint, user_id bigint, event_type string, value double, props string"


def _events_as_written(t: Source) -> DataFrame:
    """Timestamps are written as epoch milliseconds."""
    posted = F.unix_millis(F.col("ts").cast("timestamp")).alias("posted")
    return t.events.select("event_id", posted, "user_id", "event_type", "value", "props")


@query(
    "src_jsonl",
    """SELECT event_id, epoch_us(ts) // 1000 AS posted, user_id, event_type, value, props FROM events""",
)
def src_jsonl(t: Source) -> DataFrame:
    path = scratch_path(t.spark, "jsonl")
    files.write_jsonl(_events_as_written(t), path)
    return files.read_jsonl(t.spark, path, EVENT_FIELDS)


@query(
    "sink_jsonl",
    """SELECT event_id, epoch_us(ts) // 1000 AS posted, nullif(event_type, 'error') AS event_type,
              CASE WHEN value > 5 THEN value END AS value, props FROM events""",
)
def sink_jsonl(t: Source) -> DataFrame:
    path = scratch_path(t.spark, "jsonl")
    rows = _events_as_written(t).select(
        "event_id", "posted", F.nullif("event_type", F.lit("error")).alias("event_type"),
        F.when(F.col("value") > 5, F.col("value")).alias("value"), "props",
    )
    files.write_jsonl(rows, path)
    lines = t.spark.read.text(path).select(F.from_json("value", EVENT_FIELDS).alias("r")).select("r.*")
    return lines.select("event_id", "posted", "event_type", "value", "props")


def nested_conversations(t: Source) -> DataFrame:
    return nested.nest_reviews(t.conversations, ["conv_id"], ["turn"], ["turn", "role", "text"])


@query("sink_items", "SELECT conv_id, turn, role, text FROM conversations")
def sink_items(t: Source) -> DataFrame:
    path = scratch_path(t.spark, "items")
    items = nested_conversations(t).drop("part")
    files.write_jsonl(items, path)
    return nested.expand_reviews(files.read_jsonl(t.spark, path, items.schema))


@query("csv_roundtrip", "SELECT doc_id, text, lang, source, n_chars FROM documents")
def csv_roundtrip(t: Source) -> DataFrame:
    path = scratch_path(t.spark, "csv")
    files.write_csv(t.documents, path)
    return files.read_csv(t.spark, path, t.documents.schema)


@query(
    "sink_partitioned",
    f"WITH {LABELLED} SELECT doc_id, n_chars, DrugFamily, bert_compound_threshold FROM labelled",
)
def sink_partitioned(t: Source) -> DataFrame:
    path = scratch_path(t.spark, "segments")
    rows = labelled(t).select("doc_id", "n_chars", *files.SEGMENT)
    files.write_segments(rows, path)
    return files.read_segment(t.spark, path, rows.schema)


@query(
    "segment_manifest",
    f"""WITH {LABELLED} SELECT DrugFamily, bert_compound_threshold, count(*) AS rows,
        DrugFamily || '_' || bert_compound_threshold AS name,
        'segments/' || DrugFamily || '_' || bert_compound_threshold AS path
        FROM labelled GROUP BY DrugFamily, bert_compound_threshold""",
)
def segment_manifest(t: Source) -> DataFrame:
    return files.segment_manifest(labelled(t))


@query(
    "src_segment",
    f"""WITH {LABELLED} SELECT doc_id, text, n_chars, DrugFamily, bert_compound_threshold FROM labelled
        WHERE DrugFamily = 'en' AND bert_compound_threshold = 'positive'""",
)
def src_segment(t: Source) -> DataFrame:
    path = scratch_path(t.spark, "segments")
    rows = labelled(t).select("doc_id", "text", "n_chars", *files.SEGMENT)
    files.write_segments(rows, path, rows_per_file=files.TEXT_ROWS_PER_FILE)
    return files.read_segment(t.spark, path, rows.schema, DrugFamily="en", bert_compound_threshold="positive")


@query(
    "model_store",
    """WITH e AS (SELECT event_id, value / 500 AS x, sqrt(value) AS y,
              CAST('0x' || substr(md5(event_id || '-42'), 1, 8) AS BIGINT) % 5 <> 0 AS train FROM events),
       m AS (SELECT regr_intercept(y, x) AS a, regr_slope(y, x) AS b FROM e WHERE train)
       SELECT event_id, round(a + b * x, 4) AS predicted FROM e, m""",
)
def model_store(t: Source) -> DataFrame:
    """Predictions of a model that was saved and loaded again."""
    rows = t.events.select("event_id", (F.col("value") / 500).alias("score"), F.sqrt("value").alias("rating"))
    model, _ = sentiment.fit_rating_model(rows, "score", "rating", "event_id", degree=1)
    path = scratch_path(t.spark, "model")
    files.save_model(model, path)
    return files.load_model(path).transform(rows).select("event_id", F.round("PredictedOverall", 4).alias("predicted"))


@query(
    "decode_nested",
    "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events",
)
def decode_nested(t: Source) -> DataFrame:
    return t.events.select("event_id", files.decode_records("props", "k bigint")["k"].alias("k"))


@query(
    "decode_literal",
    """SELECT conv_id, turn, role, text, CAST(NULL AS VARCHAR) AS note, turn = 0 AS opening
       FROM conversations""",
)
def decode_literal(t: Source) -> DataFrame:
    """Lists written the way Python prints them, with bare None, True and False."""
    element = lambda e: F.concat(
        F.lit("{'turn': "), e["turn"].cast("string"), F.lit(", 'role': '"), e["role"], F.lit("', 'note': None, 'opening': "),
        F.when(e["turn"] == 0, "True").otherwise("False"), F.lit(", 'body': "), F.to_json(F.struct(e["text"].alias("text"))), F.lit("}"),
    )
    written = nested_conversations(t).select(
        "conv_id", F.concat(F.lit("["), F.array_join(F.transform("Reviews", element), ", "), F.lit("]")).alias("written")
    )
    schema = "array<struct<turn: bigint, role: string, note: string, opening: boolean, body: struct<text: string>>>"
    decoded = written.select("conv_id", files.decode_records("written", schema).alias("Reviews"))
    flat = nested.expand_reviews(decoded)
    return flat.select("conv_id", "turn", "role", F.col("body.text").alias("text"), "note", "opening")


@query("project_item", "SELECT p_partkey, p_name, p_brand, p_type FROM part")
def project_item(t: Source) -> DataFrame:
    return files.project(t.part, ["p_partkey", "p_name", "p_brand", "p_type"])


@query("project_review_cols", "SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders")
def project_review_cols(t: Source) -> DataFrame:
    return files.project(t.orders, ["o_orderkey", "o_orderstatus", "o_orderpriority"])


# --- nested and flat ---------------------------------------------------------------------------


@query("expand_reviews", "SELECT conv_id, turn, role, text FROM conversations")
def expand_reviews(t: Source) -> DataFrame:
    return nested.expand_reviews(nested_conversations(t).drop("part"))


@query(
    "nest_reviews",
    """SELECT conv_id, count(*) AS turns, string_agg(role, '|' ORDER BY turn) AS roles,
              sum(length(text))::BIGINT AS chars FROM conversations GROUP BY conv_id""",
)
def nest_reviews(t: Source) -> DataFrame:
    lists = nested_conversations(t)
    parts = lists.select(
        "conv_id", "part", F.size("Reviews").cast("bigint").alias("turns"),
        F.array_join(F.transform("Reviews", lambda e: e["role"]), "|").alias("roles"),
        F.aggregate("Reviews", F.lit(0).cast("bigint"), lambda acc, e: acc + F.length(e["text"])).alias("chars"),
    )
    ordered = F.array_sort(F.collect_list(F.struct("part", "roles")))
    return parts.groupBy("conv_id").agg(
        F.sum("turns").alias("turns"), F.array_join(F.transform(ordered, lambda p: p["roles"]), "|").alias("roles"), F.sum("chars").alias("chars")
    )


WORDS_SQL = r"regexp_extract_all(text, '\S+')"


@query(
    "explode_names",
    f"""SELECT doc_id, word FROM (SELECT doc_id, unnest({WORDS_SQL}) AS word FROM documents)
        UNION ALL SELECT doc_id, NULL FROM documents WHERE len({WORDS_SQL}) = 0""",
)
def explode_names(t: Source) -> DataFrame:
    words = t.documents.select("doc_id", x.tokens("text").alias("words"))
    return nested.explode_list(words, "words", "word").drop("words")


@query(
    "array_to_columns",
    """SELECT vec_id, CAST(unnest(range(len(embedding))) AS INTEGER) AS topic,
              CAST(unnest(embedding) AS DOUBLE) AS probability FROM embeddings""",
)
def array_to_columns(t: Source) -> DataFrame:
    long = nested.long_form(t.embeddings, "embedding", "topic", "probability", "vec_id")
    return long.withColumn("probability", F.col("probability").cast("double"))


@query(
    "bind_columns",
    "SELECT vec_id, label, " + ", ".join(f"CAST(embedding[{i + 1}] AS DOUBLE) AS Topic{i}" for i in range(64)) + " FROM embeddings",
)
def bind_columns(t: Source) -> DataFrame:
    wide = t.embeddings.withColumn("embedding", F.col("embedding").cast("array<double>"))
    return nested.array_to_columns(wide, "embedding", 64, "Topic")


# --- joins ------------------------------------------------------------------------------------


@query(
    "join_left_nullsafe",
    """WITH e AS (SELECT nullif(event_type, 'error') AS kind, user_id, value FROM events),
       a AS (SELECT kind, round(avg(value), 6) AS mean_value FROM e GROUP BY kind),
       b AS (SELECT kind, count(*) AS n, max(user_id) AS last_user FROM e WHERE value < 400 GROUP BY kind)
       SELECT a.kind, mean_value, n, last_user FROM a LEFT JOIN b ON a.kind IS NOT DISTINCT FROM b.kind""",
)
def join_left_nullsafe(t: Source) -> DataFrame:
    events = t.events.select(F.nullif("event_type", F.lit("error")).alias("kind"), "user_id", "value")
    a = events.groupBy("kind").agg(F.round(F.avg("value"), 6).alias("mean_value"))
    b = events.where(F.col("value") < 400).groupBy(F.col("kind").alias("other")).agg(
        F.count(F.lit(1)).alias("n"), F.max("user_id").alias("last_user")
    )
    return a.join(b, F.col("kind").eqNullSafe(F.col("other")), "left").drop("other")


@query(
    "join_inner_totals",
    """SELECT lang, source, count(*) AS n, sum(count(*)) OVER (PARTITION BY lang)::BIGINT AS total
       FROM documents GROUP BY lang, source""",
)
def join_inner_totals(t: Source) -> DataFrame:
    counts = t.documents.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    return counts.join(totals, "lang")


@query(
    "join_lookup",
    "SELECT n_nationkey, n_name, r_name FROM nation LEFT JOIN region ON n_regionkey = r_regionkey AND r_name <> 'ASIA'",
)
def join_lookup(t: Source) -> DataFrame:
    regions = t.region.where(F.col("r_name") != "ASIA")
    return clean.lookup(t.nation, regions, "n_regionkey", "r_regionkey", "r_name", "r_name").drop("n_regionkey")


# --- set operations -----------------------------------------------------------------------------


@query(
    "union_lists",
    """SELECT r_name AS word FROM region UNION SELECT n_name FROM nation
       UNION SELECT p_name FROM part UNION SELECT word FROM (VALUES ('prozac'), ('paxil')) v(word)""",
)
def union_lists(t: Source) -> DataFrame:
    fixed = t.spark.createDataFrame([("prozac",), ("paxil",)], "word string")
    lists = [t.region.select(F.col("r_name").alias("word")), t.nation.select("n_name"), t.part.select("p_name"), fixed]
    out = lists[0]
    for other in lists[1:]:
        out = out.union(other)
    return out.distinct()
