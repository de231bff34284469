"""Registered queries over the driver tables, each next to the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    centroids, conversations, exact_dedup, html_extract, mixing, near_dedup, packing, quality, sharding, substring_dedup, topk, toxicity, wordpiece,
)
from .common import table

SHARDS = 8

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(build: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = sql
        return build

    return register


@query(
    "op3_exact_dedup",
    r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       row_number() OVER (PARTITION BY t ORDER BY doc_id) = 1 AS kept, sha256(t) AS text_sha256
FROM n WINDOW g AS (PARTITION BY t)""",
)
def exact_dedup_query(spark: SparkSession, directory: str) -> DataFrame:
    return exact_dedup.membership(table(spark, directory, "documents"))


@query(
    "op5_source_mix",
    r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         CAST('0x' || substr(md5('mix' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS k
  FROM documents),
s AS (
  SELECT source, sum(size) AS source_size,
         [5, 2, 1][CAST((row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 AS INTEGER) + 1] AS weight
  FROM d GROUP BY source),
r AS (
  SELECT *, (1.5 * CAST(sum(source_size) OVER () AS DOUBLE) - coalesce(sum(2 * source_size) OVER b, 0)) / CAST(sum(weight) OVER f AS DOUBLE) AS level,
         row_number() OVER o AS place
  FROM s
  WINDOW o AS (ORDER BY CAST(source_size AS DOUBLE) / weight, encode(source)),
         b AS (ORDER BY CAST(source_size AS DOUBLE) / weight, encode(source) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
         f AS (ORDER BY CAST(source_size AS DOUBLE) / weight, encode(source) ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
t AS (
  SELECT source, source_size, least(CAST(2 * source_size AS DOUBLE),
         (SELECT arg_min(level, place) FROM r WHERE 2 * source_size > level * weight) * weight) AS target
  FROM s),
p AS (
  SELECT d.*, t.source_size, t.target, CAST(floor(t.target + 0.5) AS BIGINT) AS words,
         coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY k, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a,
         row_number() OVER () AS n
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
q AS (
  SELECT source, quota, sum(quota) OVER (ORDER BY encode(source) NULLS LAST) - quota AS low, length(bin(CAST(sum(quota) OVER () AS BIGINT))) AS bits
  FROM (SELECT source, CAST(ceil(floor(target + 0.5) / 1024) AS BIGINT) AS quota FROM t)),
slots AS (
  SELECT source, position, row_number() OVER (PARTITION BY source ORDER BY position) - 1 AS block FROM (
    SELECT source, CAST('0b' || reverse(lpad(bin(j), CAST(bits AS INTEGER), '0')) AS BIGINT) AS position
    FROM (SELECT source, bits, unnest(range(CAST(low AS BIGINT), CAST(low + quota AS BIGINT))) AS j FROM q))),
laps AS (
  SELECT n, source, a + lap * source_size AS lo, least(a + lap * source_size + size, words) AS hi FROM p, (VALUES (0), (1)) AS v(lap)),
places AS (
  SELECT n, min(position) AS first_position, max(position) AS last_position
  FROM laps l JOIN slots s ON l.source IS NOT DISTINCT FROM s.source AND hi > lo AND block BETWEEN lo // 1024 AND (hi - 1) // 1024 GROUP BY n)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(source_size AS BIGINT) AS source_size, target,
       CAST(greatest(0, least(a + size, words) - a) + greatest(0, least(a + source_size + size, words) - a - source_size) AS BIGINT) AS taken,
       first_position, last_position
FROM p LEFT JOIN places USING (n)""",
)
def source_mix_query(spark: SparkSession, directory: str) -> DataFrame:
    return mixing.taken_words(table(spark, directory, "documents"))


@query("op9_bounded_ring")
def bounded_ring_query(spark: SparkSession, directory: str) -> DataFrame:
    """Law `rows`: the ring without slack fills every shard to within one row of the mean."""
    placed = sharding.shard_documents(table(spark, directory, "documents"), SHARDS)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query("op2_quality")
def quality_query(spark: SparkSession, directory: str) -> DataFrame:
    return quality.judge(table(spark, directory, "documents"), table(spark, directory, "labels"))


@query("op4_pattern_packing")
def pattern_packing_query(spark: SparkSession, directory: str) -> DataFrame:
    return packing.pack(table(spark, directory, "documents"))


@query("op7_toxicity")
def toxicity_query(spark: SparkSession, directory: str) -> DataFrame:
    return toxicity.score(table(spark, directory, "documents"), table(spark, directory, "labels"))


@query("op10_token_counts")
def token_counts_query(spark: SparkSession, directory: str) -> DataFrame:
    return wordpiece.token_counts(table(spark, directory, "documents"))


@query("op1_main_text")
def main_text_query(spark: SparkSession, directory: str) -> DataFrame:
    return html_extract.extract(table(spark, directory, "pages"))


@query("op6_near_dedup")
def near_dedup_query(spark: SparkSession, directory: str) -> DataFrame:
    return near_dedup.membership(table(spark, directory, "documents"))


@query("op8_substring_dedup")
def substring_dedup_query(spark: SparkSession, directory: str) -> DataFrame:
    return substring_dedup.remove_repeats(table(spark, directory, "documents"))


_CENTROID_ROUND = """
a{r} AS (SELECT vec_id, e, c, distance FROM (
    SELECT vec_id, e, c, list_sum(list_transform(range(1, 65), lambda i: (e[i] - m[i]) * (e[i] - m[i]))) AS distance,
           row_number() OVER (PARTITION BY vec_id ORDER BY distance, c) AS place
    FROM v, c{r}) WHERE place = 1),
s{r} AS (SELECT c, i, floor(sum(x) / count(*)) AS x FROM (SELECT c, unnest(range(64)) AS i, unnest(e) AS x FROM a{r}) GROUP BY c, i),
c{n} AS (SELECT c, coalesce((SELECT list(CAST(x AS BIGINT) ORDER BY i) FROM s{r} WHERE s{r}.c = c{r}.c), m) AS m FROM c{r})"""


@query(
    "op11_orchard_clusters",
    """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS c, e AS m FROM v ORDER BY sha256('1:' || vec_id) LIMIT 16),"""
    + ",".join(_CENTROID_ROUND.format(r=r, n=r + 1) for r in range(4))
    + """
SELECT vec_id, CAST(c AS INTEGER) AS cluster, CAST(distance AS BIGINT) AS distance,
       CAST(sum(distance) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia,
       sha256(array_to_string(m, ',')) AS centroid_sha256
FROM a3 JOIN c3 USING (c)""",
)
def orchard_clusters_query(spark: SparkSession, directory: str) -> DataFrame:
    return centroids.membership(table(spark, directory, "embeddings"))


@query(
    "op13_pivot_top_k",
    """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0)
SELECT * FROM (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM p)
WHERE rank <= 20""",
)
def pivot_top_k_query(spark: SparkSession, directory: str) -> DataFrame:
    return topk.search(table(spark, directory, "embeddings"), F.col("vec_id") % 20 == 0)


# Costs and audits of what is left, backwards over the rows of a conversation: c and a of the states
# nothing, s, u, a. A struct is compared by cost, then by audit.
_LEFT = """
    list_min([{{'c': CAST(4 + l{s}['c'] AS BIGINT), 'a': 'D' || l{s}['a']}},
              {{'c': CASE WHEN gone THEN 1000000000 ELSE 3 + cut + l{f}['c'] END, 'a': 'R' || l{f}['a']}},
              {{'c': CASE WHEN gone THEN 1000000000 ELSE {keep} END, 'a': 'K' || CASE {name} END}}]) AS b{s}"""
_FILL = """
    {src}, list_min([b2, {{'c': b3['c'] + 3, 'a': 'I' || b3['a']}}]) AS l2, list_min([b3, {{'c': b2['c'] + 3, 'a': 'I' || b2['a']}}]) AS l3,
    list_min([b1, {{'c': l2['c'] + 3, 'a': 'I' || l2['a']}}]) AS l1, list_min([b0, {{'c': l2['c'] + 3, 'a': 'I' || l2['a']}}]) AS l0"""


def _kept(*ways: tuple[str, int]) -> dict[str, str]:
    """What keeping a row leads to, by its initial."""
    keep = "CASE " + " ".join(f"WHEN role[1] = '{i}' THEN cut + l{s}['c']" for i, s in ways) + " ELSE 1000000000 END"
    return {"keep": keep, "name": " ".join(f"WHEN role[1] = '{i}' THEN l{s}['a']" for i, s in ways)}


@query(
    "op12_conversation_repair",
    r"""
WITH RECURSIVE spaced AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key
  FROM conversations),
-- CRC-32 of the key, a byte and its eight bits at a time.
keyed AS (
  SELECT *, xor(4294967295, list_reduce(
           flatten(list_transform(string_split(key, ''), lambda c: [CAST(ord(c) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1])),
           lambda crc, x: CASE WHEN x >= 0 THEN xor(crc, x) ELSE xor(crc >> 1, (crc & 1) * 3988292384) END, 4294967295)) % 20 AS kind
  FROM spaced),
copies AS (SELECT *, unnest(CASE WHEN kind = 3 THEN [1, 2] ELSE [1] END) AS copy FROM keyed WHERE kind <> 0),
damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text FROM copies),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, encode(role), encode(text[:64]), sha256(text)) AS i FROM damaged),
told AS (
  SELECT *, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again,
         NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') AS open FROM numbered),
judged AS (
  SELECT *, blank OR again AS gone, CASE WHEN open AND NOT blank AND NOT again THEN 3 ELSE 0 END AS cut,
         lag(role[1]) OVER (PARTITION BY conv_id ORDER BY i) || role[1] AS pair FROM told),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank,
         count(*) FILTER (again AND NOT blank) AS duplicate, count(*) FILTER (cut > 0) AS truncated,
         count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n
  FROM judged GROUP BY conv_id),
steps AS (
  SELECT conv_id, n + 1 AS i, """
    + "{'c': 3::BIGINT, 'a': 'I'} AS l2, {'c': 0::BIGINT, 'a': ''} AS l3, {'c': 6::BIGINT, 'a': 'II'} AS l1, {'c': 0::BIGINT, 'a': ''} AS l0 FROM counts"
    + "\n  UNION ALL SELECT "
    + _FILL.format(src="conv_id, i").strip()
    + " FROM (SELECT j.conv_id, j.i, "
    + ", ".join(
        _LEFT.format(s=s, f=f, **_kept(*ways)).strip()
        for s, f, ways in [(0, 2, [("s", 1), ("u", 2)]), (1, 2, [("u", 2)]), (2, 3, [("a", 3)]), (3, 2, [("u", 2)])]
    )
    + r"""
    FROM steps s JOIN judged j ON s.conv_id IS NOT DISTINCT FROM j.conv_id AND j.i = s.i - 1)),
audits AS (SELECT conv_id, l0['c'] AS cost, l0['a'] AS audit FROM steps WHERE i = 1),
edits AS (SELECT conv_id, unnest(range(1, len(audit) + 1)) AS k, audit FROM audits),
placed AS (
  SELECT conv_id, k, audit[k] AS edit, k - len(regexp_replace(audit[:k], '[^I]', '', 'g')) AS i FROM edits),
kept AS (
  SELECT p.conv_id, k, edit, CASE WHEN edit = 'I' THEN '' ELSE text END AS text, CASE WHEN edit = 'K' THEN role END AS own,
         row_number() OVER (PARTITION BY p.conv_id ORDER BY k) AS place
  FROM placed p LEFT JOIN judged j ON p.conv_id IS NOT DISTINCT FROM j.conv_id AND p.i = j.i WHERE edit <> 'D'),
opened AS (SELECT *, max(CASE WHEN place = 1 AND own[1] = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id) AS opener FROM kept),
lines AS (
  SELECT conv_id, sha256(string_agg(coalesce(own, CASE WHEN (place - opener) % 2 = 1 THEN 'user' ELSE 'assistant' END) || ':' || text, chr(10) ORDER BY place)) AS digest
  FROM opened GROUP BY conv_id)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, coalesce(digest, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN counts c ON o.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN audits a ON o.conv_id IS NOT DISTINCT FROM a.conv_id
LEFT JOIN lines l ON o.conv_id IS NOT DISTINCT FROM l.conv_id""",
)
def conversation_repair_query(spark: SparkSession, directory: str) -> DataFrame:
    return conversations.repair(table(spark, directory, "conversations"))
