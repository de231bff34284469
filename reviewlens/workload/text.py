"""Token, stop word, lemma, phrase and n-gram queries over the documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import dims
from ..functions import text as x
from ..operators import nested, textprep
from .registry import Source, query


def values_sql(words: list[str]) -> str:
    return ", ".join(f"('{w}')" for w in words)


STOP_WORDS = list(dict.fromkeys(dims.ENGLISH_STOP_WORDS + dims.CUSTOM_STOP_WORDS + dims.BRAND_STOP_WORDS))
STOP_WORDS_SQL = f"""
stop AS (SELECT word FROM (VALUES {values_sql(STOP_WORDS)}) v(word) UNION SELECT p_name FROM part)
"""
# What separates words, in the notation of the SQL engine.
SPACE_CLASS_SQL = r"\x09-\x0D\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
# Letters without punctuation and digits, split into words with their position.
CLEAN_TOKENS_SQL = rf"""
split AS (
  SELECT doc_id, regexp_extract_all(regexp_replace(regexp_replace(lower(text), '[^\p{{L}}\p{{N}}_{SPACE_CLASS_SQL}]', '', 'g'), '\p{{Nd}}+', '', 'g'),
                                    '[^{SPACE_CLASS_SQL}]+') AS ws
  FROM documents),
toks AS (SELECT doc_id, unnest(range(len(ws))) AS pos, unnest(ws) AS token FROM split)
"""
PLAIN_TOKENS_SQL = rf"""
split AS (SELECT doc_id, regexp_extract_all(text, '[^{SPACE_CLASS_SQL}]+') AS ws FROM documents),
toks AS (SELECT doc_id, unnest(range(len(ws))) AS pos, unnest(ws) AS token FROM split)
"""


def joined_sql(tokens: str) -> str:
    return f"""SELECT d.doc_id, coalesce(string_agg(token, ' ' ORDER BY pos), '') AS text
               FROM documents d LEFT JOIN ({tokens}) t ON d.doc_id = t.doc_id GROUP BY d.doc_id"""


def _clean_tokens(t: Source) -> DataFrame:
    return t.documents.select("doc_id", x.tokens(x.letters_only("text")).alias("tokens"))


def _stop_words(t: Source) -> DataFrame:
    return textprep.stopword_table(t.part, "p_name")


@query("stopword_list", f"WITH {STOP_WORDS_SQL} SELECT word FROM stop")
def stopword_list(t: Source) -> DataFrame:
    return _stop_words(t)


@query(
    "clean_text",
    f"""WITH {STOP_WORDS_SQL}, {CLEAN_TOKENS_SQL}
        {joined_sql("SELECT * FROM toks WHERE token NOT IN (SELECT word FROM stop)")}""",
)
def clean_text(t: Source) -> DataFrame:
    docs = textprep.clean_texts(t.documents, "doc_id", "text", "cleaned", _stop_words(t))
    return docs.select("doc_id", F.col("cleaned").alias("text"))


LEMMAS_SQL = f"lemmas(token, lemma) AS (VALUES {', '.join(f"('{a}', '{b}')" for a, b in dims.LEMMAS.items())})"


@query(
    "lemmatize",
    f"""WITH {LEMMAS_SQL}, {CLEAN_TOKENS_SQL}
        {joined_sql("SELECT doc_id, pos, coalesce(lemma, toks.token) AS token FROM toks LEFT JOIN lemmas ON toks.token = lemmas.token")}""",
)
def lemmatize(t: Source) -> DataFrame:
    docs = t.documents.select("doc_id", x.letters_only("text").alias("letters"))
    return textprep.lemmatize_texts(docs, "doc_id", "letters", "text", dims.lemma_table(t.spark)).drop("letters")


@query(
    "lemmatize_join",
    f"""WITH {LEMMAS_SQL}, {CLEAN_TOKENS_SQL}
        SELECT doc_id, CAST(pos AS INTEGER) AS pos, coalesce(lemma, toks.token) AS token
        FROM toks LEFT JOIN lemmas ON toks.token = lemmas.token""",
)
def lemmatize_join(t: Source) -> DataFrame:
    """The form for a long lemma table."""
    tokens = textprep.token_rows(_clean_tokens(t), "doc_id", "tokens")
    return textprep.lemmatize(tokens, dims.lemma_table(t.spark)).select("doc_id", "pos", "token")


@query("tokenize", f"WITH {PLAIN_TOKENS_SQL} SELECT doc_id, CAST(pos AS INTEGER) AS pos, token FROM toks")
def tokenize(t: Source) -> DataFrame:
    return nested.each(t.documents, x.tokens("text"), "token", "doc_id", position="pos")


# --- phrases ------------------------------------------------------------------------------------------


def learn_sql(tokens: str, prefix: str) -> str:
    """Phrase table `{prefix}phrases` learned from (doc_id, pos, token)."""
    return f"""
    {prefix}next AS (SELECT doc_id, pos, token, lead(token) OVER (PARTITION BY doc_id ORDER BY pos) AS following FROM {tokens}),
    {prefix}words AS (SELECT token, count(*) AS n FROM {tokens} GROUP BY token),
    {prefix}pairs AS (SELECT token AS a, following AS b, count(*) AS n FROM {prefix}next WHERE following IS NOT NULL GROUP BY 1, 2),
    {prefix}size AS (SELECT (SELECT count(*) FROM {prefix}words) + (SELECT count(*) FROM {prefix}pairs) AS v),
    {prefix}phrases AS (
      SELECT p.a, p.b, p.n, (p.n - {dims.PHRASE_MIN_COUNT}) * (SELECT v FROM {prefix}size) / (wa.n * wb.n) AS score
      FROM {prefix}pairs p JOIN {prefix}words wa ON wa.token = p.a JOIN {prefix}words wb ON wb.token = p.b
      WHERE p.n >= {dims.PHRASE_MIN_COUNT}
        AND (p.n - {dims.PHRASE_MIN_COUNT}) * (SELECT v FROM {prefix}size) / (wa.n * wb.n) > {dims.PHRASE_THRESHOLD})
    """


def merge_sql(prefix: str, merged: str) -> str:
    """Gaps and islands: within a run of neighbouring pair starts every second one is merged."""
    return f"""
    {prefix}starts AS (SELECT n.doc_id, n.pos, n.token, n.following, row_number() OVER (PARTITION BY n.doc_id ORDER BY n.pos) AS place,
                              p.a IS NOT NULL AS starts
                       FROM {prefix}next n LEFT JOIN {prefix}phrases p ON n.token = p.a AND n.following = p.b),
    {prefix}islands AS (SELECT doc_id, place, place - row_number() OVER (PARTITION BY doc_id ORDER BY place) AS island
                        FROM {prefix}starts WHERE starts),
    {prefix}taken AS (SELECT doc_id, place FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, island ORDER BY place) AS k
                      FROM {prefix}islands) WHERE k % 2 = 1),
    {merged} AS (SELECT s.doc_id, s.pos, CASE WHEN t.place IS NULL THEN s.token ELSE s.token || '_' || s.following END AS token
                 FROM {prefix}starts s LEFT JOIN {prefix}taken t ON s.doc_id = t.doc_id AND s.place = t.place
                 LEFT JOIN {prefix}taken u ON s.doc_id = u.doc_id AND s.place = u.place + 1 WHERE u.place IS NULL)
    """


@query(
    "phrase_bigrams",
    f"WITH {CLEAN_TOKENS_SQL}, {learn_sql('toks', 'x')} SELECT a, b, n, round(score, 6) AS score FROM xphrases",
)
def phrase_bigrams(t: Source) -> DataFrame:
    return textprep.learn_phrases(_clean_tokens(t), "tokens").withColumn("score", F.round("score", 6))


@query(
    "phrase_merge",
    f"WITH {CLEAN_TOKENS_SQL}, {learn_sql('toks', 'x')}, {merge_sql('x', 'once')} {joined_sql('SELECT * FROM once')}",
)
def phrase_merge(t: Source) -> DataFrame:
    docs = _clean_tokens(t)
    merged = textprep.merge_phrases(docs, "doc_id", "tokens", textprep.learn_phrases(docs, "tokens"))
    return merged.select("doc_id", F.array_join("tokens", " ").alias("text"))


@query(
    "phrase_trigrams",
    f"""WITH {CLEAN_TOKENS_SQL}, {learn_sql('toks', 'x')}, {merge_sql('x', 'once')}, {learn_sql('once', 'y')},
        {merge_sql('y', 'twice')} {joined_sql('SELECT * FROM twice')}""",
)
def phrase_trigrams(t: Source) -> DataFrame:
    merged = textprep.bigrams_and_trigrams(_clean_tokens(t), "doc_id", "tokens")
    return merged.select("doc_id", F.array_join("tokens", " ").alias("text"))


@query(
    "ngram_vocab",
    f"""WITH {CLEAN_TOKENS_SQL},
        near AS (SELECT doc_id, token AS a, lead(token) OVER w AS b, lead(token, 2) OVER w AS c FROM toks
                 WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
        terms AS (SELECT doc_id, a AS term FROM near UNION SELECT doc_id, a || ' ' || b FROM near WHERE b IS NOT NULL
                  UNION SELECT doc_id, a || ' ' || b || ' ' || c FROM near WHERE c IS NOT NULL)
        SELECT term, count(*) AS docs FROM terms GROUP BY term
        HAVING count(*) BETWEEN {dims.NGRAM_MIN_DF} * (SELECT count(*) FROM documents) AND {dims.NGRAM_MAX_DF} * (SELECT count(*) FROM documents)""",
)
def ngram_vocab(t: Source) -> DataFrame:
    return textprep.ngram_vocabulary(_clean_tokens(t), "tokens")
