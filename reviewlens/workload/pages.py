"""Field extraction from the page table, and the record-building queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import dims
from ..functions import columns as c
from ..functions import text as x
from ..operators import clean, nested, pages, textprep
from .registry import PART_DICTIONARY, PART_FAMILIES, PART_NAMES, Source, any_name_sql, query

LINKS = rf"""
found AS (SELECT page_id, url, regexp_extract_all(html, '{pages.LINK}', 1) AS hrefs,
                 regexp_extract_all(html, '{pages.LINK}', 2) AS labels FROM pages),
links AS (SELECT page_id, url, CAST(unnest(range(len(hrefs))) AS INTEGER) AS position,
                 unnest(hrefs) AS href, unnest(labels) AS label FROM found)
"""


@query("page_links", f"WITH {LINKS} SELECT page_id, position, href FROM links")
def page_links(t: Source) -> DataFrame:
    return pages.links(t.pages).select("page_id", "position", "href")


@query("page_link_text", f"WITH {LINKS} SELECT page_id, position, href, lower(label) AS label FROM links")
def page_link_text(t: Source) -> DataFrame:
    return pages.links(t.pages).select("page_id", "position", "href", F.lower("label").alias("label"))


# Every link is tried as found, without its slash, as a query, as a fragment, with its own host
# and as a full address.
URL_FORMS = ["", "relative", "query", "fragment", "host", "full"]


@query(
    "url_resolve",
    rf"""WITH {LINKS},
    forms AS (
      SELECT page_id, url, position, form,
             CASE form WHEN 'relative' THEN substr(href, 2) WHEN 'query' THEN '?q=' || substr(href, 2)
                       WHEN 'fragment' THEN '#' || substr(href, 2) WHEN 'host' THEN '//other.example.com' || href
                       WHEN 'full' THEN 'https://other.example.com' || href ELSE href END AS link
      FROM links, (VALUES (''), ('relative'), ('query'), ('fragment'), ('host'), ('full')) f(form)),
    parts AS (
      SELECT *, split_part(url, '://', 1) AS scheme,
             split_part(split_part(split_part(split_part(url, '://', 2), '/', 1), '?', 1), '#', 1) AS host,
             split_part(split_part(url, '#', 1), '?', 1) AS plain FROM forms)
    SELECT page_id, position, form,
           CASE form WHEN 'full' THEN link WHEN 'host' THEN scheme || ':' || link
                WHEN '' THEN scheme || '://' || host || link
                WHEN 'query' THEN plain || link
                WHEN 'fragment' THEN split_part(url, '#', 1) || link
                ELSE CASE WHEN link = '' THEN url
                     WHEN regexp_matches(link, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN link
                     WHEN plain = scheme || '://' || host THEN plain || '/' || link
                     ELSE regexp_replace(plain, '[^/]*$', '') || link END END AS absolute
    FROM parts""",
)
def url_resolve(t: Source) -> DataFrame:
    bare = F.expr("substring(href, 2)")
    made = {
        "": F.col("href"), "relative": bare, "query": F.concat(F.lit("?q="), bare), "fragment": F.concat(F.lit("#"), bare),
        "host": F.concat(F.lit("//other.example.com"), F.col("href")),
        "full": F.concat(F.lit("https://other.example.com"), F.col("href")),
    }
    forms = F.array(*[F.struct(F.lit(n).alias("form"), v.alias("link")) for n, v in made.items()])
    links = pages.links(t.pages).select("page_id", "url", "position", F.explode(forms).alias("f"))
    return links.select("page_id", "position", "f.form", pages.resolve("url", F.col("f.link")).alias("absolute"))


@query(
    "page_rows_with_defaults",
    r"""WITH b AS (SELECT page_id, unnest(regexp_extract_all(html, '<li>(.*?)</li>', 1)) AS li,
                          unnest(range(len(regexp_extract_all(html, '<li>(.*?)</li>', 1)))) AS p FROM pages)
        SELECT page_id, CAST(p AS INTEGER) AS position,
               coalesce(nullif(regexp_extract(li, 'href="([^"]*)"', 1), ''), ' ') AS Link,
               coalesce(nullif(regexp_extract(li, '<a [^>]*>([^<]*)</a>', 1), ''), ' ') AS Drug,
               coalesce(nullif(regexp_extract(li, '>([A-Z][^<]*)<', 1), ''), ' ') AS Indication,
               coalesce(nullif(regexp_extract(li, '<span>([^<]*)</span>', 1), ''), ' ') AS Type
        FROM b""",
)
def page_rows_with_defaults(t: Source) -> DataFrame:
    cells = {
        "Link": 'href="([^"]*)"', "Drug": "<a [^>]*>([^<]*)</a>", "Indication": ">([A-Z][^<]*)<",
        "Type": "<span>([^<]*)</span>",
    }
    return pages.listing_rows(t.pages, "<li>(.*?)</li>", cells).drop("url")


def section_sql(start: str, tag: str) -> str:
    block = rf"regexp_extract(html, '(?s){start}(.*?)</{tag}>', 1)"
    return rf"trim(regexp_replace(regexp_replace({block}, '(?s)<[^>]*>', ' ', 'g'), '[ \t\n\r\f]+', ' ', 'g'))"


ARTICLE = section_sql(r"<article(?:\s[^>]*)?>", "article")
FOOTER = section_sql(r"<footer(?:\s[^>]*)?>", "footer")
AD = section_sql(r'<div\s[^>]*class="(?:[^"]*\s)?ad(?:\s[^"]*)?"[^>]*>', "div")
HEAD = section_sql(r"<h1(?:\s[^>]*)?>", "h1")


@query(
    "page_section_text",
    f"SELECT page_id, {HEAD} AS heading, {ARTICLE} AS article, {FOOTER} AS footer, {AD} AS ad FROM pages",
)
def page_section_text(t: Source) -> DataFrame:
    return t.pages.select(
        "page_id", pages.section_text("html", "h1").alias("heading"), pages.section_text("html", "article").alias("article"),
        pages.section_text("html", "footer").alias("footer"), pages.section_text("html", "div", "ad").alias("ad"),
    )


@query(
    "blank_default",
    rf"""SELECT page_id, CASE WHEN {AD} = '' THEN ' ' ELSE {AD} END AS ad,
                coalesce(nullif(regexp_extract(html, '<span>([^<]*)</span>', 1), ''), ' ') AS span,
                nullif(trim(regexp_extract(url, '\?(.*)$', 1)), '') AS query_part FROM pages""",
)
def blank_default(t: Source) -> DataFrame:
    return t.pages.select(
        "page_id", c.null_to_blank(pages.section_text("html", "div", "ad")).alias("ad"),
        c.null_to_blank(F.regexp_extract("html", "<span>([^<]*)</span>", 1)).alias("span"),
        c.blank_to_null(F.regexp_extract("url", r"\?(.*)$", 1)).alias("query_part"),
    )


@query(
    "page_keyword_branch",
    f"""WITH {LINKS}, k AS (
        SELECT page_id, hrefs, labels, CASE WHEN contains(lower(html), 'une ') THEN 'brand and generic'
               WHEN contains(lower(html), 'that ') THEN 'generic only' ELSE 'none' END AS kind
        FROM pages JOIN found USING (page_id))
        SELECT page_id, kind,
               CASE WHEN kind = 'brand and generic' THEN coalesce(nullif(labels[1], ''), ' ') ELSE ' ' END AS BrandName,
               CASE kind WHEN 'brand and generic' THEN coalesce(nullif(labels[2], ''), ' ')
                         WHEN 'generic only' THEN coalesce(nullif(labels[1], ''), ' ') ELSE ' ' END AS GenName
        FROM k""",
)
def page_keyword_branch(t: Source) -> DataFrame:
    kind = pages.kind_by_phrase("html", {"brand and generic": "Une ", "generic only": "That "}, "none", ignore_case=True)
    labels = F.regexp_extract_all("html", F.lit(pages.LINK), 2)
    first, second = F.get(labels, F.lit(0)), F.get(labels, F.lit(1))
    fields = pages.fields_by_kind(kind, {
        "BrandName": {"brand and generic": first},
        "GenName": {"brand and generic": second, "generic only": first},
    })
    return t.pages.select("page_id", kind.alias("kind"), *[v.alias(n) for n, v in fields.items()])


@query(
    "page_first_matching_link",
    f"""WITH {LINKS} SELECT page_id, arg_min(href, position) AS href, arg_min(label, position) AS label
        FROM links WHERE contains(label, 'th') GROUP BY page_id""",
)
def page_first_matching_link(t: Source) -> DataFrame:
    return pages.first_link_with(t.pages, "th")


@query(
    "page_classify",
    f"""WITH k AS (SELECT page_id, html, CASE WHEN contains(html, '%%%') THEN 'missing'
                     WHEN contains(html, 'The ') THEN 'conditions' WHEN contains(html, 'est') THEN 'allergies'
                     ELSE 'other' END AS kind FROM pages)
        SELECT page_id, kind,
               CASE WHEN kind = 'conditions' AND {HEAD} <> '' THEN {HEAD} ELSE ' ' END AS AvoidUse,
               CASE WHEN kind = 'conditions' AND {AD} <> '' THEN {AD}
                    WHEN kind = 'allergies' AND {HEAD} <> '' THEN {HEAD} ELSE ' ' END AS Allergies FROM k""",
)
def page_classify(t: Source) -> DataFrame:
    kind = pages.kind_by_phrase("html", {"missing": "%%%", "conditions": "The ", "allergies": "est"}, "other")
    head, ad = pages.section_text("html", "h1"), pages.section_text("html", "div", "ad")
    fields = pages.fields_by_kind(
        kind, {"AvoidUse": {"conditions": head}, "Allergies": {"conditions": ad, "allergies": head}}
    )
    return t.pages.select("page_id", kind.alias("kind"), *[v.alias(n) for n, v in fields.items()])


@query(
    "allowlist_semi",
    f"""SELECT p_partkey, p_name, p_type FROM part
        WHERE {any_name_sql("p_name")} OR {any_name_sql("p_type")}""",
)
def allowlist_semi(t: Source) -> DataFrame:
    return clean.keep_listed(t.part, "p_name", "p_type", PART_NAMES).select("p_partkey", "p_name", "p_type")


@query(
    "regex_id",
    r"""SELECT page_id, nullif(regexp_extract(lower(url), 'page=(\d+)', 1), '') AS number_in_url,
               nullif(regexp_extract(lower(html), 'track\((\d+)', 1), '') AS number_in_page FROM pages""",
)
def regex_id(t: Source) -> DataFrame:
    return t.pages.select(
        "page_id", pages.page_id_number("url", "page").alias("number_in_url"),
        c.blank_to_null(F.regexp_extract(F.lower("html"), r"track\((\d+)", 1)).alias("number_in_page"),
    )


@query(
    "digits_to_int",
    r"""SELECT c_custkey, TRY_CAST(regexp_replace(c_name, '[^0-9]', '', 'g') AS BIGINT) AS number,
               TRY_CAST(regexp_replace(c_mktsegment, '[^0-9]', '', 'g') AS BIGINT) AS no_number FROM customer""",
)
def digits_to_int(t: Source) -> DataFrame:
    return t.customer.select(
        "c_custkey", c.digits_to_long("c_name").alias("number"), c.digits_to_long("c_mktsegment").alias("no_number")
    )


@query(
    "empty_page_filter",
    f"""WITH {LINKS} SELECT page_id, contains(html, '%%%') OR contains(html, 'ß') AS no_reviews,
               CASE WHEN contains(html, '%%%') OR contains(html, 'ß') THEN ' ' ELSE CAST(length(html) AS VARCHAR) END AS Effectiveness,
               CASE WHEN contains(html, '%%%') OR contains(html, 'ß') THEN 0 ELSE len(labels) END::BIGINT AS n_reviews
        FROM pages JOIN found USING (page_id)""",
)
def empty_page_filter(t: Source) -> DataFrame:
    empty = pages.has_no_reviews("html", ["%%%", "ß"])
    labels = F.regexp_extract_all("html", F.lit(pages.LINK), 2)
    listed = F.when(empty, F.array().cast("array<string>")).otherwise(labels)
    return t.pages.select(
        "page_id", empty.alias("no_reviews"),
        F.when(empty, " ").otherwise(F.length("html").cast("string")).alias("Effectiveness"),
        F.size(listed).cast("bigint").alias("n_reviews"),
    )


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


# Pages with the marks of a drug page set in: every phrase by turns, names and paragraphs from the url.
_MARKS = [*pages.HEADING_PHRASES.values(), *pages.AVOID_PHRASES.values(), *pages.NO_REVIEW_PHRASES, "nothing of the kind"]
_MARKED_SQL = f"""marked AS (SELECT page_id, url, [{", ".join(_quoted(m) for m in _MARKS)}][CAST(page_id % {len(_MARKS)} AS INTEGER) + 1] AS mark FROM pages)"""


def _marked(t: Source) -> DataFrame:
    marks = F.array(*[F.lit(m) for m in _MARKS])
    mark = F.upper(F.get(marks, (F.col("page_id") % len(_MARKS)).cast("int")))
    mark = F.when(mark.isin([m.upper() for m in pages.HEADING_PHRASES.values()]), mark)
    mark = F.coalesce(mark, F.get(marks, (F.col("page_id") % len(_MARKS)).cast("int")))
    name = lambda n: F.concat(F.lit(f'<h3 class="drug-generic-name"><a href="/">{n} '), F.col("url"), F.lit("</a></h3>"))
    text = lambda n: F.concat(F.lit(f"<p>{n} "), F.col("url"), F.lit("</p>"))
    html = F.concat(
        F.col("html"), F.lit("<div>"), mark, F.lit("</div>"), name("one"), name("two"),
        F.lit("<section>"), text("first"), text("second"), text("third"), F.lit("</section>"),
    )
    return t.pages.select("page_id", "url", html.alias("html"))


@query(
    "page_drug_names",
    f"""WITH {_MARKED_SQL}
        SELECT page_id, CASE WHEN mark = 'common brand' THEN 'one ' || url ELSE ' ' END AS BrandName,
               CASE mark WHEN 'common brand' THEN 'two ' || url WHEN 'generic name' THEN 'one ' || url ELSE ' ' END AS GenName FROM marked""",
)
def page_drug_names(t: Source) -> DataFrame:
    return _marked(t).select("page_id", *[v.alias(n) for n, v in pages.brand_and_generic("html").items()])


@query(
    "page_contraindications",
    f"""WITH {_MARKED_SQL}
        SELECT page_id, CASE WHEN mark = 'Conditions:' THEN 'second ' || url ELSE ' ' END AS AvoidUse,
               CASE mark WHEN 'Conditions:' THEN 'third ' || url WHEN 'Allergies:' THEN 'second ' || url ELSE ' ' END AS Allergies FROM marked""",
)
def page_contraindications(t: Source) -> DataFrame:
    return _marked(t).select("page_id", *[v.alias(n) for n, v in pages.contraindications("html").items()])


@query(
    "page_without_reviews",
    f"""WITH {_MARKED_SQL}, e AS (SELECT *, mark IN ({", ".join(_quoted(p) for p in pages.NO_REVIEW_PHRASES)}) AS empty FROM marked)
        SELECT page_id, CASE WHEN empty THEN ' ' ELSE url END AS Effectiveness, CASE WHEN empty THEN ' ' ELSE 'x' END AS EaseOfUse,
               ' ' AS Satisfaction, CASE WHEN empty THEN 0 ELSE 2 END::BIGINT AS n_reviews FROM e""",
)
def page_without_reviews(t: Source) -> DataFrame:
    ratings = {"Effectiveness": F.col("url"), "EaseOfUse": F.lit("x"), "Satisfaction": F.lit(None).cast("string")}
    fields = pages.ratings_or_blank("html", ratings, F.array(F.lit("a"), F.lit("b")))
    shown = {**fields, "n_reviews": F.size(fields["Reviews"]).cast("bigint")}
    return _marked(t).select("page_id", *[v.alias(n) for n, v in shown.items() if n != "Reviews"])


@query(
    "positional_numbers",
    r"""WITH n AS (SELECT doc_id, regexp_extract_all(text, '[^ \n]*[0-9][^ \n]*') AS v FROM documents)
        SELECT doc_id, coalesce(nullif(regexp_extract(v[4], '(\d+\.?\d*)', 1), ''), ' ') AS Effectiveness,
               coalesce(nullif(regexp_extract(v[5], '(\d+\.?\d*)', 1), ''), ' ') AS EaseofUse,
               coalesce(nullif(regexp_extract(v[6], '(\d+\.?\d*)', 1), ''), ' ') AS Satisfaction FROM n""",
)
def positional_numbers(t: Source) -> DataFrame:
    values = t.documents.select("doc_id", F.regexp_extract_all("text", F.lit(r"[^ \n]*[0-9][^ \n]*"), 0).alias("v"))
    fields = {"Effectiveness": 3, "EaseofUse": 4, "Satisfaction": 5}
    return values.select("doc_id", *[pages.number_at(F.col("v"), i).alias(n) for n, i in fields.items()])


@query(
    "xml_reviews",
    """WITH n AS (SELECT conv_id, max(turn) + 1 AS last, count(*) AS c FROM conversations GROUP BY conv_id)
       SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS position,
              CAST(turn AS VARCHAR) AS Id, role AS Condition,
              CASE WHEN role = 'user' THEN 'adult' END AS Age, nullif(trim(text), '') IS NULL AS no_comment,
              regexp_replace(text, '\\s+', ' ', 'g') AS Comment
       FROM conversations
       UNION ALL SELECT conv_id, CAST(c AS INTEGER), NULL, NULL, NULL, true, NULL FROM n""",
)
def xml_reviews(t: Source) -> DataFrame:
    """A feed is written from each conversation, with one review fewer than announced."""

    def escaped(col):
        for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
            col = F.replace(col, F.lit(char), F.lit(entity))
        return col

    def element(e):
        age = F.when(e["role"] == "user", "<lookuptext1>adult</lookuptext1>").otherwise("")
        return F.concat(
            F.lit("<review><userreviewid>"), e["turn"].cast("string"), F.lit("</userreviewid><secondaryvalue>"), e["role"],
            F.lit("</secondaryvalue>"), age, F.lit("<userexperience>"), escaped(e["text"]), F.lit("</userexperience></review>"),
        )

    lists = nested.nest_reviews(t.conversations, ["conv_id"], ["turn"], ["turn", "role", "text"])
    last = F.col("part") == F.max("part").over(Window.partitionBy("conv_id"))
    feeds = lists.select(
        "conv_id", (F.col("part") * nested.MAX_ELEMENTS).alias("before"), (F.size("Reviews") + last.cast("int")).alias("expected"),
        F.concat(F.lit("<feed>"), F.array_join(F.transform("Reviews", element), ""), F.lit("</feed>")).alias("xml"),
    )
    parsed = feeds.select("conv_id", "before", F.posexplode(pages.xml_reviews("xml", F.col("expected"))).alias("position", "r"))
    return parsed.select(
        "conv_id", (F.col("before") + F.col("position")).alias("position"), "r.Id", "r.Condition", "r.Age", F.col("r.Comment").isNull().alias("no_comment"),
        F.regexp_replace("r.Comment", r"\s+", " ").alias("Comment"),
    )


# Every piece behind an ampersand begins with a reference or is left as it is.
_NAMED_SQL = ", ".join(f"({_quoted(name)}, {_quoted(char)})" for name, char in pages.named_entities().items())
UNESCAPE_SQL = rf"""
names(name, char) AS (VALUES {_NAMED_SQL}),
pieces AS (SELECT page_id, unnest(string_split(html, '&')) AS piece, unnest(range(len(string_split(html, '&')))) AS place FROM page_texts),
found AS (SELECT *, CASE WHEN place > 0 THEN regexp_extract(piece, '^(#[0-9]+|#[xX][0-9A-Fa-f]+|[A-Za-z][A-Za-z0-9]*);', 1) ELSE '' END AS ref FROM pieces),
coded AS (
  SELECT *, CASE WHEN starts_with(lower(ref), '#x') THEN CAST('0x' || right('0000000' || substr(ref, 3), 8) AS BIGINT)
                 WHEN starts_with(ref, '#') THEN CAST(right('0000000' || substr(ref, 2), 9) AS BIGINT) END AS code FROM found),
decoded AS (
  SELECT page_id, place, piece, ref, CASE WHEN code = 0 OR code > 1114111 OR code BETWEEN 55296 AND 57343 THEN chr(65533)
         WHEN code IS NOT NULL THEN chr(CAST(code AS INTEGER)) ELSE char END AS char
  FROM coded LEFT JOIN names ON ref = name)
SELECT page_id, string_agg(CASE WHEN place = 0 THEN piece WHEN char IS NULL THEN '&' || piece
                           ELSE char || substr(piece, length(ref) + 2) END, '' ORDER BY place) AS html
FROM decoded GROUP BY page_id
"""


@query(
    "html_unescape",
    f"WITH page_texts AS (SELECT page_id, replace(replace(html, '<![CDATA[', ''), ']]>', '') AS html FROM pages), {UNESCAPE_SQL}",
)
def html_unescape(t: Source) -> DataFrame:
    return t.pages.select("page_id", pages.unescape("html").alias("html"))


# References of every kind, made from the urls: named, decimal, hexadecimal, escaped and unknown ones.
_REFERENCES = ["&euro;", "&pound;&#38;amp;", "&#1114109;", "&#x10FFFD;", "&#x0;&#55296;", "&nope;&amp;lt;", "&#00065;&#X41;&", "&NotEqualTilde;"]


@query(
    "decode_references",
    f"""WITH page_texts AS (SELECT page_id, url || {' || url || '.join(_quoted(r) for r in _REFERENCES)} AS html FROM pages), {UNESCAPE_SQL}""",
)
def decode_references(t: Source) -> DataFrame:
    marked = F.concat(*[v for r in _REFERENCES for v in (F.col("url"), F.lit(r))])
    return t.pages.select("page_id", pages.unescape(marked).alias("html"))


# --- records ------------------------------------------------------------------------------------


@query(
    "assemble_record",
    """SELECT o_orderkey, o_totalprice, c_name, c_mktsegment, n_name, r_name FROM orders
       LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey
       LEFT JOIN region ON n_regionkey = r_regionkey""",
)
def assemble_record(t: Source) -> DataFrame:
    customer = t.customer.withColumnRenamed("c_custkey", "o_custkey")
    nation = t.nation.withColumnRenamed("n_nationkey", "c_nationkey")
    region = t.region.withColumnRenamed("r_regionkey", "n_regionkey")
    record = pages.assemble(t.orders, (customer, "o_custkey"), (nation, "c_nationkey"), (region, "n_regionkey"))
    return record.select("o_orderkey", "o_totalprice", "c_name", "c_mktsegment", "n_name", "r_name")


@query(
    "reuse_seen",
    """SELECT l_orderkey, l_linenumber, l_quantity, p_name, p_brand, p_retailprice
       FROM lineitem JOIN part ON l_partkey = p_partkey""",
)
def reuse_seen(t: Source) -> DataFrame:
    listing = t.lineitem.select(F.col("l_partkey").alias("p_partkey"), "l_orderkey", "l_linenumber", "l_quantity")
    details = t.part.select("p_partkey", "p_name", "p_brand", "p_retailprice")
    return pages.listed_details(listing, details, "p_partkey").drop("p_partkey")


@query(
    "build_url",
    """SELECT o_orderkey, 'https://reviews.example.com/list?objectId=' || o_orderkey || '&pageIndex=0&pageSize='
              || o_custkey || '&sortBy=DatePosted' AS url FROM orders""",
)
def build_url(t: Source) -> DataFrame:
    url = pages.build_url(
        "https://reviews.example.com/list", objectId=F.col("o_orderkey"), pageIndex="0", pageSize=F.col("o_custkey"),
        sortBy="DatePosted",
    )
    return t.orders.select("o_orderkey", url.alias("url"))


@query(
    "drop_incomplete",
    """SELECT d.doc_id, lang, quality, toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
       WHERE d.doc_id <> 0 AND lang <> '' AND quality <> 0 AND toxic <> 0""",
)
def drop_incomplete(t: Source) -> DataFrame:
    docs = t.documents.join(t.labels, "doc_id", "left").select("doc_id", "lang", "quality", "toxic")
    return clean.drop_incomplete(docs)


@query(
    "join_contains",
    f"""WITH {PART_DICTIONARY},
        hits AS (SELECT p_partkey, arg_min(name, ord) AS matched_name, arg_min(family, ord) AS matched_family
                 FROM part JOIN dictionary ON contains(p_name, name) GROUP BY p_partkey)
        SELECT p.p_partkey, p_name, matched_name, matched_family FROM part p LEFT JOIN hits h ON p.p_partkey = h.p_partkey""",
)
def join_contains(t: Source) -> DataFrame:

    matched = clean.first_match_join(t.part, "p_name", dims.dictionary_table(t.spark, PART_FAMILIES))
    return matched.select("p_partkey", "p_name", "matched_name", "matched_family")


@query(
    "anti_stopwords",
    r"""SELECT doc_id, count(*) AS kept FROM
        (SELECT doc_id, unnest(regexp_extract_all(lower(text), '\S+')) AS word FROM documents)
        WHERE word NOT IN (SELECT lower(split_part(p_name, ' ', 1)) FROM part)
          AND word NOT IN ('the', 'of', 'de', 'and', 'la') GROUP BY doc_id""",
)
def anti_stopwords(t: Source) -> DataFrame:

    fixed = t.spark.createDataFrame([(w,) for w in ("the", "of", "de", "and", "la")], "word string")
    names = t.part.select(F.lower(F.split_part("p_name", F.lit(" "), F.lit(1))).alias("word"))
    words = nested.each(t.documents, x.tokens(F.lower("text")), "token", "doc_id")
    kept = textprep.remove_stopwords(words, fixed.union(names).distinct())
    return kept.groupBy("doc_id").agg(F.count(F.lit(1)).alias("kept"))
