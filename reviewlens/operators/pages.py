"""Field extraction from fetched pages: a table `(page_id, url, html)` in, rows out.

Pages are not well formed, so fields are cut out with regular expressions. The patterns are
parameters with defaults for plain markup.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Sequence
from html.entities import html5

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as c
from ..functions.arrays import pad_array
from . import nested

LINK = r'<a\s[^>]*?href="([^"]*)"[^>]*>([^<]*)</a>'

# Names of the feed's elements and the record fields they fill, the phrases that
# tell page kinds apart.

REVIEW_TAGS = {
    "Id": "userreviewid",
    "Condition": "secondaryvalue",
    "IsPatient": "boolean2",
    "IsMale": "boolean1",
    "Age": "lookuptext1",
    "TimeUsingDrug": "lookuptext2",
    "DatePosted": "dateposted",
    "Comment": "userexperience",
    "Effectiveness": "ratingcriteria1",
    "EaseOfUse": "ratingcriteria2",
    "Satisfaction": "ratingcriteria3",
    "NumFoundHelpful": "foundhelpfulcount",
    "NumVoted": "totalvotedcount",
}
HEADING_PHRASES = {"brand and generic": "common brand", "generic only": "generic name"}
AVOID_PHRASES = {
    "missing": "We're sorry, but we couldn't find the page you tried",
    "conditions": "Conditions:",
    "allergies": "Allergies:",
}
NO_REVIEW_PHRASES = [
    "Rate this treatment and share your opinion",
    "Be the first to share your experience with this treatment",
]

# End of the fixed values.


# --- links --------------------------------------------------------------------------------


def links(pages: DataFrame, pattern: str = LINK) -> DataFrame:
    """`(page_id, url, position, href, label)`, one row per link in page order."""
    found = F.arrays_zip(
        F.regexp_extract_all("html", F.lit(pattern), 1).alias("href"),
        F.regexp_extract_all("html", F.lit(pattern), 2).alias("label"),
    )
    rows = nested.each(pages, found, "link", "page_id", "url", position="position")
    return rows.select("page_id", "url", "position", "link.*")


def resolve(base: Column | str, href: Column | str) -> Column:
    """Absolute address of a link found on a page."""
    base, href = c._col(base), c._col(href)
    scheme = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1)
    origin = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    path = F.regexp_extract(base, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    folder = F.when(path == "", "/").otherwise(F.regexp_replace(path, "[^/]*$", ""))
    without_fragment = F.regexp_replace(base, "#.*$", "")
    without_query = F.regexp_replace(base, "[?#].*$", "")
    return (
        F.when(href == "", base)
        .when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), href)
        .when(href.startswith("//"), F.concat(scheme, F.lit(":"), href))
        .when(href.startswith("/"), F.concat(origin, href))
        .when(href.startswith("#"), F.concat(without_fragment, href))
        .when(href.startswith("?"), F.concat(without_query, href))
        .otherwise(F.concat(origin, folder, href))
    )


def first_link_with(pages: DataFrame, word: str, pattern: str = LINK) -> DataFrame:
    """First link whose label contains a word; a page without one gives no row."""
    hrefs = F.regexp_extract_all("html", F.lit(pattern), 1)
    labels = F.regexp_extract_all("html", F.lit(pattern), 2)
    both = F.zip_with(hrefs, labels, lambda h, t: F.struct(h.alias("href"), t.alias("label")))
    first = F.get(F.filter(both, lambda e: e["label"].contains(word)), F.lit(0))
    return pages.select("page_id", first.alias("_l")).where(F.col("_l").isNotNull()).select("page_id", "_l.*")


def listing_rows(pages: DataFrame, block: str, cells: dict[str, str]) -> DataFrame:
    """One row per repeated block; a cell pattern that finds nothing gives a blank."""
    blocks = F.regexp_extract_all("html", F.lit(block), 1)
    rows = nested.each(pages, blocks, "_b", "page_id", "url", position="position")
    return rows.select(
        "page_id", "url", "position",
        *[c.null_to_blank(F.regexp_extract("_b", pattern, 1)).alias(name) for name, pattern in cells.items()],
    )


# --- sections and page kinds --------------------------------------------------------------


def section_text(html: Column | str, tag: str, css_class: str | None = None) -> Column:
    """Text of the first matching element, its text nodes joined by one space."""
    if css_class is None:
        start = rf"<{tag}(?:\s[^>]*)?>"
    else:
        start = rf'<{tag}\s[^>]*class="(?:[^"]*\s)?{css_class}(?:\s[^"]*)?"[^>]*>'
    block = F.regexp_extract(html, rf"(?s){start}(.*?)</{tag}>", 1)
    return F.trim(F.regexp_replace(F.regexp_replace(block, r"(?s)<[^>]*>", " "), r"\s+", " "))


def kind_by_phrase(html: Column | str, phrases: dict[str, str], otherwise: str, ignore_case: bool = False) -> Column:
    """Name of the first phrase found on the page."""
    html = c._col(html)
    html = F.lower(html) if ignore_case else html
    out = F.when(F.lit(False), F.lit(otherwise))
    for kind, phrase in phrases.items():
        out = out.when(html.contains(phrase.lower() if ignore_case else phrase), kind)
    return out.otherwise(otherwise)


def fields_by_kind(kind: Column, sources: dict[str, dict[str, Column]]) -> dict[str, Column]:
    """For each field, the source its page kind names; any other kind leaves a blank."""
    out = {}
    for field, by_kind in sources.items():
        value = F.when(F.lit(False), F.lit(" "))
        for name, source in by_kind.items():
            value = value.when(kind == name, c.null_to_blank(source))
        out[field] = value.otherwise(F.lit(" "))
    return out


def has_no_reviews(html: Column | str, phrases: Sequence[str] = tuple(NO_REVIEW_PHRASES)) -> Column:
    return c.contains_any(html, phrases)


GENERIC_NAME = r'<h3[^>]*class="drug-generic-name"[^>]*>\s*<a[^>]*>([^<]*)</a>'
SECTION_PARAGRAPH = r"(?s)<p(?:\s[^>]*)?>([^<]*)"


def brand_and_generic(html: Column | str) -> dict[str, Column]:
    """BrandName and GenName of a drug page by the phrases of its heading."""
    kind = kind_by_phrase(html, HEADING_PHRASES, "none", ignore_case=True)
    names = F.regexp_extract_all(c._col(html), F.lit(GENERIC_NAME), 1)
    first, second = F.get(names, F.lit(0)), F.get(names, F.lit(1))
    return fields_by_kind(kind, {
        "BrandName": {"brand and generic": first},
        "GenName": {"brand and generic": second, "generic only": first},
    })


def contraindications(html: Column | str) -> dict[str, Column]:
    """AvoidUse and Allergies of a page: the second and third paragraph of its section, by what
    the page says it lists."""
    section = F.regexp_extract(c._col(html), r"(?s)<section(?:\s[^>]*)?>(.*?)</section>", 1)
    paragraphs = F.regexp_extract_all(section, F.lit(SECTION_PARAGRAPH), 1)
    second, third = F.get(paragraphs, F.lit(1)), F.get(paragraphs, F.lit(2))
    kind = kind_by_phrase(html, AVOID_PHRASES, "other")
    return fields_by_kind(kind, {"AvoidUse": {"conditions": second}, "Allergies": {"conditions": third, "allergies": second}})


def ratings_or_blank(html: Column | str, ratings: dict[str, Column], reviews: Column) -> dict[str, Column]:
    """Rating fields and review list of a page; blanks and no review where it says there are none."""
    empty = has_no_reviews(html)
    fields = {name: F.when(empty, F.lit(" ")).otherwise(c.null_to_blank(value)) for name, value in ratings.items()}
    return {**fields, "Reviews": F.when(empty, F.slice(reviews, 1, 0)).otherwise(reviews)}


def page_id_number(html: Column | str, parameter: str = "drugid") -> Column:
    return c.blank_to_null(F.regexp_extract(F.lower(c._col(html)), rf"{parameter}=(\d+)", 1))


def number_at(values: Column, position: int, pattern: str = r"(\d+\.?\d*)") -> Column:
    """First number in the list item at a position; blank when item or number is missing."""
    return c.null_to_blank(F.regexp_extract(F.get(values, F.lit(position)), pattern, 1))


def build_url(base: str, **parameters: Column | str) -> Column:
    parts = [F.lit(base + "?")]
    for i, (name, value) in enumerate(parameters.items()):
        value = F.lit(value) if isinstance(value, str) else value.cast("string")
        parts += [F.lit(("&" if i else "") + name + "="), value]
    return F.concat(*parts)


# --- entities and the review feed ---------------------------------------------------------


_ENTITY_BUCKETS = 512
_REFERENCE = r"^(#[0-9]+|#[xX][0-9A-Fa-f]+|[A-Za-z][A-Za-z0-9]*);"


def named_entities() -> dict[str, str]:
    """All names of the HTML standard that end with a semicolon, without it."""
    return {name[:-1]: char for name, char in html5.items() if name.endswith(";")}


def _named(name: Column) -> Column:
    """Character of a name or null. One small map per bucket, since a lookup walks through its map."""
    buckets: list[dict[str, str]] = [{} for _ in range(_ENTITY_BUCKETS)]
    for known, char in named_entities().items():
        buckets[zlib.crc32(known.encode()) % _ENTITY_BUCKETS][known] = char
    table = F.from_json(F.lit(json.dumps(buckets)), "array<map<string, string>>")
    return F.try_element_at(F.get(table, (F.crc32(F.encode(name, "UTF-8")) % _ENTITY_BUCKETS).cast("int")), name)


def _code_point(number: Column) -> Column:
    """Character of a code point; the replacement character where there is none."""
    none = (number == 0) | (number > 0x10FFFF) | number.between(0xD800, 0xDFFF)
    sure = F.when(none, F.lit(0xFFFD)).otherwise(number)
    return F.decode(F.unhex(F.lpad(F.hex(sure), 8, "0")), "UTF-32")


def _decoded(piece: Column) -> Column:
    """A piece behind an ampersand with its reference replaced."""
    name = F.regexp_extract(piece, _REFERENCE, 1)
    rest = F.substr(piece, F.length(name) + 2)
    # Only the last digits count, so that any number of leading zeros can be read.
    hexadecimal = F.conv(F.right(F.concat(F.lit("0000000"), F.substr(name, F.lit(3))), F.lit(8)), 16, 10).cast("bigint")
    decimal = F.right(F.concat(F.lit("0000000"), F.substr(name, F.lit(2))), F.lit(9)).try_cast("bigint")
    char = F.when(F.lower(F.substr(name, F.lit(1), F.lit(2))) == "#x", _code_point(hexadecimal))
    char = char.when(name.startswith("#"), _code_point(decimal)).otherwise(_named(name))
    return F.coalesce(F.concat(char, rest), F.concat(F.lit("&"), piece))


def unescape(text: Column | str) -> Column:
    """Decode named and numeric references and drop CDATA marks, in one pass: the text is split at
    its ampersands, and every piece is decoded once."""
    out = F.replace(F.replace(c._col(text), F.lit("<![CDATA["), F.lit("")), F.lit("]]>"), F.lit(""))
    pieces = F.split(out, "&")
    later = F.transform(F.slice(pieces, F.lit(2), F.size(pieces)), _decoded)
    return F.concat(F.get(pieces, F.lit(0)), F.array_join(later, ""))


def xml_reviews(xml: Column | str, expected: Column, element: str = "review", tags: dict[str, str] = REVIEW_TAGS) -> Column:
    """Review list of an XML feed: a field without text is null, short feeds are padded.

    Fields are read within their review element, so an absent one does not shift the others.
    """
    fields = ", ".join(f"{tag}: string" for tag in tags.values())
    parsed = F.from_xml(
        c._col(xml),
        f"{element} array<struct<{fields}>>",
        {"ignoreSurroundingSpaces": "false", "mode": "PERMISSIVE"},
    )[element]
    named = F.transform(
        F.coalesce(parsed, F.array().cast(f"array<struct<{fields}>>")),
        lambda r: F.struct(*[c.blank_to_null(r[tag]).alias(name) for name, tag in tags.items()]),
    )
    empty = F.struct(*[F.lit(None).cast("string").alias(name) for name in tags])
    return pad_array(named, expected, empty)


# --- records ------------------------------------------------------------------------------


def assemble(listing: DataFrame, *details: tuple[DataFrame, str]) -> DataFrame:
    """Fields found on successive pages joined into one record by their keys."""
    out = listing
    for table, key in details:
        out = out.join(table, key, "left")
    return out


def listed_details(listing: DataFrame, details: DataFrame, key: str) -> DataFrame:
    """Details repeated for every listing row that names them."""
    return listing.join(details, key)
