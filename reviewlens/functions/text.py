"""Column functions over review text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import _col

# What separates words: ASCII white space and the Unicode spaces.
SPACE_CLASS = r"\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
# The same class in few parts: a regex tests the parts of a class one by one at every character.
_SPACE = r"\p{Z}\x09-\x0d\x1c-\x1f\x85"
SPACES = f"[{_SPACE}]+"


def tokens(text: Column | str) -> Column:
    return F.array_remove(F.split(_col(text), SPACES), "")


def word_count(text: Column | str) -> Column:
    return F.size(tokens(text))


def letters_only(text: Column | str) -> Column:
    """Lower case, without punctuation and digits."""
    return F.regexp_replace(F.lower(_col(text)), rf"[^\p{{L}}\p{{Nl}}\p{{No}}_{_SPACE}]+", "")


def without_words(token_array: Column, words: Sequence[str]) -> Column:
    return F.filter(token_array, lambda t: ~t.isin(list(words)))


def clean_text(text: Column | str, stop_words: Sequence[str]) -> Column:
    """Lower case, no punctuation, no digits, no stop words, single spaces."""
    return F.array_join(without_words(tokens(letters_only(text)), stop_words), " ")


def _listed(words: Sequence[str]) -> str:
    """Words as a SQL list: one parse instead of a call per word."""
    quoted = (w.replace("\\", "\\\\").replace("'", "\\'") for w in words)
    return ", ".join(f"'{w}'" for w in quoted) or "NULL"


def known_or_null(array: str, words: Sequence[str]) -> Column:
    """The tokens of an array column, null in place of those not listed."""
    return F.expr(f"transform(`{array}`, t -> CASE WHEN t IN ({_listed(words)}) THEN t END)")


def positions_of(array: str, words: Sequence[str]) -> Column:
    """`(i, t)` of the tokens listed, with their position in the array column."""
    return F.expr(f"array_compact(transform(`{array}`, (t, i) -> CASE WHEN t IN ({_listed(words)}) THEN struct(i AS i, t AS t) END))")


def adjacent_pairs(token_array: Column) -> Column:
    """`(a, b)` for every token and its right neighbour; the last one has none. Made within the
    row, without a shuffle."""
    following = F.slice(token_array, 2, F.greatest(F.size(token_array) - 1, F.lit(0)))
    return F.arrays_zip(token_array.alias("a"), following.alias("b"))


def ngrams(token_array: Column, n: int) -> Column:
    """Runs of n tokens joined by a space; null where a token is null."""
    count = F.greatest(F.size(token_array) - (n - 1), F.lit(0))
    columns = [F.slice(token_array, k + 1, count) for k in range(n)]
    joined = columns[0]
    for other in columns[1:]:
        joined = F.zip_with(joined, other, lambda a, b: F.concat(a, F.lit(" "), b))
    return joined
