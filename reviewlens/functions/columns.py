"""Column functions over ratings, names, labels and scores. All are built-in expressions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..dims import DATE_POSTED_FORMAT


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def first_of(columns: Sequence[Column]) -> Column:
    return F.coalesce(*columns)


# --- blanks and numbers -------------------------------------------------------------------


def blank_to_null(c: Column | str) -> Column:
    """Blank text is missing text."""
    c = _col(c)
    return F.when(F.trim(c) != "", c)


def null_to_blank(c: Column | str) -> Column:
    """The opposite, as crawled records are written: one space stands for missing."""
    c = _col(c)
    return F.when(c.isNull() | (c == ""), F.lit(" ")).otherwise(c)


def nan_to_null(c: Column | str) -> Column:
    c = _col(c)
    return F.when(~F.isnan(c), c)


def to_double(c: Column | str) -> Column:
    return nan_to_null(blank_to_null(c).try_cast("double"))


def to_long(c: Column | str) -> Column:
    return blank_to_null(c).try_cast("bigint")


def digits_to_long(c: Column | str) -> Column:
    return F.regexp_replace(_col(c), "[^0-9]", "").try_cast("bigint")


def row_mean(*columns: Column | str) -> Column:
    """Mean of the values present; null when none is."""
    cols = [_col(c) for c in columns]
    total = reduce(lambda a, b: a + b, [F.coalesce(c.cast("double"), F.lit(0.0)) for c in cols])
    present = reduce(lambda a, b: a + b, [c.isNotNull().cast("int") for c in cols])
    return F.try_divide(total, present)


def row_mean_strict(*columns: Column | str) -> Column:
    """Mean that is null as soon as one value is."""
    cols = [_col(c).cast("double") for c in columns]
    return reduce(lambda a, b: a + b, cols) / len(cols)


def round_half_even(c: Column | str, places: int = 2) -> Column:
    """Scaled, rounded to the nearest even whole and scaled back, as array libraries round."""
    scale = float(10**places)
    return F.rint(_col(c).cast("double") * scale) / scale


def truncate_to_int(c: Column | str) -> Column:
    return _col(c).cast("int")


# --- flags, dates, labels -----------------------------------------------------------------


def text_to_bool(c: Column | str) -> Column:
    c = _col(c)
    return F.when(c == "True", True).when(c == "False", False)


def bool_label(c: Column | str, yes: str = "Male", no: str = "Female") -> Column:
    c = _col(c)
    return F.when(c.cast("boolean"), yes).when(~c.cast("boolean"), no)


def parse_posted(c: Column | str) -> Column:
    return F.try_to_timestamp(_col(c), F.lit(DATE_POSTED_FORMAT))


def posted_parts(millis: Column | str) -> dict[str, Column]:
    """Timestamp, year, month and the unpadded year-month label of epoch milliseconds."""
    ts = F.timestamp_millis(_col(millis))
    year, month = F.year(ts), F.month(ts)
    return {
        "DatePosted": ts,
        "YearPosted": year,
        "MonthPosted": month,
        "YearMonthPosted": F.concat(year.cast("string"), F.lit("-"), month.cast("string")),
    }


def remap(c: Column | str, mapping: dict[str, str]) -> Column:
    c = _col(c)
    return first_of([F.when(c == old, F.lit(new)) for old, new in mapping.items()] + [c])


def with_suffix(c: Column | str, suffix: str) -> Column:
    return F.concat(_col(c), F.lit(suffix))


def truncate_label(c: Column | str, longer_than: int, keep: int) -> Column:
    c = _col(c)
    return F.when(F.length(c) > longer_than, F.concat(F.substring(c, 1, keep), F.lit("..."))).otherwise(c)


def labelled_text(parts: dict[str, Column], separator: str = "<br>") -> Column:
    return F.concat_ws(
        separator, *[F.concat(F.lit(f"{label}: "), F.coalesce(c, F.lit("null"))) for label, c in parts.items()]
    )


# --- dictionary matching ------------------------------------------------------------------
# The dictionary is a short constant kept as one array literal, so the expression stays small
# however many names there are, and matches follow dictionary order, which a
# regular-expression alternation would not.


def _names(names: Sequence[str]) -> Column:
    return F.array(*[F.lit(n) for n in names])


def contains_any(c: Column | str, names: Sequence[str]) -> Column:
    c = _col(c)
    return F.coalesce(F.exists(_names(names), lambda n: c.contains(n)), F.lit(False))


def simplify_name(c: Column | str, names: Sequence[str]) -> Column:
    c = _col(c)
    return F.coalesce(F.get(F.filter(_names(names), lambda n: c.contains(n)), F.lit(0)), c)


def backfill_name(generic: Column | str, drug: Column | str, names: Sequence[str]) -> Column:
    generic, drug = _col(generic), _col(drug)
    missing = generic.isNull() | (F.trim(generic) == "")
    return F.when(missing & contains_any(drug, names), drug).otherwise(generic)


def generic_name(generic: Column | str, drug: Column | str, names: Sequence[str]) -> Column:
    return simplify_name(backfill_name(generic, drug, names), names)


# --- scores -------------------------------------------------------------------------------


def band3(score: Column | str, low: float, high: float) -> Column:
    """negative / neutral / positive; a missing score is neutral."""
    s = nan_to_null(_col(score).cast("double"))
    return (
        F.when(s.isNull(), "neutral").when(s <= low, "negative").when(s >= high, "positive").otherwise("neutral")
    )


def softmax(*logits: Column | str) -> list[Column]:
    cols = [_col(c).cast("double") for c in logits]
    top = F.greatest(*cols)
    exps = [F.exp(c - top) for c in cols]
    total = reduce(lambda a, b: a + b, exps)
    return [e / total for e in exps]


def compound(positive: Column | str, negative: Column | str) -> Column:
    return _col(positive) - _col(negative)
