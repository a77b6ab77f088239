"""Numbers and dates out of text. Rounding: `half_up` goes toward +infinity at .5, as the row rules do."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PREFIX = r"^[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?"


def prefix_number(c: Column) -> Column:
    """The number that the text starts with, else null."""
    # null for no match, as a cast of no text would raise an error inside; no lambda, as what stands in one is never generated code
    return F.try_element_at(F.regexp_extract_all(c, F.lit(PREFIX), F.lit(0)), F.lit(1)).try_cast("double")


def finite(c: Column) -> Column:
    """Trimmed, commas dropped, numeric prefix: '12 34kg' is 12, '.' and '-' are null."""
    return prefix_number(F.replace(F.trim(c), F.lit(","), F.lit("")))


def strict(c: Column) -> Column:
    """As finite, but text after the number makes it null."""
    return F.replace(F.trim(c), F.lit(","), F.lit("")).try_cast("double")


def half_up(c: Column, places: int = 0) -> Column:
    scale = 10**places
    return F.floor(c * scale + 0.5) / scale if places else F.floor(c + 0.5)


def integer(c: Column) -> Column:
    return half_up(finite(c)).cast("long")


def loose_or_null(c: Column) -> Column:
    """Digits, dots and minus signs only, then the numeric prefix."""
    return prefix_number(F.regexp_replace(c, r"[^\d.-]", ""))


def loose(c: Column) -> Column:
    return F.coalesce(loose_or_null(c), F.lit(0.0))


def digits(c: Column) -> Column:
    """All digits as one integer: '1.5' is 15 and '-3' is 3, as in the rule."""
    return F.nullif(F.regexp_replace(c, r"\D", ""), F.lit("")).try_cast("long")


#: A number with at most a currency sign before it and a unit behind it, as most cells have it.
PLAIN_CELL = r"(?i)^[¥￥]? ?([\d,]+(?:\.\d+)?) ?(?:PCS|CTNS?|KGS?|CBM|CM|MM)?$"


def cell(c: Column) -> Column:
    """A table cell's number without currency signs and unit words."""
    plain = F.replace(F.nullif(F.regexp_extract(c, PLAIN_CELL, 1), F.lit("")), F.lit(","), F.lit("")).try_cast("double")
    bare = F.regexp_replace(F.regexp_replace(c, "[¥￥,%]", ""), r"(?i)(?:PCS|CTNS?|KGS?|CBM|CM|MM)", "")
    return F.coalesce(plain, prefix_number(F.trim(bare)))


def weight(c: Column) -> Column:
    """'12.5KGS' is 12.5; null and text without a number are 0."""
    return F.coalesce(prefix_number(F.regexp_replace(F.coalesce(c, F.lit("0")), r"[^\d.]", "")), F.lit(0.0))


def iso_date(c: Column) -> Column:
    """yyyy-mm-dd from itself, dd/mm/yyyy or dd-mm-yyyy; else null."""
    t = F.trim(c)
    turned = F.regexp_replace(t, r"^(\d{2})[/-](\d{2})[/-](\d{4})$", "$3-$2-$1")
    return F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}$"), t).when(t.rlike(r"^\d{2}(?:/\d{2}/|-\d{2}-)\d{4}$"), turned)
