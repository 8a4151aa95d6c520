"""Mixed-format date parsing as a bounded list of shapes.

Each shape is recognised by one pattern and rewritten to ``y-M-d``, so a value
meets one cast and no formatter. An optional time of day (24 hours, or 12 with
AM or PM, with or without a zone) and the weekday are accepted and dropped. A value whose month cannot be one is read the other way round.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, functions as F, types as T

from .text import bind, strip_cell

_MINUTES = r":[0-5]\d(?::[0-5]\d(?:\.\d+)?)?"
_ZONE = r"(?: ?(?:Z|UTC|GMT|[-+]\d{2}:?\d{2}))?"
CLOCK = (r"(?:(?:T|,? +)(?:(?:0?[1-9]|1[0-2])(?:" + _MINUTES + r")? ?(?i:[ap]m)|(?:[01]?\d|2[0-3])"
         + _MINUTES + r")" + _ZONE + r")?")
YEAR_FIRST = r"^(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})" + CLOCK + "$"
NUMBERS = r"^(\d{1,2})[-/.](\d{1,2})[-/.](\d{4}|\d{2})" + CLOCK + "$"
COMPACT = r"^(\d{4})(\d{2})(\d{2})$"
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
MONTH_NAME = (r"(jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?"
              r"|sept?(?:ember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)")
WEEKDAY = (r"(?:(?:mon|tue(?:s)?|wed(?:nes)?|thu(?:rs)?|fri|sat(?:ur)?|sun)(?:day)?\.?,?\s+)?")
_ORDINAL = r"(?:st|nd|rd|th)?"
DAY_NAME = (r"(?i)^" + WEEKDAY + r"(\d{1,2})" + _ORDINAL + r"(?:\s+of\b)?[\s\-/.]+" + MONTH_NAME
            + r"\.?,?[\s\-/.]+(\d{4}|\d{2})" + CLOCK + "$")
NAME_DAY = (r"(?i)^" + WEEKDAY + MONTH_NAME + r"\.?[\s\-/.]+(\d{1,2})" + _ORDINAL
            + r",?[\s\-/.]+(\d{4}|\d{2})" + CLOCK + "$")
# --- fixed value: what the profile takes for a possible date --------------------
DATE_ISH = r"(?i)[-/.:]|\b(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)"


def looks_datelike(c: Column) -> Column:
    return F.coalesce(c.rlike(DATE_ISH), F.lit(False))


_SHAPES = "|".join(f"(?:{p})" for p in (YEAR_FIRST, NUMBERS, DAY_NAME, NAME_DAY))


def has_shape(c: Column, datelike: Column) -> Column:
    """Whether ``parse_date`` knows the text's shape: without it there is no date. All
    shapes but the compact one hold what ``looks_datelike`` looks for."""
    s = strip_cell(c)
    return F.coalesce(F.when(datelike, s.rlike(_SHAPES)).otherwise(s.rlike(COMPACT)), F.lit(False))


def _full_year(y: Column, this_year: int) -> Column:
    """Two digits mean the year within fifty of this one."""
    century = this_year // 100 * 100
    near = y.cast("int") + century
    near = (F.when(near >= this_year + 50, near - 100)
            .when(near < this_year - 50, near + 100).otherwise(near))
    return F.when(F.length(y) == 2, near.cast("string")).otherwise(y)


def _ymd(y: Column, m: Column, d: Column) -> Column:
    return F.concat_ws("-", y, m, d).try_cast("date")


def parse_date(c: Column, dtype: T.DataType = T.StringType(), dayfirst: bool = True,
               this_year: int | None = None, is_tidy: bool = False) -> Column:
    """Text to date; anything unreadable is null. Typed dates pass through."""
    if isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return c.cast("date")
    this_year = this_year or dt.date.today().year
    s = c if is_tidy else strip_cell(c)

    def numeric_day(t):
        # one separator: the day part is cut at its dashes
        day = F.translate(F.regexp_extract(t, r"^[\d/.-]+", 0), "/.", "--")
        first = F.substring_index(day, "-", 1)
        second = F.substring_index(F.substring_index(day, "-", 2), "-", -1)
        year = _full_year(F.substring_index(day, "-", -1), this_year)
        ways = (_ymd(year, second, first), _ymd(year, first, second))
        return F.coalesce(*(ways if dayfirst else reversed(ways)))

    def named_day(t):
        def build(pattern, y, m, d):
            short = F.lower(F.substring(F.regexp_extract(t, pattern, m), 1, 3))
            month = F.array_position(F.array(*[F.lit(x) for x in MONTHS]), short)
            return _ymd(_full_year(F.regexp_extract(t, pattern, y), this_year),
                        month.cast("string"), F.regexp_extract(t, pattern, d))
        return (F.when(t.rlike(DAY_NAME), build(DAY_NAME, y=3, m=2, d=1))
                .when(t.rlike(NAME_DAY), build(NAME_DAY, y=3, m=1, d=2)))

    # A date with a time of day has twelve bytes at least.
    day = F.when(F.octet_length(s) <= 10, s).otherwise(F.regexp_extract(s, r"^[\d/.-]+", 0))
    year_first = F.translate(day, "/.", "--")
    return (
        F.when(s.rlike(YEAR_FIRST), year_first.try_cast("date"))
        .when(s.rlike(NUMBERS), bind(s, numeric_day))
        .when(s.rlike(COMPACT), F.regexp_replace(s, COMPACT, "$1-$2-$3").try_cast("date"))
        .when(s.rlike("(?i)jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec"),
              bind(s, named_day))
    )


def iso_text(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd")
