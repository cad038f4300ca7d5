"""Dates as ``YYYY-MM`` and ``YYYY`` strings; what names no year is null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kinweave.functions.text import YEAR, bind, strip

# Words for a time that has not ended.
PRESENT = ("present", "current", "now", "ongoing", "till date", "to date")
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
FULL_MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
WEEKDAYS = ("mon", "tue", "wed", "thu", "fri", "sat", "sun", "monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday", "tues", "wednes", "thur", "thurs", "satur")
#: Words that may stand in a date and say nothing.
FILLERS = ("of", "the", "on", "in", "ad")
TIME = r"[t\s]+\d{1,2}:\d{2}(?::\d{2}(?:[.,]\d+)?)?\s*(?:[ap]m)?\s*(?:z|utc|gmt|[+-]\d{2}:?\d{2})?$"


def _ym(year: Column, month: Column) -> Column:
    return F.when(month.between(1, 12), F.concat(year, F.lit("-"), F.lpad(month.cast("string"), 2, "0")))


def _month_number(name: Column) -> Column:
    out = F.lit(None).cast("int")
    for n, m in enumerate(MONTHS, 1):
        out = F.when(name == m, F.lit(n)).otherwise(out)
    return out


def _month_name(number: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, FULL_MONTHS)), number)


def to_year_month(c: str | Column) -> Column:
    """``YYYY-MM``; null for blank, present or unreadable values.

    ``YYYY-M...`` is taken as written, month unchecked; a bare year is its January.
    Other dates may have their year, month (by name or number), day, weekday and
    time in any order that leaves no doubt.  What names no year, or a part
    that is no part of a date, is null: nothing is filled in.
    """
    return bind(F.lower(strip(c)), _year_month)


def _year_month(s: Column) -> Column:
    dashed = r"^(\d{4})-(\d{1,2})"
    month = F.lpad(F.regexp_extract(s, dashed, 2).cast("int").cast("string"), 2, "0")
    return (
        F.when((s == "") | s.isin(*PRESENT), F.lit(None).cast("string"))
        .when(s.rlike(dashed), F.concat(F.regexp_extract(s, dashed, 1), F.lit("-"), month))
        .when(s.rlike(r"^\d{4}$"), F.concat(s, F.lit("-01")))
        .when(s.rlike(r"\d{4}"), bind(_tokens(s), lambda words: bind(F.aggregate(words, F.expr(_START), _read), _written)))
    )


def _tokens(s: Column) -> Column:
    """The words and numbers of a date, without its time of day and the endings of ordinals."""
    s = F.regexp_replace(F.regexp_replace(s, TIME, ""), r"(\d)(?:st|nd|rd|th)\b", "$1")
    s = F.regexp_replace(s, r"^(\d{4})(\d{2})(\d{2})$", "$1 $2 $3")
    s = F.regexp_replace(s, r"(?<=\d)(?=[a-z])|(?<=[a-z])(?=\d)", " ")
    return F.filter(F.split(s, r"[\s,./\-]+"), lambda w: w != "")


#: What has been read of a date: its year, how many numbers stand before it, a named month, the other numbers, and whether a token doesn't fit.
_START = "struct(cast(null as string) as year, cast(null as int) as before, cast(null as int) as month, cast(array() as array<int>) as numbers, false as odd)"


def _read(state: Column, word: Column) -> Column:
    """The state after a token: a year of four digits, a month by name, a number, a word that says nothing; anything else fits no date."""
    is_year, is_number = word.rlike(r"^\d{4}$"), word.rlike(r"^\d{1,2}$")
    month = F.when(word.rlike("^[a-z]{3,9}$"), _month_number(F.left(word, F.lit(3))))
    is_month = F.coalesce(F.startswith(_month_name(month), word) | (word == "sept"), F.lit(False))
    fine = (is_year & state["year"].isNull()) | (is_month & state["month"].isNull()) | is_number | word.isin(*WEEKDAYS, *FILLERS)
    return F.struct(
        F.when(is_year, word).otherwise(state["year"]).alias("year"),
        F.when(is_year, F.size(state["numbers"])).otherwise(state["before"]).alias("before"),
        F.when(is_month, month).otherwise(state["month"]).alias("month"),
        F.when(is_number, F.concat(state["numbers"], F.array(word.try_cast("int")))).otherwise(state["numbers"]).alias("numbers"),
        (state["odd"] | ~fine).alias("odd"),
    )


def _written(read: Column) -> Column:
    """``YYYY-MM`` of what was read; null if a part is missing, stands in doubt or is no month or day."""
    numbers, before = read["numbers"], read["before"]
    n, a, b = F.size(numbers), F.get(numbers, F.lit(0)), F.get(numbers, F.lit(1))
    is_day = lambda x: x.between(1, 31)
    # Two numbers on one side of the year: month first, unless only the second can be one.
    month = F.when(a > 12, b).otherwise(a)
    day = F.when(a > 12, a).otherwise(b)
    return F.when(~read["odd"] & read["year"].isNotNull(), (
        F.when(read["month"].isNotNull() & (n == 0), _ym(read["year"], read["month"]))
        .when(read["month"].isNotNull() & (n == 1) & is_day(a), _ym(read["year"], read["month"]))
        .when(read["month"].isNull() & (n == 1), _ym(read["year"], a))
        .when(read["month"].isNull() & (n == 2) & before.isin(0, 2) & is_day(day), _ym(read["year"], month))
    ))


def to_year(c: str | Column) -> Column:
    """The first year from 1900 to 2099 in the value; null for blank or present values."""
    s = strip(c)
    return F.when(~F.lower(s).isin(*PRESENT), F.nullif(F.regexp_extract(s, YEAR, 0), F.lit("")))
