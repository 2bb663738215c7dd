"""Date text: recognition, closed-list parsing and formatting."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidymill.functions.text import strip

# y/m/d, y-m-d or y年m月d日 with optional time; ranges are checked, month lengths are not.
_MONTH = r"(?:0?[1-9]|1[0-2])"
_DAY = r"(?:0?[1-9]|[12]\d|3[01])"
_TIME = r"(?:[ T](?:[01]?\d|2[0-3]):[0-5]\d(?::[0-5]\d)?)?"
DATE_TEXT = rf"^\d{{4}}(?:[/-]{_MONTH}[/-]|年{_MONTH}月){_DAY}日?{_TIME}$"

# Label -> marker character of a date style.
DATE_STYLES = {"slash": "/", "dash": "-", "cn": "年"}

# Output tokens and the matching Spark pattern letters.
_FORMAT_TOKENS = {
    "YYYY": "yyyy",
    "MM": "MM",
    "DD": "dd",
    "%Y": "yyyy",
    "%y": "yy",
    "%m": "MM",
    "%d": "dd",
    "%H": "HH",
    "%M": "mm",
    "%S": "ss",
}


def date_shaped(text: Column) -> Column:
    """``is_date_text`` for trimmed text; the length test spares most texts the pattern."""
    return F.length(text).between(8, 20) & text.rlike(DATE_TEXT)


def is_date_text(col: Column) -> Column:
    return date_shaped(strip(col))


def date_style(col: Column, style: str) -> Column:
    """Whether a text contains the marker of ``slash``, ``dash`` or ``cn``."""
    return strip(col).contains(DATE_STYLES[style])


def parse_date(col: Column) -> Column:
    """Date text to TIMESTAMP_NTZ; null for anything else and for impossible days (2026-02-31)."""
    text = strip(col)
    iso = F.translate(text, "/年月日", "---")  # the fourth character has no partner: it is removed
    return F.when(date_shaped(text), iso.try_cast("timestamp_ntz"))


# English months by their first three letters.
_MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
_MONTH_NAME = r"([A-Za-z]{3,9})\.?"
_NAMED = (rf"^{_MONTH_NAME} +(\d{{1,2}}),? +(\d{{4}})$", rf"^(\d{{1,2}}) +{_MONTH_NAME},? +(\d{{4}})$")
_SHORT = rf"^(\d{{1,2}})([/.-])(\d{{1,2}})\2(\d{{4}})({_TIME})$"
_DOTTED = rf"^(\d{{4}})\.(\d{{1,2}})\.(\d{{1,2}})({_TIME})$"
_DIGITS = r"^(\d{4})(\d{2})(\d{2})$"


def day_first(col: Column) -> Column:
    """Aggregate: whether the whole column writes the day before the month, by the parts that cannot be a month."""
    text = strip(col)
    first, second = (F.regexp_extract(text, _SHORT, i).try_cast("int") > 12 for i in (1, 3))
    return F.count_if(first) > F.count_if(second)


def parse_any_date(col: Column, day_comes_first: Column | None = None) -> Column:
    """Date text in more ways: also 20260901, 2026.9.1, 9/1/2026 and Sep 1, 2026.

    Of two short numbers before a year the first is the month, or the day where ``day_comes_first``; a text that is a
    date only the other way round is read that way.
    """
    text = strip(col)

    def part(pattern: str, i: int) -> Column:
        return F.regexp_extract(text, pattern, i)

    def date(year: Column, month: Column, day: Column, time: Column | None = None) -> Column:
        joined = F.concat_ws("-", year, month, day)
        return (joined if time is None else F.concat(joined, time)).try_cast("timestamp_ntz")

    def named(pattern: str, month: int, day: int) -> Column:
        listed = F.array(*(F.lit(m) for m in _MONTHS))
        place = F.array_position(listed, F.lower(F.substring(part(pattern, month), 1, 3)))
        return F.when(place > 0, date(part(pattern, 3), place.cast("string"), part(pattern, day)))

    one, two = (date(part(_SHORT, 4), part(_SHORT, m), part(_SHORT, d), part(_SHORT, 5)) for m, d in ((1, 3), (3, 1)))
    short = F.coalesce(one, two)
    if day_comes_first is not None:
        short = F.when(day_comes_first, F.coalesce(two, one)).otherwise(short)
    return (
        F.when(date_shaped(text), parse_date(col))
        .when(text.rlike(_DIGITS), date(*(part(_DIGITS, i) for i in (1, 2, 3))))
        .when(text.rlike(_DOTTED), date(*(part(_DOTTED, i) for i in (1, 2, 3, 4))))
        .when(text.rlike(_SHORT), short)
        .when(text.rlike(_NAMED[0]), named(_NAMED[0], 1, 2))
        .when(text.rlike(_NAMED[1]), named(_NAMED[1], 2, 1))
    )


def spark_pattern(output_format: str | None) -> str:
    """Translate ``YYYY-MM-DD`` or strftime codes into a Spark datetime pattern."""
    out, literal = [], ""

    def flush() -> str:
        quoted = literal.replace("'", "''")
        return f"'{quoted}'" if literal else ""

    for piece in re.findall(r"YYYY|MM|DD|%[A-Za-z]|.", output_format or "YYYY-MM-DD", re.S):
        if piece in _FORMAT_TOKENS:
            out += [flush(), _FORMAT_TOKENS[piece]]
            literal = ""
        elif len(piece) == 2:
            raise ValueError(f"a date format cannot hold {piece!r}")
        else:
            literal += piece
    return "".join([*out, flush()])


def format_date(col: Column, output_format: str | None = None, day_comes_first: Column | None = None) -> Column:
    """Date text in the wanted format; texts that do not parse are kept unchanged."""
    return F.coalesce(F.date_format(parse_any_date(col, day_comes_first), spark_pattern(output_format)), col)


def parse_deadline(col: Column) -> Column:
    """Deadline text to TIMESTAMP_NTZ: a bare ten-character date ends at 23:59:59 of that day."""
    text = F.translate(strip(col), "/", "-")
    shape = rf"^\d{{4}}-\d{{1,2}}-\d{{1,2}}(?:[ T]\d{{1,2}}:\d{{1,2}}(?::\d{{1,2}}(?:\.\d{{1,6}})?)?)?$"
    when = F.when(text.rlike(shape), text.try_cast("timestamp_ntz"))
    return F.when(F.length(text) == 10, when + F.expr("INTERVAL '23:59:59' HOUR TO SECOND")).otherwise(
        when
    )
