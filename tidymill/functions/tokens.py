"""Number tokens in prose and their canonical form."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidymill.functions.text import number_text

_WS = r"[\s\x{a0}\x{3000}]"

# Token kinds in priority order (CJK date, numeric date, thousands, plain).
NUMBER_TOKEN = (
    rf"\d{{4}}{_WS}*年{_WS}*\d{{1,2}}{_WS}*月{_WS}*\d{{1,2}}{_WS}*日?"
    r"|\d{4}[-/]\d{1,2}[-/]\d{1,2}"
    r"|\d{1,3}(?:,\d{3})+(?:\.\d+)?"
    r"|\d+(?:\.\d+)?(?:%|％|倍)?"
)


# a digit ahead: other characters are passed over without trying each kind
NUMBER_SCAN = rf"(?=\d)(?:{NUMBER_TOKEN})"


def number_tokens(text: Column) -> Column:
    """Array of number tokens of a text, in order of appearance."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(NUMBER_SCAN), F.lit(0))


def canon_token(token: Column, *, padded_dates: bool = False) -> Column:
    """Canonical form: ``date:<digits>`` or ``num:<value>``.

    A CJK date written without a blank after the year stays ``num:<text>``. The default joins
    date digits as they stand, so 2026-1-11 and 2026-11-1 coincide; ``padded_dates=True`` pads
    month and day to two digits and tells them apart.
    """
    tok = F.trim(token)
    is_date = tok.rlike(rf"^\d{{4}}(?:[-/]|{_WS}+年)")
    digits = F.regexp_replace(tok, r"[^0-9]", "")
    if padded_dates:
        parts = F.regexp_extract_all(tok, F.lit(r"\d+"), F.lit(0))
        digits = F.concat(
            parts[0],
            F.lpad(F.element_at(parts, 2), 2, "0"),
            F.lpad(F.element_at(parts, 3), 2, "0"),
        )
    bare = F.regexp_replace(F.translate(tok, ",", ""), rf"{_WS}*(?:%|％|倍){_WS}*$", "")
    value = bare.try_cast("double")
    as_text = (
        F.when(~bare.rlike(r"^\d+(?:\.\d+)?$"), bare)
        .when(F.abs(value) < 1e15, number_text(value))
        # Beyond 1e15 the digits themselves are the value: drop leading zeros and a zero fraction.
        .otherwise(F.regexp_replace(bare, r"^0+(?=\d)|\.0+$", ""))
    )
    return F.when(is_date, F.concat(F.lit("date:"), digits)).otherwise(
        F.concat(F.lit("num:"), as_text)
    )
