"""Text rules shared by every operator: trimming, missing values, numbers and shape tests.

All functions take and return ``Column`` objects built from Spark SQL expressions, so they stay
inside whole-stage code generation and work on batch and streaming frames alike.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Texts that count as "no value" after trimming and lower-casing.
MISSING_TEXTS = ("", "na", "n/a", "null", "none", "--", "-")

# The characters Python's str.strip removes.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# Shape patterns (ASCII digits only).
INTEGER = r"^[+-]?\d+$"
FLOAT = r"^[+-]?(?:\d+\.\d*|\.\d+)$"
THOUSANDS = r"^[+-]?\d{1,3}(?:,\d{3})+(?:\.\d+)?$"
BOOLEAN = r"^(?i:true|false|yes|no|y|n|是|否)$"
PHONE = r"^\d{11}$"
IDCARD = r"^\d{17}[\dXx]$"

# What counts as a number once commas are gone; keeps '1d', 'inf' and 'NaN' out of the cast.
NUMBER = r"^[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?$"


def strip(col: Column) -> Column:
    """Trim all Unicode white space on both sides (plain ``trim`` only removes U+0020)."""
    return F.btrim(col, F.lit(WHITESPACE))


def is_missing(col: Column) -> Column:
    """True for null and for the texts in ``MISSING_TEXTS``; never null itself."""
    return col.isNull() | F.lower(strip(col)).isin(*MISSING_TEXTS)


def to_number(col: Column) -> Column:
    """Parse text as DOUBLE, ignoring thousands commas; null when it is not a number."""
    return parse_number(strip(col))


def parse_number(text: Column) -> Column:
    """``to_number`` for text that is trimmed already."""
    bare = F.replace(text, F.lit(","), F.lit(""))
    number = bare.try_cast("double")
    return F.when(bare.rlike(NUMBER) & (F.abs(number) < float("inf")), number)


def is_integer(col: Column) -> Column:
    return strip(col).rlike(INTEGER)


def is_float(col: Column) -> Column:
    return strip(col).rlike(FLOAT)


def thousands_shaped(text: Column) -> Column:
    """``is_thousands`` for trimmed text; only texts with a comma meet the pattern."""
    return text.contains(",") & text.rlike(THOUSANDS)


def is_thousands(col: Column) -> Column:
    return thousands_shaped(strip(col))


def is_boolean(col: Column) -> Column:
    return strip(col).rlike(BOOLEAN)


def is_phone(col: Column) -> Column:
    return strip(col).rlike(PHONE)


def is_idcard(col: Column) -> Column:
    return strip(col).rlike(IDCARD)


# --- numbers back to text -------------------------------------------------------------------


def _is_whole(value: Column) -> Column:
    return (value == F.floor(value)) & (F.abs(value) < F.lit(1e15))


def _plain_decimal(value: Column) -> Column:
    """Up to six decimals without exponent and without trailing zeros."""
    fixed = F.round(value, 6).try_cast("decimal(38,6)").cast("string")
    return F.coalesce(F.rtrim(F.rtrim(fixed, F.lit("0")), F.lit(".")), value.cast("string"))


def tidy_number(value: Column) -> Column:
    """Round a DOUBLE to six decimals unless it is a whole number below 1e15."""
    return F.when(_is_whole(value), value).otherwise(F.round(value, 6))


def number_text(value: Column) -> Column:
    """The tidy number as text: ``1200`` rather than ``1200.0``, never an exponent."""
    return F.when(_is_whole(value), value.cast("bigint").cast("string")).otherwise(
        _plain_decimal(value)
    )


def format_value(value: Column) -> Column:
    """Thousands separators; whole numbers without tail, otherwise four decimals."""
    return F.when(_is_whole(value), F.format_number(value, 0)).otherwise(F.format_number(value, 4))


def cents(value: Column) -> Column:
    """Two decimals of the binary value, like printf's ``%.2f`` (``format_string`` rounds its shortest decimal form)."""
    return F.call_function("format_number", value, F.lit("0.00"))


def short_number(value: Column) -> Column:
    """Six significant digits, like printf's ``%g``: plain between 1e-4 and 1e6, else exponent."""
    scale = F.pow(F.lit(10.0), 5 - F.floor(F.log10(F.abs(value))).cast("double"))
    rounded = F.round(value * scale, 0) / scale
    size = F.floor(F.log10(F.abs(rounded))).cast("int")  # rounding may have added a digit
    plain = F.rtrim(
        F.rtrim(rounded.try_cast("decimal(38,12)").cast("string"), F.lit("0")), F.lit(".")
    )
    mantissa = _plain_decimal(F.round(rounded / F.pow(F.lit(10.0), size.cast("double")), 5))
    exponent = F.concat(
        F.lit("e"),
        F.when(size < 0, F.lit("-")).otherwise(F.lit("+")),
        F.lpad(F.abs(size).cast("string"), 2, "0"),
    )
    return (
        F.when(value == 0, F.lit("0"))
        .when((size >= -4) & (size < 6), plain)
        .otherwise(F.concat(mantissa, exponent))
    )
