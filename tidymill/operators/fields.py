"""Field catalog: what the columns of a text table are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidymill.functions import dates as D
from tidymill.functions import text as T
from tidymill.operators.cells import band, cells, field_position, first_k, samples, small_side
from tidymill.sources.numbering import data_columns

SAMPLE_VALUES = 3

# Type labels, and the ones a user may choose.
TYPES = ("integer", "decimal", "date", "boolean", "text", "mixed")


def _shape_counts() -> dict[str, Column]:
    """How many non-missing cells have each shape."""
    value, filled = F.col("text"), ~F.col("missing")
    tests = {
        "ints": value.rlike(T.INTEGER),
        "floats": value.rlike(T.FLOAT),
        "thousands": T.thousands_shaped(value),
        "bools": value.rlike(T.BOOLEAN),
        "dates": D.date_shaped(value),
    }
    return {name: F.count_if(filled & test) for name, test in tests.items()}


def _counted(df: DataFrame, measures: dict[str, Column]) -> DataFrame:
    """Per column: position, missing count and rate, the first three raw values, and the given counts.

    One pass counts per column and band of row numbers; its totals and the bounds for the samples follow from it.
    """
    columns = data_columns(df)
    long = cells(df)
    banded = long.groupBy("field", band().alias("_band")).agg(
        F.count("*").alias("total"), F.count_if("missing").alias("missing_cnt"), *(c.alias(n) for n, c in measures.items())
    )
    counts = banded.groupBy("field").agg(*(F.sum(c).alias(c) for c in ("total", "missing_cnt", *measures)))
    filled = banded.select("field", "_band", (F.col("total") - F.col("missing_cnt")).alias("_n"))
    first = first_k(long.where(~F.col("missing")), ["field"], SAMPLE_VALUES, len(columns), filled)
    shown = samples(first, ["field"], "value", "sample_values")
    rate = F.round(F.col("missing_cnt") / F.col("total"), 4)
    return counts.join(small_side(shown, len(columns)), "field", "left").select(
        field_position(columns).alias("position"),
        F.col("field").alias("field_name"),
        "total",
        "missing_cnt",
        rate.alias("missing_rate"),
        F.coalesce("sample_values", F.array().cast("array<string>")).alias("sample_values"),
        *measures,
    )


def field_stats(df: DataFrame) -> DataFrame:
    """Per column: position, missing count, missing rate and the first three raw values."""
    return _counted(df, {}).drop("total")


def _label(n: Column, ints: Column, floats: Column, thousands: Column, bools: Column, dates: Column):
    """Ordered rules from shape counts to ``(label, hint)``."""
    numbers = ints + floats
    texts = n - numbers - bools - dates
    label = (
        F.when(n == 0, "text")
        .when(bools == n, "boolean")
        .when(dates == n, "date")
        .when(numbers == n, F.when(floats > 0, "decimal").otherwise("integer"))
        .when(thousands == n, "text")
        .when((numbers > 0) & (texts > 0), "mixed")
        .when((dates > 0) & (numbers + thousands == 0), "date")
        .otherwise("text")
    )
    hint = (
        F.when((n > 0) & (thousands == n), "suspected number")
        .when((label == "mixed") & (thousands > 0), "contains thousands text")
        .when(label == "date", "suspected date")
        .otherwise("")
    )
    return label, hint


def _labels(n: Column) -> tuple[Column, Column]:
    return _label(n, *[F.col(c) for c in ("ints", "floats", "thousands", "bools", "dates")])


def infer_types(df: DataFrame) -> DataFrame:
    """Label every column from the shapes of all its non-missing values."""
    columns = data_columns(df)
    counts = cells(df).where(~F.col("missing")).groupBy("field").agg(
        F.count("*").alias("n"), *(c.alias(n) for n, c in _shape_counts().items())
    )
    label, hint = _labels(F.col("n"))
    # a column without any value yields no row above: it is text
    names = F.explode(F.array(*[F.lit(c) for c in columns]))
    every = df.sparkSession.range(1).select(names.alias("field"))
    found = counts.select("field", label.alias("inferred_type"), hint.alias("hint"))
    return every.join(small_side(found, len(columns)), "field", "left").select(
        field_position(columns).alias("position"),
        F.col("field").alias("field_name"),
        F.coalesce("inferred_type", F.lit("text")).alias("inferred_type"),
        F.coalesce("hint", F.lit("")).alias("hint"),
    )


def table_stats(df: DataFrame) -> DataFrame:
    """Row and column count; a table without columns is an error."""
    columns = data_columns(df)
    if not columns:
        raise ValueError("a table without columns has no catalog")
    return df.agg(F.count("*").alias("row_count")).withColumn(
        "col_count", F.lit(len(columns)).cast("bigint")
    )


def display_types(fields: DataFrame, overrides: DataFrame) -> DataFrame:
    """User-chosen type if there is one (and it is a known label), else the inferred one."""
    chosen = overrides.where(F.col("manual_type").isin(*TYPES)).select("field_name", "manual_type")
    return fields.join(chosen, "field_name", "left").withColumn(
        "display_type", F.coalesce("manual_type", "inferred_type")
    )


def field_catalog(df: DataFrame) -> DataFrame:
    """Everything the catalog keeps about the columns of one table; shapes and gaps are counted together."""
    label, hint = _labels(F.col("total") - F.col("missing_cnt"))
    return _counted(df, _shape_counts()).select(
        "position", "field_name", label.alias("inferred_type"), hint.alias("hint"), "missing_cnt", "missing_rate", "sample_values"
    )
