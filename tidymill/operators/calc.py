"""One-number aggregates of a field, as reports cite them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidymill.functions import text as T

# Aggregate names and their labels.
AGGREGATES = {
    "count": "计数",
    "count_nonnull": "非空计数",
    "sum": "合计",
    "mean": "平均值",
    "max": "最大值",
    "min": "最小值",
}


def _aggregate(field: str, agg: str) -> Column:
    number = T.to_number(F.col(field))
    if agg == "count":
        return F.count("*").cast("double")
    if agg == "count_nonnull":
        return F.count_if(~T.is_missing(F.col(field))).cast("double")
    found = {"sum": F.sum, "mean": F.avg, "max": F.max, "min": F.min}[agg](number)
    problem = F.raise_error(F.lit(f"no {agg} of {field!r}: it holds text that is not a number"))
    return F.coalesce(found, problem.cast("double"))


def calc(df: DataFrame, field: str, agg: str) -> DataFrame:
    """``(field, agg, agg_label, value, value_text, rows_used)``; one pass over one column."""
    if agg not in AGGREGATES:
        raise ValueError(f"{agg!r} is not one of the aggregates {', '.join(AGGREGATES)}")
    if field not in df.columns:
        raise ValueError(f"the table has no field {field!r}")
    found = df.agg(F.count("*").alias("rows_used"), _aggregate(field, agg).alias("v"))
    return found.select(
        F.lit(field).alias("field"),
        F.lit(agg).alias("agg"),
        F.lit(AGGREGATES[agg]).alias("agg_label"),
        T.tidy_number(F.col("v")).alias("value"),
        T.number_text(F.col("v")).alias("value_text"),
        "rows_used",
    )
