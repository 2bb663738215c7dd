"""The long form of a text table and bounded first-k selections on it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidymill.functions import text as T
from tidymill.sources.numbering import ROW_NO, data_columns

# A frame with one row per column (or per column and label) is broadcast; this is the most columns
# for which that is done without asking Spark.
MAX_BROADCAST_FIELDS = 20_000


def cells(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``(row_no, field, value, text, missing)``: one row per cell, one expression set for all.

    A wide table costs the same plan as a narrow one, and partial aggregation on ``field`` keeps
    shuffles at one row per column and task.
    """
    chosen = list(columns) if columns is not None else data_columns(df)
    long = df.select(ROW_NO, *chosen).unpivot(ROW_NO, chosen, "field", "raw")
    value = F.coalesce(F.col("raw"), F.lit(""))
    return long.select(
        ROW_NO, "field", value.alias("value"), T.strip(value).alias("text")
    ).withColumn("missing", F.lower("text").isin(*T.MISSING_TEXTS))


def field_position(columns: Sequence[str]) -> Column:
    """1-based position of ``field`` in the table."""
    return F.array_position(F.array(*[F.lit(c) for c in columns]), F.col("field"))


def small_side(frame: DataFrame, rows: int) -> DataFrame:
    """Broadcast a per-field frame while its row bound is small; beyond that Spark decides."""
    return F.broadcast(frame) if rows <= MAX_BROADCAST_FIELDS else frame


def band() -> Column:
    """Power-of-two band of ``row_no``: at most 64 of them, whatever the table size."""
    return F.floor(F.log2(F.greatest(F.col(ROW_NO), F.lit(1)).cast("double")))


def first_k(
    frame: DataFrame, keys: Sequence[str], k: int, groups: int, bands: DataFrame | None = None
) -> DataFrame:
    """The ``k`` rows with the lowest ``row_no`` per group, as column ``rank`` = 1..k.

    Row numbers are counted per band first (``bands`` passes such counts in when they exist as
    ``keys, _band, _n``), which bounds where the k-th row lies; only rows up to that bound are
    ranked, not the whole group.
    """
    if bands is None:
        bands = (
            frame.select(*keys, band().alias("_band"))
            .groupBy(*keys, "_band")
            .agg(F.count("*").alias("_n"))
        )
    by_group = Window.partitionBy(*keys)
    seen = F.sum("_n").over(by_group.orderBy("_band"))
    bound = (
        bands.select(*keys, "_band", (seen - F.col("_n")).alias("_before"))
        .where(F.col("_before") < k)
        .groupBy(*keys)
        .agg(F.max("_band").alias("_last"))
    )
    # the widest bound, as a subquery value, is applied below the unpivot: cells beyond it are
    # never formed
    reach = bound.agg(F.max("_last")).scalar()
    near = (
        frame.where(band() <= reach)
        .join(small_side(bound, groups), list(keys))
        .where(band() <= F.col("_last"))
    )
    rank = F.row_number().over(by_group.orderBy(ROW_NO))
    return near.withColumn("rank", rank).where(F.col("rank") <= k).drop("_last")


def samples(frame: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """Values of already ranked rows as one array per group, in rank order (k entries at most)."""
    ordered = F.array_sort(F.collect_list(F.struct("rank", value)))
    return frame.groupBy(*keys).agg(F.transform(ordered, lambda s: s[value]).alias(name))
