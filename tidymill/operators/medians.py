"""Exact medians of groups of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OCTAVE = 1 << 10  # buckets between two powers of two
BINS = 1 << 20  # equal parts of a bucket
_LOWEST = 1075  # the least positive double is 2^-1074


def exact_median(df: DataFrame, value: str, keys: Sequence[str] = (), name: str = "median") -> DataFrame:
    """Median per group, the mean of the two middle values for even counts; nulls are ignored.

    Spark's ``median`` holds every distinct value of a group in one task. Here the middle is found by counting:
    first in buckets on a logarithmic scale, then in equal parts of the one or two buckets that hold a middle rank.
    Only the values of the parts that hold one are ordered (see ``middle_values``).
    """
    whole, keys = not keys, list(keys) or ["_all"]
    placed = middle_values(df, value, [] if whole else keys)

    def at(rank: Column) -> Column:
        return F.max(F.when((F.col("_from") < rank) & (F.col("_from") + F.col("_n") >= rank), F.col("_v")))

    low, high = _ranks()
    middle = F.when(at(low) == at(high), at(low)).otherwise((at(low) + at(high)) / 2)
    found = placed.groupBy(*keys).agg(middle.alias(name))
    return found.drop("_all") if whole else found


def middle_values(df: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """Different values around the middle of each group: ``_v``, its count ``_n``, ``_from`` values before it, ``_total``.

    Two counts narrow the group down. A bucket has at most 2^42 doubles (a thousandth of an octave), a part of it a
    millionth of the bucket's own range, so a group of any size leaves at most some 2^22 different values, and
    ordinary data a handful. Counts are aggregated before they are shuffled, and the result is exact
    because both scales never turn two values round. NaN counts as the largest value.
    """
    rows = df.where(F.col(value).isNotNull()).select(
        *(keys or [F.lit(0).alias("_all")]), F.col(value).cast("double").alias("_v")
    )
    whole, keys = not keys, list(keys) or ["_all"]
    scaled = rows.withColumn("_bucket", _bucket(F.col("_v")))
    buckets = scaled.groupBy(*keys, "_bucket").agg(
        F.count("*").alias("_n"), F.min("_v").alias("_low"), F.max("_v").alias("_high")
    )
    group = Window.partitionBy(*keys)
    counted = buckets.withColumn("_total", F.sum("_n").over(group)).withColumn(
        "_before", F.sum("_n").over(group.orderBy("_bucket")) - F.col("_n")
    )
    wide = _holding_a_middle(counted).select(*keys, "_bucket", "_low", "_high", "_before", "_total")
    share = F.try_divide(F.col("_v") - F.col("_low"), F.col("_high") - F.col("_low"))
    # a bucket of one value, or of infinities, is one part
    part = F.when(F.coalesce(F.isnan(share), F.lit(True)), 0).otherwise(F.floor(share * BINS)).cast("bigint")
    parted = _joined(scaled, wide, [*keys, "_bucket"], whole).withColumn("_part", part)
    inside = Window.partitionBy(*keys, "_bucket").orderBy("_part")
    parts = (
        parted.groupBy(*keys, "_bucket", "_part", "_before", "_total")
        .agg(F.count("*").alias("_n"))
        .withColumn("_before", F.col("_before") + F.sum("_n").over(inside) - F.col("_n"))
    )
    narrow = _holding_a_middle(parts).select(
        *keys, "_bucket", "_part", F.col("_before").alias("_start"), F.col("_total").alias("_of")
    )
    middle = _joined(parted.drop("_before", "_total"), narrow, [*keys, "_bucket", "_part"], whole)
    values = middle.groupBy(*keys, "_bucket", "_part", "_start", "_of", "_v").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*keys, "_bucket", "_part").orderBy("_v")) - F.col("_n")
    return values.select(*keys, "_v", "_n", (F.col("_start") + before).alias("_from"), F.col("_of").alias("_total"))


def _bucket(v: Column) -> Column:
    """A whole number that never falls where ``v`` rises: the logarithm of its size, with its sign."""
    size = F.floor(F.least(F.log2(F.abs(v)), F.lit(1025.0)) * OCTAVE) + F.lit(_LOWEST * OCTAVE + 1)
    return (
        F.when(F.isnan(v), F.lit(1 << 40)).when(v == 0, F.lit(0)).when(v > 0, size).otherwise(-size).cast("bigint")
    )


def _ranks() -> tuple[Column, Column]:
    return F.floor((F.col("_total") + 1) / 2), F.ceil((F.col("_total") + 1) / 2)


def _holding_a_middle(counts: DataFrame) -> DataFrame:
    """The one or two rows of each group whose values have a middle rank."""
    low, high = _ranks()
    return counts.where((F.col("_before") < high) & (F.col("_before") + F.col("_n") >= low))


def _joined(rows: DataFrame, chosen: DataFrame, on: Sequence[str], whole: bool) -> DataFrame:
    """Null-safe join on all of ``on``; without keys ``chosen`` has at most two rows."""
    named = chosen.withColumnsRenamed({k: f"_k{k}" for k in on})
    test = F.lit(True)
    for key in on:
        test = test & F.col(key).eqNullSafe(F.col(f"_k{key}"))
    return rows.join(F.broadcast(named) if whole else named, test).drop(*(f"_k{k}" for k in on))
