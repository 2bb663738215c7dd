"""Mixing sources to target weights: how often each document is taken so that every source meets its share."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidymill.llm.common import pin
from tidymill.sources.numbering import Key, number_in_order

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
CELLS = 4096  # parts of the documents of one source and length, by hash
BUDGET = 1 << 16  # words left to the dynamic programming at most


def _targets(sources: DataFrame, weights: tuple[int, ...], most: int) -> DataFrame:
    """``key, source_size, target`` of every source: shares by weight, none above ``most`` times its size.

    What a capped source leaves is shared again by weight. Each round is one aggregate over the sources and caps
    at least one more of them, most of them in the first rounds; sources never come to the driver.
    """
    ranked = number_in_order(sources, [Key(F.col("source"), nulls_last=True)])
    kinds = F.array(*(F.lit(float(w)) for w in weights))
    now = pin(
        ranked.select(
            "key", "source_size", F.get(kinds, (F.col("row_no") - 1) % len(weights)).alias("weight"), F.lit(False).alias("capped")
        )
    )
    cap = F.lit(float(most)) * F.col("source_size")
    while True:
        free = F.when(~F.col("capped"), F.col("weight"))
        sums = now.agg(
            F.sum("source_size").alias("all"), F.sum(F.when(F.col("capped"), cap)).alias("spent"), F.sum(free).alias("weight"),
            F.count_if("capped").alias("n"),
        ).first()
        level = ((sums["all"] or 0) - (sums["spent"] or 0.0)) / sums["weight"] if sums["weight"] else 0.0
        above = ~F.col("capped") & (F.lit(level) * F.col("weight") > cap)
        if not now.filter(above).limit(1).count():
            break
        now = pin(now.withColumn("capped", F.col("capped") | above))
    target = F.when(F.col("capped"), cap).otherwise(F.lit(level) * F.col("weight"))
    return now.select("key", "source_size", target.alias("target"))


def fit_counts(lengths: np.ndarray, counts: np.ndarray, budget: int, table: int = BUDGET) -> np.ndarray:
    """How many documents of each length to take so that their lengths add up to ``budget`` or as near as can be.

    ``lengths`` are different and positive; ``counts`` say how many documents there are. Every length first gives
    the same share of its documents, rounded down, so the mix keeps the lengths of its source; the rest is a
    bounded knapsack over the documents left. Where that misses the budget, less is given beforehand, at last
    nothing. A budget of at most ``table`` words is thus met as nearly as any choice of documents can.
    """
    size, have = [int(x) for x in lengths], [int(x) for x in counts]
    words = sum(s * h for s, h in zip(size, have))
    if budget <= 0 or not words:
        return np.zeros(len(lengths), np.int64)
    if budget >= words:
        return counts.astype(np.int64)
    best, off = None, None
    for portion in (1.0, 0.5, 0.0):
        take = [int(h * budget // words * portion) for h in have]
        missed = _fill(size, have, take, budget, table)
        if off is None or missed < off:
            best, off = take, missed
        if not off:
            break
    return np.array(best, np.int64)


def _fill(size: list[int], have: list[int], take: list[int], budget: int, table: int) -> int:
    """Raise ``take`` towards ``budget``; returns how far off it stays.

    The largest lengths that fit lower what is left to ``table``. Then bundles of 1, 2, 4, ... documents of a
    length are added one by one: the sums that can be reached are the bits of one integer, and each sum remembers
    the bundle that first reached it.
    """
    order = sorted(range(len(size)), key=size.__getitem__)
    left = budget - sum(s * t for s, t in zip(size, take))
    for i in reversed(order):
        if left > table:
            more = min(have[i] - take[i], -(-(left - table) // size[i]), left // size[i])
            take[i] += more
            left -= more * size[i]
    width = 2 * left  # more than that is further off than nothing
    mask = (1 << (width + 1)) - 1
    reached, via, bundles = 1, np.full(width + 1, -1, np.int64), []
    for i in order:
        spare, bundle = min(have[i] - take[i], width // size[i]), 1
        while spare > 0 and not reached >> left & 1:
            n = min(bundle, spare)
            new = (reached << (n * size[i])) & mask & ~reached
            if new:
                bits = np.unpackbits(np.frombuffer(new.to_bytes((width >> 3) + 1, "little"), np.uint8), bitorder="little")
                via[np.flatnonzero(bits[: width + 1])] = len(bundles)
                reached |= new
            bundles.append((i, n))
            spare, bundle = spare - n, bundle * 2
    sums = np.append(0, np.flatnonzero(via >= 0))
    at = int(sums[np.argmin(np.abs(sums - left))])
    missed = abs(left - at)
    while at:
        i, n = bundles[via[at]]
        take[i] += n
        at -= n * size[i]
    return missed


FITTED = "key string, size bigint, source_size bigint, target double, whole bigint, extra bigint"


def _fitted(group: pd.DataFrame) -> pd.DataFrame:
    """For one source: how many documents of each length to take once more than all others of it."""
    rest = int(round(group["target"].iloc[0])) - int(group["whole"].iloc[0]) * int(group["source_size"].iloc[0])
    sized = (group["size"] > 0).to_numpy()
    extra = np.zeros(len(group), np.int64)
    extra[sized] = fit_counts(group["size"].to_numpy()[sized], group["n"].to_numpy()[sized], rest)
    return group[["key", "size", "source_size", "target", "whole"]].assign(extra=extra)


def mix_sources(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = WEIGHTS,
    most: int = 3,
    seed: int = 0,
) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` for every document.

    ``size`` is the number of words. Sources in code-point order (null last) take the ``weights`` in turn and share
    the words of all documents; no target is above ``most`` times its source. ``taken`` is a multiple of ``size``: a
    source takes all its documents as often as its target holds it, and once more those that fit the
    remaining budget. For these, documents are counted by exact length, ``fit_counts`` says how many of each length
    go in, and of equal lengths those with the least seeded hashes of their ids do.

    Of a source only its different lengths come together in a task; n of them need about n*n/2 words. Documents
    of one source and length are counted in ``CELLS`` parts by hash, so only those of one part are ever ordered.

    Defined cases: null texts have size 0 and are never taken; a null source is a source of its own, unlike ''; rows that
    repeat id, source and size are counted together and given out one by one; null ids are ids like any other; without
    any word all targets are 0; an empty table has no rows.
    """
    if most < 1:
        raise ValueError("sources that give less than themselves cannot make up all words")
    rows = docs.select(
        docs[id_col].cast("bigint").alias("doc_id"),
        docs[source_col].cast("string").alias("source"),
        F.regexp_count(F.coalesce(docs[text_col].cast("string"), F.lit("")), F.lit(WORD)).cast("bigint").alias("size"),
    )
    hashed = F.xxhash64(F.lit(seed), "doc_id")
    key = F.concat(F.when(F.col("source").isNull(), "n").otherwise("s"), F.coalesce("source", F.lit("")))
    units = pin(
        rows.select("doc_id", "source", key.alias("key"), "size")
        .groupBy("doc_id", "source", "key", "size")
        .agg(F.count(F.lit(1)).alias("m"))
        .withColumn("hash", hashed)
        .withColumn("cell", F.pmod("hash", F.lit(CELLS)))
    )
    cells = pin(units.groupBy("source", "key", "size", "cell").agg(F.sum("m").alias("n")))
    lengths = cells.groupBy("source", "key", "size").agg(F.sum("n").alias("n"))
    sources = lengths.groupBy("source", "key").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("bigint")
    targets = _targets(sources, weights, most).withColumn("whole", whole)
    fitted = lengths.join(targets, "key").groupBy("key").applyInPandas(_fitted, FITTED)
    in_order = Window.partitionBy("key", "size").orderBy("cell")
    left = F.col("extra") - (F.sum("n").over(in_order) - F.col("n"))
    open_cells = cells.join(fitted, ["key", "size"]).withColumn("open", F.greatest(F.lit(0), F.least("n", left)))
    in_cell = Window.partitionBy("key", "size", "cell").orderBy("hash", "doc_id")
    before = F.sum("m").over(in_cell) - F.col("m")
    counted = (
        units.select("key", "size", "cell", "hash", "doc_id", "m")
        .join(open_cells.select("key", "size", "cell", "source_size", "target", "whole", "open"), ["key", "size", "cell"])
        .withColumn("more", F.greatest(F.lit(0), F.least("m", F.col("open") - before)))
    )
    times = F.col("whole") + (F.col("copy") <= F.col("more")).cast("bigint")
    return counted.select("*", F.explode(F.sequence(F.lit(1).cast("bigint"), "m")).alias("copy")).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * times).alias("taken")
    )
