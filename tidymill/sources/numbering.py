"""Row numbers: the 1-based position of a row in its table.

Frames have no order, so text tables carry ``row_no``. Everything here is distributed: rows are counted per
block or range, what lies before a block is summed in two levels, and only positions inside one are ranked, so
no task ever sees more rows than a block holds. All of it is lazy and nothing is written.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

ROW_NO = "row_no"
HIDDEN = "__tm_"  # helper columns of a run that is accounted for while it goes (see plans.cleaning)
BLOCK_ROWS = 1 << 16
GROUP_BLOCKS = 1 << 12  # blocks that are folded together before their groups are
SAMPLED = 32  # sampled rows for each range of a sort


def data_columns(df: DataFrame) -> list[str]:
    """Columns of a text table without its row number."""
    return [c for c in df.columns if c != ROW_NO and not c.startswith(HIDDEN)]


def before_blocks(
    blocks: DataFrame,
    name: str,
    fold: Callable[[WindowSpec], Column],
    whole: Column,
    join: Callable[[Column, Column], Column],
    *,
    down: bool = False,
) -> DataFrame:
    """For each row of ``blocks`` (one per ``_block``) the fold of all blocks before it (after it with ``down``).

    Blocks are folded inside groups of ``GROUP_BLOCKS`` neighbours, then one row per group is. With blocks of 65,536
    rows a window of the second level sees one row for 2^28 rows of the table. ``fold`` is what a window frame gives,
    ``whole`` the aggregate of a group under the same name as the folded column, ``join`` puts the two levels together
    (inside, before).
    """

    def earlier(window: WindowSpec, key: str) -> WindowSpec:
        return window.orderBy(F.desc(key) if down else F.asc(key)).rowsBetween(Window.unboundedPreceding, -1)

    grouped = blocks.withColumn("_group", F.floor(F.col("_block") / GROUP_BLOCKS))
    groups = grouped.groupBy("_group").agg(whole).select(
        F.col("_group").alias("_of"), fold(earlier(Window, "_group")).alias("_outside")
    )
    inside = grouped.withColumn("_inside", fold(earlier(Window.partitionBy("_group"), "_block")))
    return inside.join(groups, F.col("_group") == F.col("_of")).select(
        *blocks.columns, join(F.col("_inside"), F.col("_outside")).alias(name)
    )


def _rows_before(counts: DataFrame) -> DataFrame:
    """``_block, _n`` with the rows before each block as ``_before``."""
    return before_blocks(
        counts, "_before", lambda w: F.coalesce(F.sum("_n").over(w), F.lit(0)), F.sum("_n").alias("_n"), lambda a, b: a + b
    )


def renumber(
    df: DataFrame, key: str = ROW_NO, *, then: Sequence[str] = (), block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Dense ``row_no`` 1..n in the order of an integer ``key`` (gaps are closed), and of ``then`` where keys repeat."""
    block = F.floor(F.col(key) / F.lit(block_rows))
    offsets = _rows_before(df.groupBy(block.alias("_block")).agg(F.count("*").alias("_n"))).select("_block", "_before")
    inside = F.row_number().over(Window.partitionBy("_block").orderBy(key, *then))
    numbered = (
        df.withColumn("_block", block)
        .withColumn("_inside", inside)
        .join(offsets, "_block")
        .withColumn(ROW_NO, F.col("_before") + F.col("_inside"))
    )
    return numbered.select(ROW_NO, *(c for c in df.columns if c != ROW_NO))


@dataclass(frozen=True)
class Key:
    """A sort key; nulls come first, or last in descending order, unless said otherwise."""

    column: Column
    down: bool = False
    nulls_last: bool | None = None

    @property
    def nulls_after(self) -> bool:
        return self.down if self.nulls_last is None else self.nulls_last

    def ordered(self) -> Column:
        if self.down:
            return self.column.desc_nulls_last() if self.nulls_after else self.column.desc_nulls_first()
        return self.column.asc_nulls_last() if self.nulls_after else self.column.asc_nulls_first()

    def before(self, a: Column, b: Column) -> Column:
        """Whether value ``a`` comes strictly before value ``b``."""
        first, second = (b, a) if self.down else (a, b)
        null, filled = (b, a) if self.nulls_after else (a, b)
        return F.coalesce(first < second, F.lit(False)) | (null.isNull() & filled.isNotNull())


def number_in_order(df: DataFrame, order: Sequence[Key]) -> DataFrame:
    """Replace ``row_no`` by the position in a total ``order`` of keys.

    Splitters from a fixed sample cut the order into as many ranges as there are shuffle partitions; rows are counted
    per range and ranked inside it. The sample is the rows with the least hashes of their keys, hence the same
    whenever it is drawn: a position does not depend on how often or where the plan runs, so nothing is
    written. Equal values are no problem, as splitters consist of all keys.
    """
    ranges = max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    names = [f"_k{i}" for i in range(len(order))]
    others = [c for c in df.columns if c != ROW_NO]
    # a generator of one row forms the keys once; as plain columns they would be formed again at each comparison
    keyed = df.select(*others, F.inline(F.array(F.struct(*(k.column.alias(n) for k, n in zip(order, names))))))
    sample = keyed.select(*names).orderBy(F.xxhash64(*names), *names).limit(ranges * SAMPLED)
    place = F.row_number().over(Window.orderBy(*(Key(F.col(n), k.down, k.nulls_last).ordered() for k, n in zip(order, names))))
    every = sample.select(F.struct(*names).alias("_s"), place.alias("_p"), F.count("*").over(Window.partitionBy()).alias("_of"))
    # position p of n starts a range when the share of ranges before it rises there
    starts = F.floor(F.col("_p") * ranges / F.col("_of")) > F.floor((F.col("_p") - 1) * ranges / F.col("_of"))
    cuts = every.where(starts & (F.col("_p") < F.col("_of"))).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_p", "_s"))), lambda x: x["_s"]).alias("_cuts")
    )

    def at_or_before(cut: Column) -> Column:
        # nulls first going up, or last going down, is how structs compare
        if all(k.down == order[0].down == k.nulls_after for k in order):
            return cut >= F.struct(*names) if order[0].down else cut <= F.struct(*names)
        out = F.lit(True)
        for key, name in reversed(list(zip(order, names))):
            a, b = cut[name], F.col(name)
            out = key.before(a, b) | (a.eqNullSafe(b) & out)
        return out

    # a binary search in the splitters, one comparison for each bit of their number
    bits = F.array(*(F.lit(1 << bit) for bit in reversed(range(ranges.bit_length()))))

    def search(at: Column, bit: Column) -> Column:
        cut = F.get("_cuts", at + bit - 1)
        return at + F.when(cut.isNotNull() & at_or_before(cut), bit).otherwise(0)

    ranged = keyed.withColumn("_cuts", cuts.scalar()).withColumn("_block", F.aggregate(bits, F.lit(0), search).cast("bigint")).drop("_cuts")
    offsets = _rows_before(ranged.groupBy("_block").agg(F.count("*").alias("_n"))).select("_block", "_before")
    inside = Window.partitionBy("_block").orderBy(*(Key(F.col(n), k.down, k.nulls_last).ordered() for k, n in zip(order, names)))
    numbered = ranged.withColumn("_inside", F.row_number().over(inside)).join(offsets, "_block")
    return numbered.select((F.col("_before") + F.col("_inside")).cast("bigint").alias(ROW_NO), *others)
