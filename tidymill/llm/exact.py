"""Exact dedup with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidymill.llm.common import folded, pin, texts


def exact_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min", fold_case: bool = False
) -> DataFrame:
    """Group rows by the 128-bit hash of their content, comparing bytes inside a group; keep one row of each.

    Returns ``doc_id, keep_id, group_size, kept, text_sha256`` for every row. ``keep`` says whether the
    smallest or the largest id stays; ``fold_case`` lower-cases A-Z before comparing.

    Copies are counted per task before anything is shuffled, so a text that fills a third of the table is a
    few rows per task. The grouping key holds the content beside its hash: texts that share a hash but
    differ in a byte are different groups. Rows find their group again by two independent digests;
    should two different texts ever share both, the job stops instead of merging them.

    Defined cases: null and empty texts are equal. Rows that repeat an id and a text are all copies and
    share the verdict of that id. A null id never stays while its group has another one; a group of null
    ids only has a null ``keep_id`` and keeps all its rows. An empty table gives an empty result.
    """
    rows = texts(docs, id_col, text_col)
    body = folded(F.col("text")) if fold_case else F.col("text")
    pick = {"min": F.min, "max": F.max}[keep]
    groups = (
        rows.select("doc_id", body.alias("body"))
        .select("doc_id", "body", F.unhex(F.md5("body")).alias("digest"))
        .groupBy("digest", "body")
        .agg(pick("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .filter("group_size > 1")
        .select("digest", F.unhex(F.sha2("body", 256)).alias("sha"), "keep_id", "group_size")
    )
    same_digests = F.when(F.count(F.lit(1)) > 1, F.raise_error(F.lit("two texts share both digests")).cast("bigint"))
    copied = pin(
        groups.groupBy("digest", "sha").agg(
            F.first("keep_id").alias("keep_id"), F.coalesce(same_digests, F.first("group_size")).alias("group_size")
        )
    )
    labelled = rows.select("doc_id", body.alias("body")).select(
        "doc_id", F.unhex(F.md5("body")).alias("digest"), F.unhex(F.sha2("body", 256)).alias("sha")
    )
    keep_id = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return (
        labelled.join(copied, ["digest", "sha"], "left")
        .select(
            "doc_id",
            keep_id.alias("keep_id"),
            F.coalesce("group_size", F.lit(1).cast("bigint")).alias("group_size"),
            F.lower(F.hex("sha")).alias("text_sha256"),
        )
        .select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")
    )
