"""Which of the accepted encodings each file of a folder has."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# single bytes, and pairs of a lead and a trail byte; possessive, so long lines need no stack
_GBK = r"^(?:[\x00-\x7F]|[\x81-\xFE][\x40-\x7E\x80-\xFE])*+$"
_BOM_BYTES = 3


def detect_encodings(spark: SparkSession, path: str) -> DataFrame:
    """``(path, encoding, ok)`` per file, judged by all its bytes: UTF-8 (with its mark or without) before GBK.

    Files are read line by line in splits, as the bytes they are; neither encoding has a line feed inside a
    character. A file is valid if all its lines are, which is one aggregate. Lines come without the mark
    at the start of a file, so its three bytes are those that the lines and their line feeds do not account for.
    Empty files have no bytes to judge and no row.
    """
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .load(path)
        .select("path", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_size").alias("_size"))
    )
    lines = (
        spark.read.option("recursiveFileLookup", "true")
        .option("lineSep", "\n")
        .text(path)
        .select(F.col("_metadata.file_path").alias("_of"), "value")
    )
    octets = F.decode(F.col("value").cast("binary"), "ISO-8859-1")
    judged = lines.groupBy("_of").agg(
        F.bool_and(F.is_valid_utf8("value")).alias("_utf8"),
        F.bool_and(octets.rlike(_GBK)).alias("_gbk"),
        F.sum(F.octet_length("value") + 1).alias("_seen"),
    )
    # the last line may end without a line feed
    marked = F.col("_size") - F.col("_seen") >= _BOM_BYTES - 1
    encoding = (
        F.when(F.col("_utf8"), F.when(marked, "utf-8-sig").otherwise("utf-8"))
        .when(F.col("_gbk") & ~marked, "gbk")
    )
    return files.join(judged, F.col("_file") == F.col("_of")).select(
        "path", encoding.alias("encoding"), encoding.isNotNull().alias("ok")
    )
