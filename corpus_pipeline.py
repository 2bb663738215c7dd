"""From raw documents to packed training sequences, as stages that each work on all their predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidymill.llm.common import pin, read
from tidymill.llm.exact import exact_duplicates
from tidymill.llm.near import near_duplicates
from tidymill.llm.packing import packed_pieces
from tidymill.llm.quality import accepted
from tidymill.llm.queries import quality_model, vocabulary
from tidymill.llm.secret_scan import redact_secrets, train_markov


def _kept(docs: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Rows whose id a verdict keeps; rows without an id cannot be told apart and stay."""
    ids = verdicts.filter("kept").select(F.col("doc_id").alias("kept_id")).distinct()
    return docs.join(ids, docs["doc_id"].cast("bigint").eqNullSafe(ids["kept_id"]), "left_semi")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labelled ones among them, does not reject."""
    return accepted(docs, quality_model(docs, read(spark, sf_dir, "labels")))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of texts that are equal but for the case of A-Z."""
    return _kept(docs, exact_duplicates(docs, keep="max", fold_case=True)).dropDuplicates(["doc_id", "text"])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by similar shingle sets."""
    return _kept(docs, near_duplicates(docs))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a mark in place of each secret and the count of characters brought up to date."""
    clean = redact_secrets(docs, train_markov(docs))
    if "n_chars" in clean.columns:
        kind = clean.schema["n_chars"].dataType
        clean = clean.withColumn("n_chars", F.coalesce(F.length("text").cast(kind), "n_chars"))
    return clean


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences with their ids."""
    return packed_pieces(docs, vocabulary, with_ids=True)


STAGES = [
    ("quality classifier", quality_classifier),
    ("exact dedup", exact_dedup),
    ("MinHash near-dedup", near_dedup),
    ("secret scans", secret_scan),
    ("packing", packing),
]

ORACLE_SQL = None  # the trained classifier and the signatures are not expressible in SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each result is written to the shared folder and read again."""
    docs = read(spark, sf_dir, "documents")
    for position, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if position < len(STAGES) - 1:
            docs = pin(docs)
    return docs
