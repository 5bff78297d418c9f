"""From raw documents to packed training sequences: five stages, each by one operator of ``chronolode.llm``.

Each stage works on all that the one before kept, is written as Parquet and read again. Counted with
``chronolode.llm``, whose operators it calls.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolode.llm import decontaminate, line_dedup, packing, quality, simhash
from chronolode.llm.tables import read
from chronolode.session import shared_path


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled ones among them, takes for good."""
    return quality.accepted(docs, read(spark, sf_dir, "labels", "doc_id", "quality"))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that many documents share; ``n_chars`` follows the text."""
    kept = line_dedup.line_dedup(docs).drop("_n_lines", "_n_dropped")
    if "n_chars" not in docs.columns:
        return kept
    return kept.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.char_length("text").cast("long"))).select(*docs.columns)


def near_copy_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of exact or near copies."""
    return simhash.without_copies(docs)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.clean_documents(docs, read(spark, sf_dir, "benchmark", "item_id", "text"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences, as ``op7_packing`` gives them. Workers are left as small as they came, for other stages to follow."""
    return packing.packed_pieces(docs, keep_table=False)


STAGES = [
    ("quality", quality_stage),
    ("line_dedup", line_stage),
    ("near_copies", near_copy_stage),
    ("benchmark", benchmark_stage),
    ("packing", packing_stage),
]

#: Discriminants, fingerprint groups and tokenizers have no SQL; tests/llm compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what lies between them is written to the shared folder."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = shared_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
