"""Five stages from raw documents to packed sequences.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one
before has kept; its result is written as Parquet and read again.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seamline.llm import decontamination, lines, ngram_join, packing, quality
from seamline.llm.common import removed, shared_folder, table, worker_path, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep."""
    worker_path(spark)
    return quality.keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the boilerplate lines of their source; n_chars is that of the text that is left."""
    cleaned = lines.drop_boilerplate(docs)
    new = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("row.n_chars")).alias("n_chars")
    return cleaned.select(*(new.get(c, F.col(f"row.`{c}`").alias(c)) for c in docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of similar ones."""
    worker_path(spark)
    return ngram_join.keep_one(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of ``benchmark``."""
    worker_path(spark)
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences."""
    worker_path(spark)
    return packing.digest(packing.harmonic_pack(docs, packing.vocabulary(), slice_bytes=2 << 20))


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", benchmark_decontamination),
    ("packing", packed),
]

#: Word-set similarity and shuffle-free packing have no short SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``.

    Results between stages lie in the folder the cluster shares; each goes as
    soon as the next one is written, so only the last stays. Every stage has a
    defined result for null texts, languages and sources, for rows without an
    id, repeated rows, very long texts, further columns and no rows: see its
    operator.
    """
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = written(stage(spark, docs, sf_dir), f"{folder}/{k}")
        if k:
            removed(spark, f"{folder}/{k - 1}")
    return docs
