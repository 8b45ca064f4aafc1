"""From raw documents to packed training sequences, in stages; each is written as Parquet and read again as the next one's input.

A stage takes (spark, docs, sf_dir), docs with the columns of `documents`, and all but the last return those columns:
quality: what the co-trained classifier rejects goes; near_dedup: of each group of near copies (five-word shingles,
similarity 0.8) the document with the smallest doc_id stays; decontaminate: documents that hold a benchmark item go;
pii: personal data in texts is replaced by its kind; packing: pieces of the rest with their places in sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from verivane.llm import decontaminate, dedup, packing, pii, quality
from verivane.llm.common import materialize, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return dedup.deduplicate(docs)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redact(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("quality", quality_stage),
    ("near_dedup", near_dedup_stage),
    ("decontaminate", decontaminate_stage),
    ("pii", pii_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs


#: Trained stages and signatures can't be written as SQL; tests compare each stage with a brute-force version.
ORACLE_SQL = None
