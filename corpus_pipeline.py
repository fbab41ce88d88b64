"""From raw documents to packed training sequences: each stage reads what the one before has written."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from threadloom.llm import stages
from threadloom.session import cut_lineage

STAGES = [
    ("toxicity", stages.drop_toxic),
    ("line dedup", stages.drop_template_lines),
    ("n-gram Jaccard join", stages.drop_near_copies),
    ("benchmark decontamination", stages.drop_contaminated),
    ("packing", stages.pack_sequences),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return docs
