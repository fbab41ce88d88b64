"""The operators as stages of a corpus pipeline: from documents to documents, with their decisions applied."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.llm import decontaminate as decon
from threadloom.llm import line_templates, ngram_join, packing, toxicity
from threadloom.llm.common import row_key

TOKENIZER = "byte_bpe_50k.json"
_KEY = "__row_key"


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a score below one half."""
    model = toxicity.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = toxicity.score(docs.withColumnRenamed("score", "__score"), model)
    return scored.where("score < 0.5").drop("score").withColumnRenamed("__score", "score")


def drop_template_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines of recurring templates; ``n_chars`` follows the text. A text may become empty."""
    left = line_templates.drop_lines(docs)
    if "n_chars" in docs.columns:
        n_chars = F.when(F.col("_n_dropped") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
        left = left.withColumn("n_chars", n_chars)
    return left.select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies the document with the smallest id; repeated rows of it count as one."""
    found = ngram_join.ngram_join(docs)
    kept = found.where(F.col("id").eqNullSafe(F.col("component"))).select(F.col("key").alias(_KEY))
    rows = docs.withColumn(_KEY, row_key("doc_id", "text"))
    return rows.join(kept, _KEY, "left_semi").dropDuplicates([_KEY]).drop(_KEY)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs."""
    found = decon.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    hit = found.where("n_hit > 0").select(F.col("key").alias(_KEY))
    return docs.withColumn(_KEY, row_key("doc_id", "text")).join(hit, _KEY, "left_anti").drop(_KEY)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in the training sequences."""
    return packing.pack(docs, public_tokenizers.path(TOKENIZER)).select(
        F.col("id").alias("doc_id"),
        "start",
        "length",
        F.col("crc").alias("ids_crc32"),
        F.col("total").alias("doc_tokens"),
        F.col("sequence").alias("sequence_id"),
        "offset",
    )
