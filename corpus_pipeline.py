"""A training-data pipeline of four stages, each an operator of loomspark.llm.

Documents that the quality classifier rejects go; one document of each group of near-duplicates
stays; sources are mixed to their target weights, so that documents of scarce sources repeat; the
mixture is encoded to ids and decoded again.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.llm import bpe, dedup, mixing, quality
from loomspark.sources.tables import written

#: No contract binds this stage: shingles of five words, 80 % in common.
WIDTH, PERCENT = 5, 80
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: documents that score 0.5 or more; null and empty texts are scored like others."""
    trees = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    others = [c for c in COLUMNS if c not in ("doc_id", "text")]
    scored = quality.score(docs, trees, others).where("predicted = 1")
    return scored.select("doc_id", "text", *(F.col("_" + c).alias(c) for c in others))


def numbered(docs: DataFrame) -> DataFrame:
    """Written, with a number for each row, since ids may be null or stand in many rows."""
    return written(docs.select(*COLUMNS).withColumn("number", F.monotonically_increasing_id()))


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: the first row of each component, whatever the rows' ids. Rows without words are linked with nothing and stay."""
    rows = numbered(docs)
    judged = dedup.near_duplicates(rows.select(F.col("number").alias("doc_id"), "text"), percent=PERCENT, width=WIDTH)
    return rows.join(judged.where("kept").select(F.col("doc_id").alias("number")), "number", "left_semi").select(*COLUMNS)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: each row as often as the mixture takes it, whatever its id, shard after shard and shuffled within.

    Null texts and texts without words stay once each; a null source is a source of its own.
    """
    return mixing.take(docs.select(*COLUMNS))


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: n_tokens, ids_sha256 and decoded_sha256 of each document of the mixture."""
    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("quality", quality_stage), ("near_dedup", dedup_stage), ("mixing", mixing_stage), ("byte_bpe", encoding_stage)]

#: SQL can't train the classifier, draw the mixture or run the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each is written as Parquet and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir))
    return docs
