"""A corpus pipeline: quality, near-duplicates, benchmark leaks, personal data, mixing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor
kept. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from catalith.llm.common import WORD, scratch, table, word_count
from catalith.llm.decontaminate import decontaminate
from catalith.llm.mixing import cycle_weights, mix
from catalith.llm.near_dup import near_duplicates
from catalith.llm.pii import redact
from catalith.llm.quality import quality_filter

#: Similarity in percent from which documents are near-duplicates, source weights in turn, and epochs at most.
NEAR, WEIGHTS, EPOCHS = 80, (5, 2, 1), 3.0


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects."""
    return quality_filter(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group; documents without words or doc_id stay.

    Rows sharing a doc_id are documents of their own: those with unrelated texts stay.
    """
    found = near_duplicates(docs, NEAR).where("kept and group_id is not null")
    kept = found.groupBy("group_id").agg(F.min(F.struct("doc_id", "text_hash")).alias("k")).select(
        F.col("k.doc_id").alias("_id"), F.col("k.text_hash").alias("_hash")
    )
    inside = F.col("doc_id").isNotNull() & F.coalesce(F.col("text").rlike(WORD), F.lit(False))
    rows = docs.where(inside).select(F.struct(*docs.columns).alias("_row"), F.col("doc_id").cast("long").alias("_id"), F.xxhash64("text").alias("_hash"))
    one = rows.join(kept.hint("shuffle_hash"), ["_id", "_hash"])
    first = F.row_number().over(Window.partitionBy("_id", "_hash").orderBy("_id"))
    one = one.withColumn("_place", first).where("_place = 1").select("_row.*")
    return one.unionByName(docs.where(~inside))


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without an overlap with a benchmark item."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data masked."""
    return redact(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes of each document."""
    return mix(docs, lambda s: cycle_weights(s, WEIGHTS), word_count(F.col("text")), EPOCHS)


STAGES = [
    ("quality", quality),
    ("near_dedup", near_dedup),
    ("benchmark_leaks", benchmark_leaks),
    ("personal_data", personal_data),
    ("mixing", mixing),
]

#: SQL can't express near-duplicate groups and personal data as the stages find them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each written as Parquet and read again."""
    folder = f"{scratch(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
