"""The corpus pipeline: five stages over documents, each written as Parquet and read again by the next one.

Every stage keeps the columns of documents; the last one adds shard and slot. A document that mixing takes more than
once is a row more than once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docrel.llm import decontamination, mixing, near_copies, quality, sharding
from docrel.llm.common import shared_dir, table

def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose predicted quality is 1."""
    model = quality.fit_quality(docs, table(spark, sf_dir, "labels"))
    scored = quality.score_quality(docs, model, name="__quality")
    return scored.where("__quality.predicted = 1").drop("__quality")


def near_copy_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies."""
    return near_copies.keep_one(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any test string of the benchmark."""
    found = decontamination.find_test_strings(docs, table(spark, sf_dir, "benchmark"), name="__leaks")
    return found.where("__leaks.n_hit = 0").drop("__leaks")


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's budget takes it."""
    # Columns of documents that have the names of mixing's results step aside meanwhile.
    aside = {c: f"__own_{c}" for c in ("size", "source_size", "target", "taken") if c in docs.columns}
    mixed = mixing.mix_sources(docs.withColumnsRenamed(aside))
    times = F.when(F.col("size") > 0, F.expr("cast(taken div size as int)")).otherwise(0)
    own = [F.col(aside.get(c, c)).alias(c) for c in docs.columns]
    return mixed.select(*own, F.explode(F.array_repeat(F.lit(0), times)).alias("__copy")).select(*docs.columns)


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in 40 shards, in their slots' order."""
    return sharding.shuffle_to_shards(docs, 40)


STAGES = [
    ("quality", quality_stage),
    ("near copies", near_copy_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("sharding", sharding_stage),
]

#: Compressed sizes and seeded hashes have no SQL form; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        path = shared_dir(spark)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
