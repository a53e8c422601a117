"""A corpus from ``documents``: classify, join near copies, decontaminate, mask secrets, mix sources.

Each stage takes (spark, docs, sf_dir) and reads its ``docs`` more than once, so
stages are handed written tables.  All but the last return the columns they got.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weftmesh.llm import decontaminate, ngram_join, quality_classifier, secret_scan, source_mixing
from weftmesh.plans.storage import materialize


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    forest = quality_classifier.train(docs, labels, ~quality_classifier.held_out())
    return quality_classifier.score(docs, forest).where(f"score >= {quality_classifier.THRESHOLD}").select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: that of the least id."""
    return ngram_join.representatives(docs)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked; every document stays."""
    return secret_scan.redact(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words of each document the mixture takes."""
    sized = docs.withColumn("size", source_mixing.n_words(docs["text"]))
    sized = sized.withColumn("quality", source_mixing.quality_weight(sized["text"], sized["size"])).select("doc_id", "source", "lang", "size", "quality")
    mixed = source_mixing.mix(materialize(sized, "mix-sizes"))
    return mixed.select("doc_id", "source", "lang", "size", "source_size", "target", "taken")


STAGES = [("quality classifier", quality), ("n-gram jaccard join", near_copies), ("benchmark decontamination", leaks), ("secret scans", secrets), ("mixing sources", mixture)]

#: The classifier has no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
