"""The corpus pipeline: documents in, packed training sequences out.

Each stage calls one operator of ledgerloom.llm on all that the one before has kept; its decisions take effect. All but
the last return the columns of documents, n_chars brought up to date. run() applies the stages one after the other, each
written as Parquet and read again.

Labels teach the first stage; the benchmark guards the fourth. An empty table passes through as an empty table; null
texts are empty to every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import decontaminate, packing, quality, simhash, templates
from ledgerloom.plans.stash import stash


def _sized(docs: DataFrame, columns: list[str]) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(*columns)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quadratic discriminant rejects go (operator 5)."""
    return quality.reject(docs, quality.fit_to_labels(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Recurring line templates go from every text (operator 6)."""
    return _sized(templates.drop_templates(docs), docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of exact and near copies stays (operator 1)."""
    return simhash.near_dedup(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut out of the texts (operator 2)."""
    return _sized(decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")), docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences (operator 7). The workers serve all stages, so their tables of known chunks are
    smaller here and go with each partition."""
    return packing.digests(packing.pack(docs, packing.vocabulary_path(), young=40_000, keep=False))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("packing", pack),
]

#: The classifier, the template tree and the tokenizer are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
