"""The pipeline from raw documents to a mixed training corpus.

Each stage works on all that the one before it kept. Rejected documents go, secrets are
replaced in the texts, and the last stage adds each document's place in the mix.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gaugewell.llm.decontamination import drop_contaminated
from gaugewell.llm.mixing import mix_sources
from gaugewell.llm.queries import TARGET_SHARES
from gaugewell.llm.secrets import redact_secrets
from gaugewell.llm.shipping import ship
from gaugewell.llm.simhash import drop_near_duplicates
from gaugewell.llm.texts import table
from gaugewell.llm.toxicity import drop_toxic
from gaugewell.session import remove_path, scratch_path, scratch_scope


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the severity model, fitted on the labelled documents, does not reject."""
    ship(spark)
    return drop_toxic(docs, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    ship(spark)
    return drop_near_duplicates(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    ship(spark)
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with their secrets replaced by a mark."""
    ship(spark)
    return redact_secrets(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their place in the mix of sources."""
    ship(spark)
    return mix_sources(docs, TARGET_SHARES)


STAGES = [
    ("toxicity", without_toxic),
    ("near_duplicates", without_near_duplicates),
    ("decontamination", without_benchmark),
    ("secrets", without_secrets),
    ("mixing", mixed),
]

#: Trained scores, walks and fingerprints are beyond SQL; tests compare the pipeline with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; what one keeps is written and read again by the next.

    What a stage has written for itself goes when its result is stored, and a result when the next one is. In the
    end only what the last stage reads is left.
    """
    scratch, docs = scratch_path(spark, "pipeline"), table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES[:-1]):
        with scratch_scope(spark):
            stage(spark, docs, sf_dir).write.parquet(f"{scratch}/{number}")
        if number:
            remove_path(spark, f"{scratch}/{number - 1}")
        docs = spark.read.parquet(f"{scratch}/{number}")
    return STAGES[-1][1](spark, docs, sf_dir)
