"""Registered queries of this subpackage and their SQL where SQL can say them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugewell.llm import secrets, sql
from gaugewell.llm.decontamination import contamination
from gaugewell.llm.embeddings import near_vectors
from gaugewell.llm.mixing import mix_sources
from gaugewell.llm.phrases import edited_likeness
from gaugewell.llm.prefixes import prefix_trie
from gaugewell.llm.quality import quality_scores
from gaugewell.llm.recompression import remove_repeats
from gaugewell.llm.shipping import ship
from gaugewell.llm.simhash import near_duplicates
from gaugewell.llm.spelling import spelling_variants
from gaugewell.llm.texts import table
from gaugewell.llm.tokens import token_counts
from gaugewell.llm.toxicity import toxicity
from gaugewell.llm.warc import round_trip

#: Target shares of the mix; every other source has a share of one.
TARGET_SHARES = {"src0": 5}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(function):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return function(ship(spark), sf_dir)

    QUERIES[function.__name__] = run
    return function


@query
def op1_secret_scans(spark, sf_dir):
    return secrets.digests(secrets.find_secrets(table(spark, sf_dir, "documents")))


ORACLES["op1_secret_scans"] = sql.secret_scans()


@query
def op2_substring_dedup(spark, sf_dir):
    return remove_repeats(table(spark, sf_dir, "documents"))


ORACLES["op2_substring_dedup"] = sql.substring_dedup()


@query
def op3_benchmark_decontamination(spark, sf_dir):
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op4_toxicity(spark, sf_dir):
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op5_quality_classifier(spark, sf_dir):
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op6_source_mixing(spark, sf_dir):
    return mix_sources(table(spark, sf_dir, "documents").select("doc_id", "source"), TARGET_SHARES)


@query
def op7_simhash_near_dedup(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"))


@query
def op8_document_fingerprints(spark, sf_dir):
    return edited_likeness(table(spark, sf_dir, "documents"))


@query
def op9_warc(spark, sf_dir):
    return round_trip(table(spark, sf_dir, "pages"))


ORACLES["op9_warc"] = sql.warc()


def _edit(start, length, text):
    return F.struct(F.floor(start).alias("start"), F.floor(start + length).alias("end"), text.alias("text"))


@query
def op10_token_counts(spark, sf_dir):
    """Counts of every document before and after two edits: a replaced passage and a deleted one."""
    size = F.length(F.coalesce("text", F.lit("")))
    edits = F.array(_edit(size / 3, 12, F.concat(F.lit(" "), F.coalesce("source", F.lit("")), F.lit("'s note"))),
                    _edit(size * 2 / 3, 5, F.lit("")))
    return token_counts(table(spark, sf_dir, "documents"), edits)


@query
def op11_embedding_near_dedup(spark, sf_dir):
    return near_vectors(table(spark, sf_dir, "embeddings"))


ORACLES["op11_embedding_near_dedup"] = sql.near_vectors()


@query
def op12_conversation_prefix_trie(spark, sf_dir):
    return prefix_trie(table(spark, sf_dir, "conversations"))


ORACLES["op12_conversation_prefix_trie"] = sql.prefix_trie()


@query
def op13_spelling_variant_grouping(spark, sf_dir):
    return spelling_variants(table(spark, sf_dir, "documents"))


ORACLES["op13_spelling_variant_grouping"] = sql.spelling_variants()
