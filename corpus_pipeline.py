"""The corpus pipeline: each stage takes (spark, docs, sf_dir) and returns a DataFrame."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession

from lattix.llm import decontam, mixing, sharding, simhash, toxicity
from lattix.llm.common import Numbered
from lattix.plans.storage import materialize, release


def filtering(stage):
    """A stage that sees doc_id, text and source by name and all other columns under names that clash with none; it returns the columns as they were."""

    @functools.wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        shielded = Numbered(docs).shielded("doc_id", "text", "lang", "source", "n_chars")
        return stage(spark, shielded, sf_dir).select(*shielded.columns).toDF(*docs.columns)

    return run_stage


@filtering
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, fitted on the labelled ones of them, doesn't reject."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs, model).where("predicted = 0")


@filtering
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of fingerprints (three-word shingles) linked at two or fewer differing bits."""
    return simhash.keep_one(docs)


@filtering
def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a whole window of ``decontam.WIDTH`` words of a benchmark item, however long they are.

    Words of shorter items, which are common in clean text, tell only if they make up one word in twenty.
    """
    found = decontam.digest(decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))
    return found.where(f"not contaminated and longest_window < {decontam.WIDTH}")


@filtering
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many tokens as there are, dealt out by target weights; a document comes once for each epoch that takes it."""
    return mixing.mix(docs, mixing.corpus_levels(), mixing.CORPUS_WEIGHTS, (1, 1), 2, seed=7)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Eight shards of nearly equal bytes."""
    return sharding.shard(docs, 8)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("sharding", shard),
]

#: SQL can't express the stages that score with a trained model or hash with XXH64.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        kept = materialize(stage(spark, docs, sf_dir), name)
        release(docs)
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
