"""From raw documents to sharded training data: five stages, each an operator of leafspark.llm over all that the one
before has kept. Stages but the last return the columns of documents.

What the stages do with nulls, empty and very long texts, repeated rows, empty tables and other columns is what their
operators' docstrings say. A stage whose labelled table has no domain of some target raises."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from leafspark.llm import decontaminate, mixing, near_copies, quality, sharding
from leafspark.llm.common import drop, settle, table
from leafspark.llm.queries import TARGETS, labelled_domains


def good_text(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal quality model accepts."""
    ratings = quality.graded(table(spark, sf_dir, "labels"))
    return quality.accepted(docs, quality.fit(docs, ratings))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, by sets of 5-word shingles alike to 0.8: that of least doc_id."""
    return near_copies.one_of_each(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its rate says: some of a language above its target go, those of one below it repeat."""
    return mixing.remixed(docs, labelled_domains(docs, table(spark, sf_dir, "labels")), TARGETS)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each row goes."""
    return sharding.shard_documents(docs)


STAGES = [("quality", good_text), ("near_duplicates", one_of_each), ("decontamination", decontaminated), ("mixing", mixed), ("sharding", sharded)]

#: A trained classifier and 64-bit hashes of shingles are beyond the oracle's SQL; tests use a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, older = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = settle(spark, name, lambda stage=stage, docs=docs: stage(spark, docs, sf_dir))
        if older is not None:
            drop(older)
        older = docs
    return STAGES[-1][1](spark, docs, sf_dir)
