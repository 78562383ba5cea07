"""A training-data pipeline over ``documents``.

Language identification drops what it rejects, the n-gram join keeps one
document of each group of near copies, decontamination drops documents into
which a benchmark item leaked, mixing repeats or leaves out documents until
each source meets its target, and sharding gives every remaining row its shard.

All columns of the documents go through every stage, whatever their names; the
last adds ``shard`` and ``slot`` (input columns so called give way to them).

Defined results, stage by stage: null texts, and texts without a letter, go in
the first stage, as their language is unknown; very long texts are treated
whole; rows without an id, and rows that repeat one, are judged row by row, so
that a distinct text never goes because of its id; of equal or near equal texts
the one with the smallest id stays, rows without an id last; a null source is a
source of its own; a null in any other column is kept; an empty table stays
empty with the same columns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tributary.llm import decontaminate, langid, mixing, ngram_join, sharding
from tributary.llm.common import drop_saved, saved, table

#: Words of a shingle and similarity in percent of near copies.
WORDS, PERCENT = 5, 80

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.keep_identified(docs, langid.fit(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.keep_one(docs, WORDS, PERCENT)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sharding.sharded(docs)


STAGES: list[tuple[str, Stage]] = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("benchmark_decontamination", benchmark_decontamination),
    ("source_mixing", source_mixing),
    ("shards", shards),
]

#: Centroids, components and label propagation have no SQL form; tests compare with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before, docs = docs, saved(stage(spark, docs, sf_dir), f"pipeline-{name}")
        drop_saved(before)  # a stage's table goes when the next one is written
    return docs
