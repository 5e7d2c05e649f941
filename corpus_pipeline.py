"""A training corpus from ``documents``: quality, near-duplicates, decontamination, mix
and shards. Each stage is written as Parquet and read again by the next.

Every stage takes whole rows and gives whole rows, with whatever columns there are and
under any names, and an empty table gives an empty one. What a stage makes of nulls,
ties, repeated rows and very long texts its own lines say.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lakeward.llm import decontaminate, mixing, quality, sharding, simhash
from lakeward.llm.shared import discard, stored

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def accept_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. A null or empty text is scored like any
    other, repeated rows each; without a positive label nothing is rejected."""
    return quality.accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each SimHash group stays; of rows that
    repeat it, the one of least text hash. Null texts and texts without words are one
    group; a group without a doc_id keeps one row."""
    return simhash.deduplicated(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold enough of a benchmark item go. A null text has no words and
    stays, rows are judged one by one; null and empty items match nothing."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it, at most three times. Texts
    without words have size 0 and are not taken; a null source is one of its own; rows
    that agree in source, doc_id and text share their copies."""
    return mixing.mixed(docs)


def cut_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The shard and slot of every row, without its text. Rows that agree in text stand
    together, ties by doc_id; null texts are one group."""
    return sharding.shard(docs, keep=("lang", "source", "n_chars"))


STAGES: list[tuple[str, Stage]] = [
    ("quality", accept_quality),
    ("near-duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mix", mix_sources),
    ("shards", cut_shards),
]

#: A fitted classifier is no SQL; the tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs, f"pipeline-{name}")
            if i:
                discard(spark, before)  # the stage before last, which nothing reads any more
    return docs
