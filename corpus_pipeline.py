"""From raw documents to a tokenised training mix: five stages, each of which one corpus operator decides.

Every stage reads what its predecessor kept, as Parquet, and returns a table; all but the last return the columns of
``documents``.  Nulls, empty and very long texts, repeated rows, empty tables and additional columns have the results that the
operators' modules define; additional columns are passed through.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession

from lakesync.llm import bpe, line_rules, mixing, near_dedup, toxicity
from lakesync.llm.common import materialise
from lakesync.session import set_runtime_defaults


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score reaches the threshold go; the model learns from the labels of this input's documents."""
    return toxicity.accepted_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def apply_quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that too many documents of a source share go, and so do documents that fail the rules."""
    return line_rules.kept_documents(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id stays."""
    return near_dedup.kept_documents(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every source is cut at, or repeated up to, its target; a document taken twice is two rows."""
    return mixing.mixed_documents(docs)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and the ids (little-endian, 4 bytes each) of every row of the mix."""
    return bpe.encoded(docs, bpe.read_tokenizer(spark))


def _with_defaults(stage):
    """The stage under the session defaults that queries run with."""
    @functools.wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        set_runtime_defaults(spark)
        return stage(spark, docs, sf_dir)

    return run_stage


STAGES = [
    ("toxicity", _with_defaults(drop_toxic)),
    ("quality rules", _with_defaults(apply_quality_rules)),
    ("near duplicates", _with_defaults(drop_near_duplicates)),
    ("mixing", _with_defaults(mix_sources)),
    ("tokens", _with_defaults(tokenise)),
]

#: A trained classifier, set similarity and BPE are beyond SQL; tests/llm holds the stages against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return docs
