"""From raw documents to mixed, deduplicated, masked and encoded ones, stage by stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from medley.llm import bpe, minhash, mixing, personal, quality
from medley.llm.common import documents, written
from medley.llm.queries import domain_labels, vocabulary


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules, without their failed lines."""
    return quality.clean(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return minhash.deduplicated(docs, percent=80)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind."""
    return personal.masked(docs)


#: Junk is gone by now: what is not toxic is one domain, which keeps its words.
MIX = {"clean": 0.97, "toxic": 0.03}


def mixing_rates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents taken as often as their rate says; toxic ones are thinned out, or repeated where they are below their share."""
    labels = domain_labels(spark, sf_dir).replace({"junk": "clean"}, subset=["domain"])
    return mixing.mixed(docs, labels, MIX)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of ids and decoded text, one row per document copy."""
    return bpe.digests(docs, vocabulary())


STAGES = [
    ("quality rules", quality_rules),
    ("MinHash near-dedup", near_duplicates),
    ("personal data", personal_data),
    ("mixing to target weights", mixing_rates),
    ("BPE encoding and decoding", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written to the shared folder and read again."""
    docs = documents(spark, sf_dir)
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


#: The CRF of the personal-data stage and the tokenizer have no SQL form.
ORACLE_SQL = None
