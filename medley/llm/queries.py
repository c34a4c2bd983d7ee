"""Registered queries of the package, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from medley.llm import bpe, impacts, minhash, mixing, neighbours, ngrams, personal, quality, quantised, residues, sharding, suffixes, wavelet
from medley.llm.common import documents
from medley.llm.oracle import SQL

__all__ = ["QUERIES", "SQL", "domain_labels", "vocabulary"]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    """Place of a public tokenizer file, outside the repository."""
    import public_tokenizers

    return public_tokenizers.path(name)


#: Domain weights of the mix: the first keeps its words, the others are thinned out.
MIX = {"clean": 0.94, "junk": 0.03, "toxic": 0.03}


def domain_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, domain) from the labelled documents."""
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "junk").when(F.col("quality") == 1, "clean")
    return spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", domain.alias("domain")).where("domain is not null")


@query
def op1_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.sharded(documents(spark, sf_dir), shards=16)


@query
def op2_wavelet_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wavelet.stored(documents(spark, sf_dir), vocabulary(), end_token=2)


@query
def op3_minhash_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(documents(spark, sf_dir), percent=85)


@query
def op4_quantised_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quantised.near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), threshold=0.95)


@query
def op5_backoff_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = ngrams.scored(documents(spark, sf_dir))
    return scored.withColumns({c: F.round(c, 4) for c in ("log_score", "mean_score")})


@query
def op6_crf_personal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal.found(documents(spark, sf_dir))


@query
def op7_soft_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.rates(documents(spark, sf_dir), domain_labels(spark, sf_dir), MIX).drop("u")


@query
def op8_trie_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(documents(spark, sf_dir), vocabulary())


@query
def op9_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.deduplicated(documents(spark, sf_dir))


@query
def op10_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(documents(spark, sf_dir), with_text=False)


@query
def op11_residue_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return residues.hard_negatives(vectors.withColumn("label", moved), F.col("vec_id") % 100 == 0)


@query
def op12_descent_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest_rows(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 100 == 0, k=10)


@query
def op13_impact_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return impacts.ranked(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), top=20)
