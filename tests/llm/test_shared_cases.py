"""Cases that every operator on documents has to stand: partitions without words, clashing column names."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from medley.llm import bpe, minhash, mixing, ngrams, personal, quality, sharding, suffixes, wavelet
from medley.llm.queries import vocabulary

LABELS = [(1, "clean"), (2, "junk"), (3, "clean"), (4, "junk")]


def _rates(d):
    labels = d.sparkSession.createDataFrame(LABELS, "doc_id long, domain string")
    return mixing.rates(d, labels, {"clean": 0.9, "junk": 0.1}).drop("u")


OPERATORS = {
    "shards": lambda d: sharding.sharded(d, shards=4),
    "tokens": lambda d: wavelet.stored(d, vocabulary(), end_token=2),
    "copies": minhash.near_duplicates,
    "scores": ngrams.scored,
    "personal": personal.found,
    "rates": _rates,
    "pieces": lambda d: bpe.digests(d, vocabulary()),
    "repeats": suffixes.deduplicated,
    "rules": lambda d: quality.quality(d, with_text=False),
}
STAGES = {"rules": quality.clean, "copies": minhash.deduplicated, "personal": personal.masked}
BLANK = [(1, None), (2, ""), (3, " "), (4, " \n\t\r "), (None, None), (4, "")]
CLASHES = ("id", "k", "tie", "s", "n", "b", "v", "a", "c", "row", "root", "hidden", "key", "kept", "size", "shard", "slot", "words", "spans", "start", "rate", "weight", "domain", "tf", "code", "bands", "found")


def rows_of(df):
    return sorted((tuple(sorted(r.asDict().items())) for r in df.collect()), key=str)


@pytest.mark.parametrize("name", OPERATORS)
def test_one_partition_without_words(docs, name):
    got = OPERATORS[name](docs(BLANK, 1))
    assert got.count() == len(BLANK)


@pytest.mark.parametrize("name", STAGES)
def test_stage_without_words(docs, name):
    assert STAGES[name](docs(BLANK, 1)).columns == docs([]).columns


def test_partition_without_words_beside_others(docs):
    one, two = docs([(10, "a b c d e f g"), (11, "a b c d e f g")], 1), docs(BLANK, 1)
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(one.unionByName(two)).collect()}
    assert got[11] == 10 and got[2] == 2


@pytest.mark.parametrize("name", OPERATORS)
def test_clashing_columns(docs, sample, name):
    plain = docs([*sample[:40], (None, None), (900, "")])
    extra = plain.withColumns({c: F.lit("clash") for c in CLASHES})
    assert rows_of(OPERATORS[name](extra)) == rows_of(OPERATORS[name](plain))


@pytest.mark.parametrize("name", STAGES)
def test_stages_keep_clashing_columns(docs, sample, name):
    plain = docs([*sample[:40], (901, "")])
    extra = plain.withColumns({c: F.lit("clash") for c in CLASHES})
    got = STAGES[name](extra)
    assert got.columns == extra.columns and rows_of(got.select(plain.columns)) == rows_of(STAGES[name](plain))
