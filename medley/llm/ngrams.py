"""Stupid-backoff scores of documents under trigram counts of the whole corpus, by joins of count tables.

Words are lower-cased in ASCII and stand as 64-bit hashes, all of them: no vocabulary is cut or held anywhere.
Every document starts with two start marks, so that each word ends exactly one trigram.

    counts(u v w) = occurrences of a trigram in the corpus; bigram, unigram and context counts are its sums
    score(w|u v)  = c(u v w) / c(u v)                  if c(u v w) >= `least`
                    backoff * c(v w) / c(v)            else if c(v w) >= `least`
                    backoff^2 * c(w) / N               else
    log_score     = sum of log score over the document's words

An n-gram seen once has no other evidence than the scored place itself, hence `least` = 2.

Documents are dealt into batches of about `BATCH` words, kept as rows of word numbers. Every batch sends each distinct
n-gram of its documents once, as a 64-bit code with its count and how often it ends a document, packed by ranges of the
codes as compressed steps from code to code.
The count tables are those ranges: a task adds up the counts of one range over all batches and answers every
batch in the order it asked. The answers meet the batches again, where each word's n-grams are looked up, scored and
summed per document. A frequent n-gram is one entry per batch, however many documents have it; ranges hold about
`RANGE` entries, so no task grows. Codes are taken for equality at 64 bits.

Defined results: null, empty and blank texts have no words, score 0 and no mean; null ids stay null; rows that
share an id are scored one by one, equal rows get equal scores (each counts in the corpus); an empty table
gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from medley.llm.common import released, utf8, written

BACKOFF = 0.4
LEAST = 2
MEMO = 1 << 18  # words whose hashes a task keeps; does not change results
BATCH, RANGE = 1 << 20, 1 << 20  # words of a batch, entries of a range; they do not change results
ALONE = 1024  # numbers from which on byte planes are compressed one by one

_u = np.uint64


class WordHashes(dict):
    """64-bit hash of every word, kept for the words seen last; 0 stands for the start mark."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO:
            self.clear()
        out = self[word] = int.from_bytes(blake2b(word, digest_size=8).digest(), "little") or 1
        return out


def _mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _u(30))) * _u(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _u(27))) * _u(0x94D049BB133111EB)
    return x ^ (x >> _u(31))


def _code(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Code of a sequence from that of its beginning and its last word."""
    with np.errstate(over="ignore"):
        return _mixed(a * _u(0x9E3779B97F4A7C15) + _mixed(b + _u(0x632BE59BD9B4E019)))


def _planes(x: np.ndarray) -> bytes:
    """Numbers as compressed planes of their bytes: those of steps between codes and of small counts are nearly constant.

    A plane of random bytes spoils the code table of its neighbours, so long arrays have every plane compressed alone.
    """
    planes = x.view(np.uint8).reshape(len(x), x.itemsize).T
    if len(x) < ALONE:
        return b"\0" + zstandard.compress(planes.tobytes(), 1)
    parts = [zstandard.compress(p.tobytes(), 1) for p in planes]
    return b"\1" + np.array([len(p) for p in parts], np.uint32).tobytes() + b"".join(parts)


def _from_planes(x: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    if x[0]:
        cuts = np.cumsum([1 + 4 * size, *np.frombuffer(x, np.uint32, size, 1)])
        planes = b"".join(zstandard.decompress(x[a:b]) for a, b in zip(cuts[:-1], cuts[1:]))
    else:
        planes = zstandard.decompress(x[1:])
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(size, -1).T).reshape(-1).view(kind)


def _steps(rising: np.ndarray) -> np.ndarray:
    return np.diff(rising, prepend=_u(0))


def _sum_of_steps(x: np.ndarray) -> np.ndarray:
    return np.cumsum(x, dtype=_u)


_packed = pa.schema([
    ("batch", pa.int64()), ("ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())), ("words", pa.binary()), ("numbers", pa.binary()), ("n", pa.int64()),
])
PACKED = "batch long, ids array<long>, sizes array<long>, words binary, numbers binary, n long"


def _pack(batch: int, ids: list, sizes: list, hashes: list) -> pa.RecordBatch:
    words, numbers, times = np.unique(np.concatenate([np.zeros(0, _u), *hashes]), return_inverse=True, return_counts=True)
    often = np.argsort(-times)  # frequent words get small numbers, which compress
    rank = np.empty(len(words), np.int32)
    rank[often] = np.arange(len(words))
    row = ([batch], [ids], [sizes], [_planes(words[often])], [_planes(rank[numbers])], [sum(sizes)])
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(row, _packed)], schema=_packed)


def word_batches(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row per batch: its documents' ids and numbers of words, its distinct words, and all words as numbers of those."""

    def rows(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, number = WordHashes(), TaskContext.get().partitionId() << 32
        ids, sizes, found, held = [], [], [], 0
        for whole in it:
            for at in range(0, whole.num_rows, 200):
                some = whole.slice(at, 200)
                for i, text in zip(some.column("id").to_pylist(), utf8(some, "text")):
                    split = text.lower().split()
                    ids.append(i)
                    sizes.append(len(split))
                    found.append(np.fromiter(map(hashes.__getitem__, split), _u, len(split)))
                    held += len(split) + 1
                    if held >= BATCH:
                        yield _pack(number, ids, sizes, found)
                        number, ids, sizes, found, held = number + 1, [], [], [], 0
        if ids:
            yield _pack(number, ids, sizes, found)

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(rows, PACKED)


class Grams:
    """The distinct n-gram codes of a batch in order, their counts, and where those of every word stand.

    Every n-gram is the context of the next word, but for the last ones of a document: its count as a context is
    its count less `lasts`. The start marks count once per document that has words.
    """

    def __init__(self, sizes: np.ndarray, words: bytes, numbers: bytes) -> None:
        names = np.concatenate([np.zeros(1, _u), _from_planes(words, _u)])
        at = _from_planes(numbers, np.int32).astype(np.int64) + 1
        n, begins = len(at), np.cumsum(sizes) - sizes
        self.doc = np.repeat(np.arange(len(sizes)), sizes)
        inner = np.ones(n, bool)
        inner[begins[sizes > 0]] = False
        final = (begins + sizes - 1)[sizes > 0]
        before = np.where(inner, np.r_[0, at][:n], 0)
        single = _code(np.zeros(1, _u), names)
        opening = _code(single[:1], names[:1])
        pair = _code(single[before], names[at])
        triple = _code(np.where(inner, np.r_[opening, pair][:n], opening), names[at])
        times = np.concatenate([np.bincount(at, minlength=len(names)), [len(final)], np.ones(2 * n, np.int64)])
        times[0] = len(final)
        every = np.concatenate([single, opening, pair, triple])
        order = np.argsort(every)
        every = every[order]
        new = np.r_[True, every[1:] != every[:-1]]
        place = np.empty(len(every), np.int64)
        place[order] = np.cumsum(new) - 1
        self.codes = every[new]
        self.ends = np.bincount(place, times).astype(np.int64)
        pairs = place[len(names) + 1 :][:n]
        self.word, self.pair, self.triple = place[at], pairs, place[len(names) + 1 + n :]
        self.context, self.pair_context = place[before], np.where(inner, np.r_[place[len(names)], pairs][:n], place[len(names)])
        self.lasts = np.bincount(np.r_[self.word[final], self.pair[final]], minlength=len(self.codes))

    def cuts(self, ranges: int) -> np.ndarray:
        """Where each range of codes begins, and the end."""
        inside = (self.codes >> _u(32)) * _u(ranges) >> _u(32)
        return np.searchsorted(inside, np.arange(ranges + 1))


def _asked(packed: DataFrame, ranges: int) -> DataFrame:
    """(range, batch, codes, ends, lasts): the distinct n-grams of every batch by range, with their counts there."""
    schema = pa.schema([("range", pa.int32()), ("batch", pa.int64()), ("codes", pa.binary()), ("ends", pa.binary()), ("lasts", pa.binary())])

    def rows(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for b, sizes, words, numbers in zip(*(batch.column(c).to_pylist() for c in ("batch", "sizes", "words", "numbers"))):
                g = Grams(np.array(sizes, np.int64), words, numbers)
                cuts = g.cuts(ranges)
                some = np.flatnonzero(np.diff(cuts))
                codes = [_planes(_steps(g.codes[cuts[p] : cuts[p + 1]])) for p in some]
                parts = [codes, *([_planes(x[cuts[p] : cuts[p + 1]]) for p in some] for x in (g.ends.astype(np.uint32), g.lasts.astype(np.uint32)))]
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(np.full(len(some), b), pa.int64()), *(pa.array(x, pa.binary()) for x in parts)], schema=schema)

    return packed.select("batch", "sizes", "words", "numbers").mapInArrow(rows, "range int, batch long, codes binary, ends binary, lasts binary")


def _counted(table: pa.Table) -> pa.Table:
    """The counts of a range over all batches, for every batch in the order of its codes."""
    codes = [_sum_of_steps(_from_planes(x, _u)) for x in table.column("codes").to_pylist()]
    _, at = np.unique(np.concatenate(codes), return_inverse=True)
    cuts = np.cumsum([len(c) for c in codes])[:-1]
    out = []
    for c in ("ends", "lasts"):
        counts = np.concatenate([_from_planes(x, np.uint32) for x in table.column(c).to_pylist()])
        total = np.bincount(at, counts).astype(np.int64)[at]  # exact below 2^53
        out.append(pa.array([_planes(x) for x in np.split(total, cuts)], pa.binary()))
    return pa.table([table.column("range"), table.column("batch"), *out], names=["range", "batch", "ends", "lasts"])


def scored(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", backoff: float = BACKOFF, least: int = LEAST) -> DataFrame:
    """doc_id, n_words, log_score and mean_score of every document."""
    spark = docs.sparkSession
    packed = written(word_batches(docs, id_col, text_col))
    total = packed.agg(F.sum("n")).first()[0] or 0
    ranges = max(1, -(-2 * total // RANGE))
    counts = written(_asked(packed, ranges).groupBy("range").applyInArrow(_counted, "range int, batch long, ends binary, lasts binary"))
    released(spark)
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("log_score", pa.float64())])

    def score(batch: pa.Table, answers: pa.Table) -> pa.Table:
        sizes = np.array(batch.column("sizes")[0].as_py(), np.int64)
        g = Grams(sizes, batch.column("words")[0].as_py(), batch.column("numbers")[0].as_py())
        answers = answers.sort_by("range")
        ends, lasts = (np.concatenate([np.zeros(0, np.int64), *(_from_planes(x, np.int64) for x in answers.column(c).to_pylist())]) for c in ("ends", "lasts"))
        followed = np.maximum(ends - lasts, 1)
        triple, pair = ends[g.triple], ends[g.pair]
        long = np.log(triple / followed[g.pair_context])
        middle = np.log(backoff) + np.log(pair / followed[g.context])
        short = 2 * np.log(backoff) + np.log(ends[g.word] / max(total, 1))
        s = np.where(triple >= least, long, np.where(pair >= least, middle, short))
        sums = np.bincount(g.doc, s, minlength=len(sizes))
        return pa.table([batch.column("ids").combine_chunks().flatten(), pa.array(sizes), pa.array(sums)], schema=schema)

    out = packed.groupBy("batch").cogroup(counts.groupBy("batch")).applyInArrow(score, "doc_id long, n_words long, log_score double")
    return out.withColumn("mean_score", F.col("log_score") / F.nullif("n_words", F.lit(0)))
