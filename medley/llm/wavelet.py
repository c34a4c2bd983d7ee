"""Token ids in compressed files that answer access, count and occurrence queries: one wavelet matrix per block.

Format: a folder with one zstd-compressed Parquet file per shard, `shard=S/...`; a shard is a range of
documents in ascending id order, a row is a block of whole documents (closed at `BLOCK_TOKENS` tokens):

    block    number inside the shard               first    tokens of the shard before the block
    doc_ids  ids of its documents                  lengths  their token counts, end token included
    zeros    per plane, how many tokens have bit 0
    planes   the bit planes, highest bit first, each padded to whole bytes
    ranks    per plane, set bits before every 512th bit (little-endian unsigned 32-bit)

In plane b tokens stand in the order left by the planes above it, tokens with bit 0 before those with bit 1.

Numbers: texts are encoded where they are read and only packed ids are shuffled, by shards whose bounds are
quantiles of the ids; a task sorts its shard and streams it into blocks, so its memory is that of a block.
Files are committed by Spark, so lost tasks leave nothing half written.

Defined results: null and empty texts give the end token alone; null ids come first; rows with equal ids stay
separate, ordered by their ids; equal texts are stored each time; an empty table gives a folder without blocks;
other columns are ignored. A document longer than a block is a block of its own.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from medley.llm.common import NULL_ID, utf8
from medley.llm.wordpieces import LibraryWords, WordSplitter
from medley.plans.skew import temporary_path

BLOCK_TOKENS = 1 << 18
STEP = 512


class WaveletMatrix:
    """Rank and select over a block of tokens."""

    def __init__(self, n: int, zeros: list[int], planes: list[np.ndarray], ranks: list[np.ndarray]) -> None:
        self.n, self.zeros, self.planes, self.ranks, self.bits = n, zeros, planes, ranks, len(planes)

    @classmethod
    def of(cls, tokens: np.ndarray, bits: int) -> WaveletMatrix:
        rest = tokens.astype(np.uint16 if bits <= 16 else np.uint32)
        zeros, planes, ranks = [], [], []
        for b in range(bits - 1, -1, -1):
            bit = (rest >> rest.dtype.type(b)) & rest.dtype.type(1) != 0
            packed = np.packbits(bit)
            planes.append(packed)
            sums = np.add.reduceat(_ones[packed], np.arange(0, len(packed), STEP // 8), dtype=np.uint32) if len(packed) else np.zeros(0, np.uint32)
            ranks.append(np.concatenate([[0], np.cumsum(sums)]).astype(np.uint32))
            low = rest[~bit]
            zeros.append(len(low))
            rest = np.concatenate([low, rest[bit]])
        return cls(len(tokens), zeros, planes, ranks)

    @classmethod
    def read(cls, n: int, zeros: list[int], planes: bytes, ranks: bytes) -> WaveletMatrix:
        width, steps = -(-n // 8), -(-n // STEP) + 1
        p, r = np.frombuffer(planes, np.uint8), np.frombuffer(ranks, "<u4")
        return cls(n, list(zeros), [p[i * width : (i + 1) * width] for i in range(len(zeros))], [r[i * steps : (i + 1) * steps] for i in range(len(zeros))])

    def _ones_before(self, plane: int, i: int) -> int:
        step = i // STEP
        part = np.unpackbits(self.planes[plane][step * STEP // 8 : -(-i // 8)])
        return int(self.ranks[plane][step]) + int(part[: i - step * STEP].sum())

    def _bit(self, plane: int, i: int) -> int:
        return int(self.planes[plane][i >> 3]) >> (7 - (i & 7)) & 1

    def access(self, i: int) -> int:
        token = 0
        for plane in range(self.bits):
            bit, ones = self._bit(plane, i), self._ones_before(plane, i)
            token = token << 1 | bit
            i = self.zeros[plane] + ones if bit else i - ones
        return token

    def _span(self, token: int, end: int) -> tuple[int, int]:
        """Range in the final order taken by the token's occurrences before place `end`."""
        if token >> self.bits:
            return 0, 0
        low, high = 0, end
        for plane in range(self.bits):
            a, b = self._ones_before(plane, low), self._ones_before(plane, high)
            low, high = (self.zeros[plane] + a, self.zeros[plane] + b) if token >> (self.bits - 1 - plane) & 1 else (low - a, high - b)
        return low, high

    def count(self, token: int, end: int | None = None) -> int:
        low, high = self._span(token, self.n if end is None else end)
        return high - low

    def _select(self, plane: int, bit: int, j: int) -> int:
        """Place of the j-th (from 0) given bit in a plane."""
        ranks = self.ranks[plane].astype(np.int64)
        before = ranks if bit else np.minimum(np.arange(len(ranks)) * STEP, self.n) - ranks
        step = int(np.searchsorted(before, j, side="right")) - 1
        part = np.unpackbits(self.planes[plane][step * STEP // 8 : (step + 1) * STEP // 8])[: self.n - step * STEP]
        return step * STEP + int(np.flatnonzero(part == bit)[j - int(before[step])])

    def locate(self, token: int, j: int) -> int:
        """Place of the token's j-th occurrence (from 0)."""
        low, high = self._span(token, self.n)
        if not 0 <= j < high - low:
            raise IndexError(j)
        at = low + j
        for plane in range(self.bits - 1, -1, -1):
            bit = token >> (self.bits - 1 - plane) & 1
            at = self._select(plane, bit, at - self.zeros[plane] if bit else at)
        return at

    def tokens(self) -> np.ndarray:
        """All tokens in order."""
        out = np.zeros(self.n, np.uint16 if self.bits <= 16 else np.uint32)
        for plane in range(self.bits - 1, -1, -1):
            bit = np.unpackbits(self.planes[plane], count=self.n).astype(bool)
            above = np.empty_like(out)
            above[~bit] = out[: self.zeros[plane]]
            above[bit] = out[self.zeros[plane] :] | out.dtype.type(1 << (self.bits - 1 - plane))
            out = above
        return out


_ones = np.array([bin(i).count("1") for i in range(256)], np.uint8)


@lru_cache(maxsize=2)
def library_words(path: str, wide: bool) -> LibraryWords:
    """One memo for each Python worker."""
    return LibraryWords(path, wide)


BLOCKS = "shard int, block int, first long, doc_ids array<long>, lengths array<int>, zeros array<int>, planes binary, ranks binary"
_blocks = pa.schema([
    ("shard", pa.int32()), ("block", pa.int32()), ("first", pa.int64()), ("doc_ids", pa.list_(pa.int64())),
    ("lengths", pa.list_(pa.int32())), ("zeros", pa.list_(pa.int32())), ("planes", pa.binary()), ("ranks", pa.binary()),
])


def write_tokens(docs: DataFrame, folder: str, path: str, end_token: int = 2, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every text and write the files."""
    spark = docs.sparkSession
    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("k"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    cuts = [i / shards for i in range(1, shards)] or [0.5]
    bounds = rows.agg(F.percentile_approx("k", cuts, 100 * shards + 10_000)).first()[0] or []
    bounds = np.unique(np.array(bounds, np.int64))
    bits = max(1, max(WordSplitter(path).tokenizer.get_vocab_size() - 1, end_token).bit_length())
    kind = "<u2" if bits <= 16 else "<u4"
    end = np.array([end_token], kind).tobytes()

    packed = pa.schema([("shard", pa.int32()), ("k", pa.int64()), ("doc_id", pa.int64()), ("ids", pa.binary())])

    def encode(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            words = library_words(path, bits > 16)
            ids = [words.encode(t) + end for t in utf8(batch, "text")]
            k = batch.column("k").to_numpy()
            shard = np.searchsorted(bounds, k, side="right").astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(shard), batch.column("k"), batch.column("doc_id"), pa.array(ids, pa.binary())], schema=packed)

    def block(shard: int, number: int, first: int, ids: list, parts: list[bytes]) -> pa.RecordBatch:
        tokens = np.frombuffer(b"".join(parts), kind)
        m = WaveletMatrix.of(tokens, bits)
        values = (shard, number, first, ids, [len(p) // tokens.itemsize for p in parts], m.zeros, b"".join(p.tobytes() for p in m.planes), b"".join(r.astype("<u4").tobytes() for r in m.ranks))
        return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, _blocks)], schema=_blocks)

    def build(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, number, first, size, ids, parts = -1, 0, 0, 0, [], []
        width = int(kind[-1])
        for batch in it:
            for s, i, p in zip(batch.column("shard").to_pylist(), batch.column("doc_id").to_pylist(), batch.column("ids").to_pylist()):
                if parts and (s != shard or size + len(p) // width > BLOCK_TOKENS):
                    yield block(shard, number, first, ids, parts)
                    number, first, size, ids, parts = number + 1, first + size, 0, [], []
                if s != shard:
                    shard, number, first = s, 0, 0
                size += len(p) // width
                ids.append(i)
                parts.append(p)
        if parts:
            yield block(shard, number, first, ids, parts)

    (
        rows.mapInArrow(encode, "shard int, k long, doc_id long, ids binary")
        .repartition(shards, "shard")
        .sortWithinPartitions("shard", "k", "ids")
        .select("shard", "doc_id", "ids")
        .mapInArrow(build, BLOCKS)
        .write.partitionBy("shard")
        .option("compression", "zstd")
        .parquet(folder)
    )


def blocks(spark: SparkSession, folder: str) -> DataFrame:
    """The files' rows, with `start`: tokens of all documents before the block. One row per shard is broadcast."""
    files = spark.read.schema(BLOCKS).parquet(folder)
    shard_tokens = files.groupBy("shard").agg(F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    offsets = shard_tokens.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shard_start"))
    return files.join(F.broadcast(offsets), "shard").withColumn("start", F.col("shard_start") + F.col("first")).drop("shard_start")


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the files alone."""
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("shard", pa.int32())])

    def rows(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for r in batch.to_pylist():
                lengths = np.array(r["lengths"], np.int64)
                ends = np.cumsum(lengths)
                tokens = WaveletMatrix.read(int(ends[-1]), r["zeros"], r["planes"], r["ranks"]).tokens().astype("<u4")
                starts = ends - lengths
                crc = [zlib.crc32(tokens[a:b].data) for a, b in zip(starts.tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(r["doc_ids"], pa.int64()), pa.array(starts + r["start"]), pa.array(lengths), pa.array(crc, pa.int64()), pa.array(np.full(len(crc), r["shard"], np.int32))],
                    schema=schema,
                )

    return blocks(spark, folder).mapInArrow(rows, "doc_id long, start long, n_tokens long, ids_crc32 long, shard int")


def token_counts(spark: SparkSession, folder: str, tokens: list[int]) -> DataFrame:
    """(token, n): occurrences of each asked token, counted by rank in every block without decoding it."""
    asked = sorted(set(tokens))
    schema = pa.schema([("token", pa.int64()), ("n", pa.int64())])

    def rows(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for r in batch.to_pylist():
                m = WaveletMatrix.read(sum(r["lengths"]), r["zeros"], r["planes"], r["ranks"])
                yield pa.RecordBatch.from_arrays([pa.array(asked, pa.int64()), pa.array([m.count(t) for t in asked], pa.int64())], schema=schema)

    return blocks(spark, folder).mapInArrow(rows, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))


def stored(docs: DataFrame, path: str, end_token: int = 2) -> DataFrame:
    """Write the files to the shared folder and read the documents back."""
    spark = docs.sparkSession
    folder = temporary_path(spark)
    write_tokens(docs, folder, path, end_token)
    return read_documents(spark, folder)
