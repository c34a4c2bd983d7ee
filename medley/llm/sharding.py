"""Reproducible shuffle and shards: a keyed Feistel permutation of the global row numbers.

Rows are numbered 0..n-1 in the order of (id, text hash). A balanced Feistel network permutes the next
power of four above n; values that fall outside 0..n-1 are sent through again until they fall inside
(cycle walking), so the permutation is exactly one of 0..n-1. A row at permuted place p belongs to shard
p mod shards at slot p div shards: row counts differ by at most one and slots have no gaps. Both ways
are computable from (n, seed) alone: `place` gives shard and slot of a row number, `row_at` the reverse.

Numbers: range partitions over (id, text hash, row tag), where the tag spreads equal rows over
partitions; the sorted frame is written once, and every partition's offset comes from one small table of
partition counts, so no step brings a hot id to one task and texts are never shuffled.

Defined results: null ids come first; rows with equal ids are ordered by a hash of their text; rows equal
in both get consecutive numbers in an arbitrary order; null text has size 1 and crc 0; an empty table
gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from medley.llm.common import NULL_ID, written

ROUNDS = 6


def _mixed(x: np.ndarray, key: int) -> np.ndarray:
    """A fixed 64-bit finalizer (splitmix64) of half-block values under a round key."""
    with np.errstate(over="ignore"):
        z = x + np.uint64(key)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def _keys(seed: int) -> list[int]:
    start = np.arange(1, ROUNDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return [int(k) for k in _mixed(start, seed % 2**64)]


def _half_bits(n: int) -> int:
    return max(1, ((max(n, 2) - 1).bit_length() + 1) // 2)


def _network(x: np.ndarray, bits: int, keys: list[int], forward: bool) -> np.ndarray:
    mask, shift = np.uint64((1 << bits) - 1), np.uint64(bits)
    left, right = x >> shift, x & mask
    for key in keys if forward else reversed(keys):
        if forward:
            left, right = right, left ^ (_mixed(right, key) & mask)
        else:
            left, right = right ^ (_mixed(left, key) & mask), left
    return (left << shift) | right


def permuted(numbers: np.ndarray, n: int, seed: int, forward: bool = True) -> np.ndarray:
    """Permutation of 0..n-1 (or its inverse) at the given numbers."""
    bits, keys = _half_bits(n), _keys(seed)
    out = _network(numbers.astype(np.uint64), bits, keys, forward)
    outside = np.flatnonzero(out >= np.uint64(n))
    while len(outside):
        out[outside] = _network(out[outside], bits, keys, forward)
        outside = outside[out[outside] >= np.uint64(n)]
    return out.astype(np.int64)


def place(number: int, n: int, shards: int, seed: int = 0) -> tuple[int, int]:
    """Shard and slot of a row number."""
    slot, shard = divmod(int(permuted(np.array([number]), n, seed)[0]), shards)
    return shard, slot


def row_at(shard: int, slot: int, n: int, shards: int, seed: int = 0) -> int:
    """Row number found at a shard's slot."""
    return int(permuted(np.array([slot * shards + shard]), n, seed, forward=False)[0])


def numbered(rows: DataFrame, order: list[str], out: str = "row_number") -> DataFrame:
    """0-based global row number in the given order; `rows` should be narrow, it is sorted and written."""
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    tagged = rows.withColumn("_tag", F.monotonically_increasing_id())
    ranged = tagged.repartitionByRange(parts, *order, "_tag").sortWithinPartitions(*order, "_tag")
    # The high bits of the id name the range partition, the low 33 bits count inside it.
    fixed = written(ranged.withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftrightunsigned("_at", 33).alias("_part")
    counts = fixed.groupBy(part).agg(F.count(F.lit(1)).alias("_n"))  # one row per partition
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    return (
        fixed.withColumn("_part", F.shiftrightunsigned("_at", 33))
        .join(F.broadcast(offsets), "_part")
        .withColumn(out, F.col("_offset") + F.col("_at").bitwiseAND(2**33 - 1))
        .drop("_part", "_offset", "_at", "_tag")
    )


def sharded(docs: DataFrame, shards: int = 16, seed: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, row_number of every row."""
    text = F.col(text_col)
    data = F.coalesce(text.cast("binary"), F.lit(b""))
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("_id"),
        (F.octet_length(data) + F.lit(1)).cast("long").alias("size"),
        F.crc32(data).alias("text_crc32"),
        F.xxhash64(data).alias("_hash"),
    )
    rows = numbered(rows, ["_id", "_hash"])
    n = rows.count()  # footers only

    @F.pandas_udf("long")
    def permute(numbers: pd.Series) -> pd.Series:
        return pd.Series(permuted(numbers.to_numpy(), n, seed))

    placed = rows.withColumn("_p", permute("row_number"))
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        F.pmod("_p", F.lit(shards)).cast("int").alias("shard"),
        F.expr(f"_p div {int(shards)}").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "row_number",
    )
