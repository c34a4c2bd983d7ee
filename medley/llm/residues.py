"""Hard negatives by exact integer scores: residue-number-system products and windows below each positive.

Components are scaled and rounded down to integers. Scores are their inner products, computed exactly with
single-precision matrix products: both matrices are taken modulo several small primes, with residues centred on 0
and so small that a product over `CHUNK` components stays below 2^24, where float32 holds every integer. The
residues of the scores are put together by Chinese remaindering in mixed radix with centred digits, which gives the
signed score directly. The number of primes follows from a bound on the scores of the block (Cauchy-Schwarz).

Work is dealt by (length, anchor block, row block), all of bounded size whatever the labels or ids: anchors are
sent to every block of rows, rows to every block of anchors. A first pass keeps each anchor's best rows of its own
label per block, a ranked window joins them; a second pass carries the score window of every positive and keeps
the best rows of other labels inside it per block, and a second ranked window joins those. Nothing is cut but ranks
beyond the asked ones.

Defined results: rows with a null label, a null or empty vector, null or non-finite components, or a vector whose scaled
length reaches 2^31 (scores might not fit 64 bits) take no part; vectors of different lengths do not meet; a null id
is the smallest id and comes back as null, but it is no anchor unless the condition says so; rows that share an id
stay separate rows, equal anchors give equal results each; an anchor without positives or a positive without
negatives in its window gives no row; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from medley.llm.common import NULL_ID, written
from medley.plans.skew import top_per_group

CHUNK = 64
#: Largest prime p for which CHUNK * ((p - 1) / 2)^2 stays below 2^24 lies below this.
PRIME_LIMIT = 1024
ROWS, ANCHORS = 4096, 1024
STRIP = 128  # anchors scored at a time inside a task


def primes() -> Iterator[int]:
    """Primes below PRIME_LIMIT, largest first."""
    for p in range(PRIME_LIMIT - 1, 2, -1):
        if all(p % f for f in range(2, int(p**0.5) + 1)):
            yield p


def _centred(x: np.ndarray, p: int) -> np.ndarray:
    """x modulo p in -(p - 1) / 2 .. (p - 1) / 2."""
    r = x % p
    return r - p * (r > p // 2)


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of the integer rows of a and b, which must fit 63 bits."""
    longest = [np.sqrt((x.astype(np.float64) ** 2).sum(axis=1).max(initial=0.0)) for x in (a, b)]
    bound = int(longest[0] * longest[1] * (1 + 1e-9)) + 2
    base: list[int] = []
    digits: list[np.ndarray] = []
    total = np.zeros((len(a), len(b)), np.int64)
    weight = 1
    for p in primes():
        one, two = (_centred(x.astype(np.int64), p).astype(np.float32) for x in (a, b))
        s = sum(((one[:, i : i + CHUNK] @ two[:, i : i + CHUNK].T).astype(np.int64) for i in range(0, a.shape[1], CHUNK)), np.zeros_like(total))
        # The digit of this prime is what the digits so far leave over, divided by their primes.
        for q, digit in zip(base, digits):
            s = (s - digit) % p * pow(q, -1, p)
        digit = _centred(s, p)
        with np.errstate(over="ignore"):  # the sum is right modulo 2^64, and scores fit
            total += digit * np.int64((weight + 2**63) % 2**64 - 2**63)
        base.append(p)
        digits.append(digit)
        weight *= p
        if weight > 2 * bound:
            return total
    raise ValueError("scores beyond 63 bits")


def _items(vectors: DataFrame, anchor: Column, scale: int, id_col: str, label_col: str, vector_col: str) -> DataFrame:
    """(id, label, anchor, d, c): rows that take part, components as 32-bit integers."""
    e = F.col(vector_col).cast("array<double>")
    whole = F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("id"),
        F.col(label_col).cast("long").alias("label"),
        F.coalesce(anchor, F.lit(False)).alias("anchor"),
        e.alias("e"),
    ).where(F.col("label").isNotNull() & (F.size("e") > 0) & whole)
    schema = pa.schema([("id", pa.int64()), ("label", pa.int64()), ("anchor", pa.bool_()), ("d", pa.int32()), ("c", pa.binary())])

    def rounded(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            sizes, cells = [], []
            for x in batch.column("e"):
                c = np.floor(scale * x.values.to_numpy(zero_copy_only=False))
                with np.errstate(over="ignore"):
                    fits = (c * c).sum() < 2.0**62
                sizes.append(len(c) if fits else 0)
                cells.append(c.astype(np.int32).tobytes() if fits else b"")
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in ("id", "label", "anchor")), pa.array(sizes, pa.int32()), pa.array(cells, pa.binary())], schema=schema)

    return rows.mapInArrow(rounded, "id long, label long, anchor boolean, d int, c binary").where("d > 0")


def _met(items: DataFrame, anchors: DataFrame, carried: list[str], n: tuple[int, int], fn: Callable, schema: str) -> DataFrame:
    """`fn` over every pair of an anchor block and a row block; `carried` are more columns of the anchors."""
    of_anchors, of_rows = n
    place = lambda blocks, seed: F.pmod(F.xxhash64("key", F.lit(seed)), F.lit(blocks)).cast("int")
    every = lambda blocks: F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    one = anchors.select("d", place(of_anchors, 1).alias("ab"), every(of_rows).alias("rb"), F.lit(0).alias("side"), "key", "id", "label", "c", *carried)
    none = [F.lit(None).cast(t).alias(c) for c, t in one.dtypes if c in carried]
    two = items.select("d", every(of_anchors).alias("ab"), place(of_rows, 2).alias("rb"), F.lit(1).alias("side"), "key", "id", "label", "c", *none)
    return one.unionByName(two).groupBy("d", "ab", "rb").applyInArrow(fn, schema)


def _sides(table: pa.Table) -> tuple[dict, dict]:
    out = []
    for side in (0, 1):
        t = table.filter(pc.equal(table.column("side"), side)).sort_by([("id", "ascending"), ("key", "ascending")])
        width = t.column("d")[0].as_py() if len(t) else 1
        cells = np.frombuffer(b"".join(t.column("c").to_pylist()), np.int32).reshape(-1, width)
        out.append({"t": t, "c": cells} | {c: t.column(c).to_numpy() for c in ("key", "id", "label")})
    return out[0], out[1]


def _highest(s: np.ndarray, n: int) -> np.ndarray:
    """Places of the n highest scores, highest first, the earlier place first among equals."""
    at = np.arange(len(s))
    if len(s) > n:
        at = np.flatnonzero(s >= np.partition(s, len(s) - n)[len(s) - n])
    return at[np.argsort(-s[at], kind="stable")][:n]


def window(positive: int, low: int, high: int) -> tuple[int, int]:
    """Lowest and highest score s with low * positive <= 100 * s <= high * positive."""
    return -(-low * positive // 100), high * positive // 100


def hard_negatives(
    vectors: DataFrame,
    anchor: Column,
    positives: int = 5,
    negatives: int = 10,
    low: int = 30,
    high: int = 90,
    scale: int = 256,
    id_col: str = "vec_id",
    label_col: str = "label",
    vector_col: str = "embedding",
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    For every row that `anchor` holds for: its `positives` best rows of the same label, and for each the `negatives`
    best rows of other labels with a score between `low` and `high` percent of the positive's. Higher scores
    come first, then smaller ids.
    """
    items = _items(vectors, anchor, scale, id_col, label_col, vector_col)
    items = written(items.withColumn("key", F.monotonically_increasing_id()))  # numbers are fixed once written
    n_rows, n_anchors = items.agg(F.count(F.lit(1)), F.count_if("anchor")).first()
    blocks = (max(1, -(-n_anchors // ANCHORS)), max(1, -(-n_rows // ROWS)))
    anchors = items.where("anchor")
    longs = [("anchor", pa.int64()), ("other", pa.int64()), ("id", pa.int64()), ("score", pa.int64())]

    def same_label(table: pa.Table) -> pa.Table:
        one, two = _sides(table)
        found: list[list] = [[], [], [], []]
        for i in range(0, len(one["key"]) if len(two["key"]) else 0, STRIP):
            for key, label, s in zip(one["key"][i:], one["label"][i:], scores(one["c"][i : i + STRIP], two["c"])):
                like = np.flatnonzero((two["label"] == label) & (two["key"] != key))
                best = like[_highest(s[like], positives)]
                for column, x in zip(found, (np.full(len(best), key), two["key"][best], two["id"][best], s[best])):
                    column.append(x)
        return pa.table([pa.array(np.concatenate([np.zeros(0, np.int64), *x])) for x in found], schema=pa.schema(longs))

    near = _met(items, anchors, [], blocks, same_label, "anchor long, other long, id long, score long")
    ranked = top_per_group(near, ["anchor"], [F.desc("score"), F.col("id"), F.col("other")], positives, "place")
    chosen = written(ranked.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("place", "id", "score"))).alias("p")))
    chosen = chosen.select(F.col("anchor").alias("key"), F.col("p.id").alias("pid"), F.col("p.score").alias("ps"))

    names = ["key", "anchor_id", "place", "positive_id", "positive_score", "negative_id", "negative_score"]

    def other_label(table: pa.Table) -> pa.Table:
        one, two = _sides(table)
        ids, wanted = one["t"].column("pid").to_pylist(), one["t"].column("ps").to_pylist()
        found: list[list] = [[] for _ in names]
        for i in range(0, len(one["key"]) if len(two["key"]) else 0, STRIP):
            for at, s in enumerate(scores(one["c"][i : i + STRIP], two["c"]), i):
                ranges = [window(p, low, high) for p in wanted[at]]
                unlike = np.flatnonzero((two["label"] != one["label"][at]) & (s >= min(x for x, _ in ranges)) & (s <= max(x for _, x in ranges)))
                unlike = unlike[np.argsort(-s[unlike], kind="stable")]
                falling = -s[unlike]
                for place, (least, most) in enumerate(ranges):
                    begin, end = np.searchsorted(falling, -most), np.searchsorted(falling, -least, "right")
                    best = unlike[begin : max(begin, min(end, begin + negatives))]
                    fixed = [np.full(len(best), x) for x in (one["key"][at], one["id"][at], place, ids[at][place], wanted[at][place])]
                    for column, x in zip(found, (*fixed, two["id"][best], s[best])):
                        column.append(x)
        return pa.table([pa.array(np.concatenate([np.zeros(0, np.int64), *x])) for x in found], schema=pa.schema([(x, pa.int64()) for x in names]))

    far = _met(items, anchors.join(chosen, "key"), ["pid", "ps"], blocks, other_label, ", ".join(f"{x} long" for x in names))
    out = top_per_group(far, ["key", "place"], [F.desc("negative_score"), F.col("negative_id")], negatives)
    real = lambda c: F.when(F.col(c) != NULL_ID, F.col(c)).alias(c)
    return out.select(real("anchor_id"), real("positive_id"), F.col("rank").cast("int").alias("rank"), real("negative_id"), "positive_score", "negative_score")
