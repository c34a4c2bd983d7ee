"""Near-duplicate documents: one-permutation MinHash with optimal densification, bands and star candidates.

A document's set holds its distinct five-word shingles (ASCII lower case; fewer words are one shingle). One
64-bit hash per shingle serves as the permutation: its leading bits name a bin, the smallest hash of a bin is
its value. An empty bin takes the value of the first non-empty bin in its own fixed random sequence. Bands of
`rows` bins make bucket keys; `rows` is the largest number for which a pair at the threshold misses all bands
with a probability of at most 1e-9.

Documents with equal sets collapse to one set first. In every bucket the member that meets most others is the
centre and is paired with all others (a star, linear in the bucket); pairs are confirmed on the full sets. Sets
of buckets whose members are not all connected by then are dealt anew by their rarest shared shingles, which
drops pairs that only share a common passage, and stars with new centres are drawn there, more per round, until no
bucket holds two members that are neither compared nor connected. So no link within a bucket is lost.

Shuffled: bucket rows of 20 bytes per band, and the texts once to get the full sets of bucket mates; nothing
is collected but counts. Hot buckets and hot centres are single keys of aggregates that combine before the
shuffle and of joins that adaptive execution splits.

Defined results: null, empty and blank texts have an empty set and link with nothing; null ids are the smallest
id and come back as null; rows that share an id are one vertex with the links of all; equal rows give equal
rows; an empty table gives an empty table; other columns are ignored. Sets are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from medley.llm.common import NULL_ID, only, utf8, written
from medley.llm.components import components

SHINGLE = 5
BANDS = 40
MISS = 1e-9
MEMO_WORDS = 400_000
LANES = 8
TASK_PAIRS = 5_000  # pairs or sets of texts that one task handles at least
LEAD = 64  # keys of a set that its bucket rows carry; bounds their bytes, results do not depend on it

_u = np.uint64
_factors = [_u(int(x) | 1) for x in np.random.default_rng(5).integers(0, 2**64, SHINGLE, dtype=np.uint64)]


def _mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _u(32))) * _u(0xD6E8FEB86659FD93)
        x = (x ^ (x >> _u(32))) * _u(0xD6E8FEB86659FD93)
    return x ^ (x >> _u(32))


class _Words(dict):
    """64-bit hashes of words, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_words = _Words()


def shingles(text: bytes) -> np.ndarray:
    """Sorted distinct shingle hashes."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    with np.errstate(over="ignore"):
        if len(h) < SHINGLE:
            return _mixed(np.array([sum((x * f for x, f in zip(h, _factors)), _u(len(h)))], np.uint64))
        n = len(h) - SHINGLE + 1
        total = h[:n] * _factors[0]
        for i in range(1, SHINGLE):
            total += h[i : n + i] * _factors[i]
    return np.unique(_mixed(total))


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    only(_words)
    return [shingles(t) for t in texts]


def band_rows(threshold: float, bands: int = BANDS) -> int:
    rows = 1
    while (1 - threshold ** (rows + 1)) ** bands <= MISS:
        rows += 1
    return rows


@lru_cache(maxsize=4096)
def _probe(bins: int, attempt: int) -> np.ndarray:
    """The bin that each bin looks into at an attempt."""
    return (_mixed(np.arange(bins, dtype=np.uint64) + _u(attempt * 0x9E3779B97F4A7C15 % 2**64)) % _u(bins)).astype(np.int64)


def signatures(sets: list[np.ndarray], bins: int) -> np.ndarray:
    """Densified one-permutation signatures of non-empty sets."""
    out = np.zeros((len(sets), bins), np.uint64)
    full = np.zeros((len(sets), bins), bool)
    sizes = np.array([len(s) for s in sets], np.int64)
    every = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    row = np.repeat(np.arange(len(sets)), sizes)
    bin_ = ((every >> _u(32)) * _u(bins) >> _u(32)).astype(np.int64)
    cell = row * bins + bin_
    first = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]]) if len(cell) else cell
    out.reshape(-1)[cell[first]] = every[first]  # sets are sorted: the first of a bin is its smallest
    full.reshape(-1)[cell[first]] = True
    r, c = np.nonzero(~full)
    attempt = 0
    while len(r):
        source = _probe(bins, attempt)[c]
        hit = full[r, source]
        out[r[hit], c[hit]] = out[r[hit], source[hit]]
        r, c = r[~hit], c[~hit]
        attempt += 1
    return out


def band_keys(sets: list[np.ndarray], threshold: float, bands: int = BANDS) -> np.ndarray:
    rows = band_rows(threshold, bands)
    s = signatures(sets, bands * rows).reshape(len(sets), bands, rows)
    with np.errstate(over="ignore"):
        key = np.arange(bands, dtype=np.uint64) * _u(0x9E3779B97F4A7C15) + np.zeros((len(sets), 1), np.uint64)
        for i in range(rows):
            key = _mixed(key * _u(0xC2B2AE3D27D4EB4F) + s[:, :, i])
    return key


def _set_number(s: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(s.tobytes()) - 2**63


def _signed(docs: DataFrame, threshold: float, id_col: str, text_col: str, bands_: int) -> DataFrame:
    """(k, s, n, bands): the set number, size and bucket keys of every document; no bands for an empty set."""
    schema = pa.schema([("k", pa.int64()), ("s", pa.int64()), ("n", pa.int64()), ("bands", pa.list_(pa.int64()))])

    def rows(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in it:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                sets = shingle_sets(utf8(batch, "text"))
                some = [i for i, s in enumerate(sets) if len(s)]
                keys = band_keys([sets[i] for i in some], threshold, bands_).view(np.int64)
                bands: list = [[]] * len(sets)
                for i, row in zip(some, keys):
                    bands[i] = row
                yield pa.RecordBatch.from_arrays(
                    [batch.column("k"), pa.array([_set_number(s) for s in sets]), pa.array([len(s) for s in sets]), pa.array(bands, pa.list_(pa.int64()))], schema=schema
                )

    return _texts(docs, id_col, text_col).mapInArrow(rows, "k long, s long, n long, bands array<long>")


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("k"), F.col(text_col).alias("text"))


def _full_sets(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """(s, shingles) of the wanted (s, k), from their documents' texts."""
    schema = pa.schema([("s", pa.int64()), ("shingles", pa.list_(pa.int64()))])

    def rows(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(at, 1000) for whole in it for at in range(0, whole.num_rows, 1000)):
            numbers, found = [], []
            for s, one in zip(batch.column("s").to_pylist(), shingle_sets(utf8(batch, "text"))):
                if _set_number(one) == s:  # rows that share an id may hold other texts
                    numbers.append(s)
                    found.append(one.view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int64()), pa.array(found, pa.list_(pa.int64()))], schema=schema)

    return texts.join(wanted.hint("shuffle_hash"), "k").select("s", "text").mapInArrow(rows, "s long, shingles array<long>")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the similarity."""
    one = sets.select(F.col("s").alias("a"), F.col("shingles").alias("one"))
    two = sets.select(F.col("s").alias("b"), F.col("shingles").alias("two"))
    met = pairs.join(one, "a").join(two, "b")
    met = met.select("a", "b", F.size(F.array_intersect("one", "two")).alias("common"), (F.size("one") + F.size("two")).alias("total"))
    return met.where(100 * F.col("common") >= percent * (F.col("total") - F.col("common"))).select("a", "b")


def _pair(x: str, y: str) -> list:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def _size_fits(percent: int) -> Column:
    return 100 * F.least("n", "cn") >= percent * F.greatest("n", "cn")


def _rooted(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """Rows with the component their set is in so far; a set without links is its own."""
    return rows.join(roots, rows["s"] == roots["v"], "left").select(*rows.columns, F.coalesce("root", "s").alias("root"))


def _unconnected(rows: DataFrame) -> DataFrame:
    """(b, most): buckets with several components, and the one most members are in."""
    counts = rows.groupBy("b", "root").agg(F.count(F.lit(1)).alias("m"))
    return counts.groupBy("b").agg(F.max_by("root", F.struct("m", "root")).alias("most"), F.count(F.lit(1)).alias("parts")).where("parts > 1").select("b", "most")


def _rare_buckets(active: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    """Buckets by a rare shared shingle, for sets that share a bucket without being connected.

    With shingles ordered from the rarest, sets at the threshold share one among their first
    n - ceil(t n) + 1, and none that only one set has. So a set with fewer than t n shared shingles links
    with nothing, and unlike sets with a common passage hardly ever meet. `lead` holds the first of the set's keys.
    """
    one = active.join(full, "s").select("s", F.explode("shingles").alias("t"))
    often = one.groupBy("t").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    hits = one.join(often, "t").groupBy("s").agg(F.array_sort(F.collect_list(F.struct("df", "t"))).alias("ts"))
    sized = active.join(hits, "s").withColumn("c", F.size("ts"))
    take = F.expr(f"n - (({percent} * n + 99) div 100) + 1 - (n - c)")
    kept = sized.withColumn("take", take.cast("int")).where("take > 0")
    listed = kept.withColumn("prefix", F.transform(F.slice("ts", F.lit(1), F.greatest("take", F.lit(0))), lambda x: x["t"])).withColumn("lead", F.slice("prefix", 1, LEAD))
    # `c` counts the shared shingles from the bucket's own on: what two sets can have in common if it is their first.
    return listed.select(F.posexplode("prefix").alias("i", "b"), "s", "k", "n", "weight", (F.col("c") - F.col("i")).alias("c"), "lead").drop("i")


def _links(texts: DataFrame, sets: DataFrame, percent: int, most: int) -> DataFrame:
    """(a, b): enough links between sets to connect every component; `most` bounds the bucket rows."""
    spark = sets.sparkSession
    rows = sets.select("s", "k", "n", F.explode("bands").alias("b"))
    shared = rows.groupBy("b").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    # A set that meets many others in its buckets is the likely origin of its copies: it becomes the centre.
    met = rows.join(shared, "b").groupBy("s").agg(F.sum("m").alias("weight"), F.collect_list("b").alias("bs"), F.first("k").alias("k"), F.first("n").alias("n"))
    active = written(met.select(F.explode("bs").alias("b"), "s", "k", "n", "weight"), most)
    most = active.count()
    full = written(_full_sets(texts, active.select("s", "k").distinct()).dropDuplicates(["s"]), most, TASK_PAIRS)

    first = active.groupBy("b").agg(F.max(F.struct("weight", "s", "n")).alias("c")).select("b", F.col("c.s").alias("c"), F.col("c.n").alias("cn"))
    stars = active.join(first, "b").where((F.col("s") != F.col("c")) & _size_fits(percent)).select(*_pair("s", "c")).distinct()
    links = written(_confirmed(stars, full, percent), most, TASK_PAIRS)
    known = links.count()
    roots = components(links, known)
    placed = _rooted(active, roots)
    open_sets = placed.join(_unconnected(placed), "b").select("s", "k", "n", "weight").distinct()
    rare = written(_rare_buckets(written(open_sets, most), full, percent))
    width = LANES
    while True:
        members = _rooted(rare, roots)
        members = written(members.join(_unconnected(members), "b"), rare.count())
        most = members.count()
        if most == 0:
            return links
        # Members outside the largest component become centres, some per bucket and round, each once.
        outside = members.where("root != most").groupBy("b", F.pmod("s", F.lit(width)).alias("lane"))
        centres = outside.agg(F.max(F.struct("weight", "s", "n", "c", "root", "lead")).alias("x"))
        centres = written(centres.select("b", *(F.col(f"x.{c}").alias(f"c{c}") for c in ("s", "n", "c", "root", "lead"))), most)
        least = F.least("c", "cc")
        pairs = members.join(centres, "b").where(
            (F.col("root") != F.col("croot"))
            & _size_fits(percent)
            & (100 * least >= percent * (F.col("n") + F.col("cn") - least))
            & F.coalesce(F.get(F.array_intersect("lead", "clead"), 0) == F.col("b"), F.lit(True))  # once per pair that shares one of its first keys
        )
        found = written(_confirmed(pairs.select(*_pair("s", "cs")).distinct(), full, percent))
        done = centres.select(F.col("b").alias("cb"), "cs")
        rare = written(members.join(done, (F.col("b") == F.col("cb")) & (F.col("s") == F.col("cs")), "left_anti").drop("root", "most"), most)
        if new := found.count():
            known += new
            links = written(links.unionByName(found), known)
            roots = components(links, known)
        width *= LANES


def near_duplicates(docs: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", bands: int = BANDS) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row; links are pairs with a similarity of at least percent / 100."""
    texts = _texts(docs, id_col, text_col)
    signed = written(_signed(docs, percent / 100, id_col, text_col, bands))
    sets = signed.where("n > 0").groupBy("s").agg(F.min("k").alias("k"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    rows = signed.count()
    links = _links(texts, sets, percent, rows * bands)
    # Documents hang on the smallest id of their set, and set numbers become those ids.
    by_set = signed.where("n > 0").groupBy("s").agg(F.min("k").alias("first"))
    own = signed.where("n > 0").join(by_set, "s").select(F.col("k").alias("a"), F.col("first").alias("b"))
    linked = links.join(by_set.select(F.col("s").alias("a"), F.col("first").alias("x")), "a").join(by_set.select(F.col("s").alias("b"), F.col("first").alias("y")), "b")
    graph = components(own.where("a != b").unionByName(linked.select(F.col("x").alias("a"), F.col("y").alias("b"))), rows + links.count())
    out = signed.join(graph, signed["k"] == graph["v"], "left").select("k", "n", F.coalesce("root", "k").alias("root"))
    real = lambda c: F.when(F.col(c) != NULL_ID, F.col(c))
    return out.select(real("k").alias("doc_id"), F.col("n").alias("n_shingles"), real("root").alias("component_id"), (F.col("k") == F.col("root")).alias("kept"))


def deduplicated(docs: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with the smallest id of their component, with all their columns; of rows that share an id all stay."""
    kept = near_duplicates(docs, percent, id_col, text_col).where("kept").select("doc_id").distinct()
    same = docs[id_col].cast("long").eqNullSafe(kept["doc_id"])
    return docs.join(kept, same, "left_semi")
