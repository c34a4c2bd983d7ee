"""Ranked lexical search by range-maximum tables: best-first intervals of documents, split at the strongest ones.

Terms are runs of ASCII letters and digits and of any other non-ASCII characters; only A-Z are lower-cased, so texts
are cut as UTF-8 bytes. With N documents that have terms, L terms in all, n terms in a document, df documents with a
term and tf of its occurrences in one,

    w     = floor(1000 * ln((2 N + 2) / (2 df + 1)))           in double precision
    m     = 100 - 25 + (25 n N) div L
    score = sum over the query's terms, repeats included, of w * ((1000000000 tf) div (1000 tf + 12 m))

Index: one pass over all texts keeps per document its length and the queried terms with their counts; N, L and df are
aggregates over it. Documents are dealt at random to shards of about `DOCS` documents, more if their lists hold more
than `POSTINGS` entries a shard. In a shard, documents stand in id order and every term has a posting list: places and
impacts (the term's share of the score), with a sparse table of the greatest impact over every run of 2^j
postings, so that the greatest impact of a term in an interval of places is one look-up of two overlapping runs.

Search, per shard and query: the sum of these maxima over the query's terms bounds all scores in an interval. The
intervals with the highest bounds are taken first; each is split at the document where its strongest term is
greatest, which is scored exactly. Short intervals are scored whole. It ends when no bound is left that could change
the best `top`. So every shard gives its exact best; a ranked window joins the shards. Shards meet the queries in
blocks of `QUERIES`, so no task grows with the corpus, the number of queries or a frequent term.

Defined results: null, empty and term-less texts rank nowhere and do not count in N; items without terms give no
row; equal texts score alike and come by id; a null id is the smallest and comes back as null; rows that share an id
are separate documents or items; empty tables give an empty table; other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from medley.llm.common import NULL_ID, utf8, written
from medley.plans.skew import top_per_group

DOCS, POSTINGS, QUERIES = 1 << 15, 1 << 22, 256
SHORT = 32  # places of an interval that is scored whole
TOGETHER = 256  # intervals taken in one step
# Up to so many queried terms, of so many bytes, are held by the tasks of the first pass; beyond, terms are joined.
HELD_TERMS, HELD_BYTES = 1 << 18, 1 << 25

_kept = b"0123456789abcdefghijklmnopqrstuvwxyz"
_table = bytes(c if c >= 128 else c + 32 if 65 <= c <= 90 else c if c in _kept else 32 for c in range(256))


def terms(text: bytes) -> list[bytes]:
    return text.translate(_table).split()


def _term_rows(df: DataFrame, key: str, text_col: str) -> DataFrame:
    """(key, n, terms, tf): the distinct terms of every text with their counts."""
    schema = pa.schema([("key", pa.int64()), ("n", pa.int64()), ("terms", pa.list_(pa.binary())), ("tf", pa.list_(pa.int64()))])

    def rows(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(at, 1000) for whole in it for at in range(0, whole.num_rows, 1000)):
            found = [Counter(terms(t)) for t in utf8(batch, "text")]
            columns = [[c.total() for c in found], [list(c) for c in found], [list(c.values()) for c in found]]
            yield pa.RecordBatch.from_arrays([batch.column("key"), *(pa.array(c, f.type) for c, f in zip(columns, list(schema)[1:]))], schema=schema)

    texts = df.select(F.col(key).alias("key"), F.col(text_col).alias("text"))
    return texts.mapInArrow(rows, "key long, n long, terms array<binary>, tf array<long>")


def _held_rows(df: DataFrame, key: str, text_col: str, numbers: dict[bytes, int]) -> DataFrame:
    """(key, n, t, tf) of every text: its number of terms, the numbered ones among them and their counts."""
    schema = pa.schema([("key", pa.int64()), ("n", pa.int64()), ("t", pa.list_(pa.int64())), ("tf", pa.list_(pa.int64()))])

    def rows(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(at, 1000) for whole in it for at in range(0, whole.num_rows, 1000)):
            sizes, numbered, counts = [], [], []
            for text in utf8(batch, "text"):
                found = terms(text)
                at = np.fromiter((numbers.get(x, -1) for x in found), np.int64, len(found))
                t, tf = np.unique(at[at >= 0], return_counts=True)
                sizes.append(len(found))
                numbered.append(t)
                counts.append(tf)
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(sizes, pa.int64()), pa.array(numbered, schema.field("t").type), pa.array(counts, schema.field("tf").type)], schema=schema)

    texts = df.select(F.col(key).alias("key"), F.col(text_col).alias("text"))
    return texts.mapInArrow(rows, "key long, n long, t array<long>, tf array<long>")


class Postings:
    """A term's places in a shard, its impacts there, and for every j the place of the greatest of 2^j from each on."""

    def __init__(self, places: np.ndarray, impacts: np.ndarray) -> None:
        self.places, self.impacts = places, impacts
        best = np.arange(len(places), dtype=np.int32)
        self.levels = [best]
        width = 1
        while 2 * width <= len(places):
            one, two = best[:-width], best[width:]
            best = np.where(impacts[two] > impacts[one], two, one)
            self.levels.append(best)
            width *= 2

    def greatest(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Greatest impact among the places low <= p < high of each interval (0 if none) and the place of it."""
        i, j = np.searchsorted(self.places, low), np.searchsorted(self.places, high)
        some = np.flatnonzero(j > i)
        value, at = np.zeros(len(low), np.int64), np.zeros(len(low), np.int64)
        i, j = i[some], j[some]
        level = np.frexp(j - i)[1] - 1
        for k in np.unique(level):
            m = level == k
            one, two = self.levels[k][i[m]], self.levels[k][j[m] - (1 << int(k))]
            best = np.where(self.impacts[two] > self.impacts[one], two, one)
            value[some[m]], at[some[m]] = self.impacts[best], self.places[best]
        return value, at

    def of(self, places: np.ndarray) -> np.ndarray:
        """Impacts at the given places, 0 where the term does not occur."""
        i = np.searchsorted(self.places, places)
        i[i == len(self.places)] = 0
        return np.where(self.places[i] == places, self.impacts[i], 0)


def best_places(lists: list[tuple[Postings, int]], size: int, top: int) -> tuple[np.ndarray, np.ndarray]:
    """The `top` places with the highest scores above 0, lower places first among equals, of a query's (list, repeats)."""

    def scores(places: np.ndarray) -> np.ndarray:
        return sum((p.of(places) * repeats for p, repeats in lists), np.zeros(len(places), np.int64))

    def bounds(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The summed maxima of each interval, and the place of the greatest of them."""
        total, most, at = (np.zeros(len(low), np.int64) for _ in range(3))
        for p, repeats in lists:
            value, place = p.greatest(low, high)
            value *= repeats
            total += value
            larger = value > most
            most[larger], at[larger] = value[larger], place[larger]
        return total, at

    found: list[tuple[int, int]] = []  # (score, -place), the worst kept one first

    def offer(places: np.ndarray) -> None:
        s = scores(places)
        least = found[0][0] if len(found) == top else 1
        for score, place in zip(s[s >= least].tolist(), places[s >= least].tolist()):
            if len(found) < top:
                heapq.heappush(found, (score, -place))
            else:
                heapq.heappushpop(found, (score, -place))

    total, at = bounds(np.array([0]), np.array([size]))
    queue = [(-int(total[0]), 0, size, int(at[0]))] if total[0] > 0 else []
    while queue:
        # An interval with the worst kept score as its bound still counts if it starts before that place.
        taken = []
        while queue and len(taken) < TOGETHER:
            bound, low, high, place = heapq.heappop(queue)
            if len(found) == top and (-bound < found[0][0] or (-bound == found[0][0] and low > -found[0][1])):
                if -bound < found[0][0]:
                    queue.clear()
                continue
            taken.append((low, high, place))
        if not taken:
            break
        low, high, place = np.array(taken).T
        short = high - low <= SHORT
        if short.any():
            span = high[short] - low[short]
            offer(np.repeat(low[short] - np.r_[0, np.cumsum(span)[:-1]], span) + np.arange(span.sum()))
        low, high, place = low[~short], high[~short], place[~short]
        offer(place)
        low, high = np.concatenate([low, place + 1]), np.concatenate([place, high])
        total, at = bounds(low, high)
        for b, x, y, z in zip((-total).tolist(), low.tolist(), high.tolist(), at.tolist()):
            if b < 0:
                heapq.heappush(queue, (b, x, y, z))
    out = sorted((-s, -p) for s, p in found)
    return np.array([p for _, p in out], np.int64), np.array([-s for s, _ in out], np.int64)


def ranked(
    docs: DataFrame,
    items: DataFrame,
    top: int = 20,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """item_id, rank, doc_id and score of every item's `top` best documents."""
    long_id = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(NULL_ID))
    asked = items.select(F.col(item_col).alias("item_id"), F.col(item_text_col).alias("text"))
    asked = written(asked.withColumn("q", F.monotonically_increasing_id()))  # numbers are fixed once written
    words = _term_rows(asked, "q", "text").select(F.col("key").alias("q"), F.explode(F.arrays_zip("terms", "tf")).alias("x"))
    words = written(words.select("q", F.col("x.terms").alias("term"), F.col("x.tf").alias("repeats")))
    vocabulary = written(words.select("term").distinct().withColumn("t", F.monotonically_increasing_id()))
    wanted = words.join(vocabulary, "term").select("q", "t", "repeats")

    texts = docs.select(long_id(id_col).alias("id"), F.col(text_col).alias("text"))
    number, size = vocabulary.agg(F.count(F.lit(1)), F.sum(F.length("term"))).first()
    if number <= HELD_TERMS and (size or 0) <= HELD_BYTES:
        rows = _held_rows(texts, "id", "text", {bytes(r["term"]): r["t"] for r in vocabulary.collect()})
        rows = written(rows.where("n > 0").withColumn("row", F.monotonically_increasing_id()))
    else:
        rows = written(_term_rows(texts, "id", "text").where("n > 0").withColumn("row", F.monotonically_increasing_id()))
        pairs = rows.select("row", F.explode(F.arrays_zip("terms", "tf")).alias("x")).select("row", F.col("x.terms").alias("term"), "x.tf")
        found = pairs.join(vocabulary, "term").groupBy("row").agg(F.collect_list(F.struct("t", "tf")).alias("g"))
        rows = written(rows.select("row", "key", "n").join(found.select("row", F.col("g.t").alias("t"), F.col("g.tf").alias("tf")), "row", "left"))
    total = rows.agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("words")).first()
    counted = written(rows.select(F.explode("t").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("df")))
    postings = counted.agg(F.sum("df")).first()[0] or 0
    shards = max(1, -(-total["docs"] // DOCS), -(-postings // POSTINGS))
    weight = F.floor(F.lit(1000.0) * F.log(F.lit(2.0 * total["docs"] + 2) / (2.0 * F.col("df") + 1)))
    weighed = wanted.join(counted, "t").withColumn("w", weight).where("w > 0")

    blocks = max(1, -(-asked.count() // QUERIES))
    place = F.expr(f"75L + (25L * n * {total['docs']}L) div {total['words'] or 1}L")
    shard = F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int").alias("shard")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    nothing = lambda *kinds: [F.lit(None).cast(k).alias(c) for c, k in kinds]
    # Documents go to every block of queries and queries to every shard; both are cut to a bounded size.
    listed = rows.where("size(t) > 0").select(shard, every(blocks).alias("block"), F.col("key").alias("id"), F.lit(None).cast("long").alias("q"), place.alias("m"), F.col("t").alias("ts"), F.col("tf").alias("x"), *nothing(("w", "array<long>")))
    many = weighed.groupBy("q").agg(F.collect_list(F.struct("t", "repeats", "w")).alias("g"))
    sought = many.select(every(shards).alias("shard"), F.pmod(F.xxhash64("q"), F.lit(blocks)).cast("int").alias("block"), *nothing(("id", "long")), "q", *nothing(("m", "long")), F.col("g.t").alias("ts"), F.col("g.repeats").alias("x"), F.col("g.w").alias("w"))

    schema = pa.schema([(c, pa.int64()) for c in ("q", "doc", "score")])

    def search(table: pa.Table) -> pa.Table:
        asked_ = pc.is_valid(table.column("q"))
        queries, held = table.filter(asked_), table.filter(pc.invert(asked_)).sort_by("id")
        out: list[list] = [[], [], []]
        if len(queries) and len(held):
            lists = _posting_lists(queries, held)
            ids = held.column("id").to_numpy()
            for q, ts, repeats in zip(queries.column("q").to_pylist(), queries.column("ts").to_pylist(), queries.column("x").to_pylist()):
                at, score = best_places([(lists[t], r) for t, r in zip(ts, repeats) if t in lists], len(held), top)
                for column, x in zip(out, (np.full(len(at), q), ids[at], score)):
                    column.append(x)
        return pa.table([pa.array(np.concatenate([np.zeros(0, np.int64), *x])) for x in out], schema=schema)

    met = listed.unionByName(sought).groupBy("shard", "block").applyInArrow(search, "q long, doc long, score long")
    best = top_per_group(met, ["q"], [F.desc("score"), F.col("doc")], top)
    named = best.join(asked.select("q", "item_id"), "q")
    return named.select("item_id", F.col("rank").cast("int").alias("rank"), F.when(F.col("doc") != NULL_ID, F.col("doc")).alias("doc_id"), "score")


def _posting_lists(queries: pa.Table, held: pa.Table) -> dict[int, Postings]:
    """The lists of the queries' terms over the documents of a shard, which stand in id order."""
    weights = dict(zip(pc.list_flatten(queries.column("ts")).to_pylist(), pc.list_flatten(queries.column("w")).to_pylist()))
    sizes = pc.list_value_length(held.column("ts")).to_numpy().astype(np.int64)
    t = pc.list_flatten(held.column("ts")).to_numpy()
    tf = pc.list_flatten(held.column("x")).to_numpy()
    place = np.repeat(np.arange(len(held)), sizes)
    m = np.repeat(held.column("m").to_numpy(), sizes)
    use = np.isin(t, np.fromiter(weights, np.int64, len(weights)))
    t, tf, place, m = t[use], tf[use], place[use], m[use]
    order = np.argsort(t, kind="stable")
    t, place = t[order], place[order].astype(np.int32)
    share = (1_000_000_000 * tf[order]) // (1000 * tf[order] + 12 * m[order])
    cuts = np.flatnonzero(np.r_[True, t[1:] != t[:-1]]) if len(t) else np.zeros(0, np.int64)
    return {int(t[i]): Postings(place[i:j], share[i:j] * weights[int(t[i])]) for i, j in zip(cuts, np.r_[cuts[1:], len(t)])}
