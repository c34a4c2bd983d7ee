"""Approximate nearest neighbours: NN-descent on Spark joins, then greedy search on the graph.

Points are distinct usable vectors; equal vectors are one point with its smallest ids. Every point starts with
its nearest points inside small cells: `TREES` random partitions, whose cuts are medians of a bounded sample, with
cells dealt into blocks of at most about `LEAF` points. NN-descent then improves the lists: round by round each point is sent
to all points that list it or that it lists; there the members meet, and every member gets those that are nearer than
its farthest neighbour so far. Members that have met before do not meet again. A point that very many list is cut
into blocks of `HUB` members, dealt anew every round, so all of them take part and no group grows. Rounds end when fewer
than `SETTLED` of all neighbours change.

Search: a query is a point of the graph and starts there. Its beam holds the `beam` nearest points seen; each round
all of the beam that were not followed yet are followed to all their neighbours in either direction, by joins on the graph and
the vectors, until every query's whole beam is followed. Distances are Euclidean in double precision on
the original vectors; only the descent compares vectors rounded to half precision.

Rows shuffled per round of the descent: one vector in half precision per listed neighbour and direction. Nothing is
collected but counts and the bounded sample, and all state is written between rounds.

Defined results: null, empty and zero vectors and vectors with null or non-finite components take no part; vectors
of different lengths are in different graphs and never meet; null ids are the smallest id and come back as null, and
are a query only if the condition says so; rows that share an id and a vector are one row, and no row of the query's own
id is in its answer; with fewer candidates all come back; an empty table gives an empty table; other columns are
ignored. The result is approximate beyond `LEAF` points: README and tests state measured recall.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from medley.llm.common import NULL_ID, written
from medley.plans.skew import top_per_group

WIDTH, BEAM = 24, 200  # neighbours of a point, points a query keeps
TREES, LEAF, SAMPLE = 4, 512, 16_384
HUB = 96
SETTLED, ROUNDS = 0.05, 8
HUGE = 1e150  # components are cut to this for projections, which then cannot overflow


def _points(vectors: DataFrame, query: Column, id_col: str, vector_col: str, k: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Points (v, first: smallest id, d, x: binary of doubles), the `k` + 1 smallest ids of each (v, id), and the queries (v, query_id)."""
    rows = vectors.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("id"),
        F.coalesce(query, F.lit(False)).alias("asked"),
        F.col(vector_col).cast("array<double>").alias("e"),
    )
    whole = F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where((F.size("e") > 0) & whole & F.exists("e", lambda x: x != 0))
    rows = rows.withColumn("e", F.transform("e", lambda x: x + F.lit(0.0)))  # -0.0 is 0.0
    rows = written(rows)
    points = rows.groupBy("e").agg(F.min("id").alias("first"))
    points = written(points.withColumn("v", F.monotonically_increasing_id()))  # numbers are fixed once written
    met = rows.join(points, "e").select("v", "id", "asked").distinct()
    ids = written(top_per_group(met.select("v", "id").distinct(), ["v"], [F.col("id")], k + 1).select("v", "id"))
    queries = written(met.where("asked").select("v", F.col("id").alias("query_id")))
    schema = pa.schema([("v", pa.int64()), ("first", pa.int64()), ("d", pa.int32()), ("x", pa.binary())])

    def packed(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            cells = [x.values.to_numpy().tobytes() for x in batch.column("e")]
            yield pa.RecordBatch.from_arrays([batch.column("v"), batch.column("first"), pa.array([len(c) // 8 for c in cells], pa.int32()), pa.array(cells, pa.binary())], schema=schema)

    return written(points.select("v", "first", "e").mapInArrow(packed, "v long, first long, d int, x binary")), ids, queries


def _matrix(cells: pa.ChunkedArray | pa.Array, kind: type = np.float64) -> np.ndarray:
    values = cells.to_pylist()
    return np.frombuffer(b"".join(values), kind).reshape(len(values), -1)


def _half(x: np.ndarray) -> np.ndarray:
    """Vectors in half precision, each divided by its greatest component's power of two, and those exponents."""
    scale = np.frexp(np.abs(x).max(axis=1))[1]
    return np.ldexp(x, -scale[:, None]).astype(np.float16), scale


def _squares(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Squared distances between rows, by a matrix product; not a number where they overflow."""
    with np.errstate(all="ignore"):
        return np.maximum((one**2).sum(axis=1)[:, None] + (two**2).sum(axis=1)[None, :] - 2 * one @ two.T, 0)


class Cuts:
    """A random partition: directions and medians of a binary tree over a sample."""

    def __init__(self, sample: np.ndarray, depth: int, seed: int) -> None:
        rng = np.random.default_rng([seed, 11])
        sample = np.clip(sample, -HUGE, HUGE)
        self.directions = rng.normal(size=(depth, sample.shape[1]))
        self.medians = []
        cell = np.zeros(len(sample), np.int64)
        for level, direction in enumerate(self.directions):
            at = sample @ direction
            order = np.lexsort((at, cell))
            starts = np.searchsorted(cell[order], np.arange(1 << level))
            sizes = np.diff(np.r_[starts, len(sample)])
            middle = np.minimum(starts + sizes // 2, len(sample) - 1)
            self.medians.append(np.where(sizes > 0, at[order][middle], 0.0))
            cell = cell * 2 + (at >= self.medians[-1][cell])

    def of(self, x: np.ndarray) -> np.ndarray:
        cell, x = np.zeros(len(x), np.int64), np.clip(x, -HUGE, HUGE)
        for direction, median in zip(self.directions, self.medians):
            cell = cell * 2 + (x @ direction >= median[cell])
        return cell


def _first_lists(points: DataFrame, width: int) -> DataFrame:
    """(v, u, g): for every point its nearest points of the same cell, in every tree; g is the squared distance."""
    sizes = {r["d"]: r["n"] for r in points.groupBy("d").agg(F.count(F.lit(1)).alias("n")).collect()}
    cuts: dict[int, list[Cuts]] = {}
    for d, n in sizes.items():
        chosen = points.where(F.col("d") == d).orderBy(F.xxhash64("v", F.lit(5)), "v").limit(SAMPLE).select("x").toArrow()
        sample = _matrix(chosen.column("x"))
        depth = min(max(0, int(np.ceil(np.log2(n / LEAF)))), max(0, int(np.log2(max(1, len(sample) / 32)))))
        cuts[d] = [Cuts(sample, depth, tree) for tree in range(TREES if depth else 1)]
    schema = pa.schema([("v", pa.int64()), ("d", pa.int32()), ("x", pa.binary()), ("cells", pa.list_(pa.int64()))])

    def placed(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            lengths = batch.column("d").to_numpy()
            cells: list = [None] * batch.num_rows
            for d in np.unique(lengths):
                at = np.flatnonzero(lengths == d)
                x = _matrix(batch.column("x").take(pa.array(at)))
                for i, row in zip(at, np.stack([c.of(x) for c in cuts[int(d)]], axis=1)):
                    cells[i] = row
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells, pa.list_(pa.int64()))], schema=schema)

    rows = points.select("v", "d", "x").mapInArrow(placed, "v long, d int, x binary, cells array<long>")
    rows = written(rows.select("v", "d", "x", F.posexplode("cells").alias("tree", "cell")))
    # One row per cell, of which there are at most TREES times the sample for a length.
    counts = rows.groupBy("d", "tree", "cell").agg(F.greatest(F.lit(1), F.round(F.count(F.lit(1)) / LEAF)).cast("long").alias("blocks"))
    dealt = rows.join(counts, ["d", "tree", "cell"]).withColumn("block", F.pmod(F.xxhash64("v", "tree"), F.col("blocks")))

    def nearest(table: pa.Table) -> pa.Table:
        v, x = table.column("v").to_numpy(), _matrix(table.column("x"))
        take = min(width, len(v) - 1)
        if take < 1:
            return pa.table([pa.array([], f.type) for f in _link], schema=_link)
        square = _squares(x, x)
        np.fill_diagonal(square, np.inf)
        near = np.argpartition(square, take - 1, axis=1)[:, :take]
        return pa.table([np.repeat(v, take), v[near].ravel(), np.take_along_axis(square, near, 1).ravel()], schema=_link)

    return dealt.select("d", "tree", "cell", "block", "v", "x").groupBy("d", "tree", "cell", "block").applyInArrow(nearest, "v long, u long, g double")


_link = pa.schema([("v", pa.int64()), ("u", pa.int64()), ("g", pa.float64())])


def _shortest(links: DataFrame, width: int) -> DataFrame:
    """The `width` nearest links of every point, each once; `fresh` if none of its copies was there before."""
    once = links.groupBy("v", "u").agg(F.min("g").alias("g"), F.min("fresh").alias("fresh"))
    return top_per_group(once, ["v"], [F.col("g"), F.col("u")], width).drop("rank")


def _both(links: DataFrame) -> DataFrame:
    """(p, m, fresh): every point with all that list it or that it lists."""
    ends = links.select(F.col("v").alias("p"), F.col("u").alias("m"), "fresh").unionByName(links.select(F.col("u").alias("p"), F.col("v").alias("m"), "fresh"))
    return ends.groupBy("p", "m").agg(F.max("fresh").alias("fresh"))


def graph(points: DataFrame, width: int = WIDTH) -> DataFrame:
    """(v, u, g): the neighbour lists of all points, by NN-descent."""
    schema = pa.schema([("v", pa.int64()), ("x", pa.binary()), ("scale", pa.int32())])

    def halved(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            cells, scales = [], []
            for c in batch.column("x").to_pylist():
                h, s = _half(np.frombuffer(c)[None, :])
                cells.append(h.tobytes())
                scales.append(int(s[0]))
            yield pa.RecordBatch.from_arrays([batch.column("v"), pa.array(cells, pa.binary()), pa.array(scales, pa.int32())], schema=schema)

    halves = written(points.select("v", "x").mapInArrow(halved, "v long, x binary, scale int"))

    def meet(table: pa.Table) -> pa.Table:
        m, fresh, far = (table.column(c).to_numpy() for c in ("m", "fresh", "far"))
        x = np.ldexp(_matrix(table.column("x"), np.float16).astype(np.float64), table.column("scale").to_numpy()[:, None])
        square = _squares(x, x)
        np.fill_diagonal(square, np.inf)
        a, b = np.nonzero((square < far[:, None]) & (fresh[:, None] | fresh[None, :]))
        return pa.table([m[a], m[b], square[a, b]], schema=_link)

    links = written(_shortest(_first_lists(points, width).withColumn("fresh", F.lit(True)), width))
    for turn in range(ROUNDS):
        ends = _both(links)
        blocks = ends.groupBy("p").agg(F.ceil(F.count(F.lit(1)) / HUB).alias("blocks"), F.max("fresh").alias("any")).where("any")
        farthest = links.groupBy("v").agg(F.when(F.count(F.lit(1)) >= width, F.max("g")).otherwise(float("inf")).alias("far"))
        members = halves.join(farthest, "v").withColumnRenamed("v", "m")
        # Members of a point that is cut into blocks may not have met before.
        dealt = ends.join(blocks, "p").select(
            "p", "m", (F.col("fresh") | (F.col("blocks") > 1)).alias("fresh"), F.pmod(F.xxhash64("p", "m", F.lit(turn)), F.col("blocks")).alias("block")
        )
        found = dealt.join(members, "m").groupBy("p", "block").applyInArrow(meet, "v long, u long, g double")
        every = found.withColumn("fresh", F.lit(True)).unionByName(links.withColumn("fresh", F.lit(False)))
        links = written(_shortest(every, width))
        changed, total = links.agg(F.count_if("fresh"), F.count(F.lit(1))).first()
        if changed <= SETTLED * total:
            break
    return links.select("v", "u", "g")


def _greedy(points: DataFrame, links: DataFrame, starts: DataFrame, beam: int) -> DataFrame:
    """(q, v, first, g): the `beam` nearest points found for every query point, and the point itself."""
    follow = written(_both(links.withColumn("fresh", F.lit(False))).select(F.col("p").alias("v"), F.col("m").alias("u")))
    ask = written(starts.join(points, "v").select(F.col("v").alias("q"), "first", "d", F.col("x").alias("y")))
    schema = pa.schema([("q", pa.int64()), ("v", pa.int64()), ("first", pa.int64()), ("g", pa.float64())])

    def measured(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            lengths, g = batch.column("d").to_numpy(), np.zeros(batch.num_rows)
            for d in np.unique(lengths):
                at = np.flatnonzero(lengths == d)
                one, two = (_matrix(batch.column(c).take(pa.array(at))) for c in ("x", "y"))
                with np.errstate(over="ignore"):
                    g[at] = ((one - two) ** 2).sum(axis=1)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("q", "v", "first")), pa.array(g)], schema=schema)

    kept = written(ask.select("q", F.col("q").alias("v"), "first", F.lit(0.0).alias("g"), F.lit(False).alias("followed")))
    seen = kept.select("q", "v")
    while True:
        front = kept.where("not followed").select("q", "v")
        if front.isEmpty():
            return kept.select("q", "v", "first", "g")
        reached = front.join(follow, "v").select("q", F.col("u").alias("v")).distinct().join(seen, ["q", "v"], "left_anti")
        found = reached.join(points.select("v", "first", "x"), "v").join(ask.drop("first"), "q").select("q", "v", "first", "d", "x", "y")
        found = found.mapInArrow(measured, "q long, v long, first long, g double")
        found = written(found)
        seen = seen.unionByName(found.select("q", "v"))
        every = kept.withColumn("followed", F.lit(True)).unionByName(found.withColumn("followed", F.lit(False)))
        kept = written(top_per_group(every, ["q"], [F.col("g"), F.col("first"), F.col("v")], beam + 1).drop("rank"))


def nearest_rows(
    vectors: DataFrame,
    query: Column,
    k: int = 10,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    width: int = WIDTH,
    beam: int = BEAM,
) -> DataFrame:
    """query_id, rank, vec_id and score (distance) of the `k` nearest rows found for every row that `query` holds for."""
    points, ids, asked = _points(vectors, query, id_col, vector_col, k)
    near = _greedy(points, graph(points, width), asked.select("v").distinct(), max(beam, k))
    # Of a query's points the nearest k + 1 are enough, and of a point the k + 1 smallest ids.
    close = top_per_group(near, ["q"], [F.col("g"), F.col("first"), F.col("v")], k + 1).drop("rank")
    met = close.drop("first").join(asked.withColumnRenamed("v", "q"), "q").join(ids, "v").where("id != query_id")
    best = top_per_group(met.withColumn("score", F.sqrt("g")), ["query_id", "q"], [F.col("score"), F.col("id")], k)
    real = lambda c: F.when(F.col(c) != NULL_ID, F.col(c))
    return best.select(real("query_id").alias("query_id"), F.col("rank").cast("int").alias("rank"), real("id").alias("vec_id"), "score")
