"""Near-duplicate vectors: inverted lists with product-quantised residuals, probed widely, reranked exactly.

Index: unit vectors go to the list of their nearest coarse centre (about sqrt(n) lists); the residual is cut in
`SUBSPACES` parts, each stored as the number of its nearest code. Centres and codes are fitted by k-means on at
most `sample` vectors, those with the smallest hashes; every vector is indexed.

Search: each vector is compared within its own list and visits every other list whose border with its own is
nearer than `slack`. A pair at the threshold is sqrt(2 - 2 cos) apart, so if a border lies between the two, one of
them is at most half of that away from it: with slack at that half, the default, every pair meets in one of the
two lists. Where both visit each other, the visit to the earlier list leaves the pair out. Inside a list distances come from a table of the
visitor's residual parts against all codes, plus the stored error of each code, which bounds the true
distance from below: no true pair of a probed list is lost there. What remains is reranked by cosine in
double precision.

Work is dealt by (list, block, block): lists are cut in blocks of about `BLOCK` vectors, so a list or a group of
copies of any size is spread over many bounded groups. A group returns link counts per vector and a spanning
forest of its links, never all pairs. Equal vectors are one vector with a multiplicity.

Every length of vectors has an index of its own, fitted on at most `sample` of them; lists are numbered on.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components link with nothing, nor do
vectors of different lengths; null ids are the smallest id and come back as null; rows that share an id are one
vertex of the components and count as separate rows in n_links; equal rows get equal results; an empty table gives
an empty table; other columns are ignored. No pair is lost unless a smaller `slack` is given.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from medley.llm.common import NULL_ID, written
from medley.llm.components import components

SUBSPACES = 8
CODES = 256
BLOCK = 1024
SAMPLE = 16_384


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (x @ (-2 * centres.T) + (centres**2).sum(axis=1)).argmin(axis=1)


def kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 1) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centres = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        home = _nearest(x, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, home, x)
        n = np.bincount(home, minlength=len(centres))
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres


class Index:
    """Coarse centres and residual codes."""

    def __init__(self, sample: np.ndarray, lists: int) -> None:
        self.centres = kmeans(sample, max(1, min(lists, len(sample))))
        self.width = -(-sample.shape[1] // SUBSPACES)
        rest = self.cut(sample - self.centres[_nearest(sample, self.centres)])
        self.codes = [kmeans(rest[:, s], min(CODES, len(sample)), seed=s) for s in range(SUBSPACES)]

    def cut(self, x: np.ndarray) -> np.ndarray:
        """Vectors as (row, subspace, part), padded with zeros."""
        full = np.zeros((len(x), SUBSPACES * self.width))
        full[:, : x.shape[1]] = x
        return full.reshape(len(x), SUBSPACES, self.width)

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(list, codes, distance between the vector and its coded place)."""
        home = _nearest(x, self.centres)
        rest = self.cut(x - self.centres[home])
        codes = np.stack([_nearest(rest[:, s], c) for s, c in enumerate(self.codes)], axis=1)
        error = sum(((rest[:, s] - c[codes[:, s]]) ** 2).sum(axis=1) for s, c in enumerate(self.codes))
        return home, codes.astype(np.uint8), np.sqrt(error)

    def visited(self, x: np.ndarray, home: np.ndarray, slack: float) -> list[np.ndarray]:
        """Other lists whose border with the own one is nearer than slack."""
        d = x @ (-2 * self.centres.T) + (self.centres**2).sum(axis=1)
        own, square = self.centres[home], (self.centres**2).sum(axis=1)
        between = np.sqrt(np.maximum(square + square[home][:, None] - 2 * own @ self.centres.T, 1e-300))
        # Twice the distance to the border times `between`; the margin is above what rounding adds.
        near = d - d[np.arange(len(x)), home][:, None] <= 2 * slack * between + 1e-7
        near[np.arange(len(x)), home] = False
        return [np.flatnonzero(row) for row in near]

    def table_distances(self, x: np.ndarray, home: int, codes: np.ndarray) -> np.ndarray:
        """Squared distances from vectors to coded places of a list, summed from one table row per subspace."""
        rest = self.cut(x - self.centres[home])
        out = np.zeros((len(codes), len(x)))
        for s, c in enumerate(self.codes):
            used, at = np.unique(codes[:, s], return_inverse=True)  # a list seldom holds all codes
            part, c = rest[:, s], c[used]
            table = (c**2).sum(axis=1)[:, None] + (part**2).sum(axis=1) - 2 * (c @ part.T)
            out += table[at]
        return np.maximum(out, 0).T


def _unit(batch: pa.RecordBatch, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(usable rows, unit vectors in double precision) of one length."""
    column = batch.column("e").to_pylist()
    rows, out = [], []
    for i, e in enumerate(column):
        if e is not None and len(e) == width and None not in e:
            rows.append(i)
            out.append(e)
    x = np.array(out, np.float64).reshape(len(rows), width)
    with np.errstate(all="ignore"):
        size = np.sqrt((x * x).sum(axis=1))
    tiny = (size < 1e-150) | ~np.isfinite(size)  # squares under- or overflow: scale first
    if tiny.any():
        with np.errstate(all="ignore"):
            top = np.abs(x[tiny]).max(axis=1, keepdims=True) if width else np.zeros((0, 1))
            x[tiny] = x[tiny] / top
            size[tiny] = np.sqrt((x[tiny] ** 2).sum(axis=1))
    good = np.isfinite(size) & (size > 0)
    return np.array(rows, np.int64)[good], x[good] / size[good][:, None]


ENTRY = "s long, mult long, list int, codes binary, error double, unit binary, visits array<int>"
_entry = pa.schema([
    ("s", pa.int64()), ("mult", pa.int64()), ("list", pa.int32()), ("codes", pa.binary()), ("error", pa.float64()),
    ("unit", pa.binary()), ("visits", pa.list_(pa.int32())),
])


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest vertex reachable from each of n vertices."""
    root = np.arange(n)
    while True:
        least = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, least)
        np.minimum.at(new, b, least)
        np.minimum.at(new, root[a], least)
        np.minimum.at(new, root[b], least)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _links(one: dict, two: dict | None, index: Index, first: int, home: int, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(set numbers, partial link counts, forest roots) of a group of list `home`; without `two` the pairs inside `one`.

    `first` is the number of the index's first list.
    """
    other = one if two is None else two
    reach = np.sqrt(max(0.0, 2 - 2 * threshold)) + 1e-6  # above what rounding adds to the root of a small square
    near = np.sqrt(index.table_distances(one["unit"], home - first, other["codes"])) <= reach + other["error"][None, :]
    if two is None:
        near = np.triu(near | near.T, 1)
    else:
        # Members that visit a later list have met its vectors there.
        for later in np.unique(one["home"][one["home"] > home]):
            near[np.ix_(one["home"] == later, two["row"][two["visits"] == later])] = False
    a, b = np.nonzero(near)
    keep = np.einsum("ij,ij->i", one["unit"][a], other["unit"][b]) >= threshold
    a, b = a[keep], b[keep]
    if two is None:
        s, n = one["s"], len(one["s"])
        mult = one["mult"]
    else:
        s, n = np.concatenate([one["s"], two["s"]]), len(one["s"]) + len(two["s"])
        mult, b = np.concatenate([one["mult"], two["mult"]]), b + len(one["s"])
    count = np.zeros(n, np.int64)
    np.add.at(count, a, mult[b])
    np.add.at(count, b, mult[a])
    linked = np.flatnonzero(count)
    return s[linked], count[linked], s[_forest(n, a, b)[linked]]


def near_vectors(
    vectors: DataFrame,
    threshold: float = 0.95,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    slack: float | None = None,
    sample: int = SAMPLE,
    block: int = BLOCK,
) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row."""
    spark = vectors.sparkSession
    if slack is None:
        slack = np.sqrt(max(0.0, 2 - 2 * threshold)) / 2
    rows = vectors.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("k"), F.col(vector_col).cast("array<double>").alias("e"))
    distinct = rows.where(F.size("e") > 0).groupBy("e").agg(F.min("k").alias("first"), F.count(F.lit(1)).alias("mult"))
    distinct = written(distinct.withColumn("s", F.monotonically_increasing_id()))  # numbers are fixed once written
    rows = written(rows.join(distinct.select("e", "s"), "e", "left").select("k", "s"))

    indexes: dict[int, tuple[Index, int]] = {}
    first = 0
    for width, n in sorted(map(tuple, distinct.groupBy(F.size("e")).count().collect())):
        chosen = distinct.where(F.size("e") == width).orderBy(F.xxhash64("s", F.lit(7)), "s").limit(sample).select("e").toArrow().to_batches()
        x = np.concatenate([np.zeros((0, width)), *(_unit(b, width)[1] for b in chosen if b.num_rows)])
        indexes[width] = Index(x if len(x) else np.zeros((1, width)), int(np.ceil(np.sqrt(n)))), first
        first += len(indexes[width][0].centres)

    def entries(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # In slices, so that distances to all centres stay small.
        for batch in (whole.slice(i, 1000) for whole in it for i in range(0, whole.num_rows, 1000)):
            for width in {len(e) for e in batch.column("e")}:
                at, unit = _unit(batch, width)
                if not len(at):
                    continue
                index, begin = indexes[width]
                home, codes, error = index.encode(unit)
                visits = [v + begin for v in index.visited(unit, home, slack)]
                take = pa.array(at)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("s").take(take), batch.column("mult").take(take), pa.array((home + begin).astype(np.int32)), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(error),
                     pa.array([u.tobytes() for u in unit], pa.binary()), pa.array(visits, pa.list_(pa.int32()))],
                    schema=_entry,
                )

    indexed = written(distinct.select("s", "mult", "e").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "s").mapInArrow(entries, ENTRY))
    # Blocks per list, from one row per list; visitors are cut likewise.
    member = indexed.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    guests = indexed.select(F.explode("visits").alias("list")).groupBy("list").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("guest_blocks"))
    plan = written(member.join(guests, "list", "left").select("list", "blocks", F.coalesce("guest_blocks", F.lit(0)).alias("guest_blocks")))
    payload = ["s", "mult", "codes", "error", "unit", "home", "later"]
    # The list a visitor comes from and the later lists a host visits say which pairs meet elsewhere.
    no_home, no_later = F.lit(-1).alias("home"), F.lit(None).cast("array<int>").alias("later")
    own = indexed.withColumn("home", no_home).withColumn("later", F.expr("filter(visits, v -> v > list)")).drop("visits").join(F.broadcast(plan), "list").withColumn("x", F.pmod("s", F.col("blocks")).cast("int"))
    many = lambda c: F.sequence(F.lit(0), c - 1)
    # Side 0 and 1 meet in a group: two blocks of members (x <= y), or a block of visitors (x < 0) and one of members.
    inside = own.withColumn("later", no_later).withColumn("o", F.explode(many(F.col("blocks")))).select(
        "list", F.least("x", "o").alias("x"), F.greatest("x", "o").alias("y"), F.when(F.col("x") <= F.col("o"), 0).otherwise(1).alias("side"), *payload
    )
    hosts = own.where("guest_blocks > 0").withColumn("o", F.explode(many(F.col("guest_blocks")))).select("list", (-1 - F.col("o")).alias("x"), F.col("x").alias("y"), F.lit(1).alias("side"), *payload)
    visit = indexed.withColumn("home", F.col("list")).withColumn("later", no_later).withColumn("list", F.explode("visits")).join(F.broadcast(plan), "list")
    visit = visit.withColumn("x", F.pmod("s", F.col("guest_blocks")).cast("int")).withColumn("o", F.explode(many(F.col("blocks"))))
    visit = visit.select("list", (-1 - F.col("x")).alias("x"), F.col("o").alias("y"), F.lit(0).alias("side"), *payload)

    def compare(table: pa.Table) -> pa.Table:
        home, bx, by = (table.column(c)[0].as_py() for c in ("list", "x", "y"))
        side = table.column("side").to_numpy()
        width = len(table.column("unit")[0].as_py()) // 8

        def rows_of(mask: np.ndarray) -> dict:
            t = table.filter(pa.array(mask))
            later = t.column("later").combine_chunks()
            sizes = pc.fill_null(pc.list_value_length(later), 0).to_numpy()
            return {
                "home": t.column("home").to_numpy(), "row": np.repeat(np.arange(len(t)), sizes), "visits": later.flatten().to_numpy(),
                "s": t.column("s").to_numpy(), "mult": t.column("mult").to_numpy(), "error": t.column("error").to_numpy(),
                "codes": np.frombuffer(b"".join(t.column("codes").to_pylist()), np.uint8).reshape(-1, SUBSPACES),
                "unit": np.frombuffer(b"".join(t.column("unit").to_pylist()), np.float64).reshape(-1, width),
            }

        one, two = rows_of(side == 0), None if bx == by else rows_of(side == 1)
        if not len(one["s"]) or (two is not None and not len(two["s"])):
            s = n = root = np.zeros(0, np.int64)
        else:
            s, n, root = _links(one, two, *indexes[width], home, threshold)
        return pa.table({"s": pa.array(s, pa.int64()), "n": pa.array(n, pa.int64()), "root": pa.array(root, pa.int64())})

    met = written(inside.unionByName(hosts).unionByName(visit).groupBy("list", "x", "y").applyInArrow(compare, "s long, n long, root long"))
    by_vector = met.groupBy("s").agg(F.sum("n").alias("n"))
    sets = distinct.select("s", "first", "mult")
    usable = indexed.select("s")
    info = sets.join(usable, "s").join(by_vector, "s", "left").select("s", "first", "mult", F.coalesce("n", F.lit(0)).alias("n"))
    edges = met.where("s != root").select("s", "root").distinct()
    edges = edges.join(sets.select("s", F.col("first").alias("a")), "s").join(sets.select(F.col("s").alias("root"), F.col("first").alias("b")), "root").select("a", "b")
    own_rows = rows.join(info, "s")
    graph = components(edges.unionByName(own_rows.select(F.col("k").alias("a"), F.col("first").alias("b"))))
    out = rows.join(info.select("s", "mult", "n"), "s", "left").join(graph, F.col("k") == F.col("v"), "left")
    out = out.select("k", F.coalesce(F.col("n") + F.col("mult") - 1, F.lit(0)).cast("long").alias("n_links"), F.coalesce("root", "k").alias("root"))
    real = lambda c: F.when(F.col(c) != NULL_ID, F.col(c))
    return out.select(real("k").alias("vec_id"), "n_links", real("root").alias("component_id"), (F.col("k") == F.col("root")).alias("kept"))
