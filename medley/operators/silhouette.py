"""Mean Euclidean silhouettes of any number of labellings, in one pass over the pairs of rows.

A row's silhouette is (b - a) / max(a, b), with a its mean distance to the other rows of its cluster and b the smallest
of its mean distances to another cluster. Mean distances need every pair: the measure is defined on them, and no bound
from cells is narrow enough beyond a few dimensions to stand for them. So the pairs are measured, all labellings at once,
but none is ever a row of a table: rows with the same features and labels are one point with a weight, points are dealt
into blocks, and a task takes two blocks, forms their distances by matrix products, tile by tile, and gives back one
vector of sums per point, a cell per cluster. The work grows with the square of the distinct points, as in the definition;
a task's memory and a row's size do not grow. A point is sent to as many tasks as there are blocks, so blocks are as large
as a task's memory allows: up to `PARTS` blocks of `CELLS` cells, what is shuffled grows with the points alone, and
beyond with their square over the size of a block.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, functions as F

from medley.functions.sparse import Rows
from medley.plans.skew import materialized

# Most points and features of a block, the points of a tile's two sides, and how many blocks there are while they are
# smaller than that; they bound a task's memory and do not change results.
BLOCK, CELLS, STRIP, TILE, PARTS = 32768, 1 << 22, 512, 2048, 8


def _blocks(points: int, cells: int) -> int:
    """Into how many blocks so many points with so many features in all are dealt."""
    return max(-(-points // BLOCK), -(-cells // CELLS), min(PARTS, -(-points // TILE)), 1)


def _distance_sums(points: DataFrame, width: int) -> DataFrame:
    """(point, sums): for every point (point, weight, cells, at) its summed distances to each of `width` clusters."""
    size = points.agg(F.count(F.lit(1)).alias("points"), F.sum(F.size("cells").cast("long")).alias("cells")).first()
    blocks = _blocks(size["points"], size["cells"] or 0)
    own = points.withColumn("x", F.pmod(F.xxhash64("point"), F.lit(blocks)).cast("int"))
    # Every pair of blocks meets once, the smaller number on side 0.
    dealt = own.withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    dealt = dealt.select(F.least("x", "o").alias("x"), F.greatest("x", "o").alias("y"), F.when(F.col("x") <= F.col("o"), 0).otherwise(1).alias("side"), "point", "weight", "cells", "at")
    schema = pa.schema([("point", pa.int64()), ("sums", pa.list_(pa.float64()))])

    def clusters(table: pa.Table) -> np.ndarray:
        """Weights by cluster of every labelling."""
        at = table.column("at").combine_chunks().flatten().to_numpy().reshape(len(table), -1)
        out = np.zeros((len(table), width))
        out[np.arange(len(table))[:, None], at] = table.column("weight").to_numpy()[:, None]
        return out

    def tiles(n: int, m: int, inside: bool) -> Iterator[tuple[int, int, int, int]]:
        """Runs of the first n points with runs of the others, or of all points if they are one block."""
        for far in range(0 if inside else n, m, TILE):
            for low in range(0, n, STRIP):
                yield low, min(low + STRIP, n), far, min(far + TILE, m)

    def meet(table: pa.Table) -> pa.Table:
        inside = table.column("x")[0].as_py() == table.column("y")[0].as_py()
        table = table.sort_by("side")
        n = len(table) if inside else int((table.column("side").to_numpy() == 0).sum())
        rows, weights = Rows(table.column("cells")), clusters(table)
        sums = np.zeros((len(table), width))
        for low, high, far, end in tiles(n, len(table), inside):
            strip, tile = slice(low, high), slice(far, end)
            d = np.sqrt(rows.squares(strip, tile))
            if inside:
                same = np.arange(max(low, far), min(high, end))
                d[same - low, same - far] = 0.0  # not what rounding makes of it
            sums[strip] += d @ weights[tile]
            if not inside:
                sums[tile] += d.T @ weights[strip]
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, sums.size + 1, width), pa.int32()), sums.ravel())
        return pa.table([table.column("point"), lists.cast(schema.field("sums").type)], schema=schema)

    met = dealt.groupBy("x", "y").applyInArrow(meet, "point long, sums array<double>")
    total = met.groupBy("point").agg(Summarizer.sum(array_to_vector("sums")).alias("sums"))
    return total.select("point", vector_to_array("sums").alias("sums"))


def mean_silhouettes(rows: DataFrame, labels: Sequence[str]) -> dict[str, float | None]:
    """Mean Euclidean silhouette of every labelling of `rows` (cells, labels); None for one with fewer than two clusters.

    Rows alone in their cluster count as 0. The labels of a labelling are few enough to be held by the driver.
    """
    names = [f"_l{i}" for i in range(len(labels))]
    rows = rows.select("cells", *[F.col(c).cast("string").alias(n) for c, n in zip(labels, names)])
    points = rows.groupBy("cells", *names).agg(F.count(F.lit(1)).alias("weight"))
    points = materialized(points.withColumn("point", F.monotonically_increasing_id()))
    sizes = [{r[0]: r[1] for r in points.groupBy(n).agg(F.sum("weight")).orderBy(n).collect()} for n in names]
    used = [i for i, s in enumerate(sizes) if len(s) > 1]
    out: dict[str, float | None] = dict.fromkeys(labels)
    if not used:
        return out
    first = np.cumsum([0, *(len(sizes[i]) for i in used)])
    places = [{label: int(begin) + j for j, label in enumerate(sizes[i])} for i, begin in zip(used, first)]
    at = F.array(*[F.coalesce(*[F.when(F.col(names[i]).eqNullSafe(F.lit(label)), F.lit(p)) for label, p in place.items()]) for i, place in zip(used, places)])
    numbered = materialized(points.select("point", "weight", "cells", at.alias("at")))
    members = np.concatenate([list(sizes[i].values()) for i in used]).astype(np.float64)

    def scored(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            if not batch.num_rows:
                continue
            sums = np.array(batch.column("sums").to_pylist())
            own_at, weight = np.array(batch.column("at").to_pylist()), batch.column("weight").to_numpy()
            row, totals = np.arange(len(sums)), []
            for j in range(len(used)):
                own, low, high = own_at[:, j], first[j], first[j + 1]
                others = sums[:, low:high] / members[low:high]
                others[row, own - low] = np.inf
                b, n = others.min(axis=1), members[own]
                a = sums[row, own] / np.maximum(n - 1, 1)
                most = np.maximum(a, b)
                totals.append((weight * np.where((n > 1) & (most > 0), (b - a) / np.where(most > 0, most, 1), 0)).sum())
            yield pa.RecordBatch.from_arrays([pa.array(range(len(used)), pa.int32()), pa.array(totals, pa.float64())], names=["labelling", "total"])

    judged = _distance_sums(numbered, int(first[-1])).join(numbered.select("point", "weight", "at"), "point").select("sums", "at", "weight")
    found = judged.mapInArrow(scored, "labelling int, total double").groupBy("labelling").agg(F.sum("total").alias("total")).collect()
    n = sum(sizes[0].values())
    return out | {labels[used[r["labelling"]]]: r["total"] / n for r in found}
