"""k-means clusters over the item features, with the number of clusters chosen by silhouette.

All candidate numbers of clusters are fitted side by side: they share their seeds, drawn once, and an iteration is one
scan that assigns every row under each number and sums rows by (number, cluster, feature), followed by one aggregate.
Rows stay sparse; centres are as wide as the features and the only thing that goes to and from the driver.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

from medley.operators.features import Weights, features_vector
from medley.operators.membership import filter_membership
from medley.operators.silhouette import mean_silhouettes
from medley.plans.skew import materialized

# Candidate numbers of clusters and the seed.
K_MIN, K_MAX, SEED = 2, 12, 42
# Rows from which seeds are drawn, iterations at most, and the largest move of a centre that ends them.
SAMPLE, ROUNDS, STILL = 4096, 20, 1e-4
SLICE = 512  # rows compared with all centres at a time; does not change results


def with_cells(vectors: DataFrame) -> DataFrame:
    """Vectors with `cells`, their non-zero features by place, unless they come with them."""
    if "cells" in vectors.columns:
        return vectors
    listed = F.transform(vector_to_array("features"), lambda x, i: F.struct(i.alias("feature"), x.alias("value")))
    return vectors.withColumn("cells", F.filter(listed, lambda c: c["value"] != 0))


def silhouettes(rows: DataFrame, labels: Sequence[str]) -> dict[str, float | None]:
    """Mean Euclidean silhouette of every labelling; None for one with fewer than two clusters."""
    return mean_silhouettes(with_cells(rows), labels)


class _Sparse:
    """Rows of a batch as places of features, values and the row of each."""

    def __init__(self, cells: pa.Array) -> None:
        flat = cells.flatten()
        self.sizes = pc.fill_null(pc.list_value_length(cells), 0).to_numpy()
        self.code, self.value = flat.field("feature").to_numpy(), flat.field("value").to_numpy()
        self.row = np.repeat(np.arange(len(cells)), self.sizes)

    def products(self, centres: np.ndarray) -> np.ndarray:
        """Inner products of all rows with all centres."""
        out = np.zeros((len(self.sizes), len(centres)))
        ends = np.r_[0, np.cumsum(self.sizes)]
        for low in range(0, len(self.sizes), SLICE):
            high = min(low + SLICE, len(self.sizes))
            some = slice(ends[low], ends[high])
            used, at = np.unique(self.code[some], return_inverse=True)
            dense = np.zeros((high - low, len(used)))
            dense[self.row[some] - low, at] = self.value[some]
            out[low:high] = dense @ centres[:, used].T
        return out


def seeds(rows: DataFrame, width: int, k: int) -> np.ndarray:
    """k rows far from each other: each is drawn with a chance that grows with its squared distance to those before.

    Drawn from at most SAMPLE rows, those with the smallest hashes. The first of them are the seeds of a smaller k.
    """
    chosen = rows.orderBy(F.xxhash64("row", F.lit(SEED)), "row").limit(SAMPLE).select("cells").toArrow()
    sample = _Sparse(chosen.column("cells").combine_chunks())
    n = len(sample.sizes)
    square = np.bincount(sample.row, sample.value**2, minlength=n)
    draw = np.random.default_rng(SEED)
    centres = np.zeros((k, width))
    far = np.ones(n)
    for i in range(k):
        chance = far / far.sum() if far.sum() > 0 else np.full(n, 1 / n)
        at = int(draw.choice(n, p=chance))
        mine = sample.row == at
        centres[i, sample.code[mine]] = sample.value[mine]
        d = np.maximum(square + square[at] - 2 * sample.products(centres[i : i + 1])[:, 0], 0)
        d[at] = 0
        far = d if i == 0 else np.minimum(far, d)
    return centres


class Fits:
    """Centres for several numbers of clusters, one after the other in one matrix."""

    def __init__(self, first: np.ndarray, numbers: Sequence[int]) -> None:
        self.numbers = list(numbers)
        self.cuts = np.cumsum([0, *self.numbers])
        self.centres = np.concatenate([first[:k] for k in self.numbers])

    def labels(self, rows: _Sparse) -> np.ndarray:
        """The nearest centre of every row, for every number of clusters."""
        d = (self.centres**2).sum(axis=1) - 2 * rows.products(self.centres)
        return np.stack([d[:, a:b].argmin(axis=1) for a, b in zip(self.cuts, self.cuts[1:])], axis=1)

    def moved(self, rows: DataFrame) -> float:
        """One iteration for all numbers; the largest move of a centre."""
        width = self.centres.shape[1]

        def sums(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, count = np.zeros(self.centres.size), np.zeros(len(self.centres))
            for batch in it:
                some = _Sparse(batch.column("cells"))
                at = self.labels(some) + self.cuts[:-1]
                count += np.bincount(at.ravel(), minlength=len(count))
                for j in range(at.shape[1]):
                    np.add.at(total, at[some.row, j] * width + some.code, some.value)
            cell = np.flatnonzero(total)
            # The count of a centre stands behind its features.
            centre = np.concatenate([cell // width, np.arange(len(count))])
            feature = np.concatenate([cell % width, np.full(len(count), width)])
            yield pa.RecordBatch.from_arrays([pa.array(centre), pa.array(feature), pa.array(np.concatenate([total[cell], count]))], names=["centre", "feature", "x"])

        found = rows.select("cells").mapInArrow(sums, "centre long, feature long, x double").groupBy("centre", "feature").agg(F.sum("x").alias("x")).toArrow()
        table = np.zeros((len(self.centres), width + 1))
        table[found.column("centre").to_numpy(), found.column("feature").to_numpy()] = found.column("x").to_numpy()
        some = table[:, -1] > 0  # a centre without rows stays
        new = np.where(some[:, None], table[:, :-1] / np.maximum(table[:, -1:], 1), self.centres)
        move = float(np.sqrt(((new - self.centres) ** 2).sum(axis=1)).max())
        self.centres = new
        return move


def labelings(vectors: DataFrame, k_min: int, k_max: int) -> tuple[DataFrame, dict[int, float]]:
    """`vectors` (row, features or cells, …) with a column `k<n>` for every number of clusters, and their silhouettes."""
    rows = materialized(with_cells(vectors))
    width = (rows.select(F.max(F.array_max("cells.feature"))).first()[0] or 0) + 1
    fits = Fits(seeds(rows, width, k_max), range(k_min, k_max + 1))
    for _ in range(ROUNDS):
        if fits.moved(rows) <= STILL:
            break
    schema = pa.schema([("_row", pa.int64()), *((f"k{k}", pa.int32()) for k in fits.numbers)])

    def labelled(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            found = fits.labels(_Sparse(batch.column("cells"))).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("row").cast(pa.int64()), *(pa.array(c) for c in found.T)], schema=schema)

    names = [f"k{k}" for k in fits.numbers]
    found = rows.select("row", "cells").mapInArrow(labelled, "_row long, " + ", ".join(f"{c} int" for c in names))
    out = materialized(rows.join(found, rows["row"] == found["_row"]).drop("_row"))
    scores = silhouettes(out, names)
    return out, {int(name[1:]): s for name, s in scores.items() if s is not None}


def _best(scores: dict[int, float], default: int) -> int:
    """The number of clusters with the highest score above -1, ties to the smaller."""
    return min((k for k in scores if scores[k] > -1), key=lambda k: (-scores[k], k), default=default)


def choose_k(vectors: DataFrame, k_min: int = K_MIN, k_max: int = K_MAX) -> tuple[int, dict[int, float]]:
    """Number of clusters with the best Euclidean silhouette, and the scores."""
    n = vectors.count()
    if n <= k_min:
        return max(1, n), {}
    scores = labelings(vectors, k_min, min(k_max, n - 1))[1]
    return _best(scores, k_min), scores


def cluster_vectors(vectors: DataFrame, k: int | str = "auto") -> DataFrame:
    """`vectors` (row, features, …) with `cluster_id`; k is clamped to 1..rows."""
    n = vectors.count()
    if k == "auto" and n > K_MIN:
        labelled, scores = labelings(vectors, K_MIN, min(K_MAX, n - 1))
        return labelled.select(*vectors.columns, F.col(f"k{_best(scores, K_MIN)}").alias("cluster_id"))
    wanted = max(1, min(n if k == "auto" else int(k), n))
    if wanted == 1:
        return vectors.withColumn("cluster_id", F.lit(0))
    return KMeans(featuresCol="features", predictionCol="cluster_id", k=wanted, seed=SEED).fit(vectors).transform(vectors)


def cluster_kmeans(tracks: DataFrame, k: int | str = "auto", weights: Weights = Weights()) -> DataFrame:
    """Items with `cluster_id` set by k-means over genres, audio features and year."""
    vectors, _ = features_vector(tracks.drop("cluster_id"), weights, with_cells=True)
    return cluster_vectors(vectors.withColumn("row", F.col("pos")), k).drop("row", "features", "cells")


def cluster_items(
    tracks: DataFrame,
    algorithm: str = "kmeans",
    k: int | str = "auto",
    weights: Weights = Weights(),
    playlists: Sequence[str] | None = None,
    min_cluster_size: int = 5,
) -> DataFrame:
    """Cluster the rows of the selected playlists, and only those, by either algorithm."""
    from medley.operators.density import cluster_density

    if algorithm not in ("kmeans", "hdbscan"):
        raise ValueError(f"Unsupported algorithm {algorithm!r}: there are kmeans and hdbscan.")
    chosen = filter_membership(tracks, playlists)
    if algorithm == "kmeans":
        return cluster_kmeans(chosen, k, weights)
    return cluster_density(chosen, weights, min_cluster_size)
