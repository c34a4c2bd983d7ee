"""k-means side by side and Euclidean silhouettes against plain numpy over all rows and pairs."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors

from medley.operators import kmeans, silhouette
from medley.plans import graph


def frame(spark, x, labels=None):
    rows = [(i, Vectors.dense(v), *((int(labels[i]),) if labels is not None else ())) for i, v in enumerate(x)]
    return spark.createDataFrame(rows, ["row", "features", *(["label"] if labels is not None else [])])


def plain_silhouette(x, labels):
    d = np.sqrt(((x[:, None, :] - x[None, :, :]) ** 2).sum(axis=2))
    total = 0.0
    for i, own in enumerate(labels):
        if (labels == own).sum() > 1:
            a = d[i][labels == own].sum() / ((labels == own).sum() - 1)
            b = min(d[i][labels == c].mean() for c in set(labels.tolist()) - {own})
            total += (b - a) / max(a, b) if max(a, b) > 0 else 0.0
    return total / len(x)


def plain_lloyd(x, centres):
    for _ in range(kmeans.ROUNDS):
        labels = ((x[:, None, :] - centres[None, :, :]) ** 2).sum(axis=2).argmin(axis=1)
        new = np.array([x[labels == c].mean(axis=0) if (labels == c).any() else centres[c] for c in range(len(centres))])
        move = np.sqrt(((new - centres) ** 2).sum(axis=1)).max()
        centres = new
        if move <= 1e-12:
            break
    return ((x[:, None, :] - centres[None, :, :]) ** 2).sum(axis=2).argmin(axis=1)


@pytest.mark.parametrize("block", [2048, 40])
def test_silhouette_equals_all_pairs(spark, monkeypatch, block):
    """Several blocks, copies, a cluster of one row, rows on one place."""
    monkeypatch.setattr(silhouette, "BLOCK", block)
    monkeypatch.setattr(silhouette, "STRIP", 17)
    r = np.random.default_rng(5)
    labels = r.integers(0, 4, 150)
    x = r.normal(size=(150, 6)) + labels[:, None] * r.normal(size=6)
    x = np.concatenate([x, x[:30], np.zeros((3, 6)), np.ones((1, 6)) * 9])
    labels = np.concatenate([labels, labels[:20], r.integers(0, 4, 13), [7]])
    df = frame(spark, x, labels)
    got = kmeans.silhouettes(df.selectExpr("*", "label % 2 as half", "0 as same"), ["label", "half", "same"])
    assert got["label"] == pytest.approx(plain_silhouette(x, labels), abs=1e-9)
    assert got["half"] == pytest.approx(plain_silhouette(x, labels % 2), abs=1e-9)
    assert got["same"] is None


def test_all_numbers_of_clusters_side_by_side(spark, monkeypatch):
    monkeypatch.setattr(kmeans, "STILL", 1e-12)
    r = np.random.default_rng(8)
    x = np.concatenate([r.normal(size=(60, 5)) + 4 * r.normal(size=5) for _ in range(4)])
    x[:, 3] = np.where(x[:, 3] > 0, 1.0, 0.0)
    df = frame(spark, x)
    rows = kmeans.with_cells(df)
    first = kmeans.seeds(rows, 5, 6)
    labelled, scores = kmeans.labelings(df, 2, 6)
    got = {c.row: c for c in labelled.collect()}
    for k in range(2, 7):
        want = plain_lloyd(x, first[:k])
        assert [got[i][f"k{k}"] for i in range(len(x))] == want.tolist()
        assert scores[k] == pytest.approx(plain_silhouette(x, want), abs=1e-9)
    assert kmeans.choose_k(df, 2, 6)[0] == max(scores, key=lambda k: (scores[k], -k))


def test_one_scan_per_iteration(spark):
    """An iteration of all numbers of clusters is one job over the rows."""
    rows = kmeans.with_cells(frame(spark, np.random.default_rng(1).normal(size=(50, 3))))
    fits = kmeans.Fits(kmeans.seeds(rows, 3, 12), range(2, 13))
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("iteration", "one")
    fits.moved(rows)
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(tracker.getJobIdsForGroup("iteration")) <= 2  # the scan's stage and the aggregate's
    assert len(fits.centres) == sum(range(2, 13))


def test_points_are_sent_to_few_tasks(spark, monkeypatch):
    """How often a point is sent does not grow with the points while a block fits a task; tiles that cross give the same."""
    assert [silhouette._blocks(n, 64 * n) for n in (100, 10_000, 50_000, 250_000)] == [1, 5, 8, 8]
    assert silhouette._blocks(600_000, 64 * 600_000) == 19
    assert silhouette._blocks(10_000, 10_000 * 4000) == 10  # blocks of as many features
    for name, size in (("STRIP", 7), ("TILE", 10), ("PARTS", 2)):
        monkeypatch.setattr(silhouette, name, size)
    rng = np.random.default_rng(3)
    x, labels = rng.normal(size=(83, 5)), rng.integers(0, 3, 83)
    assert kmeans.silhouettes(frame(spark, x, labels), ["label"])["label"] == pytest.approx(plain_silhouette(x, labels), abs=1e-9)


def test_shortest_tree_drops_links_between_the_same_parts(spark, monkeypatch):
    """A round hands on one link per pair of parts; the tree is that of the plain method, ties included."""
    written, sizes = graph.materialized, []

    def counted(df):
        out = written(df)
        if out.columns == ["a", "b", "length", "pa", "pb"]:
            sizes.append((out.count(), out.selectExpr("least(pa, pb)", "greatest(pa, pb)").distinct().count()))
        return out

    monkeypatch.setattr(graph, "materialized", counted)
    rng = np.random.default_rng(9)
    links = sorted({(int(min(x)), int(max(x)), float(rng.integers(1, 9))) for x in rng.integers(0, 60, (900, 2)) if x[0] != x[1]})
    links = sorted({(a, b): (a, b, w) for a, b, w in links}.values())
    root, want = list(range(60)), []
    for w, a, b in sorted((w, a, b) for a, b, w in links):
        if root[a] != root[b]:
            root = [root[b] if r == root[a] else r for r in root]
            want.append((a, b, w))
    got = graph.shortest_links(spark.createDataFrame(links, "a long, b long, length double")).collect()
    assert sorted(tuple(r) for r in got) == sorted(want)
    assert all(rows == pairs for rows, pairs in sizes)
