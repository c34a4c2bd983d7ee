"""Approximate neighbours: exact on small tables, recall against brute force on larger ones."""

from __future__ import annotations

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from medley.llm import neighbours

SCHEMA = "vec_id long, embedding array<double>, label int, v string, query_id long"


def plain(rows, k=10):
    """Answers by all distances; rows that share an id and a vector are one."""
    use = {}
    for i, e in rows:
        if e and None not in e and np.isfinite(np.array(e)).all() and np.any(e):
            use[(-(2**63) if i is None else i, tuple(e))] = np.array(e, np.float64)
    out = []
    for i, e in use:
        if i % 5 == 0 and i != -(2**63):
            x = use[i, e]
            found = sorted((float(np.sqrt(((x - y) ** 2).sum())), o) for (o, f), y in use.items() if o != i and len(f) == len(e))[:k]
            out += [(i, r, None if o == -(2**63) else o, round(s, 9)) for r, (s, o) in enumerate(found, 1)]
    return sorted(out, key=str)


def got(spark, docs, rows, **more):
    docs([])  # sets the shared folder
    frame = spark.createDataFrame([(i, e, 1, "x", 2) for i, e in rows], SCHEMA).repartition(3)
    found = neighbours.nearest_rows(frame, F.col("vec_id") % 5 == 0, **more)
    assert found.columns == ["query_id", "rank", "vec_id", "score"]
    return sorted(((q, r, v, round(s, 9)) for q, r, v, s in found.collect()), key=str)


def test_exact_on_a_small_table(spark, docs):
    r = np.random.default_rng(1)
    rows = [(i, r.integers(-3, 4, 4).astype(float).tolist()) for i in range(120)]
    rows += [(200 + i, [9.0, 9.0, 9.0, 9.0]) for i in range(40)] + [(300 + i, [1.0, float(i)]) for i in range(6)]
    rows += [(400, None), (401, []), (402, [0.0] * 4), (405, [float("nan")] * 4), (406, [None] * 4), (407, [float("inf")] * 4), (410, [1e200, 1.0, 0.0, -0.0])]
    rows += [(5, rows[5][1]), (5, rows[5][1]), (10, rows[11][1]), (None, rows[15][1]), (420, [7.0] * 9)]
    assert got(spark, docs, rows) == plain(rows)


def test_few_and_no_candidates(spark, docs):
    assert got(spark, docs, []) == []
    assert got(spark, docs, [(5, [1.0])]) == []
    assert got(spark, docs, [(5, [1.0]), (6, [2.0]), (7, [0.5])]) == [(5, 1, 7, 0.5), (5, 2, 6, 1.0)]


def test_equal_vectors(spark, docs):
    """Answers among copies come by id, however many there are."""
    rows = [(i, [1.0, 2.0]) for i in range(3000)] + [(5000 + i, [float(i), 1.0]) for i in range(50)]
    found = got(spark, docs, rows)
    assert [x[2] for x in sorted(found) if x[0] == 2000] == list(range(10))
    assert [x[2] for x in sorted(found) if x[0] == 5] == [0, 1, 2, 3, 4, 6, 7, 8, 9, 10]
    assert len([x for x in found if x[0] == 5000]) == 10


def near_copies(n):
    r = np.random.default_rng(7)
    x = r.normal(size=(n, 24))
    x[: n // 3] = x[0] + r.normal(size=(n // 3, 24)) * 1e-3
    return x


@pytest.mark.parametrize("kind", ["table", "clusters", "near copies"])
def test_recall(spark, docs, kind):
    """Recall at 10 with production parameters, on tables that take many cells and rounds."""
    if kind == "table":
        x = np.array(pq.read_table("/root/testdata/sf0.1/embeddings.parquet")["embedding"].to_pylist(), np.float64)
    elif kind == "clusters":
        r = np.random.default_rng(6)
        x = r.normal(size=(60, 24))[r.integers(0, 60, 5000)] * 3 + r.normal(size=(5000, 24))
    else:
        x = near_copies(5000)
    found = {}
    for q, _, v, _ in got(spark, docs, list(enumerate(x.tolist()))):
        found.setdefault(q, set()).add(v)
    hits = 0
    for q in range(0, len(x), 5):
        d = ((x - x[q]) ** 2).sum(axis=1)
        d[q] = np.inf
        hits += len(found[q] & set(np.argpartition(d, 10)[:10].tolist()))
    assert hits >= 0.9 * 10 * len(range(0, len(x), 5))
