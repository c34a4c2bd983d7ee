"""Hard negatives against plain integer arithmetic."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from medley.llm import residues

SCHEMA = "vec_id long, embedding array<double>, label int, anchor string, score long, c string"


def plain(rows, positives=5, negatives=10):
    """Rows of the contract by loops over Python integers."""
    use = []
    for i, e, label in rows:
        if label is None or not e or None in e or not np.isfinite(np.array(e)).all():
            continue
        c = [int(x) for x in np.floor(256.0 * np.array(e))]
        if sum(x * x for x in c) < 2**62:
            use.append((-(2**63) if i is None else i, c, label, i is not None and i % 3 == 0))
    out = []
    for a, (i, c, label, anchor) in enumerate(use):
        if not anchor:
            continue
        scored = [(-sum(x * y for x, y in zip(c, o[1])), o[0], o[2]) for b, o in enumerate(use) if b != a and len(o[1]) == len(c)]
        for s, p in sorted((s, o) for s, o, k in scored if k == label)[:positives]:
            fit = sorted((n, o) for n, o, k in scored if k != label and 30 * -s <= 100 * -n <= 90 * -s)[:negatives]
            out += [(i, p, r, o, -s, -n) for r, (n, o) in enumerate(fit, 1)]
    null = lambda x: None if x == -(2**63) else x
    return sorted(((null(a), null(p), r, null(o), s, n) for a, p, r, o, s, n in out), key=str)


def got(spark, docs, rows):
    docs([])  # sets the shared folder
    frame = spark.createDataFrame([(i, e, label, "x", 1, "y") for i, e, label in rows], SCHEMA).repartition(3)
    found = residues.hard_negatives(frame, F.col("vec_id") % 3 == 0)
    assert found.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(map(tuple, found.collect()), key=str)


@pytest.mark.parametrize("top", [5, 500, 10**5, 2**31 - 1])
def test_exact_scores(top):
    r = np.random.default_rng(top)
    d = 200 if top < 2**20 else 1
    a, b = r.integers(-top, top + 1, (30, d)), r.integers(-top, top + 1, (40, d))
    want = [[sum(int(x) * int(y) for x, y in zip(p, q)) for q in b] for p in a]
    assert (residues.scores(a.astype(np.int32), b.astype(np.int32)) == np.array(want, object)).all()


def test_float32_products_are_exact():
    p = next(residues.primes())
    assert residues.CHUNK * ((p - 1) // 2) ** 2 < 2**24


@pytest.mark.parametrize("blocks", [(4096, 1024), (17, 8)])
def test_equal_to_loops(spark, docs, monkeypatch, blocks):
    monkeypatch.setattr(residues, "ROWS", blocks[0])
    monkeypatch.setattr(residues, "ANCHORS", blocks[1])
    r = np.random.default_rng(3)
    rows = [(i, (r.integers(-3, 4, 8) / 16).tolist(), int(r.integers(0, 4))) for i in range(150)]
    rows += [(200, None, 1), (201, [], 1), (202, [None] * 8, 1), (203, [float("nan")] * 8, 1), (204, [1.0] * 8, None), (207, [float("inf")] * 8, 2)]
    rows += [(3, rows[3][1], rows[3][2]), (3, rows[3][1], rows[3][2]), (None, rows[6][1], 1), (210, [0.5] * 3, 0), (213, [0.4] * 3, 0), (214, [0.3] * 3, 1)]
    rows += [(216, [1e30] * 8, 1), (219, [1e5] * 8, 2), (222, [2e5] * 8, 2), (223, [5e4] * 8, 3)]
    assert got(spark, docs, rows) == plain(rows)


def test_one_label_ties_and_no_rows(spark, docs):
    assert got(spark, docs, []) == []
    same = [(i, [0.5, 0.25], 1) for i in range(20)]
    assert got(spark, docs, same) == []
    mixed = same + [(i, [0.25, 0.125], 2) for i in range(20, 60)]
    found = got(spark, docs, mixed)
    assert found == plain(mixed) and {x[3] for x in found if x[0] == 0} == set(range(20, 30))
