"""Ranked search against scores of all documents by plain integers."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from medley.llm import impacts

_term = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
_low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return _term.findall((text or "").translate(_low))


def plain(rows, items, top=20):
    docs = [(-(2**63) if i is None else i, Counter(terms(t))) for i, t in rows]
    docs = [(i, c, c.total()) for i, c in docs if c]
    n_docs, n_words = len(docs), sum(n for _, _, n in docs)
    df = Counter(t for _, c, _ in docs for t in c)
    out = []
    for item, text in items:
        found = []
        for i, c, n in docs:
            m = 100 - 25 + (25 * n * n_docs) // n_words
            s = sum(r * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 12 * m)) for t, r in Counter(terms(text)).items() if t in c)
            if s > 0:
                found.append((-s, i))
        out += [(item, r, None if i == -(2**63) else i, -s) for r, (s, i) in enumerate(sorted(found)[:top], 1)]
    return sorted(out, key=str)


def got(spark, docs, rows, items, **more):
    asked = spark.createDataFrame([(i, t, "x", 0, 1) for i, t in items], "item_id long, text string, q string, term long, doc_id long")
    found = impacts.ranked(docs(rows), asked, **more)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted(map(tuple, found.collect()), key=str)


def corpus(seed, n=400):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(120)] + ["Über", "naïve", "中文", "X1", "x1"]
    weights = [1 / (i + 1) for i in range(len(words))]
    made = lambda most: r.choice([" ", ", ", "-"]).join(r.choices(words, weights, k=r.randrange(most)))
    rows = [(i, made(60)) for i in range(n)]
    rows += [(n + i, rows[3][1]) for i in range(60)] + [(2 * n, "W1 " * 40_000), (2 * n + 1, " -- "), (2 * n + 1, "w5 w7 w9"), (2 * n + 1, "w5 w7 w9")]
    items = [(i, made(40)) for i in range(20)] + [(100, rows[3][1]), (101, None), (102, ""), (103, "unknown"), (1, "w90 w91"), (None, "中文 w80")]
    return rows, items


@pytest.mark.parametrize(("seed", "sizes"), [(1, {}), (2, {"DOCS": 50, "QUERIES": 4}), (3, {"SHORT": 1, "TOGETHER": 1}), (4, {"HELD_TERMS": 0, "POSTINGS": 500})])
def test_equal_to_all_scores(spark, docs, monkeypatch, edge_rows, seed, sizes):
    for name, value in sizes.items():
        monkeypatch.setattr(impacts, name, value)
    rows, items = corpus(seed)
    rows += [(1000 + i if i is not None else None, t) for i, t in edge_rows]
    assert got(spark, docs, rows, items) == plain(rows, items)


def test_empty_tables(spark, docs):
    assert got(spark, docs, [], [(1, "a")]) == []
    assert got(spark, docs, [(1, "a b")], []) == []
    assert got(spark, docs, [(1, None), (2, "")], [(1, "a")]) == []


def test_greatest_of_intervals():
    r = np.random.default_rng(2)
    places = np.flatnonzero(r.random(300) < 0.4)
    impacts_ = r.integers(1, 50, len(places))
    p = impacts.Postings(places, impacts_)
    low = r.integers(0, 300, 500)
    high = np.minimum(low + r.integers(0, 120, 500), 300)
    value, at = p.greatest(low, high)
    for x, y, v, a in zip(low, high, value, at):
        inside = (places >= x) & (places < y)
        assert v == impacts_[inside].max(initial=0)
        assert v == 0 or (x <= a < y and impacts_[places == a][0] == v)


def test_few_documents_are_scored():
    """The bounds spare most documents of a query with a few strong ones."""
    r = np.random.default_rng(4)
    size, lists = 20_000, []
    for share, most in ((0.5, 30), (0.5, 30), (0.002, 900), (0.002, 900)):
        places = np.flatnonzero(r.random(size) < share)
        lists.append((impacts.Postings(places, r.integers(most // 2, most, len(places))), 1))
    seen = []
    of = impacts.Postings.of
    try:
        impacts.Postings.of = lambda self, p: seen.append(len(p)) or of(self, p)
        at, score = impacts.best_places(lists, size, 20)
    finally:
        impacts.Postings.of = of
    every = sum(p.of(np.arange(size)) for p, _ in lists)
    assert score.tolist() == sorted(every.tolist(), reverse=True)[:20]
    assert sum(seen) / len(lists) < size / 4
