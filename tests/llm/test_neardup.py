"""Near-duplicate documents against all pairs, and components against a plain union-find."""

from __future__ import annotations

import random

import numpy as np
import pytest

from medley.llm import components as parts, minhash
from medley.llm.components import components


def word_set(text):
    words = (text or "").encode().lower().split()
    if not words:
        return frozenset()
    return frozenset(zip(*(words[i:] for i in range(5)))) if len(words) >= 5 else frozenset([tuple(words)])


def roots_of(vertices, links):
    root = {v: v for v in vertices}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for a, b in links:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {v: find(v) for v in vertices}


def plain(rows, percent):
    sets = [(i if i is not None else -(2**63), word_set(t)) for i, t in rows]
    distinct = {}
    for i, s in sets:
        distinct.setdefault(s, []).append(i)
    links = [(ids[0], i) for s, ids in distinct.items() if s for i in ids]
    some = [s for s in distinct if s]
    for x in range(len(some)):
        for y in range(x):
            common = len(some[x] & some[y])
            if 100 * common >= percent * (len(some[x]) + len(some[y]) - common):
                links.append((distinct[some[x]][0], distinct[some[y]][0]))
    root = roots_of({i for i, _ in sets}, links)
    shown = lambda i: None if i == -(2**63) else i
    return sorted(((shown(i), len(s), shown(root[i]), root[i] == i) for i, s in sets), key=str)


def got(df):
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in df.collect()), key=str)


def near(seed):
    """Chains and hubs of edited copies, short texts, unrelated texts."""
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = []
    for group in range(6):
        base = [r.choice(vocabulary) for _ in range(r.choice((6, 12, 60, 200)))]
        for _ in range(r.randint(1, 14)):
            words = list(base)
            for _ in range(max(1, len(words) * r.choice((0, 1, 2, 3)) // 200)):
                words[r.randrange(len(words))] = r.choice(vocabulary)
            if r.random() < 0.3:
                base = words  # a chain
            rows.append(" ".join(words).upper() if r.random() < 0.1 else " ".join(words))
    rows += ["", "  ", "one two", "One  two", "three"]
    r.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize(("seed", "percent"), [(1, 80), (2, 85), (3, 80)])
def test_equal_to_all_pairs(docs, seed, percent):
    rows = near(seed)
    assert got(minhash.near_duplicates(docs(rows), percent)) == plain(rows, percent)


def test_edge_rows_and_samples(docs, edge_rows, sample):
    rows = edge_rows + [(None, "a null id"), (4, sample[3][1])] + [(i + 100, t) for i, t in sample]
    assert got(minhash.near_duplicates(docs(rows), 85)) == plain(rows, 85)
    assert minhash.near_duplicates(docs([])).count() == 0
    kept = minhash.deduplicated(docs(rows), 85)
    assert kept.columns == docs(rows).columns
    want = {i for i, _, _, k in plain(rows, 85) if k}
    assert {r["doc_id"] for r in kept.collect()} == want


def test_signatures_estimate_similarity():
    r = np.random.default_rng(1)
    a = r.integers(0, 2**64, 300, dtype=np.uint64)
    for share in (0.5, 0.8, 0.95):
        same = int(300 * 2 * share / (1 + share))
        b = np.concatenate([a[:same], r.integers(0, 2**64, 300 - same, dtype=np.uint64)])
        s = minhash.signatures([np.unique(a), np.unique(b), np.unique(a)[:1]], 2000)
        assert abs((s[0] == s[1]).mean() - share) < 0.08
        assert len(set(s[2].tolist())) == 1


def test_components(spark, docs):
    r = random.Random(9)
    docs([])
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 180)] + [(r.randint(200, 260), r.randint(200, 260)) for _ in range(50)]
    want = roots_of({v for a, b in links if a != b for v in (a, b)}, [x for x in links if x[0] != x[1]])
    frame = spark.createDataFrame(links + links[:9], "a long, b long").repartition(3)
    assert {x["v"]: x["root"] for x in components(frame).collect()} == want
    assert components(frame.where("a < 0")).count() == 0


def test_very_long_near_copies(docs):
    """Rows stay small for long texts: near copies of 200,000 words among copies of a part of them."""
    r = random.Random(12)
    words = [f"w{r.randrange(30_000)}" for _ in range(200_000)]
    other = list(words)
    for at in range(0, len(other), 400):
        other[at] = "changed"
    half = words[:100_000] + [f"v{r.randrange(30_000)}" for _ in range(100_000)]
    rows = [(1, " ".join(words)), (2, " ".join(other)), (3, " ".join(half)), (4, " ".join(words[:100_000])), (5, " ".join(words[1000:]))]
    rows = rows + [(10 + i, " ".join(words[i * 7 : i * 7 + 300])) for i in range(40)]
    assert got(minhash.near_duplicates(docs(rows), percent=85)) == plain(rows, 85)


def test_small_link_tables_take_few_tasks(spark, monkeypatch, docs):
    """A small table is written by a few tasks whatever the shuffle's partitions, and rounds end with the first stars."""
    docs([(1, "one")])  # sets the shared folder
    files = []

    def counted(df, *bounds):
        out = written(df, *bounds)
        files.append(len(out.inputFiles()))
        return out

    conf = {"spark.sql.shuffle.partitions": "211", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {c: spark.conf.get(c) for c in conf}
    written = parts.written
    monkeypatch.setattr(parts, "written", counted)
    try:
        for c, value in conf.items():
            spark.conf.set(c, value)
        chains = spark.createDataFrame([(i + j, i + j + 1) for i in range(0, 6000, 6) for j in range(3)], "a long, b long")
        got = {x["v"]: x["root"] for x in components(chains).collect()}
        assert got == {i + j: i for i in range(0, 6000, 6) for j in range(4)}
        assert max(files[1:]) <= 2 * spark.sparkContext.defaultParallelism
        files.clear()
        stars = spark.createDataFrame([(i, i + j) for i in range(0, 6000, 6) for j in (1, 2)], "a long, b long")
        assert components(stars).count() == 3000 and len(files) == 1
    finally:
        for c, value in before.items():
            spark.conf.set(c, value)
