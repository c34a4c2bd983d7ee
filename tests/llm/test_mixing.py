"""N-gram scores and mixing rates against plain versions."""

from __future__ import annotations

import math
from collections import Counter

import pytest

from medley.llm import mixing, ngrams


def plain_scores(rows, backoff=0.4, least=2):
    texts = [(t or "").encode().lower().split() for _, t in rows]
    grams = [list(zip(*((["<", "<"] + t)[i:] for i in range(3)))) for t in texts]
    c3 = Counter(g for d in grams for g in d)
    c2, c1, x3, x2 = Counter(), Counter(), Counter(), Counter()
    for (a, b, c), n in c3.items():
        c2[b, c] += n
        c1[c] += n
        x3[a, b] += n
        x2[b] += n
    total = sum(c1.values())

    def score(g):
        a, b, c = g
        if c3[g] >= least:
            return math.log(c3[g] / x3[a, b])
        if c2[b, c] >= least:
            return math.log(backoff) + math.log(c2[b, c] / x2[b])
        return 2 * math.log(backoff) + math.log(c1[c] / total)

    return [(i, len(d), sum(map(score, d))) for (i, _), d in zip(rows, grams)]


def test_scores_equal_plain_version(docs, edge_rows, sample):
    rows = edge_rows + sample[:60] + [(900, "The cat"), (901, "the cat sat")]
    got = sorted(((str(r["doc_id"]), r["n_words"], r["log_score"], r["mean_score"]) for r in ngrams.scored(docs(rows)).collect()), key=lambda x: x[:2])
    want = sorted(((str(i), n, s) for i, n, s in plain_scores(rows)), key=lambda x: x[:2])
    for g, w in zip(got, want):
        assert g[:2] == w[:2] and math.isclose(g[2], w[2], rel_tol=1e-9, abs_tol=1e-9)
        assert (g[3] is None) == (w[1] == 0)
    assert len(got) == len(want) and ngrams.scored(docs([])).count() == 0


def test_scores_over_many_ranges_and_batches(docs, sample, monkeypatch):
    """Counts come from many ranges of codes and meet several batches, one of them without a word."""
    rows = sample[:80] + [(2000 + i, x) for i, x in enumerate([None, "", " \n", "the", "the the the the"])] + sample[:5]
    monkeypatch.setattr(ngrams, "RANGE", 50)
    got = sorted((str(r["doc_id"]), r["n_words"], round(r["log_score"], 6)) for r in ngrams.scored(docs(rows).repartition(6)).collect())
    assert got == sorted((str(i), n, round(s, 6)) for i, n, s in plain_scores(rows))


def test_default_keeps_every_word(docs, edge_rows):
    """More distinct words than any small vocabulary holds: rare trigrams are counted, unknown ones stay apart."""
    rare = [(i + 100, f"rare{i} pair{i} word{i} " * 2 + f"once{i} in{i} text{i}") for i in range(1000)]
    rows = edge_rows + rare + [(5000, "rare7 pair7 word7"), (5001, "never seen before")]
    got = sorted(((str(r["doc_id"]), r["n_words"], r["log_score"]) for r in ngrams.scored(docs(rows)).collect()), key=lambda x: (x[0], x[1], x[2]))
    want = sorted(((str(i), n, s) for i, n, s in plain_scores(rows)), key=lambda x: (x[0], x[1], x[2]))
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert all(math.isclose(g[2], w[2], rel_tol=1e-9, abs_tol=1e-9) for g, w in zip(got, want))


def posterior_rows(n=400):
    import random

    r = random.Random(6)
    rows = []
    for i in range(n):
        p = [r.random() ** 3 for _ in range(3)]
        rows.append((i, i, 0.5, r.randint(0, 500), *(x / sum(p) for x in p)))
    return rows


def test_rates_meet_reachable_targets(spark, docs):
    docs([])
    rows = posterior_rows()
    frame = spark.createDataFrame(rows, "rid long, id long, u double, n long, p0 double, p1 double, p2 double")
    for targets, budget in (({"a": 0.5, "b": 0.3, "c": 0.2}, None), ({"a": 0.6, "b": 0.2, "c": 0.2}, 50_000.0)):
        got = mixing.fitted_rates(frame, targets, budget, rounds=400).collect()
        totals = [sum(r["rate"] * r["n"] * r[f"p{d}"] for r in got) for d in range(3)]
        size = budget or sum(r[3] * r[4] for r in rows) / 0.5
        assert all(r["rate"] >= 0 for r in got)
        for t, share in zip(totals, targets.values()):
            assert abs(t - share * size) <= 2e-3 * size


def plain_rates(rows, goals, rounds):
    rate = [1.0] * len(rows)
    total = lambda: [sum(x * r[3] * r[4 + d] for x, r in zip(rate, rows)) for d in range(3)]
    start = total()
    for _ in range(rounds):
        g = [(t - goal) / s for t, goal, s in zip(total(), goals, start)]
        if max(map(abs, g)) <= mixing.TOLERANCE:
            break
        rate = [max(0.0, x - sum(p * y for p, y in zip(r[4:], g))) for x, r in zip(rate, rows)]
    return rate


def test_rates_equal_plain_descent(spark, docs):
    docs([])
    rows = posterior_rows(120)
    frame = spark.createDataFrame(rows, "rid long, id long, u double, n long, p0 double, p1 double, p2 double")
    total = sum(r[3] for r in rows)
    want = plain_rates(rows, [0.9 * total, 0.0, 0.1 * total], 20)
    got = {r["rid"]: r["rate"] for r in mixing.fitted_rates(frame, {"a": 0.9, "b": 0.0, "c": 0.1}, float(total), rounds=20).collect()}
    assert all(math.isclose(got[i], w, abs_tol=1e-9) for i, w in enumerate(want)) and min(want) == 0.0


def test_posteriors_on_held_out_documents(spark, docs):
    from medley.llm.queries import MIX, domain_labels

    sf = "/root/testdata/sf0.1"
    docs([])
    labels = domain_labels(spark, sf)
    half = labels.where("doc_id % 2 = 0")
    out = mixing.rates(spark.read.parquet(f"{sf}/documents.parquet"), half, MIX)
    rest = out.join(labels.where("doc_id % 2 = 1"), "doc_id").collect()
    right = sum(max(("clean", "junk", "toxic"), key=lambda d: r[f"p_{d}"]) == r["domain"] for r in rest)
    assert right >= 0.9 * len(rest)
    clean = [r["copies"] >= 1 for r in rest if r["domain"] == "clean"]
    assert sum(clean) >= 0.97 * len(clean)
    rows = out.collect()
    for r in rows:
        assert math.isclose(r["p_clean"] + r["p_junk"] + r["p_toxic"], 1.0, abs_tol=1e-9) and r["copies"] in (math.floor(r["rate"]), math.floor(r["rate"]) + 1)
    kept = [r["copies"] >= 1 for r in rows if r["p_clean"] > 0.99]
    assert sum(kept) >= 0.99 * len(kept)


def test_mixing_edge_rows(spark, docs, edge_rows, sample):
    from pyspark.sql import functions as F

    rows = edge_rows + [(i + 100, t) for i, t in sample[:40]]
    labels = spark.createDataFrame([(i + 100, "b" if i % 3 else "a") for i, _ in sample[:30]] + [(100, "a"), (None, "a"), (1, None), (99999, "b"), (2, "other")], "doc_id long, domain string")
    table = docs(rows).withColumn("copies", F.lit(7)).withColumn("u", F.lit("x")).withColumn("id", F.lit(1)).withColumn("row", F.lit(2))
    out = mixing.mixed(table, labels, {"a": 0.5, "b": 0.5}, budget=10_000.0)
    assert out.columns == table.columns
    counts = Counter((r["doc_id"], r["text"]) for r in out.collect())
    want = Counter()
    for r in mixing.rates(table, labels, {"a": 0.5, "b": 0.5}, budget=10_000.0).collect():
        want[r["doc_id"]] += r["copies"]
    by_id = Counter()
    for (i, _), n in counts.items():
        by_id[i] += n
    assert by_id == +want
    assert mixing.rates(docs([]), labels, {"a": 1.0}).count() == 0
    alike = mixing.rates(docs(rows), labels.where("false"), {"a": 0.5, "b": 0.5}).collect()
    assert len(alike) == len(rows) and all(r["p_a"] == 0.5 for r in alike)
