"""Repeated passages against a dictionary of all windows."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest

from medley.llm import suffixes


def plain(rows):
    """Results of all rows, by brute force over every window; equal rows are one document."""
    docs = sorted({(-1 if i is None else i, t or "") for i, t in rows})
    first: dict[bytes, tuple] = {}
    out = {}
    for d in docs:
        data = d[1].encode()
        gone = np.zeros(len(data), bool)
        for s in range(len(data) - suffixes.LENGTH + 1):
            if first.setdefault(data[s : s + suffixes.LENGTH], (d, s)) != (d, s):
                gone[s : s + suffixes.LENGTH] = True
        runs = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
        kept = bytes(np.frombuffer(data, np.uint8)[~gone])
        out[d] = (len(data), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest())
    return sorted((str(i), *out[-1 if i is None else i, t or ""]) for i, t in rows)


def made(seed, n=60):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randint(1, 9)))
    passages = [" ".join(word() for _ in range(r.randint(15, 60))) for _ in range(6)]
    rows = []
    for i in range(n):
        parts = []
        for _ in range(r.randint(0, 5)):
            if r.random() < 0.5:
                p = r.choice(passages)
                a = r.randint(0, len(p) // 2)
                parts.append(p[a : a + r.randint(40, 300)])
            else:
                parts.append(" ".join(word() for _ in range(r.randint(1, 40))))
        rows.append((i, " ".join(parts)))
    rows += [(n + 1, rows[5][1]), (n + 2, rows[5][1]), (n + 3, "x" * 700), (n + 4, "ab" * 300), (n + 5, "x" * 99), (n + 6, "x" * 100)]
    rows.append((n + 7, rows[3][1] + rows[3][1]))
    return rows


def result(df):
    return sorted((str(r["doc_id"]), r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in df.collect())


@pytest.mark.parametrize(("seed", "hot"), [(1, suffixes.HOT), (1, 1), (2, 3)])
def test_equal_to_brute_force(docs, seed, hot, monkeypatch):
    rows = made(seed)
    assert result(suffixes.deduplicated(docs(rows, 4), hot=hot)) == plain(rows)


def test_edge_rows_and_samples(docs, edge_rows, sample):
    short = [(i, t[:3000] if t and len(t) > 100_000 else t) for i, t in edge_rows]
    rows = short + [(1, None), (7, short[9][1])] + [(i + 100, t) for i, t in sample[:40]]
    rows += [(900, sample[1][1]), (900, sample[2][1]), (900, sample[2][1]), (None, sample[3][1])]
    got = result(suffixes.deduplicated(docs(rows)))
    # Rows sharing an id are ordered by a hash of their text, so the plain order need not be the same among them.
    want = plain(rows)
    assert [x for x in got if x[0] != "900"] == [x for x in want if x[0] != "900"] and len(got) == len(want)
    assert suffixes.deduplicated(docs([])).count() == 0


@pytest.mark.parametrize(("partitions", "hot"), [(1, suffixes.HOT), (4, suffixes.HOT), (1, 1)])
def test_long_equal_rows_are_one_document(docs, sample, partitions, hot):
    long = [t for _, t in sample if t and 1000 < len(t) < 20_000][:4]
    rows = [(None, long[0]), (None, long[0]), (900, long[1]), (900, long[1]), (900, long[1]), (901, "new " + long[1][200:600] + " end"), (5, long[2])]
    rows += [(902, long[3] + " " + long[3]), (902, long[3] + " " + long[3])]
    assert result(suffixes.deduplicated(docs(rows, partitions), hot=hot)) == plain(rows)


def test_segments_of_long_texts(monkeypatch):
    r = random.Random(4)
    texts = ["".join(r.choice("ab ") for _ in range(5000)).encode(), b"", b"q" * 400, ("lead " * 30).encode()]
    whole = suffixes.sampled(texts)
    monkeypatch.setattr(suffixes, "SEGMENT", 137)
    parts = suffixes.sampled(texts)
    assert all((a == b).all() for a, b in zip(whole, parts))
    covered = {(int(d), int(p)) for d, p in zip(whole[0], whole[1])}
    for d, t in enumerate(texts):  # every window holds a kept suffix
        for s in range(len(t) - suffixes.LENGTH + 1):
            assert any((d, p) in covered for p in range(s, s + suffixes.REACH + 1))


def test_multikey_order():
    r = np.random.default_rng(1)
    keys = r.integers(0, 3, (500, 5)).astype(np.uint64)
    order = suffixes.multikey_order(keys)
    assert [tuple(x) for x in keys[order]] == sorted(tuple(x) for x in keys)


def test_zero_bytes_are_not_padding():
    body = bytes(range(1, 61))
    suffixes_ = [body + b"\0" * 40, body, body + b"\0" * 40, body + b"\0" * 20]
    at, start, end = suffixes.repeated_spans(suffixes_, [b""] * 4, np.zeros(4, np.int64))
    assert list(zip(at, start, end)) == [(2, 0, 100)]


def test_kept_bytes(docs):
    letters = random.Random(8)
    p = "".join(letters.choice("abcdefgh ") for _ in range(180))
    got = {r["doc_id"]: r["kept"] for r in suffixes.deduplicated(docs([(1, p), (2, "new " + p + " end")]), with_kept=True).collect()}
    assert got[1] == p.encode() and got[2].startswith(b"new") and got[2].endswith(b"end") and len(got[2]) < 12
