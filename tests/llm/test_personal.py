"""Fixed patterns against the plain expressions; the field against held-out sentences and exhaustive decoding."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import time

import numpy as np

from medley.llm import personal as P


def plain(text):
    digits = lambda s: re.sub("[^0-9]", "", s)
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append(("email", *m.span()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m.group().split(".")):
            out.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = digits(m.group())
        if 16 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(d[::-1])) % 10 == 0:
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 8 <= len(digits(m.group())) <= 15:
            out.append(("phone", *m.span()))
    return out


def made(r):
    parts = ["a@b.c", "x.y@", "@", "1.2.3.4", "256.1.1.1", "0001.2.3.4", "4111111111111111", "4111 1111 1111 1111", "4111-1111 1111-1111", "1234567890123456", "+1 (222) 333-4444", "+1", "+", ".", "-", " ", "7", "é", "a@b-c.d-e.f.", "%", "\n", "(", "12"]
    return "".join(r.choice(parts) for _ in range(r.randint(0, 14)))


def test_base_spans_equal_plain_patterns(sample):
    r = random.Random(2)
    for text in [made(r) for _ in range(6000)] + [t for _, t in sample]:
        assert P.base_spans(text) == plain(text), text


def test_patterns_stay_linear():
    start = time.time()
    for text in ("x" * 400_000 + "@", "1" * 400_000, "1." * 200_000, "+1 " * 100_000 + "x", "a@" * 200_000, "1 " * 200_000, "+1" + "(" * 300_000):
        P.base_spans(text)
    assert time.time() - start < 20


def test_field_on_held_out_sentences():
    field = P._field(P.fitted())
    right = total = wrong = 0
    for s in P.labelled_table(150, seed=1234):
        tags = dict(field.tag([" ".join(w for w, _ in s).encode()])[0])
        for i, (_, y) in enumerate(s):
            got = P.LABELS[tags.get(i, 0)]
            total += y != "O"
            right += y != "O" and got == y
            wrong += y == "O" and got != "O"
    assert right >= 0.95 * total and wrong <= 0.02 * total


def test_viterbi_equals_exhaustive_search():
    r = np.random.default_rng(3)
    k = len(P.LABELS)
    field = P.Field([], np.zeros((0, k)), r.normal(size=(k, k)) * 2)
    runs = [r.normal(size=(n, k)) * 2 for n in (1, 2, 3, 3, 4, 1)]
    for run, got in zip(runs, field.viterbi(runs)):
        value = lambda y: sum(run[i, a] for i, a in enumerate(y)) + sum(field.t[a, b] for a, b in zip((0, *y), (*y, 0)))  # noqa: B023, E731
        best = max(itertools.product(range(k), repeat=len(run)), key=value)
        assert tuple(got.tolist()) == best


def test_gradient_is_that_of_the_likelihood():
    """Expected counts equal the derivative of log Z."""
    r = np.random.default_rng(4)
    k = len(P.LABELS)
    field = P.Field([], np.zeros((0, k)), r.normal(size=(k, k)))
    e, length = r.normal(size=(2, 3, k)), np.array([3, 2])
    inside = np.arange(3)[None, :] < length[:, None]

    def log_z():
        total = 0.0
        for row, n in zip(e, length):
            paths = itertools.product(range(k), repeat=int(n))
            total += np.log(sum(np.exp(sum(row[i, a] for i, a in enumerate(y)) + sum(field.t[a, b] for a, b in zip((0, *y), (*y, 0)))) for y in paths))
        return total

    node, edge = field._expected(e, inside, length)
    before = log_z()
    for a, b in ((0, 0), (0, 3), (2, 5), (4, 0)):
        field.t[a, b] += 1e-5
        assert abs((log_z() - before) / 1e-5 - edge[a, b]) < 1e-3
        field.t[a, b] -= 1e-5
    e[1, 1, 4] += 1e-5
    assert abs((log_z() - before) / 1e-5 - node[1, 1, 4]) < 1e-3


def test_query_columns_on_edge_rows(docs, edge_rows, sample):
    rows = edge_rows + sample[:80] + [(800, "call (222) 333-4444 now and mail joe[at]work.com please"), (801, "version 2.0 of 2021 costs 300")]
    got = P.found(docs(rows)).collect()
    want = sorted((str(i), hashlib.sha256(P.spelled(plain(t or "")).encode()).hexdigest()) for i, t in rows)
    assert sorted((str(r["doc_id"]), r["base_sha256"]) for r in got) == want
    spans = {r["doc_id"]: r["spans"] for r in got}
    assert spans[800] == "email:33:48,phone:5:19" and spans[801] == ""
    assert P.found(docs([])).count() == 0


def test_masked_keeps_rows_and_columns(docs, edge_rows):
    rows = edge_rows + [(50, "mail a.b@c.de or +1 (222) 333-4444, host 1.2.3.4.")]
    out = P.masked(docs(rows))
    got = out.collect()
    assert out.columns == docs(rows).columns and len(got) == len(rows)
    text = next(r for r in got if r["doc_id"] == 50)
    assert text["text"] == "mail <email> or <phone>, host <ip>." and text["n_chars"] == len(text["text"])
    assert {r["text"] for r in got if r["doc_id"] == 1} == {None}
    assert P.masked(docs([])).count() == 0
