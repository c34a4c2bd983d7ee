from __future__ import annotations

import random

import pytest

from medley.operators import match

TEXTS = "title string, artist string, album string"


def plain_hits(queries, items):
    """First item by pos for every query: field by field, then any field."""
    words = lambda *texts: {w for t in texts for w in (t or "").split()}
    out = {}
    for i, *asked in queries:
        out[i] = (None, None)
        if not words(asked[0]):
            continue
        tests = (
            ("fields", lambda held: all(words(a) <= words(h) for a, h in zip(asked, held))),
            ("words", lambda held: words(*asked[:2]) <= words(*held)),
        )
        for name, holds in tests:
            hit = next((key for _, key, *held in sorted(items) if holds(held)), None)
            if hit is not None:
                out[i] = (hit, name)
                break
    return out


@pytest.mark.parametrize("short", [0, 3, 4096])
def test_blocks_give_the_first_hit(spark, monkeypatch, short):
    monkeypatch.setattr(match, "SHORT", short)
    rng = random.Random(11)
    some = lambda n: " ".join(rng.choices(["the", "love", "you", "night", "blue", "x"], [20, 10, 8, 4, 2, 1], k=rng.randint(0, n)))
    items = [(p, f"id{p}", some(5), some(3), rng.choice([None, "", some(2)])) for p in rng.sample(range(-500, 10**6), 300)]
    queries = [(i, some(4), some(2), rng.choice([None, some(1)])) for i in range(60)] + [(60, "the", None, None), (61, "nowhere", "the", ""), (62, None, "the", None)]
    got = match.match_text(spark.createDataFrame(queries, f"query_id long, {TEXTS}"), spark.createDataFrame(items, f"pos long, spotify_id string, {TEXTS}"))
    found = {r.query_id: (r.spotify_id, r.matched_by) for r in got.collect()}
    assert found == plain_hits(queries, items)
