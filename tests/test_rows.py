"""Memberships, text helpers, lookups and enrichment on small rows."""

from __future__ import annotations

import json
import sys

import pytest
from pyspark.sql import functions as F

from medley.functions.arrays import ordered_union
from medley.functions.text import fold, norm_text, token_sort_similarity
from medley.operators import enrich
from medley.operators.membership import (
    explode_memberships,
    filter_groups,
    filter_membership,
    group_name_of,
    implode_memberships,
    is_selected,
    membership_integrity,
    membership_mismatches,
)
from medley.sources import lookups


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_filter_membership_keeps_matching_pairs_only(tracks):
    df = tracks(
        [
            {"spotify_id": "a", "playlist_ids": ["Work-1", "home"], "playlist_names": ["Desk", "Sofa"]},
            {"spotify_id": "b", "playlist_ids": ["home"], "playlist_names": ["Sofa"]},
            {"spotify_id": "c", "playlist_ids": ["x", "y"], "playlist_names": ["homework"]},
            {"spotify_id": "d"},
        ]
    )
    kept = {r.spotify_id: (r.playlist_ids, r.playlist_names) for r in filter_membership(df, ["WORK"]).collect()}
    assert kept == {"a": (["Work-1"], ["Desk"]), "c": (["x"], ["homework"])}
    assert filter_membership(df, None) is df
    assert {r.spotify_id for r in filter_membership(df, [""]).collect()} == {"a", "b", "c"}
    assert [r.s for r in df.orderBy("pos").select(is_selected(["sofa"]).alias("s")).collect()] == [True, True, False, False]


def test_filter_groups_by_name_or_id(spark):
    df = spark.createDataFrame([("p1", "Morning"), ("p2", "Evening"), ("morn3", "x")], "spotify_id string, name string")
    assert {r.spotify_id for r in filter_groups(df, ["MORN"]).collect()} == {"p1", "morn3"}
    assert filter_groups(df, []).count() == 3


def test_group_name_falls_back_to_the_id(tracks):
    df = tracks([{"spotify_id": "a", "playlist_ids": ["p", "q", "p"], "playlist_names": ["P"]}])
    names = df.select(*[group_name_of(F.lit(g)).alias(g) for g in ("p", "q", "z")]).first()
    assert (names.p, names.q, names.z) == ("P", "q", "z")


def test_mismatched_memberships_fail_with_id_and_lengths(tracks):
    df = tracks([{"spotify_id": "bad", "playlist_ids": ["p", "q"], "playlist_names": ["P"]}])
    assert membership_mismatches(df).collect() == [("bad", 2, 1)]
    with pytest.raises(Exception, match="Track bad has mismatched playlist metadata: 2 playlist_ids vs 1 playlist_names"):
        membership_integrity(df).collect()


def test_explode_and_implode_are_inverse_and_bounded(tracks):
    df = tracks(
        [
            {"spotify_id": "a", "playlist_ids": list("pqrst"), "playlist_names": list("PQRST")},
            {"spotify_id": "b", "playlist_ids": ["p"], "playlist_names": ["P"]},
        ]
    )
    long = explode_memberships(df)
    whole = {r.spotify_id: r.playlist_ids for r in implode_memberships(long).collect()}
    assert whole == {"a": list("pqrst"), "b": ["p"]}
    chunks = {(r.spotify_id, r.part): r.playlist_names for r in implode_memberships(long, chunk=2).collect()}
    assert chunks == {("a", 0): ["P", "Q"], ("a", 1): ["R", "S"], ("a", 2): ["T"], ("b", 0): ["P"]}


def test_folding_of_every_character(spark):
    points = [chr(i) for i in range(sys.maxunicode + 1) if not 0xD800 <= i < 0xE000]
    texts = [(i, "".join(points[i : i + 1000])) for i in range(0, len(points), 1000)]
    got = spark.createDataFrame(texts, "i long, t string").select("i", fold("t").alias("f")).collect()
    assert {r.i: r.f for r in got} == {i: t.casefold() for i, t in texts}


def test_text_helpers(spark):
    assert one(spark, norm_text(F.lit("  A  b \tC\n"))) == "a b c"
    assert one(spark, fold(F.lit("STRAßE"))) == "strasse"
    assert one(spark, token_sort_similarity(F.lit("Blue  Train"), F.lit("train BLUE"))) == 1.0
    assert one(spark, token_sort_similarity(F.lit(""), F.lit(" "))) == 1.0
    assert one(spark, token_sort_similarity(F.lit("abcd"), F.lit("abxd"))) == pytest.approx(0.75)
    assert one(spark, token_sort_similarity(F.lit("abc"), F.lit(""))) == 0.0


def test_ordered_union_keeps_existing_repeats(spark):
    a, b = F.array(*map(F.lit, ["x", "x", "y"])), F.array(*map(F.lit, ["z", "y", "z"]))
    assert one(spark, ordered_union(a, b)) == ["x", "x", "y", "z"]


def test_lookup_key_drops_blank_parts(spark):
    def key(*parts):
        return one(spark, lookups.lookup_key("svc", *[F.lit(p) for p in parts]))

    assert key(" Artist ", "ALBUM") == "svc:artist:album"
    assert key("", "x") == key("x", "") == "svc:x"
    assert key("", "") is None
    assert key("  ", "") == "svc"


@pytest.mark.parametrize(
    ("recheck", "force", "expected"),
    [
        (False, False, {"new"}),
        (True, False, {"new", "none", "open"}),
        (False, True, {"new", "none", "open", "done"}),
    ],
)
def test_pending_lookups(spark, recheck, force, expected):
    stored = spark.createDataFrame(
        [("none", "{}"), ("open", '{"exhausted": false}'), ("done", '{"exhausted": true}')], "key string, payload string"
    )
    wanted = spark.createDataFrame([(k,) for k in ("new", "new", "none", "open", "done", None)], "key string")
    got = lookups.pending_lookups(wanted, stored, recheck, force, exhausted=True).collect()
    assert {r.key for r in got} == expected and len(got) == len(expected)
    assert "open" not in {r.key for r in lookups.pending_lookups(wanted, stored, True, False).collect()}


def test_upsert_replaces_by_key(spark):
    schema = "service string, key string, payload string, version long"
    old = spark.createDataFrame([("s", "a", "1", 1), ("s", "b", "1", 1), ("t", "a", "1", 1)], schema)
    new = spark.createDataFrame([("s", "a", "{}", 2)], schema)
    got = {(r.service, r.key): r.payload for r in lookups.upsert_lookup(old, new).collect()}
    assert got == {("s", "a"): "{}", ("s", "b"): "1", ("t", "a"): "1"}


def answers(spark, service, pairs):
    rows = [(service, k, json.dumps(v), 1) for k, v in pairs.items()]
    return spark.createDataFrame(rows, "service string, key string, payload string, version long")


def test_features_overwrite_only_with_truthy_values(spark, tracks):
    df = tracks(
        [
            {"spotify_id": "hit", "tempo": 90.0, "energy": 0.5, "valence": 0.1},
            {"spotify_id": "empty", "tempo": 90.0},
            {"spotify_id": "absent", "tempo": 90.0},
            {"spotify_id": "nullish", "tempo": 90.0},
        ]
    )
    stored = answers(
        spark,
        "reccobeats",
        {
            "spotify:hit": {"content": [{"id": "x", "tempo": 120.5, "energy": 0.0}, {"tempo": 1.0}]},
            "spotify:empty": {"content": []},
            "spotify:nullish": {"content": [{}]},
        },
    )
    got = {r.spotify_id: r for r in enrich.enrich_features(df, stored).collect()}
    hit = got["hit"]
    assert (hit.tempo, hit.energy, hit.valence, hit.feature_source, hit.feature_match_confidence) == (
        120.5,
        0.5,
        0.1,
        "reccobeats",
        0.5,
    )
    for name in ("empty", "absent", "nullish"):
        row = got[name]
        assert (row.tempo, row.feature_source, row.feature_match_confidence) == (None, "unmatched", 0.0)


def test_rows_outside_the_filter_pass_unchanged(spark, tracks):
    df = tracks(
        [
            {"spotify_id": "a", "tempo": 1.0, "playlist_ids": ["in"], "playlist_names": ["In"]},
            {"spotify_id": "b", "tempo": 2.0, "playlist_ids": ["out"], "playlist_names": ["Out"]},
        ]
    )
    got = {r.spotify_id: r for r in enrich.enrich_features(df, answers(spark, "reccobeats", {"k": {}}), ["IN"]).collect()}
    assert got["a"].feature_source == "unmatched" and got["a"].tempo is None
    assert got["b"].feature_source is None and got["b"].tempo == 2.0


@pytest.mark.parametrize(
    ("level", "expected"),
    [
        ("top", ("getgenre album top", 40.0, ["t"])),
        ("best", ("getgenre album top", 40.0, ["t"])),
        ("clean", ("getgenre album clean", 40.0, ["t", "g"])),
        ("all", ("getgenre album all", 40.0, ["t", "g", "u"])),
    ],
)
def test_genre_levels(spark, level, expected):
    payload = {"top_genres": ["t"], "genres": ["g", "t", 3, "", None], "unvalidated_genres": ["u"], "analysis": {"level": 40}}
    got = enrich.extract_genres(answers(spark, "getgenre", {"k": payload}), level).first()
    assert (got.source, got.confidence, got.genres) == expected


def test_genre_tiers_fall_through_to_artists(spark):
    payloads = {
        "validated": {"top_genres": [], "genres": ["g"], "unvalidated_genres": ["u"]},
        "unvalidated": {"unvalidated_genres": ["u"]},
        "artists": {
            "genres": "not a list",
            "album_artists": [{"genres": ["a", "b"], "analysis": {"level": 30}}, {"genres": ["b", "c"]}],
        },
        "nothing": {},
    }
    got = {r.key: r for r in enrich.extract_genres(answers(spark, "getgenre", payloads), "best").collect()}
    assert got["validated"].source == "getgenre album validated"
    assert got["unvalidated"].genres == ["u"]
    assert (got["artists"].source, got["artists"].confidence, got["artists"].genres) == (
        "getgenre artist validated",
        15.0,
        ["a", "b", "c"],
    )
    assert got["nothing"].source is None and got["nothing"].genres == []
    with pytest.raises(ValueError, match="level"):
        enrich.extract_genres(answers(spark, "getgenre", payloads), "most")


def test_genres_second_lookup_and_stale_clearing(spark, tracks):
    df = tracks(
        [
            {"spotify_id": "both", "artist": "Ann", "album": "One", "genres": ["old"]},
            {"spotify_id": "solo", "artist": "Bob", "album": "Two", "genres": ["old"]},
            {"spotify_id": "none", "artist": "Cy", "album": "Three", "genres": ["old"]},
            {"spotify_id": "no album", "artist": "Dee", "album": ""},
        ]
    )
    stored = answers(
        spark,
        "getgenre",
        {
            "getgenre:ann:one": {"genres": ["x"], "analysis": {"level": 80}},
            "getgenre:ann": {"genres": ["wrong"]},
            "getgenre:bob:two": {},
            "getgenre:bob": {"genres": ["y"]},
            "getgenre:dee": {"top_genres": ["z"]},
        },
    )
    got = {r.spotify_id: r for r in enrich.enrich_genres(df, stored).collect()}
    assert (got["both"].genres, got["both"].genre_match_confidence) == (["x"], 0.8)
    assert (got["solo"].genres, got["solo"].genre_source) == (["y"], "getgenre album validated")
    assert (got["none"].genres, got["none"].genre_source, got["none"].genre_match_confidence) == ([], "unmatched", 0.0)
    assert got["no album"].genres == ["z"]
    summary = enrich.enrichment_summary(enrich.enrich_genres(df, stored)).first()
    assert (summary.with_genres, summary.with_features, summary.tracks) == (3, 0, 4)
