"""Merging, exports, matching, clusters and the plan helpers."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from medley.operators import density, export, kmeans
from medley.operators.features import Weights
from medley.operators.match import match_text
from medley.operators.merge import merge_libraries
from medley.plans import commands
from medley.plans.skew import numbered_parts, running_number, top_per_group
from medley.schema import MissingFeaturesError
from medley.sources import services


# --- merging ---


def as_rows(df):
    return [r.asDict() for r in df.orderBy("pos").drop("pos").collect()]


def model_merge(files, metadata=()):
    """The definition, row by row: the k-th row of an id meets the k-th known row of that id."""
    known, out = {}, []
    for rows, main in [*((f, True) for f in files), *((f, False) for f in metadata)]:
        seen = {}
        for r in rows:
            k = seen.get(r["spotify_id"], 0)
            seen[r["spotify_id"]] = k + 1
            same = known.setdefault(r["spotify_id"], [])
            if k < len(same):
                old = same[k]
                if main:
                    pairs = {}
                    for row in (old, r):
                        names = row["playlist_names"]
                        for i, p in enumerate(row["playlist_ids"]):
                            pairs.setdefault(p, names[i] if i < len(names) else p)
                    old["playlist_ids"], old["playlist_names"] = list(pairs), list(pairs.values())
                for g in r["genres"]:
                    if g not in old["genres"]:
                        old["genres"].append(g)
                for c in ("title", "year", "tempo"):
                    old[c] = r[c] if old[c] is None else old[c]
            elif main:
                copy = {**r, "genres": list(r["genres"])}
                same.append(copy)
                out.append(copy)
    return out


def random_library(rnd, n):
    rows = []
    for _ in range(n):
        ids = [rnd.choice("pqrs") for _ in range(rnd.randrange(3))]
        ids = list(dict.fromkeys(ids))
        rows.append(
            {
                "spotify_id": rnd.choice("abcdef"),
                "title": rnd.choice([None, "", "t1", "t2"]),
                "year": rnd.choice([None, 1, 2]),
                "tempo": rnd.choice([None, 0.5]),
                "playlist_ids": ids,
                "playlist_names": [p + rnd.choice("12") for p in ids],
                "genres": rnd.sample(["x", "y", "z"], rnd.randrange(3)),
            }
        )
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_merge_matches_the_definition(tracks, seed):
    rnd = random.Random(seed)
    files = [random_library(rnd, rnd.randint(1, 14)) for _ in range(3)]
    meta = [random_library(rnd, 10)]
    got = as_rows(merge_libraries([tracks(f) for f in files], [tracks(f) for f in meta]))
    expected = model_merge(files, meta)
    assert [{k: g[k] for k in e} for g, e in zip(got, expected)] == expected and len(got) == len(expected)


def test_merge_single_keeps_repeats_and_empty_fails(tracks):
    rows = [{"spotify_id": "a", "genres": ["x", "x"], "playlist_ids": ["p", "p"], "playlist_names": ["P", "Q"]}] * 2
    got = as_rows(merge_libraries([tracks(rows)]))
    assert [(r["genres"], r["playlist_ids"], r["playlist_names"]) for r in got] == [(["x", "x"], ["p", "p"], ["P", "Q"])] * 2
    with pytest.raises(ValueError, match="no library"):
        merge_libraries([])


def test_merge_files(spark, tracks, tmp_path):
    first, second = str(tmp_path / "a.parquet"), str(tmp_path / "b.parquet")
    from medley.sources.tracks import read_tracks, write_tracks

    write_tracks(tracks([{"spotify_id": "a", "title": "T", "artist": "", "album": "L"}]), first)
    write_tracks(tracks([{"spotify_id": "b", "title": "U", "artist": "x", "album": "L"}]), second)
    commands.merge(spark, [first, second], str(tmp_path / "out.jsonl"))
    assert [r.spotify_id for r in read_tracks(spark, str(tmp_path / "out.jsonl")).orderBy("pos").collect()] == ["a", "b"]


# --- exports ---


def test_split_by_cluster_in_batches(tracks):
    rows = [{"spotify_id": f"t{i}", "cluster_id": [None, -1, 0, 1][i % 4]} for i in range(20)]
    got = {(r.cluster_id, r.batch): r for r in commands.split(tracks(rows), "Mix-").collect()}
    assert set(got) == {(0, 0), (1, 0)}
    assert got[0, 0].track_ids == ["t2", "t6", "t10", "t14", "t18"]
    assert (got[0, 0].group_name, got[0, 0].description) == ("Mix-Cluster 0", "Generated from cluster 0 (5 tracks).")
    noisy = commands.split(tracks(rows), skip_noise=False, dry_run=True).collect()
    assert sorted((r.cluster_id, r.track_count) for r in noisy) == [(-1, 5), (0, 5), (1, 5)]
    small = export.batched_export(tracks(rows), ["cluster_id"], size=2).where("cluster_id = 1").orderBy("batch").collect()
    assert [r.track_ids for r in small] == [["t3", "t7"], ["t11", "t15"], ["t19"]]


def model_first(rows, by_isrc=True):
    ids, codes, out = set(), set(), []
    for i, r in enumerate(rows):
        if r["spotify_id"] in ids or (by_isrc and r["isrc"] and r["isrc"] in codes):
            continue
        ids.add(r["spotify_id"])
        codes.add(r["isrc"])
        out.append(i)
    return out


@pytest.mark.parametrize("functional", [True, False])
def test_first_of_each_matches_greedy(tracks, functional):
    rnd = random.Random(5)
    rows = []
    for _ in range(120):
        i = rnd.randrange(40)
        code = (i * 7) % 15 if functional else rnd.randrange(25)
        rows.append({"spotify_id": f"t{i}", "isrc": [None, "", f"I{code}"][2 if code else rnd.randrange(2) * (not functional)]})
    got = [r.pos for r in export.first_of_each(tracks(rows)).orderBy("pos").collect()]
    assert got == model_first(rows)
    got = [r.pos for r in export.first_of_each(tracks(rows), by_isrc=False).orderBy("pos").collect()]
    assert got == model_first(rows, False)


def test_merge_playlists(tracks):
    rows = [
        {"spotify_id": i, "isrc": c, "playlist_ids": ["p"], "playlist_names": ["Pop"]}
        for i, c in (("first", "s"), ("d", "1"), ("d", "1"), ("late", "s"), ("u", ""))
    ]
    got = commands.merge_playlists(tracks(rows), ["POP"], "All").collect()
    assert [(r.group_name, r.track_ids, r.description) for r in got] == [("All", ["first", "d", "u"], "Merged from: POP.")]
    with pytest.raises(ValueError, match="hold no rows"):
        commands.merge_playlists(tracks(rows), ["zzz"], "All")


# --- matching ---


def test_match_text_strict_then_loose(spark, tracks):
    catalogue = tracks(
        [
            {"spotify_id": "a", "title": "Blue Train", "artist": "Coltrane", "album": "Blue"},
            {"spotify_id": "b", "title": "Blue Train Live", "artist": "Coltrane", "album": "Live"},
            {"spotify_id": "c", "title": "Solo", "artist": "Monk", "album": "Blue Train"},
        ]
    )
    asked = [
        (1, "train BLUE", "coltrane", None),
        (2, "blue train", "", "live"),
        (3, "blue train solo", "monk", "other"),
        (4, "nothing", "", ""),
        (5, "blue train", "", "missing"),
    ]
    queries = spark.createDataFrame(asked, "query_id long, title string, artist string, album string")
    got = {r.query_id: (r.spotify_id, r.matched_by) for r in match_text(queries, catalogue).collect()}
    assert got == {1: ("a", "fields"), 2: ("b", "fields"), 3: ("c", "words"), 4: (None, None), 5: ("a", "words")}


def test_long_chain_of_first_wins(spark, monkeypatch):
    """Every row shares one key with the row before and one with the row after: log2 rounds of two writes."""
    writes = []
    written = export.materialized
    monkeypatch.setattr(export, "materialized", lambda df: writes.append(1) or written(df))
    rows = [(i, f"i{(i + 1) // 2}", f"c{i // 2}") for i in range(1000)]
    df = spark.createDataFrame(rows, "pos long, spotify_id string, isrc string")
    assert sorted(r.pos for r in export.first_of_each(df).collect()) == list(range(0, 1000, 2))
    assert len(writes) <= 2 * 12 + 6


def test_dense_first_wins_in_few_passes(spark, monkeypatch):
    """Rows whose keys are shared by many are halved by every pass, so few rows are written and none waits for chains."""
    written, sizes = export.materialized, []

    def counted(df):
        out = written(df)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(export, "materialized", counted)
    rnd = random.Random(8)
    rows = [(i, f"i{rnd.randrange(100)}", rnd.choice([None, f"c{rnd.randrange(250)}", f"c{rnd.randrange(250)}"])) for i in range(4000)]
    df = spark.createDataFrame(rows, "pos long, spotify_id string, isrc string")
    want = model_first([{"spotify_id": i, "isrc": c} for _, i, c in rows])
    assert sorted(tuple(r) for r in export.first_of_each(df).collect()) == [rows[i] for i in want]
    assert sum(sizes) <= 3 * len(rows)


# --- clusters ---


def planted(spark, sizes, spread=0.1, noise=0):
    rnd = np.random.default_rng(4)
    rows = []
    for label, n in enumerate(sizes):
        centre = np.array([10.0 * label, 5.0 * (label % 2), -3.0 * label])
        rows += [(label, centre + rnd.normal(0, spread, 3)) for _ in range(n)]
    rows += [(-1, rnd.uniform(-400, 400, 3)) for _ in range(noise)]
    data = [(i, label, Vectors.dense(v)) for i, (label, v) in enumerate(rows)]
    return spark.createDataFrame(data, ["row", "label", "features"])


def test_choose_k_finds_planted_clusters(spark):
    vectors = planted(spark, [12, 12, 12])
    assert kmeans.choose_k(vectors, k_max=5)[0] == 3
    assert [kmeans.choose_k(planted(spark, [n]))[0] for n in (1, 2)] == [1, 2]
    labels = {(r.label, r.cluster_id) for r in kmeans.cluster_vectors(vectors, 3).collect()}
    assert len(labels) == 3 and len({c for _, c in labels}) == 3
    assert {r.cluster_id for r in kmeans.cluster_vectors(vectors, 0).collect()} == {0}


def test_silhouette_is_the_mean_over_rows(spark):
    rows = [(0, 0, 0.0), (1, 0, 1.0), (2, 1, 5.0), (3, 1, 7.0), (4, 2, 20.0)]
    df = spark.createDataFrame([(r, c, 0, Vectors.dense([x])) for r, c, x in rows], ["row", "label", "same", "features"])
    x = {r: v for r, _, v in rows}
    own = {r: c for r, c, _ in rows}
    total = 0.0
    for r in x:
        mates = [abs(x[r] - x[o]) for o in x if o != r and own[o] == own[r]]
        others = [np.mean([abs(x[r] - x[o]) for o in x if own[o] == c]) for c in set(own.values()) - {own[r]}]
        total += (min(others) - np.mean(mates)) / max(min(others), np.mean(mates)) if mates else 0.0
    got = kmeans.silhouettes(df, ["label", "same"])
    assert got["label"] == pytest.approx(total / 5) and got["same"] is None


def listed(vectors):
    """Vectors as lists of their non-zero features."""
    cells = F.transform(vector_to_array("features"), lambda x, i: F.struct(F.format_string("f%05d", i).alias("feature"), x.alias("value")))
    return vectors.select("row", F.filter(cells, lambda c: c["value"] != 0).alias("cells"))


def test_density_finds_planted_clusters_and_noise(spark):
    vectors = planted(spark, [25, 30, 40], spread=0.3, noise=6)
    got = vectors.join(density.density_labels(listed(vectors), 5), "row").collect()
    by_label = {}
    for r in got:
        by_label.setdefault(r.label, []).append(r.cluster_id)
    for label in (0, 1, 2):
        common = max(set(by_label[label]), key=by_label[label].count)
        assert common >= 0 and by_label[label].count(common) >= 0.9 * len(by_label[label])
    assert by_label[-1].count(-1) >= 5
    assert {c for c in by_label[0] + by_label[1] + by_label[2] if c >= 0} == {0, 1, 2}


@pytest.mark.parametrize("clusters", [20, 600])
def test_density_finds_neighbours_at_every_number_of_clusters(spark, clusters):
    r = np.random.default_rng(4)
    x = np.repeat(r.normal(size=(clusters, 20)) * 6, 20, axis=0) + r.normal(size=(clusters * 20, 20))
    points = listed(spark.createDataFrame([(i, Vectors.dense(v)) for i, v in enumerate(x)], ["row", "features"]))
    found = {(p.a, p.b) for p in density.candidate_links(points, 5).collect()}
    hits = 0
    for i, v in enumerate(x):
        square = ((x - v) ** 2).sum(axis=1)
        square[i] = np.inf
        hits += sum((min(i, j), max(i, j)) in found for j in np.argpartition(square, 5)[:5].tolist())
    recall = hits / (5 * len(x))
    print("neighbour recall", clusters, recall)
    assert recall >= 0.95


def test_density_counts_copies(spark):
    data = [(i, Vectors.dense([float(i // 10), 0.0])) for i in range(30)] + [(30, Vectors.dense([50.0, 9.0]))]
    labels = {r.row: r.cluster_id for r in density.density_labels(listed(spark.createDataFrame(data, ["row", "features"])), 5).collect()}
    assert len({labels[i] for i in range(10)}) == 1 and len(labels) == 31 and labels[30] == -1


def test_cluster_command(tracks):
    rows = [{"spotify_id": str(i), "tempo": 10.0 + 200 * (i % 2), "playlist_ids": ["p" if i < 6 else "q"], "playlist_names": ["N"]} for i in range(8)]
    out, summary = commands.cluster(tracks(rows), k=2, playlists=["p"])
    assert tuple(summary.first()) == (6, 2)
    labels = {(int(r.spotify_id) % 2, r.cluster_id) for r in out.collect()}
    assert len(labels) == 2
    with pytest.raises(ValueError, match="Unsupported algorithm"):
        commands.cluster(tracks(rows), algorithm="dbscan")
    with pytest.raises(MissingFeaturesError):
        commands.cluster(tracks([{"spotify_id": "a"}]))
    same = [{"spotify_id": str(i), "genres": ["rock"], "tempo": 120.0} for i in range(3)]
    assert {r.cluster_id for r in commands.cluster(tracks(same), k=1)[0].collect()} == {0}
    light = commands.cluster(tracks(rows), k=2, weights=Weights(audio=0.0, audio_overrides={"tempo": 1.0}))[0]
    assert light.select("cluster_id").distinct().count() == 2


# --- plan helpers ---


def test_running_number_over_many_buckets(spark):
    df = spark.range(0, 5000).select(F.when(F.col("id") % 3 > 0, "hot").otherwise("cold").alias("k"), (F.col("id") * 1_000_003).alias("pos"))
    got = running_number(df, ["k"], "n").collect()
    for key in ("hot", "cold"):
        numbers = [r.n for r in sorted(got, key=lambda r: r.pos) if r.k == key]
        assert numbers == list(range(1, len(numbers) + 1))


def test_running_number_spreads_a_hot_key(spark):
    """One key owns 60 % of the rows at sparse places: its rows fill several partitions, none more than its share."""
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "10")
    try:
        rows = spark.range(0, 20_000, 1, 4).select(
            F.when(F.col("id") % 10 < 6, F.lit("hot")).otherwise(F.concat(F.lit("k"), F.col("id") % 977)).alias("k"),
            (F.pmod(F.xxhash64("id"), F.lit(2**55))).alias("pos"),
        )
        sizes = [r["count"] for r in numbered_parts(rows, ["k"], ["pos"]).groupBy("_part").count().collect()]
        assert len(sizes) == 10 and max(sizes) <= 2 * 20_000 / 10
        got = running_number(rows, ["k"], "n").collect()
        for key in ("hot", "k3"):
            numbers = [r.n for r in sorted(got, key=lambda r: r.pos) if r.k == key]
            assert numbers == list(range(1, len(numbers) + 1))
        every = running_number(rows.where("k = 'hot'"), [], "n").collect()
        assert [r.n for r in sorted(every, key=lambda r: r.pos)] == list(range(1, 12_001))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_running_number_with_null_keys(spark):
    df = spark.createDataFrame([(None, 1), ("a", 2), (None, 3)], "k string, pos long")
    assert sorted((r.k or "", r.pos, r.n) for r in running_number(df, ["k"], "n").collect()) == [("", 1, 1), ("", 3, 2), ("a", 2, 1)]


def test_top_per_group_cuts_before_the_shuffle(spark):
    df = spark.range(0, 3000).select((F.col("id") % 2).alias("g"), F.col("id").alias("pos"))
    few = top_per_group(df, ["g"], [F.col("pos").desc()], 3)
    assert "WindowGroupLimit" in few._jdf.queryExecution().executedPlan().toString()
    many = top_per_group(df, ["g"], [F.col("pos").desc()], 1200)
    assert many.count() == 2400 and many.agg(F.min("pos")).first()[0] == 600


def test_hot_join_key_is_split_by_adaptive_execution(spark):
    """The layout the operators use: a join on a hot key, then a step with another clustering."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "10000",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20000",
        "spark.sql.shuffle.partitions": "16",
    }
    old = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        from medley.operators.outliers import group_distances

        rows = spark.range(0, 40000, 1, 16).select(
            F.col("id").alias("pos"),
            F.lit(0).alias("m_idx"),
            F.col("id").cast("string").alias("spotify_id"),
            F.when(F.rand(1) < 0.5, F.lit("hot")).otherwise(F.concat(F.lit("g"), F.col("id") % 500)).alias("group_id"),
            F.array(F.lit("rock")).alias("genres"),
            F.rand(2).alias("energy"),
        )
        df = group_distances(rows)
        assert df.count() == 40000
        plan = df._jdf.queryExecution()
        df.collect()
        assert "skew=true" in plan.executedPlan().toString()
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def counted(spark, df, column):
    """The frame with one column passed through a Python function, and the number of rows it has been called for."""
    calls = spark.sparkContext.accumulator(0)

    def same(value):
        calls.add(1)
        return value

    return df.withColumn(column, F.udf(same, df.schema[column].dataType)(column)), calls


def test_running_number_by_key_and_over_ranges(spark):
    df = spark.range(2000).select((F.col("id") % 7).alias("k"), (F.col("id") % 3).alias("f"), F.col("id").alias("pos"))
    by_key, over_ranges = (running_number(df, ["k", "f"], "n", by=["k"], most=most).collect() for most in (2000, 100))
    assert len(by_key) == 2000 and sorted(by_key) == sorted(over_ranges)


def test_merge_makes_its_input_rows_once(spark, tracks):
    rnd = random.Random(3)
    files = [random_library(rnd, 40) for _ in range(2)]
    frames = [tracks(f) for f in files]
    watched, calls = counted(spark, frames[0], "title")
    got = as_rows(merge_libraries([watched, frames[1]]))
    assert got == as_rows(merge_libraries(frames))
    assert calls.value == 40


def test_library_parses_its_pages_once(spark):
    rows = spark.range(60).select(
        (F.col("id") % 9).cast("string").alias("spotify_id"), F.col("id").alias("at"), F.col("id").cast("string").alias("group_id"), F.lit("g").alias("group_name"),
        *[F.lit("x").alias(c) for c in services.ATTRIBUTES],
    )
    watched, calls = counted(spark, rows, "group_id")
    items, members = services.collect_library(watched, ["at"])
    assert items.count() == 9 and members.count() == 60 and calls.value == 60
    assert sorted((r.spotify_id, r.m_idx, r.group_id) for r in members.collect()) == sorted((str(i % 9), i // 9, str(i)) for i in range(60))


def test_unreadable_years_are_not_cast(spark):
    """Only four digits reach the cast, as a failed one costs far more than a row; the years are those of the plain cast."""
    texts = ["1999-01-02", "1900", "1901", "c. 1999", "", None, " 199", "+199", "199.", "19 9", "2001", "20011", "0000", "１９９９", "-1999", "1e10", "199\n"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    plain = F.substring("t", 1, 4).try_cast("int")
    got = df.select(services.release_year(F.col("t")).alias("year"), F.when(plain > 1900, plain).alias("want"))
    assert [r.year for r in got.collect()] == [r.want for r in got.collect()] == [1999, None, 1901] + [None] * 7 + [2001, 2001] + [None] * 5
    plan = df.select(services.release_year(F.col("t")))._jdf.queryExecution().optimizedPlan().toString()
    assert "RLIKE" in plan
