from __future__ import annotations

import os
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F, types as T

from medley.sources.store import KeyedStore

ROWS = "service string, key string, payload string, version long"


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def data_files(path):
    return {str(p): os.stat(p).st_mtime_ns for p in Path(path, "data").rglob("*.parquet")}


@pytest.fixture
def store(spark, tmp_path):
    return KeyedStore.create(spark, str(tmp_path / "store"), buckets=16)


def test_upserts_equal_plain_version(spark, store):
    rng = random.Random(4)
    plain = {}
    for _ in range(3):
        batch = [
            (rng.choice("st"), rng.choice([None, *(str(i) for i in range(40))]), rng.choice([None, "", "{}", "x" * 50]), rng.choice([None, *range(5)]))
            for _ in range(60)
        ]
        order = lambda r: (r[3] is not None, r[3] or 0, r[2] is not None, r[2] or "")
        newest = {}
        for r in batch:
            if r[:2] not in newest or order(r) > order(newest[r[:2]]):
                newest[r[:2]] = r
        for k, r in newest.items():
            if k not in plain or order(r)[:2] >= order(plain[k])[:2]:
                plain[k] = r
        store.upsert(spark.createDataFrame(batch, ROWS))
        assert rows_of(store.read()) == sorted(plain.values(), key=repr)
    assert rows_of(KeyedStore(spark, store.path).read()) == sorted(plain.values(), key=repr)


def test_only_touched_buckets_are_rewritten(spark, store):
    store.upsert(spark.range(400).select(F.lit("s").alias("service"), F.col("id").cast("string").alias("key"), F.lit("1").alias("payload"), F.lit(1).alias("version")))
    before, named = data_files(store.path), dict(store.state["folders"])
    assert len(named) == 16
    touched = store.upsert(spark.createDataFrame([("s", "7", "2", 2), ("s", "new", "2", 2)], ROWS))
    after = data_files(store.path)
    assert 1 <= len(touched) <= 2 and len(after) - len(before) == len(touched)
    assert all(after[f] == t for f, t in before.items())
    assert {int(b) for b, f in store.state["folders"].items() if named.get(b) != f} == set(touched)
    got = {r.key: r.payload for r in store.read().collect()}
    assert len(got) == 401 and got["7"] == got["new"] == "2" and got["8"] == "1"


def test_lookup_reads_the_buckets_of_its_keys(spark, store):
    store.upsert(spark.createDataFrame([("s", str(i), "1", 1) for i in range(200)] + [("s", None, "none", 1)], ROWS))
    wanted = spark.createDataFrame([("s", "5", 1), ("s", "5", 2), ("s", None, 3), ("t", "5", 4)], "service string, key string, payload long")
    found = store.lookup(wanted)
    assert rows_of(found) == sorted([("s", "5", "1", 1), ("s", None, "none", 1)], key=repr)
    assert len({f.rsplit("/", 2)[1] for f in found.inputFiles()}) <= 3
    assert store.lookup(wanted.limit(0)).count() == 0


def test_nothing_to_write_and_late_versions(spark, store):
    assert store.upsert(spark.createDataFrame([], ROWS)) == [] and store.number == 0 and store.read().count() == 0
    store.upsert(spark.createDataFrame([("s", "a", "new", 5)], ROWS))
    store.upsert(spark.createDataFrame([("s", "a", "late", 4)], ROWS))
    assert rows_of(store.read()) == [("s", "a", "new", 5)]
    store.upsert(spark.createDataFrame([("s", "a", "again", 5)], ROWS).withColumn("extra", F.lit(1)).withColumn("store_bucket", F.lit(99)))
    assert rows_of(store.read()) == [("s", "a", "again", 5)]


def test_two_writers_and_a_half_done_manifest(spark, store):
    other = KeyedStore(spark, store.path)
    store.upsert(spark.createDataFrame([("s", "a", "1", 1)], ROWS))
    with pytest.raises(RuntimeError, match="moved on"):
        other.upsert(spark.createDataFrame([("s", "b", "1", 1)], ROWS))
    Path(store.path, "manifest", f"{2:020d}.json").write_text('{"schema"')
    again = KeyedStore(spark, store.path)
    assert again.number == 1
    again.upsert(spark.createDataFrame([("s", "b", "1", 1)], ROWS))
    assert again.number == 3 and {r.key for r in KeyedStore(spark, store.path).read().collect()} == {"a", "b"}
    with pytest.raises(FileExistsError):
        KeyedStore.create(spark, store.path)
    with pytest.raises(FileNotFoundError):
        KeyedStore(spark, store.path + "-none")


def test_vacuum_and_other_number_of_buckets(spark, store):
    for v in range(3):
        store.upsert(spark.createDataFrame([("s", str(i), str(v), v) for i in range(0, 100, v + 1)], ROWS))
    want = rows_of(store.read())
    store.rebucketed(5)
    assert rows_of(store.read()) == want and len(store.state["folders"]) == 5
    gone = store.vacuum()
    assert gone > 0 and len(data_files(store.path)) == 5 and store.vacuum() == 0
    assert rows_of(KeyedStore(spark, store.path).read()) == want
    store.upsert(spark.createDataFrame([("s", "3", "z", 9)], ROWS))
    assert {r.key: r.payload for r in store.read().collect()}["3"] == "z"


def test_keys_of_other_types(spark, tmp_path):
    schema = T.StructType.fromDDL("id long, at timestamp_ntz, names array<string>, part struct<a: int>")
    store = KeyedStore.create(spark, str(tmp_path / "s"), schema, keys=["id"], version="at", buckets=3)
    rows = "SELECT CAST(id AS INT) AS id, timestamp_ntz'2024-01-01 00:00:00' AS at, array(string(id)) AS names, named_struct('a', 1) AS part FROM range(20)"
    store.upsert(spark.sql(rows))
    store.upsert(spark.sql("SELECT 3 AS id, timestamp_ntz'2024-01-02 00:00:00' AS at, array('x', NULL) AS names, named_struct('a', 2) AS part"))
    got = {r.id: (r.names, r.part.a) for r in store.read().collect()}
    assert len(got) == 20 and got[3] == (["x", None], 2) and got[4] == (["4"], 1)
    with pytest.raises(ValueError, match="not in the schema"):
        KeyedStore.create(spark, str(tmp_path / "t"), schema, keys=["key"], version="at")
