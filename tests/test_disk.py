"""What steps leave on the disks."""

from __future__ import annotations

import os
import random

import pytest
from pyspark.sql import functions as F

from medley.operators.merge import merge_libraries
from medley.plans.graph import shortest_links
from medley.plans.skew import materialized, shared_folder


def test_a_written_step_leaves_no_shuffle_files(spark):
    """Nothing reads them again; else they stay on the disks until the driver happens to collect its garbage."""
    status = spark._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker().shuffleStatuses()
    before = status.size()
    back = materialized(spark.range(1000).repartition(4, "id").groupBy((F.col("id") % 7).alias("k")).count())
    assert back.count() == 7
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    assert status.size() <= before + 2  # the count's own


def _folders(spark):
    return {f for f in os.listdir(shared_folder(spark)) if f.startswith("medley-")}


def test_rounds_of_a_tree_leave_their_links_only(spark):
    """A round's tables go with the round: what is left are the chosen links, one table a round."""
    rnd = random.Random(1)
    rows = [(min(a, b), max(a, b), rnd.random()) for a, b in (rnd.sample(range(300), 2) for _ in range(900))]
    before = _folders(spark)
    links = shortest_links(spark.createDataFrame(rows, "a long, b long, length double"))
    parts = {i: i for i in range(300)}
    total = 0.0
    for a, b, length in sorted(rows, key=lambda x: (x[2], x[0], x[1])):  # Kruskal
        while parts[a] != a:
            a = parts[a]
        while parts[b] != b:
            b = parts[b]
        if a != b:
            parts[a], total = b, total + length
    assert sum(r.length for r in links.collect()) == pytest.approx(total)
    assert len(_folders(spark) - before) <= 10  # 300 rows: about 4 rounds, and the last one's tables


def test_a_merge_keeps_one_copy_of_its_rows(spark, tracks):
    before = _folders(spark)
    merged = merge_libraries([tracks([{"spotify_id": x} for x in "abc"]), tracks([{"spotify_id": x} for x in "cd"])])
    assert [r.spotify_id for r in merged.orderBy("pos").collect()] == list("abcd")
    assert len(_folders(spark) - before) == 1
