from __future__ import annotations

import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from medley.bindings import as_tracks  # noqa: E402
from medley.schema import TRACK_SCHEMA  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]")
        .appName("medley-tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def tracks(spark):
    """Build item rows from dicts; `pos` is the place in the list, missing fields are null or empty."""

    def build(rows: list[dict]):
        from pyspark.sql import types as T

        names = sorted({k for r in rows for k in r}) or ["spotify_id"]
        kinds = {f.name: f.dataType for f in TRACK_SCHEMA.fields}
        schema = T.StructType([T.StructField("pos", T.LongType())] + [T.StructField(n, kinds[n]) for n in names])
        return as_tracks(spark.createDataFrame([(i, *[r.get(n) for n in names]) for i, r in enumerate(rows)], schema))

    return build


@pytest.fixture
def members(spark):
    """Membership rows from (group_id, group_name, item) in order."""

    def build(rows):
        data = [(i, 0, item, group, name) for i, (group, name, item) in enumerate(rows)]
        return spark.createDataFrame(data, "pos long, m_idx int, spotify_id string, group_id string, group_name string")

    return build
