from __future__ import annotations

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark, tmp_path_factory):
    """Documents from (doc_id, text) pairs, in several partitions, with a shared checkpoint folder set."""
    if spark.conf.get("spark.checkpoint.dir", None) is None:
        spark.conf.set("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoint")))

    def build(rows, partitions: int = 3):
        full = [(i, t, "en", "s", None if t is None else len(t)) for i, t in rows]
        return spark.createDataFrame(full, SCHEMA).repartition(partitions)

    return build


@pytest.fixture(scope="session")
def sample():
    """All texts of the smallest table."""
    import pyarrow.parquet as pq

    t = pq.read_table("/root/testdata/sf0.001/documents.parquet")
    return list(zip(t["doc_id"].to_pylist(), t["text"].to_pylist()))


EDGE = [
    (None, "a null id"), (1, None), (2, ""), (3, " \n\t "), (4, "one"), (4, "one"), (4, "another text, same id"),
    (5, "x" * 300_000), (6, "word " * 60_000), (7, "ünïcödé 中文 🙂 <|endoftext|> mail a.b@c.de +1 (222) 333-4444"), (8, "one"),
]


@pytest.fixture(scope="session")
def edge_rows():
    """Nulls, empty and very long texts, ties and repeated rows."""
    return list(EDGE)
