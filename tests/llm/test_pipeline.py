"""The pipeline stage by stage, and the registered names."""

from __future__ import annotations

import corpus_pipeline

import __spark_entry__
from medley.llm import quality
from medley.llm.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"


def test_one_query_per_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))
    assert set(SQL) <= set(QUERIES) <= set(__spark_entry__.queries()) and "pipeline" in __spark_entry__.queries()


def test_stages(spark, docs):
    """Every stage keeps the columns; rejected documents go, groups keep one, personal data is masked."""
    docs([])
    table = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in table.collect()}
    kept = {i: quality.judge((t or "").encode(), 0.3, 0.1, 0.5) for i, t in texts.items()}
    now, seen = table, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = corpus_pipeline.written(stage(spark, now, SF))
        assert out.columns == table.columns, name
        seen.append({(r["doc_id"], r["text"]) for r in out.collect()})
        now = out
    assert seen[0] == {(i, v["clean_text"].decode()) for i, v in kept.items() if v["kept"]}
    assert seen[1] <= seen[0] and {i for i, _ in seen[2]} == {i for i, _ in seen[1]} and seen[3] <= seen[2]
    assert len(seen[3]) >= 0.8 * len(seen[2])
    last = corpus_pipeline.STAGES[-1][1](spark, now, SF).collect()
    assert {r["doc_id"] for r in last} == {i for i, _ in seen[3]} and len(last) == now.count()


def test_stages_on_edge_rows(spark, docs, edge_rows):
    for rows in ([], edge_rows):
        now = docs(rows).withColumnRenamed("lang", "kept")  # a column name that operators use themselves
        for _, stage in corpus_pipeline.STAGES[:-1]:
            now = corpus_pipeline.written(stage(spark, now, SF))
            assert now.columns == ["doc_id", "text", "kept", "source", "n_chars"]
        corpus_pipeline.STAGES[-1][1](spark, now, SF).collect()
