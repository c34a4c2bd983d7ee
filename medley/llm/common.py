"""What the operators share: shared-folder tables, row keys, typed Arrow batches, contract words.

Words are runs of bytes outside 0x20 and 0x09-0x0D, which is how `bytes.split()` cuts, so the Python
sides split UTF-8 bytes and never decode.
"""

from __future__ import annotations

import gc
import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from medley.plans.skew import temporary_path

#: Stands for a null id: sorts before every real one.
NULL_ID = -(2**63)


#: Rows that one task writes at least, when a frame is known to be small.
TASK_ROWS = 50_000


def few_tasks(df: DataFrame, rows: int, per_task: int = TASK_ROWS) -> DataFrame:
    """A frame of at most `rows` rows in as many tasks as these fill, and in two per core at least.

    A task that writes a file costs far more than the few rows it may hold. Large frames stay as they are.
    """
    spark = df.sparkSession
    tasks = max(2 * spark.sparkContext.defaultParallelism, -(-rows // per_task))
    return df.coalesce(tasks) if tasks < int(spark.conf.get("spark.sql.shuffle.partitions")) else df


def written(df: DataFrame, rows: int | None = None, per_task: int = TASK_ROWS) -> DataFrame:
    """Write a frame that several later steps read to the shared folder and read it back.

    Cuts the lineage with files that outlive any executor, keeps column pruning and real sizes. The folder is
    deleted when Spark ends. `rows` is a bound of the frame's rows, where one is known (`few_tasks`).
    """
    df = df if rows is None else few_tasks(df, rows, per_task)
    path = temporary_path(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def released(spark: SparkSession) -> None:
    """Have the driver forget finished steps now, so that Spark deletes their shuffle files before the next ones."""
    for _ in range(2):
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(1)  # the files go in the background


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(k, tie, id, text): a key for every row, null ids as the smallest key.

    `tie` is 0 while ids are unique; rows that share an id are told apart by a hash of their text, so
    equal rows have equal keys and count as one document. One scan of the id column decides.
    """
    ids = docs.select(F.col(id_col).cast("long").alias("id"))
    repeated = ids.groupBy("id").count().where("count > 1").limit(1).count() > 0
    tie = F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))) if repeated else F.lit(0).cast("long")
    return docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("k"),
        tie.alias("tie"),
        F.col(id_col).cast("long").alias("id"),
        F.col(text_col).alias("text"),
    )


def batches(schema: pa.Schema, fn: Callable[[pa.RecordBatch], dict]) -> Callable[[Iterator], Iterator]:
    """A mapInArrow function from one that turns a batch into columns."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            if batch.num_rows:
                out = fn(batch)
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in schema], schema=schema)

    return run


_in_use: list[dict] = []


def only(*memos: dict) -> None:
    """Empty the memos that this Python worker filled for other operators, so that it keeps those of one at a time.

    Workers serve one stage after the other, and an idle one keeps what it holds.
    """
    for old in _in_use:
        if not any(old is m for m in memos):
            old.clear()
    _in_use[:] = memos


def utf8(batch: pa.RecordBatch, name: str) -> list[bytes]:
    """A text column as UTF-8 bytes, null as empty."""
    return [x or b"" for x in batch.column(name).cast(pa.binary()).to_pylist()]
