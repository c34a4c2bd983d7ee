"""Numbering, top-k and lineage cuts that hold when one key owns a large share of all rows.

Joins need no helper: the operators put every join on a large side directly above its shuffles and
before a step with another clustering, the layout in which adaptive execution splits hot join keys
over several tasks by itself. Aggregates combine map-side. What is left is ranking, done here.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from weakref import WeakKeyDictionary

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T


#: The folder of every materialized frame.
_written: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()
#: Rows of one key that a task may number alone.
KEY_ROWS = 1_000_000
#: Setting under which Spark deletes a query's shuffle files when the query ends; without it they stay until the driver happens to collect its garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _changes(batch: pa.RecordBatch, keys: Sequence[str], last: list | None) -> np.ndarray:
    """Where a row's key differs from that of the row before; `last` is the key before the batch."""
    out = np.zeros(batch.num_rows, bool)
    out[0] = last is None or [batch.column(k)[0].as_py() for k in keys] != last
    for k in keys:
        c = batch.column(k)
        a, b = c.slice(1), c.slice(0, len(c) - 1)
        same = pc.or_(pc.fill_null(pc.equal(a, b), False), pc.and_(pc.is_null(a), pc.is_null(b)))
        out[1:] |= ~same.to_numpy(zero_copy_only=False)
    return out


def numbered_parts(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Rows sorted into range partitions by (key, order) and written: with the partition `_part` and, counted
    from 1 inside (partition, key), `_in`."""
    keys = list(keys)
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(parts, *keys, *order).sortWithinPartitions(*keys, *order)
    if not keys:  # the place inside the partition is the lower part of Spark's own row ids
        placed = ranged.withColumn("_id", F.monotonically_increasing_id())
        part, place = F.shiftright("_id", 33).cast("int"), F.col("_id").bitwiseAND(F.lit(2**33 - 1)) + 1
        return materialized(placed.withColumns({"_part": part, "_in": place}).drop("_id"))
    schema = T.StructType([*df.schema.fields, T.StructField("_part", T.IntegerType()), T.StructField("_in", T.LongType())])

    def number(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        last, n = None, 0
        for batch in it:
            if not batch.num_rows:
                continue
            new = np.flatnonzero(_changes(batch, keys, last)) if keys else np.zeros(0, np.int64)
            at = np.arange(1, batch.num_rows + 1)
            start = np.full(batch.num_rows, -n)  # rows before the batch under the same key count on
            start[new] = new
            inside = at - (np.maximum.accumulate(np.where(start >= 0, start, 0)) if len(new) else start)
            if len(new) and new[0]:
                inside[: new[0]] = at[: new[0]] + n
            last, n = [batch.column(k)[-1].as_py() for k in keys], int(inside[-1])
            columns = [*batch.columns, pa.array(np.full(batch.num_rows, part, np.int32)), pa.array(inside.astype(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "_part", "_in"])

    return materialized(ranged.mapInArrow(number, schema))


def running_number(
    df: DataFrame, keys: Sequence[str], out: str, order: Sequence[str] = ("pos",), by: Sequence[str] = (), most: int = KEY_ROWS
) -> DataFrame:
    """1-based position of every row inside its key (of all rows without keys), in the given order.

    While no key has more than `most` rows, they are numbered key by key; a task then holds whole keys of `by`, some or
    all of the key columns. Beyond that, and without keys, rows are range-partitioned by (key, order), so a hot key is
    cut over as many partitions as its rows fill; the sorted rows are numbered partition by partition and written. Only
    the first key of a partition can have rows in earlier ones: its offset comes from one row per partition. The order
    must be total inside a key, else equal rows are numbered in any order.
    """
    by = list(by or keys)
    if by and (df.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0) <= most:
        place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long")
        return df.repartition(*by).select(*[F.col(f"`{c}`") for c in df.columns if c != out], place.alias(out))
    fixed = numbered_parts(df, keys, order)
    key = F.struct(*keys) if keys else F.struct(F.lit(0).alias("all"))
    ends = fixed.groupBy("_part").agg(F.min(key).alias("_first"), F.max(F.struct(key.alias("key"), "_in")).alias("_last"))
    ends = ends.select("_part", "_first", F.col("_last.key").alias("_key"), F.col("_last._in").alias("_n"))
    chain = Window.partitionBy("_key").orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    order_ = Window.orderBy("_part")
    before = ends.withColumn("_sum", F.sum("_n").over(chain)).select(
        F.col("_part").alias("_p"), "_first", F.lag("_key").over(order_).alias("_k"), F.lag("_sum").over(order_).alias("_offset")
    )
    offsets = F.broadcast(before.where(F.col("_k").eqNullSafe(F.col("_first"))).drop("_k"))
    shift = F.when(key.eqNullSafe(F.col("_first")), F.col("_offset")).otherwise(F.lit(0))
    met = fixed.join(offsets, F.col("_part") == F.col("_p"), "left")
    return met.select(*[F.col(f"`{c}`") for c in df.columns if c != out], (F.col("_in") + F.coalesce(shift, F.lit(0))).alias(out))


def top_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, out: str = "rank") -> DataFrame:
    """First `n` rows of every group in the given order.

    The rank filter lets Spark cut every group to `n` rows before the shuffle. Beyond the limit up
    to which Spark does that, groups are first cut inside salts.
    """
    limit = int(SparkSession.active().conf.get("spark.sql.optimizer.windowGroupLimitThreshold", "1000"))
    final = Window.partitionBy(*keys).orderBy(*order)
    if n > limit:
        salted = df.withColumn("_salt", F.pmod(F.xxhash64("pos"), F.lit(256)))
        first = Window.partitionBy(*keys, "_salt").orderBy(*order)
        df = salted.withColumn("_rn", F.row_number().over(first)).where(F.col("_rn") <= n).drop("_rn", "_salt")
    return df.withColumn(out, F.row_number().over(final)).where(F.col(out) <= n)


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, as the session names it in spark.checkpoint.dir.

    Only on a local master a missing one is made, and removed when the program ends.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="medley-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def temporary_path(spark: SparkSession, suffix: str = "") -> str:
    """A new path in the shared folder that is deleted when Spark ends."""
    path = f"{shared_folder(spark)}/medley-{uuid.uuid4().hex}{suffix}"
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


@contextmanager
def shuffles_released(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the queries that end inside are deleted then, as nothing reads them again."""
    old = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, old)


def materialized(df: DataFrame) -> DataFrame:
    """Write a frame that several later steps read to the shared folder and read it back.

    Cuts the lineage, keeps column pruning and real sizes for the planner, and survives the loss of
    any executor. The folder is deleted when Spark ends or by `discarded`, the step's shuffle files once it is written.
    """
    spark = df.sparkSession
    path = temporary_path(spark)
    with shuffles_released(spark):
        df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    _written[back] = path
    return back


def discarded(*frames: DataFrame) -> None:
    """Delete the folders of materialized frames that no later step reads."""
    for df in frames:
        if path := _written.pop(df, None):
            target = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(target, True)
