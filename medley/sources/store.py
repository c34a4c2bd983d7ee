"""A stored table of the newest row per key whose updates rewrite only the buckets they touch.

Rows lie in `buckets` buckets by a hash of their key, one folder per bucket and write. A manifest per snapshot names
the folder of every bucket, so an upsert reads and writes the buckets of its keys, and all others are taken over
by name. Old snapshots stay readable until `vacuum`.

    path/manifest/00000000000000000003.json   schema, keys, version column, number of buckets, bucket -> folder
    path/data/<write>/store_bucket=17/...     the rows of a bucket

A manifest is created under a name that must not exist yet: of two writers that began from the same snapshot
one fails and can begin again, and neither loses rows. A file a writer left half done is no snapshot.

The driver holds one entry per bucket, never rows. Keys are hashed evenly and a key has one row, so buckets grow alike;
`rebucketed` changes their number when they have become too large.

Defined results: of the rows of a key the highest version wins (null is the lowest), with equal versions the update, among
equal updates the highest values; null keys are keys; no updates make no new snapshot.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from medley.plans.skew import materialized

BUCKET = "store_bucket"
BUCKETS = 64

LOOKUP_ROWS = T.StructType([*(T.StructField(n, T.StringType()) for n in ("service", "key", "payload")), T.StructField("version", T.LongType())])


class KeyedStore:
    """The newest snapshot of a stored table; `upsert` moves on to the next one."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        found = self._snapshots()
        if not found:
            raise FileNotFoundError(f"no store in {path}")
        self._use(found[-1])

    @classmethod
    def create(
        cls, spark: SparkSession, path: str, schema: T.StructType = LOOKUP_ROWS, keys: Sequence[str] = ("service", "key"), version: str = "version", buckets: int = BUCKETS
    ) -> KeyedStore:
        """An empty store. The keys, the version and the number of buckets belong to it from then on."""
        if missing := {*keys, version} - set(schema.names):
            raise ValueError(f"not in the schema: {', '.join(sorted(missing))}")
        out = cls.__new__(cls)
        out.spark, out.path = spark, path.rstrip("/")
        if out._snapshots():
            raise FileExistsError(f"{path} holds a store")
        out.number = -1
        out.state = {"schema": schema.jsonValue(), "keys": list(keys), "version": version, "buckets": buckets, "folders": {}}
        out._commit(out.state)
        return out

    # --- reading ---

    @property
    def schema(self) -> T.StructType:
        return T.StructType.fromJson(self.state["schema"])

    def read(self) -> DataFrame:
        """All rows of the snapshot."""
        return self._rows(self.state["folders"])

    def lookup(self, wanted: DataFrame) -> DataFrame:
        """The stored rows of the wanted keys; only their buckets are read."""
        keys = self.state["keys"]
        asked = wanted.select(*(F.col(k).cast(self.schema[k].dataType).alias(k) for k in keys)).distinct()
        rows = self._rows(self._touched(asked.select(self._bucket().alias(BUCKET))))
        same = [F.col(f"r.{k}").eqNullSafe(F.col(f"w.{k}")) for k in keys]
        return rows.alias("r").join(asked.alias("w"), same, "left_semi")

    # --- writing ---

    def upsert(self, updates: DataFrame) -> list[int]:
        """Insert or replace by key and commit a new snapshot; the numbers of the buckets that were rewritten."""
        fields = self.schema.fields
        typed = updates.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in fields))
        newest = materialized(self._newest(typed.withColumn("_fresh", F.lit(1))).withColumn(BUCKET, self._bucket()))
        touched = self._touched(newest)
        if not touched:
            return []
        old = self._rows(touched).withColumn("_fresh", F.lit(0)).withColumn(BUCKET, self._bucket())
        written = self._written(old.unionByName(newest.withColumn("_fresh", F.lit(1))), len(touched), self.state["buckets"])
        self._commit({**self.state, "folders": {**self.state["folders"], **{b: f"{written}/{BUCKET}={b}" for b in touched}}})
        return sorted(map(int, touched))

    def rebucketed(self, buckets: int) -> None:
        """The same rows in another number of buckets, as a new snapshot."""
        rows = self.read().withColumn("_fresh", F.lit(0)).withColumn(BUCKET, self._bucket(buckets))
        held = [str(r[0]) for r in rows.select(BUCKET).distinct().collect()]
        written = self._written(rows, max(1, len(held)), buckets)
        self._commit({**self.state, "buckets": buckets, "folders": {b: f"{written}/{BUCKET}={b}" for b in held}})

    def vacuum(self, keep: int = 1) -> int:
        """Delete all but the last `keep` snapshots and the folders only they name; the number of folders deleted.

        Not while another program writes: its folder is not named by any snapshot yet.
        """
        fs, numbers = self._fs(), self._snapshots()
        held = {f for n in numbers[-max(1, keep) :] for f in self._load(n)["folders"].values()}
        for n in numbers[: -max(1, keep)]:
            fs.delete(self._path(self._manifest(n)), False)
        gone = 0
        for write in self._listed(f"{self.path}/data"):
            folders = [f"{write}/{x}" for x in self._listed(f"{self.path}/data/{write}") if x.startswith(BUCKET)]
            dead = [f for f in folders if f not in held]
            for f in [write] if len(dead) == len(folders) else dead:
                fs.delete(self._path(f"{self.path}/data/{f}"), True)
            gone += len(dead)
        return gone

    # --- parts ---

    def _bucket(self, buckets: int | None = None) -> Column:
        return F.pmod(F.xxhash64(*self.state["keys"]), F.lit(buckets or self.state["buckets"])).cast("int")

    def _touched(self, rows: DataFrame) -> list[str]:
        """The buckets of some rows: at most as many as the store has."""
        return [str(r[0]) for r in rows.select(BUCKET).distinct().collect()]

    def _rows(self, buckets: Sequence[str]) -> DataFrame:
        folders = [f"{self.path}/data/{self.state['folders'][b]}" for b in buckets if b in self.state["folders"]]
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*folders)

    def _newest(self, rows: DataFrame, *by: str) -> DataFrame:
        """One row per key. The aggregate combines before any shuffle, so a key with very many updates is no hot one."""
        keys, version = self.state["keys"], self.state["version"]
        values = [f.name for f in self.schema.fields if f.name not in keys and f.name != version]
        best = rows.groupBy(*by, *keys).agg(F.max(F.struct(version, "_fresh", *values)).alias("_best"))
        return best.select(*by, *(F.col(n) if n in keys else F.col(f"_best.{n}").alias(n) for n in self.schema.names))

    def _written(self, rows: DataFrame, touched: int, buckets: int) -> str:
        """Write the newest rows, every bucket by one task; the name of the new folder."""
        name = uuid.uuid4().hex
        dealt = rows.repartition(min(touched, buckets), BUCKET)  # the aggregate by (bucket, key) needs no further shuffle
        self._newest(dealt, BUCKET).write.partitionBy(BUCKET).parquet(f"{self.path}/data/{name}")
        return name

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(name)

    def _fs(self):
        return self._path(self.path).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _listed(self, folder: str) -> list[str]:
        fs, path = self._fs(), self._path(folder)
        return sorted(s.getPath().getName() for s in fs.listStatus(path)) if fs.exists(path) else []

    def _manifest(self, number: int) -> str:
        return f"{self.path}/manifest/{number:020d}.json"

    def _load(self, number: int) -> dict | None:
        stream = self._fs().open(self._path(self._manifest(number)))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        except json.JSONDecodeError:  # left half done
            return None
        finally:
            stream.close()

    def _snapshots(self) -> list[int]:
        numbers = [int(n.removesuffix(".json")) for n in self._listed(f"{self.path}/manifest") if n.endswith(".json") and not n.startswith(".")]
        self._last = numbers[-1] if numbers else -1
        return [n for n in numbers if self._load(n) is not None]

    def _use(self, number: int) -> None:
        self.number, self.state = number, self._load(number)

    def _commit(self, state: dict) -> None:
        found = self._snapshots()
        if found and found[-1] != self.number:
            raise RuntimeError(f"{self.path} has moved on from snapshot {self.number} to {found[-1]}")
        number = self._last + 1
        try:
            stream = self._fs().create(self._path(self._manifest(number)), False)
        except Py4JJavaError as error:
            raise RuntimeError(f"another writer holds snapshot {number} of {self.path}") from error
        try:
            stream.write(json.dumps(state).encode())
        finally:
            stream.close()
        self.number, self.state = number, state
