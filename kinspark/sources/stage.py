"""Intermediate tables, written once to storage that every executor can reach.

The chain materialises a table wherever several later steps read it. A written Parquet table
(unlike a cached or locally checkpointed one) outlives lost executors, cuts the lineage, keeps
column pruning, and tells the planner its size.

A stage with a run name outlives the driver, too: each finished step leaves an entry in the run's manifest, and a
later stage of the same run and input version reads that step's table in place of making it again.
"""

from __future__ import annotations

import hashlib
import json
import tempfile
import time
import uuid
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from kinspark.sources import files

CHECKPOINT_DIR = "spark.checkpoint.dir"
PREFIX, MANIFEST = "kinspark-", "manifest"


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder the session names; a scratch folder only for an unset local session."""
    named = spark.conf.get(CHECKPOINT_DIR, None) or spark.sparkContext.getConf().get(CHECKPOINT_DIR)
    named = named or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if spark.sparkContext.master.startswith("local"):
        return tempfile.mkdtemp(prefix="kinspark-")
    raise ValueError(f"set {CHECKPOINT_DIR} to a folder that all executors share")


@dataclass(frozen=True)
class Dealt:
    """Rows that are already hashed by ``key`` into as many partitions as there are to be buckets.

    With ``split_by``, a column of few values, each bucket is stored in parts that a filter on it picks.
    Without ``ordered``, the rows of a bucket are not sorted by the key.
    """

    rows: DataFrame
    key: str
    buckets: int
    split_by: str | None = None
    ordered: bool = True


class Stage:
    """A folder under the checkpoint folder, one per instance, holding one table per ``save``.

    Every written table gets a path of its own, so a table handed out earlier never changes. With a ``run`` name
    the folder belongs to that run, and ``version`` says what its steps were made from.
    """

    def __init__(self, spark: SparkSession, run: str | None = None, version: str = ""):
        self.spark = spark
        self.run, self.version = run, version
        self.id = uuid.uuid4().hex[:12]
        folder = self.id if run is None else f"run-{hashlib.md5(run.encode()).hexdigest()[:12]}"
        self.root = f"{checkpoint_root(spark)}/{PREFIX}{folder}"
        self._count = 0
        self._tables: list[str] = []
        self.written: list[str] = []  # steps that this instance made

    def new_path(self, name: str) -> str:
        self._count += 1
        own = f"{self.id}-" if self.run else ""
        return f"{self.root}/{own}{self._count:04d}-{name}"

    def write(self, name: str, df: DataFrame, partition_by: Sequence[str] = ()) -> str:
        """Write ``df`` as Parquet and return the path."""
        path = self.new_path(name)
        df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)
        return path

    def save(self, name: str, df: DataFrame, partition_by: Sequence[str] = ()) -> DataFrame:
        """Write ``df`` and return the written table with the same columns and types."""
        path = self.write(name, df, partition_by)
        return self.spark.read.schema(df.schema).parquet(path).select(*df.columns)

    def save_bucketed(self, name: str, df: DataFrame, key: str, buckets: int, ordered: bool = True) -> DataFrame:
        """Write ``df`` hashed (and sorted) by ``key``, so joins on it need no shuffle of this side."""
        return self._write_bucketed(name, df, key, buckets, ordered)[0]

    def _write_bucketed(
        self, name: str, df: DataFrame, key: str, buckets: int, ordered: bool = True
    ) -> tuple[DataFrame, str]:
        return self._write_dealt(name, Dealt(df.repartition(buckets, key), key, buckets, ordered=ordered))

    def _write_dealt(self, name: str, dealt: Dealt) -> tuple[DataFrame, str]:
        path, table = self.new_path(name), self._new_table(name)
        writer = dealt.rows.write.mode("overwrite").bucketBy(dealt.buckets, dealt.key)
        if dealt.ordered:
            writer = writer.sortBy(dealt.key)
        if dealt.split_by:
            writer = writer.partitionBy(dealt.split_by)
        writer.option("path", path).saveAsTable(table)
        return self.spark.table(table), path

    def _new_table(self, name: str) -> str:
        self._tables.append(f"kinspark_{self.id}_{self._count}_{name}")
        return self._tables[-1]

    def step(
        self, name: str, make: Callable[[], DataFrame | Dealt], bucket_by: str | None = None, buckets: int = 1
    ) -> DataFrame:
        """The stored table of a step, made only if no earlier stage of this run and version has finished it.

        ``name`` must be one step's alone within a run. Rows that come as ``Dealt`` are stored in those buckets.
        """
        entry = f"{self.root}/{MANIFEST}/{name}.json"
        known = files.read_text(self.spark, entry) if self.run else None
        done = json.loads(known) if known else None
        if done and done["version"] == self.version and files.exists(self.spark, f"{done['path']}/_SUCCESS"):
            return self._finished(name, done)
        df, split_by = make(), None
        if isinstance(df, Dealt):
            bucket_by, buckets, split_by = df.key, df.buckets, df.split_by
            table, path = self._write_dealt(name, df)
        elif bucket_by:
            table, path = self._write_bucketed(name, df, bucket_by, buckets)
        else:
            path = self.write(name, df)
            table = self.spark.read.schema(df.schema).parquet(path).select(*df.columns)
        self.written.append(name)
        if self.run:
            done = {"version": self.version, "path": path, "schema": table.schema.jsonValue()}
            files.write_text(self.spark, entry, json.dumps(done | {"bucket_by": bucket_by, "buckets": buckets, "split_by": split_by}))
        return table

    def _finished(self, name: str, done: dict) -> DataFrame:
        schema = StructType.fromJson(done["schema"])
        if not done["bucket_by"]:
            return self.spark.read.schema(schema).parquet(done["path"]).select(*schema.names)
        self._count += 1
        table, key = self._new_table(name), done["bucket_by"]
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
        parts = f" PARTITIONED BY (`{done['split_by']}`)" if done.get("split_by") else ""
        self.spark.sql(
            f"CREATE TABLE {table} ({columns}) USING parquet{parts} CLUSTERED BY (`{key}`) SORTED BY (`{key}`)"
            f" INTO {done['buckets']} BUCKETS LOCATION '{done['path']}'"
        )
        if parts:
            self.spark.catalog.recoverPartitions(table)
        return self.spark.table(table)

    def growing(self, name: str, key: str, buckets: int) -> GrowingTable:
        """A table that is appended to step by step, bucketed by ``key``."""
        path = self.new_path(name)
        return GrowingTable(self.spark, self._new_table(name), path, key, buckets)

    def release(self) -> None:
        """Forget the bucketed tables and delete this instance's folder."""
        for table in self._tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {table}")
        self._tables.clear()
        files.delete(self.spark, self.root)


def expire(spark: SparkSession, days: float) -> list[str]:
    """Delete the stage folders in which nothing was begun or finished for so many days; their paths.

    Runs that stopped for good leave such folders. ``days`` should be well above the longest single step.
    """
    root, oldest = checkpoint_root(spark), time.time() - days * 86_400
    gone = []
    for path in files.children(spark, root):
        if path.rsplit("/", 1)[1].startswith(PREFIX):
            seen = [path, *files.children(spark, path), *files.children(spark, f"{path}/{MANIFEST}")]
            if max(files.modified(spark, p) for p in seen) < oldest:
                files.delete(spark, path)
                gone.append(path)
    return gone


@dataclass
class GrowingTable:
    """A bucketed table in steps: rows once appended stay, and reading any of its steps shuffles nothing."""

    spark: SparkSession
    table: str
    path: str
    key: str
    buckets: int
    steps: int = 0

    def append(self, df: DataFrame) -> tuple[int, int]:
        """Add the rows as the next step; its number and row count.

        ``df`` should already be hashed by the key into as many partitions as there are buckets.
        """
        rows, number = Observation(), self.steps
        counted = df.observe(rows, F.count(F.lit(1)).alias("n")).withColumn("step", F.lit(number))
        writer = counted.write.mode("append").partitionBy("step").bucketBy(self.buckets, self.key)
        writer.option("path", self.path).saveAsTable(self.table)
        self.steps += 1
        return number, rows.get["n"]

    def read(self, steps: Iterable[int]) -> DataFrame:
        """The rows of these steps, without a look at the others."""
        return self.spark.table(self.table).filter(F.col("step").isin(*steps)).drop("step")
