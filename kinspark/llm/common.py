"""What several operators of this folder share: reading tables, and the words of a text."""

from __future__ import annotations

import gc
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs of anything but ASCII white space.
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def words(text: str = "text") -> Column:
    """The words of a text column in order; of a null text, none."""
    parts = F.split(F.coalesce(F.col(text), F.lit("")), SPACE)
    return F.filter(parts, lambda w: w != "")


def n_words(text: str = "text") -> Column:
    parts = F.split(F.coalesce(F.col(text), F.lit("")), SPACE)
    ends = (F.element_at(parts, 1) == "").cast("int")
    ends += ((F.size(parts) > 1) & (F.element_at(parts, -1) == "")).cast("int")
    return (F.size(parts) - ends).cast("long")


def partitions_for(rows: int, per_partition: int) -> int:
    return max(1, -(-rows // per_partition))


def settle(spark: SparkSession) -> None:
    """Lets Spark drop the shuffle files of steps whose results are stored: it does so once the JVM has
    collected their plans, which on an idle driver may be after the end of the job."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def discard(stage, keep: Sequence[str]) -> None:
    """Deletes the tables of a stage but those of the names to keep. Nothing still to run may read them."""
    context = stage.spark.sparkContext
    root = context._jvm.org.apache.hadoop.fs.Path(stage.root)
    files = root.getFileSystem(context._jsc.hadoopConfiguration())
    for status in files.listStatus(root) if files.exists(root) else []:
        if status.getPath().getName().partition("-")[2] not in keep:
            files.delete(status.getPath(), True)
    for name in [t for t in stage._tables if t.rpartition("_")[2] not in keep]:
        stage.spark.sql(f"DROP TABLE IF EXISTS {name}")
        stage._tables.remove(name)


def components(edges: DataFrame, stage) -> DataFrame:
    """(u, v) -> (node, label): every node of an edge and the smallest node it is connected with.

    Alternates large and small stars, each a grouped minimum and a join; every step is a stored table.
    """
    u, v = F.col("u"), F.col("v")
    edges = stage.save("edges", edges.filter(u != v).select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).distinct())
    state = None
    while True:
        both = edges.unionByName(edges.select(v.alias("u"), u.alias("v")))
        lowest = both.groupBy("u").agg(F.least(u, F.min("v")).alias("m"))
        large = both.join(lowest, "u").filter(v > u).select(v.alias("u"), F.col("m").alias("v"))
        large = stage.save("large", large.distinct())
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u").filter(v != F.col("m")).select(v.alias("u"), F.col("m").alias("v"))
        small = small.unionByName(lowest.select("u", F.col("m").alias("v")))
        edges = stage.save("small", small.filter(u != v).distinct())
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == state:
            break
        state = now
    return edges.select(u.alias("node"), v.alias("label")).unionByName(
        edges.select(v.alias("node"), v.alias("label")).distinct()
    )
