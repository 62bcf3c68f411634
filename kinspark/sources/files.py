"""Single files and folders of whatever file system a path names, through Spark's own file layer."""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def _of(spark: SparkSession, path: str):
    """(file system, path) of a path text."""
    context = spark.sparkContext
    found = context._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(context._jsc.hadoopConfiguration()), found


def exists(spark: SparkSession, path: str) -> bool:
    system, found = _of(spark, path)
    return system.exists(found)


def delete(spark: SparkSession, path: str) -> None:
    system, found = _of(spark, path)
    system.delete(found, True)


def modified(spark: SparkSession, path: str) -> float:
    """Seconds since 1970."""
    system, found = _of(spark, path)
    return system.getFileStatus(found).getModificationTime() / 1000


def children(spark: SparkSession, path: str) -> list[str]:
    """What lies directly in a folder; nothing if there is none."""
    system, found = _of(spark, path)
    return [status.getPath().toString() for status in system.listStatus(found)] if system.exists(found) else []


def describe(spark: SparkSession, path: str) -> list[tuple[str, int, int]]:
    """Path, length and time of each file of a table: what tells whether it has changed."""
    system, found = _of(spark, path)
    return sorted((s.getPath().toString(), s.getLen(), s.getModificationTime()) for s in system.listStatus(found))


def rename(spark: SparkSession, old: str, new: str) -> None:
    """Move a folder to a name that is free."""
    system, found = _of(spark, old)
    try:
        moved = system.rename(found, _of(spark, new)[1])
    except Py4JJavaError as failure:
        raise OSError(f"cannot rename {old} to {new}") from failure
    if not moved:
        raise OSError(f"cannot rename {old} to {new}")


def read_text(spark: SparkSession, path: str) -> str | None:
    """The text of a small file; None if there is none."""
    system, found = _of(spark, path)
    if not system.exists(found):
        return None
    stream = system.open(found)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file under another name, then put it in its place."""
    system, found = _of(spark, path)
    fresh = found.suffix(".new")
    stream = system.create(fresh, True)
    stream.write(text.encode())
    stream.close()
    system.delete(found, False)
    rename(spark, fresh.toString(), path)
