"""Folders of a file system that Spark reads: listing, atomic renames, removal."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    at, fs = _at(spark, path)
    return fs.exists(at)


def names(spark: SparkSession, path: str) -> list[str]:
    """What a folder holds, by name; nothing if it is not there."""
    at, fs = _at(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []


def renamed(spark: SparkSession, path: str, to: str) -> bool:
    """Moves a folder or file in one step; false if ``to`` is there already."""
    at, fs = _at(spark, path)
    target = spark._jvm.org.apache.hadoop.fs.Path(to)
    fs.mkdirs(target.getParent())
    return not fs.exists(target) and fs.rename(at, target)


def removed(spark: SparkSession, path: str) -> None:
    at, fs = _at(spark, path)
    fs.delete(at, True)


def put_text(spark: SparkSession, path: str, text: str) -> None:
    """Writes a small file."""
    at, fs = _at(spark, path)
    out = fs.create(at, False)
    out.write(bytearray(text.encode()))
    out.close()
