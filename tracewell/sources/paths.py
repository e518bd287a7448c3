"""Paths of any Hadoop file system: what is there, small files, and renames. Where a system cannot be reached, calls raise."""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def filesystem(spark: SparkSession, path: str):
    """The file system of a path, and the path as it knows it."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    try:
        return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at
    except Py4JJavaError as error:
        raise OSError(f"{path} cannot be reached: {error.java_exception.toString()}") from None


def _asked(spark: SparkSession, path: str, call):
    fs, at = filesystem(spark, path)
    try:
        return call(fs, at)
    except Py4JJavaError as error:
        raise OSError(f"{path} cannot be reached: {error.java_exception.toString()}") from None


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a file or folder; a system that does not answer raises, and is not taken for an absent path."""
    return _asked(spark, path, lambda fs, at: fs.exists(at))


def qualified(spark: SparkSession, path: str) -> str:
    """The path with its file system, in one form however it is written."""
    fs, at = filesystem(spark, path)
    return fs.makeQualified(at).toUri().normalize().toString().rstrip("/")


def matches(spark: SparkSession, pattern: str) -> bool:
    """Whether a pattern names anything."""
    return bool(_asked(spark, pattern, lambda fs, at: fs.globStatus(at)))


def stamp(spark: SparkSession, path: str) -> tuple:
    """What tells one state of a table's files from another: names, sizes and times."""
    return tuple(sorted((f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in _asked(spark, path, lambda fs, at: fs.listStatus(at))))


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file, new."""

    def put(fs, at):
        out = fs.create(at, False)
        out.write(bytearray(text.encode()))
        out.close()

    _asked(spark, path, put)


def delete(spark: SparkSession, path: str) -> None:
    _asked(spark, path, lambda fs, at: fs.delete(at, True))


def rename(spark: SparkSession, path: str, to: str) -> None:
    if not _asked(spark, path, lambda fs, at: fs.rename(at, filesystem(spark, to)[1])):
        raise OSError(f"could not move {path} to {to}")


def overlap(spark: SparkSession, a: str, b: str) -> bool:
    """Whether one of two paths is the other or lies in it, however they are written."""
    a, b = qualified(spark, a) + "/", qualified(spark, b) + "/"
    return a.startswith(b) or b.startswith(a)


def staging(spark: SparkSession, target: str, sources: list[str] = ()) -> str:
    """A new path beside target to build it in. Refuses a target that overlaps a source, and one that exists."""
    for s in sources:
        if overlap(spark, target, s):
            raise ValueError(f"output {target} overlaps source {s}")
    if exists(spark, target):
        raise FileExistsError(target)
    return f"{target.rstrip('/')}.{uuid.uuid4().hex}"
