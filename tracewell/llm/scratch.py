"""Written intermediate tables in the folder that all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a two-column table of longs is broadcast (about 60 MB once hashed).
BROADCAST_ROWS = 1_000_000


def shared_dir(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; one of our own only where it is unset (tests, one machine)."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        at = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at


#: Rows of narrow tables that are written in one file, where their number is known.
FILE_ROWS = 1_000_000


def written(df: DataFrame, rows: int | None = None) -> DataFrame:
    """df, written once as Parquet and read back: no lineage, and nothing is lost with an executor. A known number of rows keeps small tables in few files."""
    spark = df.sparkSession
    df = df if rows is None else df.coalesce(rows // FILE_ROWS + 1)
    path = f"{shared_dir(spark)}/tracewell-{uuid.uuid4().hex}"
    df.write.parquet(path)
    fs, at = _place(spark, path)
    fs.deleteOnExit(at)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def _place(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def discard(*tables: DataFrame) -> None:
    """Deletes tables of written() that nothing reads any more; others are left alone."""
    for table in tables:
        if path := getattr(table, "_written_at", None):
            fs, at = _place(table.sparkSession, path)
            fs.delete(at, True)


def with_keys(df: DataFrame, keys: DataFrame, on: str | list[str] | Column, how: str = "inner", rows: int | None = None) -> DataFrame:
    """df joined to the narrow table keys: broadcast if it is counted as small, else by shuffle."""
    n = keys.count() if rows is None else rows
    return df.join(F.broadcast(keys) if n <= BROADCAST_ROWS else keys, on, how)


def few(table: DataFrame, rows: int = BROADCAST_ROWS) -> list[np.ndarray] | None:
    """The columns of longs of a table, sorted by the first, to be sent to every task with a kernel; None if it has more than `rows`."""
    if table.count() > rows:
        return None
    got = table.toArrow()
    order = np.argsort(got.column(0).to_numpy())
    return [got.column(c).to_numpy()[order] for c in table.columns]


def among(x: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of x are in the sorted keys, and the places there of those."""
    at = np.searchsorted(keys, x)
    found = at < len(keys)
    found[found] = keys[at[found]] == x[found]
    return found, at[found]
