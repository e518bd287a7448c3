"""Guarded writers. A table is written beside its place and then renamed, so a reader sees all of it or nothing."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, DecimalType, DoubleType, FloatType, MapType, StructType


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def inside(a: str, b: str) -> bool:
    """Whether one path is the other or lies in it."""
    a, b = a.rstrip("/") + "/", b.rstrip("/") + "/"
    return a.startswith(b) or b.startswith(a)


def publish(df: DataFrame, path: str, sources: list[str] = (), overwrite: bool = False, by: list[str] = (), kind: str = "parquet") -> None:
    """Write df to path. Refuses a path that overlaps a source, and an existing one unless overwrite is set."""
    spark = df.sparkSession
    for s in sources:
        if inside(path, s):
            raise ValueError(f"output {path} overlaps source {s}")
    fs, target = _fs(spark, path)
    if fs.exists(target) and not overwrite:
        raise FileExistsError(path)
    staged = f"{path.rstrip('/')}.{uuid.uuid4().hex}"
    df.write.partitionBy(*by).format(kind).save(staged)
    # The old table is moved aside before, and goes after: a failure in between loses neither.
    aside = _fs(spark, f"{path.rstrip('/')}.old-{uuid.uuid4().hex}")[1]
    old = fs.exists(target)
    if old and not fs.rename(target, aside):
        raise OSError(f"could not move {path} aside")
    if not fs.rename(_fs(spark, staged)[1], target):
        if old:
            fs.rename(aside, target)
        raise OSError(f"could not move {staged} to {path}")
    if old:
        fs.delete(aside, True)


def canonical(value: Column, kind: DataType) -> Column:
    """value in one form: fields of structs by name, entries of maps by key, whole floating numbers as integers, NaN as null."""
    if isinstance(kind, StructType):
        inner = F.struct(*(canonical(value[f.name], f.dataType).alias(f.name) for f in sorted(kind.fields, key=lambda f: f.name)))
        return F.when(value.isNotNull(), inner)
    if isinstance(kind, ArrayType):
        return F.transform(value, lambda x: canonical(x, kind.elementType))
    if isinstance(kind, MapType):
        return F.array_sort(F.transform(F.map_entries(value), lambda e: F.struct(e["key"].cast("string").alias("key"), F.to_json(F.struct(canonical(e["value"], kind.valueType).alias("v"))).alias("value"))))
    if isinstance(kind, DecimalType):
        return canonical(value.cast("double"), DoubleType())
    if isinstance(kind, (FloatType, DoubleType)):
        whole = (value == F.floor(value)) & (F.abs(value) < 1e15)
        return F.when(F.isnan(value), None).when(whole, value.cast("long").cast("string")).otherwise(value.cast("string"))
    return value.cast("string")


def config_hash(df: DataFrame, *names: str) -> Column:
    """Hash of a run's settings, columns of df, whatever the order in which they are given and however numbers are written."""
    parts = [F.coalesce(F.to_json(F.struct(canonical(F.col(n), df.schema[n].dataType).alias(n))), F.lit("")) for n in sorted(names)]
    return F.sha2(F.concat_ws("\n", *parts), 256)


def may_run(wanted: DataFrame, done: DataFrame, by: tuple[str, ...] = ("name",)) -> DataFrame:
    """Runs (name, hash) that are new, with `conflict` where a saved run of that name has another hash; equal ones drop out.

    by: the columns that tell runs apart, where names alone may repeat."""
    both = wanted.join(done.select(*by, F.col("hash").alias("saved")), [*by], "left")
    return both.where(~F.col("hash").eqNullSafe(F.col("saved"))).select("name", F.col("saved").isNotNull().alias("conflict"))


def labelled_probs(labels: DataFrame, probs: DataFrame) -> DataFrame:
    """labels (sample_id, label) beside the probability arrays (sample_id, probs) of the same samples; an id that one side lacks or has twice raises, as does an array of another length than the first one's.

    Only ids and sizes are compared beforehand; the arrays move once, for the join."""
    sides = labels.select("sample_id", F.lit(1).alias("l"), F.lit(0).alias("p"), F.lit(None).cast("int").alias("size")).unionByName(probs.select("sample_id", F.lit(0).alias("l"), F.lit(1).alias("p"), F.size("probs").alias("size")))
    each = sides.groupBy("sample_id").agg(F.sum("l").alias("l"), F.sum("p").alias("p"), F.min("size").alias("low"), F.max("size").alias("high"))
    found = each.agg(F.count_if((F.col("l") != 1) | (F.col("p") != 1) | F.col("sample_id").isNull()).alias("unmatched"), F.min("low").alias("low"), F.max("high").alias("high")).first()
    if found["unmatched"] or found["low"] != found["high"]:
        raise ValueError(f"labels and probabilities do not match: {found['unmatched']} ids, arrays of {found['low']} to {found['high']} classes")
    return labels.select("sample_id", "label").join(probs.select("sample_id", "probs"), "sample_id")


def prediction_rows(df: DataFrame) -> DataFrame:
    return df.select("sample_id", "label", "prediction", F.format_string("%.6f", F.floor(F.col("p1") * 1e6 + 0.5) / 1e6).alias("probability_label1"))
