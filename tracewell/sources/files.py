"""JSON documents and listings of experiment folders."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import recorded_tag
from . import paths

MANIFEST = "schema_version int, num_classes int, thresholds_mm array<double>, splits map<string,array<string>>"
CANDIDATES = "configurations array<struct<id:string,parameters:map<string,double>>>"


def texts(spark: SparkSession, pattern: str) -> DataFrame:
    """(path, value): whole text files, for folders read at a given depth by a pattern."""
    return spark.read.text(pattern, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")


#: Name of the table that holds the small files of a packed folder.
PACKED = "packed.parquet"


def pack(rows: DataFrame, root: str) -> None:
    """rows (path below root, value: the whole text) as a packed folder: many small files in few large ones, so that no work goes by the number of files."""
    rows.select("path", "value").write.parquet(f"{root.rstrip('/')}/{PACKED}")


def packed(spark: SparkSession, root: str) -> DataFrame | None:
    """(path, value) of the files in a packed folder, with root before their paths; None where the folder is not packed."""
    root = root.rstrip("/")
    if not paths.exists(spark, f"{root}/{PACKED}"):
        return None
    rows = spark.read.schema("path string, value string").parquet(f"{root}/{PACKED}")
    return rows.select(F.concat(F.lit(f"{root}/"), "path").alias("path"), "value")


def below(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    """(path, value) of the texts below root that a pattern names, where * stands for part of a name; the folder may be packed."""
    root = root.rstrip("/")
    rows = packed(spark, root)
    if rows is None:
        return texts(spark, f"{root}/{pattern}")
    return rows.where(F.col("path").rlike("^" + re.escape(f"{root}/") + "[^/]*".join(map(re.escape, pattern.split("*"))) + "$"))


def folder(path: Column) -> Column:
    return F.regexp_replace(path, "/[^/]+$", "")


def manifests(df: DataFrame, text: str) -> DataFrame:
    """df exploded to (split, position, sample_id) of frozen manifests, with `sound`: version 1 and as many classes as thresholds make."""
    m = df.withColumn("_m", F.from_json(text, MANIFEST))
    sound = F.coalesce((F.col("_m.schema_version") == 1) & (F.col("_m.num_classes") == F.size("_m.thresholds_mm") + 1), F.lit(False))
    each = m.withColumn("sound", sound).select(*(c for c in df.columns if c != text), "sound", F.explode("_m.splits").alias("split", "ids"))
    return each.select(*(c for c in each.columns if c != "ids"), F.posexplode("ids").alias("position", "sample_id"))


def candidates(df: DataFrame, text: str) -> DataFrame:
    """df exploded to (id, parameters) of candidate files."""
    c = df.select(*(c for c in df.columns if c != text), F.explode(F.from_json(text, CANDIDATES)["configurations"]).alias("c"))
    return c.select(*(x for x in c.columns if x != "c"), "c.id", "c.parameters")


def candidate_files(spark: SparkSession, folder: str) -> DataFrame:
    """(file, method, id, parameters) of every *top15.json of a folder, which may be packed."""
    kind = "method string, configurations array<struct<id:string,parameters:map<string,double>>>"
    t = below(spark, folder, "*top15.json").select(F.regexp_extract("path", "/(?:[^/=]*=)?([^/=]*top15[.]json)", 1).alias("file"), F.from_json("value", kind).alias("c"))
    return t.select("file", "c.method", F.explode("c.configurations").alias("x")).select("file", "method", "x.*")


#: Fixed value: the layout of runs that are listed.
LAYOUT = "headsim_cubic"
CONFIG = "feature_layout string, model_family string, label_scheme struct<tag:string,thresholds_mm:array<string>>, num_classes int, form string, region_name string, channel_mode string, data_dir string"
METRICS = "metrics map<string,map<string,double>>, feature_dim int, best_epoch int, trained_epochs int"
HISTORY = "array<struct<epoch:int,learning_rate:double,train_loss:double,val_loss:double,val_auc:double,val_accuracy:double>>"


def run_folders(spark: SparkSession, root: str) -> DataFrame:
    """One row for each run's folder: its config.json, metrics.json and history.json. Folders without a config of LAYOUT or without metrics are left out, and an unreadable history is empty. The root may be packed."""

    def part(name: str) -> DataFrame:
        t = below(spark, root, f"*/*{name}.json")
        return t.select(F.regexp_extract("path", f"/(?:[^/=]*=)?([^/]+)/(?:[^/=]*=)?{name}[.]json", 1).alias("name"), F.col("value").alias(name))

    config, metrics = F.from_json("config", CONFIG), F.from_json("metrics", METRICS)
    runs = part("config").withColumn("c", config).where(F.col("c.feature_layout") == LAYOUT)
    runs = runs.join(part("metrics").withColumn("m", metrics).where(F.size("m.metrics") > 0), "name").join(part("history"), "name", "left")
    scheme = F.col("c.label_scheme")
    return runs.select(
        "name", F.coalesce("c.model_family", F.lit("emd")).alias("model_family"), recorded_tag(scheme["tag"], scheme["thresholds_mm"]).alias("label_tag"), "c.num_classes", "c.form",
        F.col("c.region_name").alias("region"), F.col("c.channel_mode").alias("channel"), "c.data_dir", "m.feature_dim", "m.best_epoch", "m.trained_epochs",
        F.coalesce(F.from_json("history", HISTORY), F.array().cast(HISTORY)).alias("history"), F.col("m.metrics").alias("metrics"),
    )


#: Fixed value: the threshold of data sets that record none.
DEFAULT_THRESHOLDS = (1.0,)


def discover(spark: SparkSession, root: str, base: str | None = None) -> DataFrame:
    """(place, data_dir, thresholds, num_classes, tag) of the data sets: the base folder first, if it is there, with a scheme or without; then each folder below root that carries a label_scheme.json.

    An unreadable scheme counts as none recorded, an absent root as empty, and a folder met twice as one."""
    named = "/([^/]+)/(?:[^/=]*=)?label_scheme[.]json"
    pattern, base = f"{root.rstrip('/')}/*/*label_scheme.json", paths.qualified(spark, base) if base else None
    found = spark.createDataFrame([], "path string, value string")
    if paths.matches(spark, pattern):
        found = texts(spark, pattern)
    rows = found.select(F.regexp_extract("path", f"^(.*){named}", 1).alias("above"), F.regexp_extract("path", named, 1).alias("data_dir"), "value", F.lit(1).alias("place"))
    if base and paths.exists(spark, base):
        above, _, name = base.rpartition("/")
        own = texts(spark, f"{base}/label_scheme.json").select("value") if paths.exists(spark, f"{base}/label_scheme.json") else spark.createDataFrame([(None,)], "value string")
        same = F.regexp_replace(F.concat_ws("/", "above", "data_dir"), "^file:/+", "file:/") == F.regexp_replace(F.lit(base), "^file:/+", "file:/")
        rows = rows.where(~same).unionByName(own.select(F.lit(above).alias("above"), F.lit(name).alias("data_dir"), "value", F.lit(0).alias("place")))
    s = rows.select("place", "above", "data_dir", F.from_json(F.trim("value"), "thresholds_mm array<string>, tag string").alias("s")).dropDuplicates(["above", "data_dir"])
    numbers = F.filter(F.transform("s.thresholds_mm", lambda x: x.try_cast("double")), lambda x: x.isNotNull())
    none = F.col("s.thresholds_mm").isNull() & F.col("s.tag").isNull()
    thresholds = F.when(none, F.array(*(F.lit(x) for x in DEFAULT_THRESHOLDS))).otherwise(F.coalesce(numbers, F.array().cast("array<double>")))
    classes = F.when(F.size(thresholds) > 0, F.size(thresholds) + 1).otherwise(2)
    return s.select("place", "data_dir", thresholds.alias("thresholds"), classes.alias("num_classes"), recorded_tag(F.col("s.tag"), F.col("s.thresholds_mm")).alias("tag"))


def label_schemes(df: DataFrame, text: str) -> DataFrame:
    """df with `thresholds` and `tag` of a scheme's text; both null where it is absent or corrupt."""
    s = F.from_json(text, "thresholds_mm array<double>, tag string")
    return df.withColumn("thresholds", s["thresholds_mm"]).withColumn("tag", s["tag"]).drop(text)


def file_hashes(spark: SparkSession, path: str, name: str = "/([^/]+)$") -> DataFrame:
    """(path, sha256) of every file under a folder; `name` is the part of a path by which files are told apart. The folder may be packed."""
    rows = packed(spark, path)
    if rows is not None:
        return rows.select(F.regexp_extract("path", name, 1).alias("path"), F.sha2(F.col("value").cast("binary"), 256).alias("sha256"))
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return found.select(F.regexp_extract("path", name, 1).alias("path"), F.sha2("content", 256).alias("sha256"))


def changed_hashes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Paths whose hash differs, or that only one side has."""
    both = old.withColumnRenamed("sha256", "old").join(new.withColumnRenamed("sha256", "new"), "path", "full")
    return both.where(~F.col("old").eqNullSafe(F.col("new")))
