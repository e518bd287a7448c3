"""Data set folders: per split the traces X, labels y and pool rows indices as arrays, and the samples' records as JSON.

A sample that lacks traces keeps its place: they are NaN in X, and its record names them as `absent`.
Arrays and records lie side by side and are read by one scan (`arrays.read_aligned`). Beside the splits lie
`label_scheme.json`, `split_metadata.json` and `manifest.csv`. A folder is built beside its place and renamed when it is
whole; one that exists, or that overlaps its source, is refused.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import class_names, scheme_tag
from ..operators import curation as C
from ..operators.curation import SPLITS, manifest_rows
from . import paths
from .arrays import FIELDS, read_aligned, write_aligned
from .files import manifests
from .scratch import shared_path

SCHEME = "thresholds_mm array<double>, num_classes int, tag string, class_names array<string>, label_rule string"
ARRAYS = [("values", "X.npy", "array<float>"), ("label", "y.npy", "int")]
POOL_ROW = ("pool_row", "indices.npy", "long")
RECORDS = "samples.json"
#: Fixed value: numbers of pool rows are below this; None lifts it.
POOL_ROWS = 10_000
#: Columns of a pool without its traces and the further keys of its records.
NARROW = ["split", "position", "label", "pool_row", "sample_id", "point_id", "depth_value", "source_label"]
#: Columns that tell all that changes when a data set is dealt anew.
PLACED = ["pool_row", "split", "position", "label", "source_label"]
#: Key of a record that names the traces (frame * channels + channel) a sample lacks; their places in the array hold NaN.
ABSENT = "absent"


def load_split(spark: SparkSession, folder: str, split: str, inner: tuple[int, int, int], pool_rows: bool = False, limit: int | None = POOL_ROWS, columns: list[str] | None = None) -> DataFrame:
    """(split, position, label, pool_row, sample_id, point_id, depth_value, source_label, extra, values) of a split; pool_row is null unless asked for.

    Arrays of another shape than [n, *inner], and parts of different numbers, raise; so do missing arrays, and pool rows
    beyond the limit when they are read. A missing samples.json (allowed without pool_rows) leaves the record's fields
    null. `extra` holds the further keys of a record as JSON. columns: only these are read."""
    return _loaded(spark, folder, [split], inner, pool_rows, limit, columns)


def _loaded(spark: SparkSession, folder: str, splits: list[str], inner: tuple[int, ...], pool_rows: bool, limit: int | None, columns: list[str] | None) -> DataFrame:
    folder = folder.rstrip("/")
    there = pool_rows or all(paths.exists(spark, f"{folder}/{s}/{RECORDS}") for s in splits)
    limits = {"pool_row": limit} if pool_rows and limit is not None else {}
    out = read_aligned(spark, folder, ARRAYS + [POOL_ROW] * pool_rows, splits, RECORDS if there else None, columns, {"values": tuple(inner)}, limits)
    absent = {"pool_row": "long"} | {c: kind for c, (kind, _) in FIELDS.items()} | {"extra": "map<string,string>"}
    out = out.withColumns({c: F.lit(None).cast(kind) for c, kind in absent.items() if c not in out.columns and (columns is None or c in columns)})
    order = [c for c in [*NARROW, "extra", "values"] if c in out.columns]
    return out.select(*order)


def load_pool(spark: SparkSession, folder: str, inner: tuple[int, int, int], limit: int | None = POOL_ROWS, columns: list[str] | None = None) -> DataFrame:
    """All splits of a folder as one scan, with their pool rows.

    Pool rows that do not count from 0 without gaps or repetitions, ids that are empty or repeated, and depths that are
    absent or not finite raise: they are counted by a scan of these columns alone."""
    checked = _loaded(spark, folder, list(SPLITS), inner, True, limit, ["pool_row", "sample_id", "depth_value"])
    problems = {k: v for k, v in C.pool_problems(checked).first().asDict().items() if k != "n_rows" and v}
    if problems:
        raise ValueError(f"{folder}: no sound pool: {problems}")
    return _loaded(spark, folder, list(SPLITS), inner, True, limit, columns)


def stacked(held: Column, frames: int, channels: int, points: int) -> list[Column]:
    """`values` and `extra` of a sample out of its traces, an array of (frame, channel, signal) in any order: those that it lacks are NaN, and its record names them."""
    one = lambda k: F.get(F.filter(held, lambda t: t["frame"] * channels + t["channel"] == k), F.lit(0))["signal"]
    every = F.sequence(F.lit(0), F.lit(frames * channels - 1))
    values = F.flatten(F.transform(every, lambda k: F.coalesce(one(k), F.array_repeat(F.lit(float("nan")), points))))
    absent = F.filter(every, lambda k: one(k).isNull())
    extra = F.when(F.size(absent) > 0, F.create_map(F.lit(ABSENT), F.to_json(absent)))
    return [values.alias("values"), extra.alias("extra")]


def absent(extra: Column) -> Column:
    """The traces that a sample lacks, by its record."""
    return F.coalesce(F.from_json(extra[ABSENT], "array<int>"), F.array().cast("array<int>"))


def total(values: Column, extra: Column, points: int) -> Column:
    """Sum over the values of the traces that a sample has."""
    gone = absent(extra)
    held = F.when(F.size(gone) > 0, F.filter(values, lambda x, i: ~F.array_contains(gone, F.floor(i / points).cast("int")))).otherwise(values)
    return F.aggregate(held, F.lit(0.0), lambda a, x: a + x)


def traces(rows: DataFrame, frames: int, channels: int, points: int) -> DataFrame:
    """rows with `values` as one row for each (frame, channel, signal); those that a sample lacks are left out where `extra` is among the columns."""
    every = F.sequence(F.lit(0), F.lit(frames * channels - 1))
    if "extra" in rows.columns:
        every = F.array_except(every, absent(F.col("extra")))
    each = F.transform(every, lambda k: F.struct(F.floor(k / channels).cast("int").alias("frame"), (k % channels).cast("int").alias("channel"), F.slice("values", k * points + 1, F.lit(points)).alias("signal")))
    return rows.select(*(c for c in rows.columns if c != "values"), F.explode(each).alias("t")).select(*(c for c in rows.columns if c != "values"), "t.*")


def _counts(spark: SparkSession, folder: str, inner: tuple[int, ...], classes: int) -> dict[str, dict[str, int]]:
    """Rows of each split and class as they lie in a folder, zeros included; other classes raise. What was written is counted, so a task that ran twice counts once."""
    label = F.when(F.col("label").between(0, classes - 1), F.col("label")).otherwise(-1)
    found = {(r.split, r.k): r["count"] for r in _loaded(spark, folder, list(SPLITS), inner, True, None, ["split", "label"]).groupBy("split", label.alias("k")).count().collect()}
    if strange := {s: n for (s, k), n in found.items() if k < 0}:
        raise ValueError(f"labels beyond the {classes} classes: {strange}")
    return {s: {str(k): found.get((s, k), 0) for k in range(classes)} for s in SPLITS}


def _arrays(rows: DataFrame, folder: str, inner: tuple[int, ...]) -> None:
    names = [c for c in [*NARROW, "extra", "values"] if c in rows.columns]
    kinds = {"label": "int", "pool_row": "long", "sample_id": "string", "point_id": "string", "depth_value": "double", "source_label": "int"}
    own = rows.select(*(F.col(c).cast(kinds[c]).alias(c) if c in kinds else F.col(c) for c in names))
    write_aligned(own, folder, [("values", "X.npy", "float32", tuple(inner)), ("label", "y.npy", "int64", ()), ("pool_row", "indices.npy", "int64", ())], list(SPLITS), RECORDS)


def _described(spark: SparkSession, folder: str, inner: tuple[int, ...], thresholds: list[float], method: str, seed: int, shares: dict[str, dict[str, int]], ratios: dict[str, float] | None, more: dict | None, scheme_more: dict | None) -> dict:
    """Writes scheme, metadata and manifest of the arrays in folder, and returns the metadata."""
    one = C.thresholds_of(thresholds)
    tag, names = spark.range(1).select(scheme_tag(one), class_names(one)).first()
    sizes = {s: sum(v.values()) for s, v in shares.items()}
    total = max(1, sum(sizes.values()))
    meta = {
        "method": method, "thresholds_mm": list(thresholds), "threshold_rule": "class = digitize(depth_value, thresholds); thresholds are inclusive lower bounds", "num_classes": len(names), "class_names": list(names),
        "random_seed": seed, "sample_counts": sizes, "actual_ratios": {s: n / total for s, n in sizes.items()}, "requested_ratios": ratios, "class_distribution": shares,
        "per_class_pool_counts": {name: sum(shares[s][str(k)] for s in SPLITS) for k, name in enumerate(names)}, "feature_shape": list(inner), "x_dtype": "float32", "y_dtype": "int64", "adc_dc_level_preserved": True,
    } | (more or {})
    scheme = {"thresholds_mm": list(thresholds), "num_classes": len(names), "tag": tag + ("_keepsplit" if method == "keep_source_split" else ""), "class_names": list(names), "label_rule": "label = digitize(depth_value, thresholds), thresholds inclusive"} | (scheme_more or {})
    for name, value in (("split_metadata.json", meta), ("label_scheme.json", scheme)):
        paths.write_text(spark, f"{folder}/{name}", json.dumps(value, ensure_ascii=False))
    write_manifest(_loaded(spark, folder, list(SPLITS), inner, True, None, NARROW), f"{folder}/manifest.csv")
    return meta


def _build(spark: SparkSession, folder: str, sources: list[str], make: Callable[[str], dict]) -> dict:
    """make(path) builds a folder beside its place; it is renamed when that has ended, and goes when it fails."""
    staged = paths.staging(spark, folder.rstrip("/"), sources)
    try:
        out = make(staged)
        paths.rename(spark, staged, folder.rstrip("/"))
    except BaseException:
        paths.delete(spark, staged)
        raise
    return out


def write_dataset(
    rows: DataFrame, folder: str, inner: tuple[int, int, int], thresholds: list[float], method: str = "stratified", seed: int = 42,
    ratios: dict[str, float] | None = None, sources: list[str] = (), more: dict | None = None,
) -> dict:
    """A folder from rows (split, position, label, source_label, pool_row, sample_id, depth_value, values, perhaps point_id and extra); returns its metadata.

    Positions count from 0 in each split, else it raises; rows of a split that is none, or of a class beyond the
    thresholds, raise too. The scheme's tag ends in _keepsplit where the source's split was kept."""
    spark = rows.sparkSession

    def make(staged: str) -> dict:
        _arrays(rows, staged, inner)
        return _described(spark, staged, inner, thresholds, method, seed, _counts(spark, staged, inner, len(thresholds) + 1), ratios, more, None)

    return _build(spark, folder, list(sources), make)


def _with_traces(spark: SparkSession, source: str, placed: DataFrame, inner: tuple[int, ...], limit: int | None) -> DataFrame:
    """The pool's traces and records with the columns PLACED of placed, by pool row."""
    whole = _loaded(spark, source, list(SPLITS), inner, True, limit, ["pool_row", "sample_id", "point_id", "depth_value", "extra", "values"])
    return whole.join(placed.select(*PLACED), "pool_row")


def relabel_dataset(
    spark: SparkSession, source: str, folder: str, inner: tuple[int, int, int], thresholds: list[float], ratios: dict[str, float] | None = None, seed: int = 42,
    keep_source_split: bool = False, min_per_split: int = 1, allow_small_classes: bool = False, limit: int | None = POOL_ROWS,
) -> dict:
    """A whole folder into a new one: labels by other thresholds, splits dealt anew by the ratios or kept, and a report beside it. Returns the report.

    Labels, splits and ranks are worked out on the narrow columns; the traces are read once, meet them by pool row, and
    keep their bytes. The further keys of records stay. Nothing is left behind by a class too small for the splits, a
    pool that is not sound, or an output that exists or overlaps its source."""

    def make(staged: str) -> dict:
        pool = load_pool(spark, source, inner, limit, NARROW)
        own = C.labelled(pool.drop("source_label").withColumnRenamed("label", "source_label"), thresholds)
        report = pool_report(own, thresholds)
        if keep_source_split:
            placed, method = own, "keep_source_split"
        else:
            dealt = C.stratified_split(own.drop("split", "position"), ratios, seed, min_per_split=min_per_split, allow_small_classes=allow_small_classes)
            placed, method = C.keep_split(dealt).withColumnRenamed("split_rank", "position"), "stratified_random_split"
        at = shared_path(spark, "placed")  # read twice: by the join and for its statistics
        placed.select(*PLACED).write.parquet(at)
        _arrays(_with_traces(spark, source, spark.read.parquet(at), inner, limit), staged, inner)
        _described(spark, staged, inner, thresholds, method, seed, _counts(spark, staged, inner, len(thresholds) + 1), ratios, {"source_dir": source, "source_split_counts": report["source_split_counts"], "source_total_samples": report["total_samples"]}, None)
        paths.write_text(spark, f"{staged}/relabel_report.json", json.dumps(report, ensure_ascii=False))
        return report

    return _build(spark, folder, [source], make)


def pool_report(pool: DataFrame, thresholds: list[float]) -> dict:
    """Counts, shares and depths of each class and split of a pool (label, source_label, split, depth_value), whether its classes are large enough, and how many labels stay."""
    names = pool.sparkSession.range(1).select(class_names(C.thresholds_of(thresholds))).first()[0]
    cells = pool.groupBy("label", "split").agg(F.count("*").alias("n"), F.min("depth_value").alias("low"), F.max("depth_value").alias("high"), F.count_if(F.col("label") == F.col("source_label")).alias("agree")).collect()  # classes times splits
    total = sum(c.n for c in cells)
    each = []
    for k, name in enumerate(names):
        own = [c for c in cells if c.label == k]
        n = sum(c.n for c in own)
        each.append({"label": k, "name": name, "count": n, "share": n / total if total else 0.0, "depth_min": min((c.low for c in own), default=None), "depth_max": max((c.high for c in own), default=None), "per_split": {s: sum(c.n for c in own if c.split == s) for s in SPLITS}})
    agree, least = sum(c.agree for c in cells), min(e["count"] for e in each)
    return {
        "thresholds": list(thresholds), "num_classes": len(names), "class_names": list(names), "total_samples": total, "depth_range": [min((c.low for c in cells), default=None), max((c.high for c in cells), default=None)], "per_class": each,
        "source_split_counts": {s: sum(c.n for c in cells if c.split == s) for s in SPLITS}, "old_label_matches_thresholds": agree == total, "label_agreement_with_source": agree / total if total else None,
        "smallest_class": least, "is_tiny": least * 0.25 < 2,
    }


def freeze_dataset(spark: SparkSession, source: str, folder: str, manifest: str, inner: tuple[int, int, int], limit: int | None = POOL_ROWS) -> dict:
    """A new folder with the splits and row order of a frozen manifest, or none: whatever does not match raises. Returns the metadata.

    First the ids of manifest and pool are compared, without traces: ids that only one side has or that are given more
    than once, and names of splits. Then the arrays are written beside their place and their classes counted there,
    split by split, against the manifest's counts; the folder is renamed only if these are equal."""
    head = _manifest_head(spark, manifest)
    thresholds, classes = list(head["thresholds_mm"]), int(head["num_classes"])
    wanted = {s: {k: int(n) for k, n in v.items()} for s, v in head["class_distribution"].items()}
    if set(wanted) != set(SPLITS) or len(thresholds) + 1 != classes:
        raise ValueError(f"{manifest}: class counts of {sorted(wanted)} and {len(thresholds)} thresholds do not fit {classes} classes of {SPLITS}")

    def make(staged: str) -> dict:
        pool = load_pool(spark, source, inner, limit, ["pool_row", "sample_id", "label", "depth_value"]).withColumnRenamed("label", "source_label")
        ids = manifests(spark.read.text(manifest, wholetext=True), "value").groupBy("sample_id").agg(F.min(F.struct("split", "position")).alias("m"), F.count("*").alias("copies"))
        both = C.labelled(pool, thresholds).withColumn("held", F.lit(True)).join(ids.select("sample_id", "m.*", "copies"), "sample_id", "full")
        at = shared_path(spark, "aligned")
        both.write.parquet(at)
        both = spark.read.parquet(at)
        marks = {"missing": F.col("held").isNull(), "extra": F.col("copies").isNull(), "repeated": F.col("copies") > 1, "of no split": ~F.col("split").isin(*SPLITS)}
        found = both.agg(*(F.count_if(c).alias(k) for k, c in marks.items()), *(F.count_if(F.col("split") == s).alias(s) for s in SPLITS)).first().asDict()
        wrong = {k: found[k] for k in marks if found[k]} | {s: "empty" for s in SPLITS if not found[s]}
        if wrong:
            raise ValueError(f"pool and manifest do not match: {wrong}")
        _arrays(_with_traces(spark, source, both.withColumn("position", F.col("position").cast("long")), inner, limit), staged, inner)
        counts = _counts(spark, staged, inner, classes)
        if counts != wanted:
            raise ValueError(f"labels disagree with the manifest's class counts: {counts}, expected {wanted}")
        kept = {k: head[k] for k in ("tag", "display_name") if head.get(k) is not None}
        more = {"reference_split": {"manifest_name": manifest.rstrip("/").rpartition("/")[2], "match_key": "sample_id"}, "source_dir": source}
        meta = _described(spark, staged, inner, thresholds, "reference_sample_ids", int(head.get("seed") or 0), counts, head.get("ratios"), more, kept)
        spark.read.text(manifest, wholetext=True).write.text(f"{staged}/reference_split_manifest.json")
        return meta

    return _build(spark, folder, [source], make)


def _manifest_head(spark: SparkSession, path: str) -> dict:
    """What a manifest says beside its ids; another version than 1 raises."""
    kind = "schema_version int, num_classes int, thresholds_mm array<double>, class_distribution map<string,map<string,long>>, tag string, display_name string, seed long, ratios array<double>"
    one = spark.read.text(path, wholetext=True).select(F.from_json("value", kind).alias("m")).first()
    head = one["m"].asDict() if one and one["m"] else {}
    if head.get("schema_version") != 1 or not head.get("thresholds_mm") or head.get("num_classes") is None or not head.get("class_distribution"):
        raise ValueError(f"{path}: no manifest of version 1 with thresholds and class counts")
    return head


def write_manifest(rows: DataFrame, path: str) -> None:
    """CSV with headers, sorted by the splits' order and the pool row over the parts of the folder; depths with four decimals."""
    placed = manifest_rows(rows).repartitionByRange("split_order", "pool_row").sortWithinPartitions("split_order", "pool_row")
    placed.drop("split_order").write.option("header", True).csv(path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("split string, pool_row long, sample_id string, depth string, source_label int, label int").option("header", True).csv(path)


def label_scheme(spark: SparkSession, folder: str) -> DataFrame:
    """The scheme of a folder: one row, or none where the file is absent or holds no JSON object. A file system that does not answer raises."""
    path = f"{folder.rstrip('/')}/label_scheme.json"
    if not paths.exists(spark, path):
        return spark.createDataFrame([], SCHEME)
    texts = spark.read.text(path, wholetext=True)
    return texts.select(F.from_json(F.trim("value"), SCHEME).alias("s")).where("s.thresholds_mm is not null or s.tag is not null or s.num_classes is not null").select("s.*")
