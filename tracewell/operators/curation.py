"""Data-set curation: pools, label schemes, splits, manifests."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.ranks import hash_bucket, hash_ranked, ranked
from ..functions.scalars import digitize, half_up
from ..sources.scratch import shared_path

SPLITS = ("train", "val", "test")


def thresholds_of(values: list[float]) -> Column:
    return F.array(*(F.lit(float(v)) for v in values))


def labelled(pool: DataFrame, thresholds: list[float], name: str = "label") -> DataFrame:
    return pool.withColumn(name, digitize(F.col("depth_value"), thresholds_of(thresholds)))


def split_union(parts: dict[str, DataFrame]) -> DataFrame:
    """Rows of several splits with the split's name."""
    frames = [df.withColumn("split", F.lit(name)) for name, df in parts.items()]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def pool_problems(pool: DataFrame) -> DataFrame:
    """One row of counts, all zero for a sound pool: rows, duplicate rows, gaps, bad depths, empty and duplicate ids."""
    per_id = pool.groupBy("sample_id").agg(F.count("*").alias("n"))
    per_row = pool.groupBy("pool_row").agg(F.count("*").alias("n"))
    bad = ~F.coalesce(F.abs("depth_value") < F.lit(math.inf), F.lit(False))  # null, NaN and infinities
    empty = F.col("sample_id").isNull() | (F.col("sample_id").cast("string") == "")
    one = pool.agg(F.count("*").alias("n_rows"), F.count_if(bad).alias("bad_depth"), F.count_if(empty).alias("empty_ids"), F.max("pool_row").alias("top"), F.min("pool_row").alias("low"))
    rows = per_row.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_rows"), F.count("*").alias("k"))
    ids = per_id.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_ids"))
    gaps = F.greatest(F.col("top") + 1 - F.col("k"), F.lit(0)) + F.when(F.col("low") < 0, 1).otherwise(0)
    return one.crossJoin(rows).crossJoin(ids).select("n_rows", "duplicate_rows", gaps.alias("gaps"), "bad_depth", "empty_ids", "duplicate_ids")  # three tables of one row


def pool_tiling(pool: DataFrame, total: int) -> DataFrame:
    """Rows of range(total) that the pool lacks, rows beyond it, and rows held more than once."""
    whole = pool.sparkSession.range(total).select(F.col("id").alias("pool_row"))
    per = pool.groupBy("pool_row").agg(F.count("*").alias("n"))
    both = whole.withColumn("wanted", F.lit(True)).join(per, "pool_row", "full")
    what = F.when(F.col("n").isNull(), "missing").when(F.col("wanted").isNull(), "extra").when(F.col("n") > 1, "duplicate")
    return both.select("pool_row", what.alias("problem")).where("problem is not null")


def keep_split(pool: DataFrame) -> DataFrame:
    """The split as it was, with the place of each row in it."""
    return ranked(pool, ["split"], ["pool_row"], "split_rank").withColumn("split_rank", F.col("split_rank") - 1).drop("split_rank_of")


def limit_split(pool: DataFrame, n: int) -> DataFrame:
    """The first n rows of every split in stored order."""
    return keep_split(pool).where(F.col("split_rank") < n)


def allocate_counts(counts: DataFrame, ratios: dict[str, float], by: str = "label") -> DataFrame:
    """(by, split, exact, allocated): shares of n by the largest remainder, ties to the earlier split."""
    shares = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(s).alias("split"), F.lit(r).alias("ratio")) for i, (s, r) in enumerate(ratios.items())))
    rows = counts.select(by, "n", F.explode(shares).alias("s")).select(by, "n", "s.*").withColumn("exact", F.col("n") * F.col("ratio"))
    floor = F.floor("exact")
    left = F.col("n") - F.sum(floor).over(W.partitionBy(by))
    order = F.row_number().over(W.partitionBy(by).orderBy((F.col("exact") - floor).desc(), "i"))
    return rows.withColumn("left", left).withColumn("order", order).select(by, "i", "split", "exact", (floor + (F.col("order") <= F.col("left")).cast("long")).alias("allocated"))


def seeded(seed: int, key: str = "sample_id") -> Column:
    """The hash that shuffles rows: equal for equal seeds and keys."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")).cast("binary"))


def stratified_split(pool: DataFrame, ratios: dict[str, float], seed: int, by: str = "label", min_per_split: int = 1, allow_small_classes: bool = False) -> DataFrame:
    """pool with `split`: each class is shuffled by a seeded hash and cut by its allocated counts.

    A class that would give a split after the first fewer than min_per_split rows raises, unless small classes are allowed."""
    at = shared_path(pool.sparkSession, "pool")  # read three times; and the optimizer fails on joins by a label that is still an expression
    pool.drop("split").write.parquet(at)
    pool = pool.sparkSession.read.parquet(at)
    rows = pool.withColumn("_key", seeded(seed))
    rows = hash_ranked(rows, [by], hash_bucket(F.col("_key")), ["_key", "sample_id"], "_rank")
    per_split = allocate_counts(pool.groupBy(by).agg(F.count("*").alias("n")), ratios, by)
    if not allow_small_classes and (small := per_split.where((F.col("i") > 0) & (F.col("allocated") < min_per_split)).orderBy(by, "i").limit(1).collect()):
        raise ValueError(f"class {small[0][by]} would have {small[0].allocated} rows in {small[0].split}, fewer than {min_per_split}")
    upto = per_split.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("i", "split", "allocated"))).alias("cuts"))
    ends = F.transform("cuts", lambda c, k: F.struct(c["split"].alias("split"), F.aggregate(F.slice("cuts", 1, k + 1), F.lit(0).cast("long"), lambda a, x: a + x["allocated"]).alias("end")))
    first = F.get(F.filter("ends", lambda e: F.col("_rank") <= e["end"]), F.lit(0))["split"]
    return rows.join(upto.select(by, ends.alias("ends")), by).withColumn("split", first).drop("_key", "_rank", "ends")


def class_sample(pool: DataFrame, n: int, seed: int, by: str = "label") -> DataFrame:
    """n rows of each class by a seeded hash; classes with fewer give all they have and `short` tells."""
    rows = hash_ranked(pool.withColumn("_key", seeded(seed)), [by], hash_bucket(F.col("_key")), ["_key", "sample_id"], "_rank").where(F.col("_rank") <= n)
    return rows.withColumn("short", F.count("*").over(W.partitionBy(by)) < n).drop("_key", "_rank")


def class_counts(pool: DataFrame, classes: int, splits: tuple[str, ...] = SPLITS) -> DataFrame:
    """Rows, share and depth range of each split and class, empty cells too."""
    spark = pool.sparkSession
    cells = spark.range(classes).select(F.col("id").cast("int").alias("label"), F.explode(F.array(*(F.lit(s) for s in splits))).alias("split"))
    found = pool.groupBy("split", "label").agg(F.count("*").alias("n"), F.min("depth_value").alias("depth_min"), F.max("depth_value").alias("depth_max"))
    out = cells.join(found, ["split", "label"], "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))
    total = F.sum("n").over(W.partitionBy("split"))
    return out.select("split", "label", "n", (F.col("n") / F.greatest(total, F.lit(1))).alias("share"), "depth_min", "depth_max")


def relabel_report(pool: DataFrame, old: str, new: str, tiny: int) -> DataFrame:
    """Smallest class, whether it is tiny, and how many labels agree with the old ones; one row."""
    sizes = pool.groupBy(new).agg(F.count("*").alias("n"))
    least = sizes.agg(F.min(F.struct("n", new)).alias("m"), F.count("*").alias("classes"))
    match = pool.agg(F.count_if(F.col(old) == F.col(new)).alias("agree"), F.count("*").alias("n_rows"))
    return least.crossJoin(match).select(F.col(f"m.{new}").alias("smallest_class"), F.col("m.n").alias("smallest_n"), (F.col("m.n") < tiny).alias("is_tiny"), "classes", "agree", "n_rows")  # one row each


def manifest_align(manifest: DataFrame, pool: DataFrame) -> DataFrame:
    """Rows of a frozen manifest (split, position, sample_id) with their pool columns."""
    return manifest.join(pool.drop("split"), "sample_id")


def missing_extra(manifest: DataFrame, pool: DataFrame) -> DataFrame:
    """Ids that only one side has, and ids that the manifest gives more than once."""
    missing = manifest.join(pool, "sample_id", "left_anti").select("sample_id", F.lit("missing").alias("problem")).distinct()
    extra = pool.join(manifest, "sample_id", "left_anti").select("sample_id", F.lit("extra").alias("problem")).distinct()
    twice = manifest.groupBy("sample_id").count().where("count > 1").select("sample_id", F.lit("duplicate").alias("problem"))
    return missing.union(extra).union(twice)


def class_check(wanted: DataFrame, found: DataFrame) -> DataFrame:
    """Cells (split, label) where wanted and found counts differ."""
    both = wanted.withColumnRenamed("n", "wanted").join(found.withColumnRenamed("n", "found"), ["split", "label"], "full")
    return both.select("split", "label", F.coalesce("wanted", F.lit(0)).alias("wanted"), F.coalesce("found", F.lit(0)).alias("found")).where("wanted <> found")


def class_count_dev(pool: DataFrame) -> DataFrame:
    """Number of classes, from development splits only."""
    return pool.where(F.col("split").isin("train", "val")).agg((F.max("label") + 1).alias("num_classes"))


def manifest_rows(pool: DataFrame) -> DataFrame:
    """Text rows of a manifest: depth with four decimals, and the place of the split in the fixed order to sort by. Without a source_label the label is its own source."""
    place = F.array_position(F.array(*(F.lit(s) for s in SPLITS)), F.col("split"))
    source = F.col("source_label") if "source_label" in pool.columns else F.col("label")
    depth = F.format_string("%.4f", half_up(F.col("depth_value") * 10000) / 10000)
    return pool.select(place.cast("int").alias("split_order"), "split", "pool_row", "sample_id", depth.alias("depth"), source.cast("int").alias("source_label"), "label")
