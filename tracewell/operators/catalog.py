"""Catalogue of experiments and audits of data sets.

Tables: experiments (name, model_family, form, region, channel, label_tag, data_dir, metrics...), images (file).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ranks
from ..functions.scalars import rate_problem
from .spans import RANGES, wrong

#: Fixed value: the pattern of a preprocessing image's name.
IMAGE = r"^form_(.+?)__regions_(.+?)__channels_([1234])__class_(imminent|safe|label\d+)__headsim_cubic\.png$"
#: Parameters of the transformer, and their presets.
PARAMETERS = {
    "patch_size": "int", "dim": "int", "depth": "int", "heads": "int", "mlp_dim": "int",
    "dropout": "double", "learning_rate": "double", "weight_decay": "double", "batch_size": "int", "warmup_epochs": "int",
}
PRESETS = {
    "legacy": (8, 256, 3, 2, 512, 0.1, 3e-4, 0.05, 8, 5),
    "baseline_top1": (16, 64, 4, 8, 256, 0.1, 3e-4, 0.05, 4, 5),
    "six_channel_top1": (8, 256, 4, 4, 1024, 0.1, 1e-3, 0.02, 24, 5),
    "beam_vote_top1": (8, 256, 4, 4, 512, 0.25, 1e-3, 0.01, 4, 5),
    "six_channel_beam_vote_top1": (8, 256, 2, 4, 1024, 0.4, 3e-4, 0.0, 4, 5),
}
#: Where a preset comes from (file, method, id, position in the file).
PRESET_PACKAGE = "ViT_reference/top15_hyperparameters_test_accuracy_20261024"
PRESET_ORIGINS = {
    "baseline_top1": ("01_baseline_top15.json", "baseline", "random_0047", 1),
    "six_channel_top1": ("03_six_channel_top15.json", "six_channel", "random_0048", 1),
    "beam_vote_top1": ("04_beam_vote_top15.json", "beam_vote", "random_0096", 1),
    "six_channel_beam_vote_top1": ("05_six_channel_beam_vote_top15.json", "six_channel_beam_vote", "random_0086", 1),
}


def selected(df: DataFrame, **wanted: str) -> DataFrame:
    """Rows that equal every wanted value; `all` asks for nothing."""
    for column, value in wanted.items():
        if value != "all":
            df = df.where(F.col(column) == value)
    return df


def valid_history(df: DataFrame, epoch: str, loss: str) -> DataFrame:
    """Rows of text columns with a positive epoch and a number for a loss, as numbers."""
    e, l = F.col(epoch).try_cast("int"), F.col(loss).try_cast("double")
    return df.withColumn(epoch, e).withColumn(loss, l).where((F.col(epoch) > 0) & F.col(loss).isNotNull() & ~F.isnan(loss))


def resolve_classes(wanted: DataFrame, observed: DataFrame, classes: int) -> DataFrame:
    """Requested labels with their problem, if any: out_of_range, repeated or no_support."""
    n = wanted.groupBy("label").agg(F.count("*").alias("n"))
    seen = observed.select("label").distinct().withColumn("seen", F.lit(True))
    what = F.when((F.col("label") < 0) | (F.col("label") >= classes), "out_of_range").when(F.col("n") > 1, "repeated").when(F.col("seen").isNull(), "no_support").otherwise("ok")
    return n.join(seen, "label", "left").select("label", what.alias("status"))


def preset_of(preset: Column, variant: Column, region_set: Column) -> Column:
    """The preset that `auto` stands for, by model variant and region set; another name stays."""
    whole = region_set == "dyn_envelope_full"
    auto = F.when(variant == "cross_vote", F.when(whole, "six_channel_beam_vote_top1").otherwise("beam_vote_top1")).otherwise(F.when(whole, "six_channel_top1").otherwise("baseline_top1"))
    return F.when(preset == "auto", auto).otherwise(preset)


def resolve_hyperparameters(runs: DataFrame) -> DataFrame:
    """runs (hyperparameter_preset, model_variant, region_set and PARAMETERS, null where not given), resolved.

    Given values win, 0 too, and the preset fills the rest; `origin` tells where the preset comes from (null for legacy).
    An unknown preset raises."""
    table = runs.sparkSession.createDataFrame([(k, *v) for k, v in PRESETS.items()], "_preset string, " + ", ".join(f"_{k} {t}" for k, t in PARAMETERS.items()))
    origin = F.coalesce(*(F.when(F.col("_preset") == k, F.struct(F.lit(PRESET_PACKAGE).alias("package"), *(F.lit(x).alias(n) for n, x in zip(("file", "method", "id", "position"), v, strict=True)))) for k, v in PRESET_ORIGINS.items()))
    named = runs.withColumn("hyperparameter_preset", preset_of(F.col("hyperparameter_preset"), F.col("model_variant"), F.col("region_set")))
    out = named.join(F.broadcast(table), F.col("hyperparameter_preset") == F.col("_preset"), "left")  # five presets
    known = F.when(F.col("_preset").isNull(), F.raise_error(F.concat(F.lit("unknown preset "), F.coalesce("hyperparameter_preset", F.lit("null")))).cast("string")).otherwise(F.col("_preset"))
    filled = {k: F.coalesce(F.col(k), F.col(f"_{k}")).cast(t) for k, t in PARAMETERS.items()}
    return out.withColumns({"hyperparameter_preset": known, "origin": origin, **filled}).drop("_preset", *(f"_{k}" for k in PARAMETERS))


#: What settings of the detector, the decomposition, the perceptron and the transformer must not be.
WRONG = {name: wrong(name) for name in RANGES} | {
    "max_imfs": "max_imfs <= 0", "max_sift_iterations": "max_sift_iterations <= 0", "sift_sd_threshold": "not (sift_sd_threshold > 0)",
    "num_classes": "num_classes < 2", "weight_decay": "weight_decay < 0", "dropout": "not (dropout >= 0 and dropout < 1)", "batch_size": "batch_size <= 0", "epochs": "epochs <= 0", "patience": "patience <= 0",
    "patch_size": "patch_size < 1", "dim": "dim < 1 or dim % 2 <> 0", "depth": "depth < 1", "mlp_dim": "mlp_dim < 1",
    "hidden_dims": "size(hidden_dims) = 0 or exists(hidden_dims, x -> x <= 0)", "heads": "heads < 1 or dim % greatest(heads, 1) <> 0",
}


def broken_rules(settings: tuple[str, ...] = tuple(WRONG), rates: bool = True) -> Column:
    """Names of the rules that the settings, columns of these names, break; the learning rate's first one too."""
    named = [F.when(F.expr(WRONG[n]), n) for n in settings]
    rate = [rate_problem(F.col("learning_rate"), F.col("min_learning_rate"), F.col("warmup_epochs"), F.col("lr_schedule"))] if rates else []
    return F.array_compact(F.array(*named, *rate))


def dataset_tags(experiments: DataFrame, schemes: DataFrame) -> DataFrame:
    """The run's own tag, else that of its data folder's scheme, else null."""
    s = schemes.select("data_dir", F.col("tag").alias("_tag"))
    return experiments.join(s, "data_dir", "left").withColumn("label_tag", F.coalesce("label_tag", "_tag")).drop("_tag")


def image_parts(file: Column) -> Column:
    """Struct (form, region, channel, class) of an image's name, or null."""
    part = lambda i: F.regexp_extract(file, IMAGE, i)
    return F.when(file.rlike(IMAGE), F.struct(part(1).alias("form"), part(2).alias("region"), part(3).alias("channel"), part(4).alias("class")))


def image_pairs(files: DataFrame) -> DataFrame:
    """For each form, region and channel the image files of the two classes."""
    x = files.withColumn("p", image_parts(F.col("file"))).where("p is not null").select("file", "p.*")
    return x.groupBy("form", "region", "channel").agg(F.max(F.when(F.col("class") == "imminent", F.col("file"))).alias("imminent"), F.max(F.when(F.col("class") == "safe", F.col("file"))).alias("safe"))


def with_images(experiments: DataFrame, files: DataFrame, expected: Column) -> DataFrame:
    """Experiments whose image is there; equal labels get their place appended. Images without an experiment drop out.

    Places are ranks over ranges of (label, name), so a label that most runs share is no task of its own."""
    e = experiments.withColumn("file", expected).join(files.select("file").distinct(), "file", "left_semi")
    e = ranks.ranked(e, ["label"], ["name"], "_k")
    return e.withColumn("shown", F.when(F.col("_k_of") > 1, F.concat("label", F.lit(" ("), F.col("_k").cast("string"), F.lit(")"))).otherwise(F.col("label"))).drop("_k", "_k_of")


def sort_place(df: DataFrame, column: str, descending: bool, tie: str, text: bool = False) -> DataFrame:
    """df with `place`: finite numbers in the given direction, then everything else; equal ones and the rest in the order of tie. text: by the lower-case form instead, missing last."""
    number = F.col(column).try_cast("double")
    key = F.lower(column) if text else F.when(F.abs(number) < float("inf"), number)
    rows = df.withColumn("_key", key)
    order = F.col("_key").desc_nulls_last() if descending else F.col("_key").asc_nulls_last()
    return ranks.ranked(rows, [], [order, F.col(tie).asc()], "place").drop("_key", "place_of")


def shown(x: Column) -> Column:
    """Three decimals, `-` for none."""
    return F.when(x.isNull(), "-").otherwise(F.format_string("%.3f", F.floor(x * 1000 + 0.5) / 1000))


def compare_sets(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two data sets (sample_id, split, depth_value, label) by id: shared ids, same split, label and depth disagreements; one row."""
    y = b.select("sample_id", F.col("split").alias("s2"), F.col("depth_value").alias("d2"), F.col("label").alias("l2"))
    both = a.join(y, "sample_id")
    return both.agg(F.count("*").alias("n_shared"), F.count_if(F.col("split") == F.col("s2")).alias("same_split"), F.count_if(F.col("label") != F.col("l2")).alias("label_disagree"), F.count_if(F.abs(F.col("depth_value") - F.col("d2")) > 1e-6).alias("depth_disagree"))


def leakage(df: DataFrame, group: str) -> DataFrame:
    """Groups (specimens) that lie in more than one split, by pair of splits."""
    each = df.select(group, "split").distinct()
    other = each.withColumnRenamed("split", "other")
    return each.join(other, group).where("split < other").groupBy("split", "other").agg(F.count("*").alias("n_shared"))


def fold_overlap(folds: DataFrame, fixed: DataFrame) -> DataFrame:
    """Rows of each fold, and those that the fixed split has too."""
    seen = fixed.select("sample_id").distinct().withColumn("seen", F.lit(1))
    return folds.join(seen, "sample_id", "left").groupBy("fold").agg(F.count("*").alias("n"), F.count("seen").alias("n_shared"))
