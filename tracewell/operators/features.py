"""Features of decomposed branches: statistics, pooling, scaling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.signals import STATS, component_stats, emd
from .branches import component_limits


def components(branches: DataFrame, modes: int = 5) -> DataFrame:
    """Each branch's modes and residue as rows: component, is_residue, signal. Absent modes have no row."""
    out = branches.withColumn("_e", emd(F.col("signal"), modes))
    each = out.select(*(c for c in branches.columns if c != "signal"), F.col("_e.n_modes").alias("n_modes"), F.posexplode("_e.components").alias("component", "signal"))
    return each.where((F.col("component") < F.col("n_modes")) | (F.col("component") == modes)).withColumn("is_residue", F.col("component") == modes)


def pooled(components: DataFrame, key: list[str], streams: int, modes: int = 5, spacing: str | None = None) -> DataFrame:
    """Mean of each statistic over streams and component slots; absent components count as zeros."""
    step = F.col(spacing) if spacing else F.lit(1.0)
    s = components.withColumn("_s", component_stats(F.col("signal"), step))
    return s.groupBy(*key).agg(*((F.sum(f"_s.{k}") / (streams * (modes + 1))).alias(k) for k in STATS))


def component_curves(branches: DataFrame, key: list[str], modes: int = 5) -> DataFrame:
    """Curves of every component of branches (key, signal, start, input_len, spacing_mm): (key, component, is_residue, pos, mm, value, limit).

    Absent components are curves of zeros. limit is 1.1 times the largest absolute value that a component has at a
    branch's place (region_idx, channel), over all rows, and 1 where there is next to nothing."""
    own = branches.withColumn("_e", emd(F.col("signal"), modes))
    slots = F.transform("_e.components", lambda c, i: F.struct(((i < F.col("_e.n_modes")) | (i == modes)).alias("there"), c.alias("c")))
    each = own.select(*key, "spacing_mm", F.posexplode(slots).alias("component", "s"))
    each = each.select(*key, "spacing_mm", "component", F.when(F.col("s.there"), F.col("s.c")).otherwise(F.transform("s.c", lambda x: F.lit(0.0))).alias("signal"))
    limits = component_limits(each, ["region_idx", "channel", "component"])  # settings: few rows
    shown = each.join(F.broadcast(limits), ["region_idx", "channel", "component"])
    return shown.select(*key, "component", (F.col("component") == modes).alias("is_residue"), "spacing_mm", "limit", F.posexplode("signal").alias("pos", "value")).withColumn("mm", F.col("pos") * F.col("spacing_mm")).drop("spacing_mm")


def long_features(pooled: DataFrame, key: list[str]) -> DataFrame:
    """(key, stat_idx, stat, value)."""
    rows = F.array(*(F.struct(F.lit(i).alias("stat_idx"), F.lit(k).alias("stat"), F.col(k).alias("value")) for i, k in enumerate(STATS)))
    return pooled.select(*key, F.explode(rows).alias("f")).select(*key, "f.*")


def vectors(features: DataFrame) -> DataFrame:
    """(sample_id, names, features): channel by channel, branch by branch, statistic by statistic."""
    name = F.concat(F.col("name"), F.lit("[ch"), (F.col("channel") + 1).cast("string"), F.lit("]."), F.col("stat"))
    item = F.struct("channel", "region_idx", "stat_idx", name.alias("name"), "value")
    v = features.groupBy("sample_id").agg(F.array_sort(F.collect_list(item)).alias("v"))
    return v.select("sample_id", F.col("v.name").alias("names"), F.col("v.value").alias("features"))


def scaler(features: DataFrame, by: list[str], absolute: float = 1e-8, relative: float = 1e-6) -> DataFrame:
    """(by, mean, scale, degenerate) of each feature; fit it on the training split."""
    s = features.groupBy(*by).agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))
    flat = F.col("std") <= absolute + relative * F.abs("mean")
    return s.select(*by, "mean", F.when(flat, 1.0).otherwise(F.col("std")).alias("scale"), flat.alias("degenerate"))


def scaled(features: DataFrame, scaler: DataFrame, by: list[str]) -> DataFrame:
    """features with value as (value - mean) / scale, 0 for degenerate ones. The scaler has one row per feature column."""
    x = features.join(F.broadcast(scaler), by)
    return x.withColumn("value", F.when(F.col("degenerate"), 0.0).otherwise((F.col("value") - F.col("mean")) / F.col("scale"))).drop("mean", "scale", "degenerate")
