"""Choice of frames. Traces stay arrays, one row each; only what was chosen is exploded or averaged.

Tables: scans (sample_id, frame, channel, signal) and spans (sample_id, channel, start, end).
"""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.signals import lagged_similarity

#: Physical channels of each channel mode.
CHANNELS = {1: (0,), 2: (1,), 3: (0, 1), 4: (0, 1)}


def interval(signal: Column, start: Column, end: Column) -> Column:
    return F.slice(signal, (start + 1).cast("int"), F.greatest(end - start, F.lit(0)).cast("int"))


def select_channels(scans: DataFrame, mode: int) -> DataFrame:
    return scans.where(F.col("channel").isin(*CHANNELS[mode]))


def peak(signal: Column) -> Column:
    return F.array_max(F.transform(signal, F.abs))


def frame_peaks(scans: DataFrame, spans: DataFrame | None = None) -> DataFrame:
    """Largest magnitude of each trace, inside its channel's span where spans are given."""
    if spans is None:
        return scans.withColumn("peak", peak(F.col("signal")))
    return scans.join(spans, ["sample_id", "channel"]).withColumn("peak", peak(interval(F.col("signal"), F.col("start"), F.col("end"))))


def frame_rank(peaks: DataFrame) -> DataFrame:
    """peaks with `rank` from 1: larger peaks first, then earlier frames."""
    return peaks.withColumn("rank", F.row_number().over(W.partitionBy("sample_id", "channel").orderBy(F.col("peak").desc(), "frame")))


def mean_of(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Pointwise mean of a few traces (at most three a group), summed in the order of their frames, so that it is the same number however rows arrive."""
    got = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("frame", "signal"))).alias("t")).select(*keys, F.col("t.signal").alias("x"))
    place = F.sequence(F.lit(1), F.size(F.col("x")[0]))
    mean = F.transform(place, lambda i: F.aggregate("x", F.lit(0.0), lambda a, s: a + F.element_at(s, i)) / F.size("x"))
    # Exploding the one array makes a column of it that Arrow kernels can take; they cannot take a lambda's result.
    return got.select(*keys, F.explode(F.array(mean)).alias("signal"))


def mean_std_traces(scans: DataFrame) -> DataFrame:
    """(sample_id, channel, mean, std): both as traces, over all frames; the deviation is of the population.

    Frames are summed point by point as vectors, in each task before the shuffle, so neither points nor single frames are shuffled."""
    own = scans.groupBy("sample_id", "channel").agg(Summarizer.metrics("mean", "variance", "count").summary(array_to_vector("signal")).alias("s"))
    share = (F.col("s.count") - 1) / F.col("s.count")  # the summary's variance is that of a sample
    return own.select("sample_id", "channel", vector_to_array("s.mean").alias("mean"), F.transform(vector_to_array("s.variance"), lambda v: F.sqrt(v * share)).alias("std"))


def mean_std(scans: DataFrame) -> DataFrame:
    """(sample_id, channel, pos, mean, std) of mean_std_traces, point by point."""
    return mean_std_traces(scans).select("sample_id", "channel", F.posexplode(F.arrays_zip("mean", "std")).alias("pos", "v")).select("sample_id", "channel", "pos", "v.mean", "v.std")


def locator_signal(scans: DataFrame, k: int = 3) -> DataFrame:
    """Mean of the k frames of each channel with the largest peaks of the whole trace."""
    return mean_of(frame_rank(frame_peaks(scans)).where(F.col("rank") <= k), ["sample_id", "channel"])


def select_c3(scans: DataFrame, spans: DataFrame, k: int) -> DataFrame:
    """Each channel's first k frames by its own span."""
    return frame_rank(frame_peaks(scans, spans)).where(F.col("rank") <= k)


def overlap(ranked: DataFrame, top: int = 10) -> DataFrame:
    """Frames among the first `top` of both channels, in the first channel's order (`place` from 1)."""
    first = ranked.where((F.col("channel") == 0) & (F.col("rank") <= top)).select("sample_id", "frame", "rank", "peak")
    second = ranked.where((F.col("channel") == 1) & (F.col("rank") <= top)).select("sample_id", "frame")
    return first.join(second, ["sample_id", "frame"], "left_semi").withColumn("place", F.row_number().over(W.partitionBy("sample_id").orderBy("rank")))


def similarity_rank(scans: DataFrame, spans: DataFrame, top: int = 10, lags: int = 5) -> DataFrame:
    """The first channel's first frames by how alike both channels are in its span, then by peak, then by frame."""
    first = frame_rank(frame_peaks(scans.where("channel = 0"), spans)).where(F.col("rank") <= top)
    right = scans.where("channel = 1").select("sample_id", "frame", F.col("signal").alias("other"))
    both = first.join(right, ["sample_id", "frame"])
    cut = lambda c: interval(F.col(c), F.col("start"), F.col("end"))
    scored = both.withColumn("score", F.round(lagged_similarity(cut("signal"), cut("other"), lags), 12))
    place = F.row_number().over(W.partitionBy("sample_id").orderBy(F.col("score").desc(), F.col("peak").desc(), "frame"))
    return scored.select("sample_id", "frame", "peak", "score", place.alias("place"))


def select_c4(scans: DataFrame, spans: DataFrame, k: int, top: int = 10) -> DataFrame:
    """k frames shared by both channels: of the overlap if it is large enough, else by similarity."""
    ranked = frame_rank(frame_peaks(scans, spans))
    shared = overlap(ranked, top).withColumn("n", F.count("*").over(W.partitionBy("sample_id"))).where((F.col("n") >= k) & (F.col("place") <= k))
    alike = similarity_rank(scans, spans, top).where(F.col("place") <= k).join(shared.select("sample_id").distinct(), "sample_id", "left_anti")
    cols = ["sample_id", "place", "frame"]
    return shared.select(*cols, F.lit(True).alias("used_overlap")).unionByName(alike.select(*cols, F.lit(False).alias("used_overlap")))


def select_shared_peak(scans: DataFrame) -> DataFrame:
    """One frame per sample: the largest magnitude over both whole traces."""
    per = frame_peaks(scans).groupBy("sample_id", "frame").agg(F.max("peak").alias("peak"))
    return per.groupBy("sample_id").agg(F.max_by("frame", F.struct("peak", -F.col("frame"))).alias("frame"), F.max("peak").alias("peak"))


def select_energy_cosine(scans: DataFrame, top: int = 10) -> DataFrame:
    """Of the first channel's first frames by whole-trace peak, the one whose squared traces point the same way most."""
    first = frame_rank(frame_peaks(scans.where("channel = 0"))).where(F.col("rank") <= top)
    right = scans.where("channel = 1").select("sample_id", "frame", F.col("signal").alias("other"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * x * y * y), F.lit(0.0), lambda s, v: s + v)
    score = F.try_divide(dot("signal", "other"), F.sqrt(dot("signal", "signal") * dot("other", "other")))
    rows = first.join(right, ["sample_id", "frame"]).withColumn("score", F.round(F.coalesce(score, F.lit(0.0)), 12))
    return rows.groupBy("sample_id").agg(F.max_by("frame", F.struct("score", -F.col("frame"))).alias("frame"), F.max("score").alias("score"))


def choice_stats(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Samples whose frames differ between two rules, and those that fell back, per group and for all."""
    x = a.groupBy(*keys, "sample_id").agg(F.array_sort(F.collect_set("frame")).alias("fa"))
    y = b.groupBy("sample_id").agg(F.array_sort(F.collect_set("frame")).alias("fb"), F.min("used_overlap").alias("direct"))
    both = x.join(y, "sample_id")
    return both.rollup(*keys).agg(F.count("*").alias("n"), F.count_if(F.col("fa") != F.col("fb")).alias("n_differ"), F.count_if(~F.col("direct")).alias("n_fallback"))


def prepared(scans: DataFrame, spans: DataFrame, form: str, mode: int, top: int = 10) -> DataFrame:
    """(sample_id, channel, stream, signal) of one frame form and channel mode."""
    some = select_channels(scans, mode)
    if form == "raw50":
        return some.select("sample_id", "channel", F.col("frame").cast("int").alias("stream"), "signal")
    if form == "mean_std":
        return mean_std_traces(some).select("sample_id", "channel", F.posexplode(F.array("mean", "std")).alias("stream", "signal"))
    k = {"max1": 1, "top3_mean": 3}[form]
    if mode == 4:
        chosen = select_c4(scans, spans, k, top).select("sample_id", "frame")
        rows = some.join(chosen, ["sample_id", "frame"])
    else:
        rows = select_c3(some, spans, k)
    return mean_of(rows, ["sample_id", "channel"]).select("sample_id", "channel", F.lit(0).alias("stream"), "signal")
