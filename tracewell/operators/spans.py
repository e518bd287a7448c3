"""Location of the dynamic span of each sample and channel from the smoothed envelope.

Everything after the envelope is column functions on one row per sample, so a sample is shuffled once.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.signals import envelope
from .frames import locator_signal


@dataclass(frozen=True)
class Detector:
    """Settings of the detector; the defaults are fixed values for traces of 896 points."""

    noise_start: int = 71
    weak_threshold: float = 0.015
    smooth_window: int = 5
    peak_window_back: int = 50
    peak_window_forward: int = 150
    peak_ratio: float = 0.05
    gap_max: int = 8
    min_run_width: int = 8
    min_run_area_ratio: float = 0.05
    merge_max_lead: int = 96
    lead_back: int = 20
    main_start_min: int = 70
    main_length: int = 170
    tail_length: int = 600
    length: int = 896
    locator_top_k: int = 3

    def errors(self) -> list[str]:
        """Names of the settings that are out of range, by the rules that hold for tables of settings too."""
        return [k for k in RANGES if not allowed(k, getattr(self, k))]


#: Least and most that each setting of the detector may be.
RANGES = {
    "noise_start": (0, None), "weak_threshold": (0, None), "smooth_window": (1, None), "peak_window_back": (0, None), "peak_window_forward": (1, None), "peak_ratio": (0, 1), "gap_max": (0, None), "min_run_width": (1, None),
    "min_run_area_ratio": (0, 1), "merge_max_lead": (0, None), "lead_back": (0, None), "main_length": (4, None), "main_start_min": (0, None), "tail_length": (4, None), "locator_top_k": (1, None),
}
#: Of these the ends are not allowed.
OPEN = ("peak_ratio",)


def allowed(name: str, value: float) -> bool:
    low, high = RANGES[name]
    return (low < value < high) if name in OPEN else low <= value and (high is None or value <= high)


def wrong(name: str) -> str:
    """The same as SQL, true of a value that is not allowed."""
    low, high = RANGES[name]
    more, less = (">", "<") if name in OPEN else (">=", "<=")
    return f"not ({name} {more} {low}" + (f" and {name} {less} {high})" if high is not None else ")")


def moving_average(x: Column, window: int, first: int = 0) -> Column:
    """Mean of `window` points about each, at most as many as there are, from point `first` on; places beyond an end read as that end, earlier points are 0."""
    last, size = F.size(x) - 1, F.greatest(F.least(F.lit(window), F.size(x) - first), F.lit(1))
    right = F.floor(size / 2).cast("int")
    left = right - F.when(size % 2 == 0, 1).otherwise(0)
    at = lambda i: F.get(x, F.least(F.greatest(i, F.lit(first)), last))
    mean = lambda i: F.aggregate(F.sequence(i - left, i + right), F.lit(0.0), lambda a, j: a + at(j)) / size
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.when(i < first, F.lit(0.0)).otherwise(mean(i)))


def first_above(x: Column, threshold: Column, first: int) -> Column:
    """First place from `first` on with a value above the threshold, or null."""
    return F.get(F.filter(F.sequence(F.lit(first), F.size(x) - 1), lambda i: F.get(x, i) > threshold), F.lit(0))


def runs_above(x: Column, threshold: Column, first: int) -> Column:
    """Maximal runs of values above the threshold: array of (start, end, width, area)."""
    place, last = F.sequence(F.lit(first), F.size(x) - 1), F.size(x) - 1
    over = lambda i: F.get(x, i) > threshold
    starts = F.filter(place, lambda i: over(i) & ((i == first) | ~over(F.greatest(i - 1, F.lit(0)))))
    ends = F.filter(place, lambda i: over(i) & ((i == last) | ~over(F.least(i + 1, last))))
    area = lambda a, z: F.aggregate(F.slice(x, a + 1, z - a + 1), F.lit(0.0), lambda s, v: s + v)
    return F.zip_with(starts, ends, lambda a, z: F.struct(a.alias("start"), (z + 1).alias("end"), (z + 1 - a).alias("width"), area(a, z).alias("area")))


def merged_start(runs: Column, anchor: Column, c: Detector) -> Column:
    """Start of the first run of the packet that ends with the anchor run: walks back over close, wide and strong runs."""
    earlier = F.reverse(F.filter(runs, lambda r: r["end"] <= anchor["start"]))
    start = F.struct(anchor["start"].alias("at"), F.lit(True).alias("on"), F.lit(0).alias("n"))

    def step(s: Column, r: Column) -> Column:
        ok = s["on"] & (s["at"] - r["end"] <= c.gap_max) & (r["width"] >= c.min_run_width) & (r["area"] >= c.min_run_area_ratio * anchor["area"]) & (anchor["start"] - r["start"] <= c.merge_max_lead)
        return F.struct(F.when(ok, r["start"]).otherwise(s["at"]).alias("at"), ok.alias("on"), (s["n"] + ok.cast("int")).alias("n"))

    return F.aggregate(earlier, start, step)


def smoothed(scans: DataFrame, c: Detector) -> DataFrame:
    """(sample_id, channel, env): smoothed envelope of the locator signal."""
    e = locator_signal(scans, c.locator_top_k).withColumn("env", envelope(F.col("signal")))
    return e.select("sample_id", "channel", moving_average(F.col("env"), c.smooth_window, c.noise_start).alias("env"))


def references(env: DataFrame, c: Detector) -> DataFrame:
    """(sample_id, channel, env, direct, reference, rule): crossing of each channel, borrowed or joint where it has none."""
    rows = env.withColumn("direct", first_above(F.col("env"), F.lit(c.weak_threshold), c.noise_start))
    one = rows.groupBy("sample_id").agg(F.array_sort(F.collect_list(F.struct("channel", "direct", "env"))).alias("ch"))
    found = F.filter("ch", lambda x: x["direct"].isNotNull())
    place = F.sequence(F.lit(0), F.lit(c.length - 1))
    joint = F.transform(place, lambda i: F.sqrt(F.aggregate("ch", F.lit(0.0), lambda a, x: a + F.get(x["env"], i) * F.get(x["env"], i)) / F.size("ch")))
    one = one.withColumn("joint", F.when(F.size(found) == 0, joint)).withColumn("level", F.array_max(F.slice("joint", c.noise_start + 1, c.length)) * 0.5)
    one = one.withColumn("joint_at", F.when(F.size(found) == 0, first_above(F.col("joint"), F.col("level"), c.noise_start)))
    donor = F.get(found, F.lit(0))["direct"]
    each = one.select("sample_id", "joint_at", (F.size("ch") - F.size(found)).alias("missing"), F.size("ch").alias("channels"), donor.alias("donor"), F.explode("ch").alias("x")).select("sample_id", "joint_at", "missing", "channels", "donor", "x.*")
    lone = (F.col("missing") == 1) & (F.col("channels") == 2)
    reference = F.coalesce("direct", F.when(lone, F.col("donor")), F.when(F.col("missing") == F.col("channels"), F.col("joint_at")))
    rule = F.when(F.col("direct").isNotNull(), "direct").when(lone, "paired_fallback").when(F.col("missing") == F.col("channels"), "rms_joint_fallback").otherwise("undefined")
    return each.select("sample_id", "channel", "env", "direct", reference.alias("reference"), rule.alias("rule"))


def located(scans: DataFrame, c: Detector, corrections: DataFrame | None = None) -> DataFrame:
    """Spans: start, end, tail, crossing, peak, threshold, rule, runs, and status (`ok`, or why a row has no span).

    corrections (sample_id, channel, recorded, manual) replace the crossing where it still is the recorded one.
    """
    r = references(smoothed(scans, c), c)
    low, high = F.greatest(F.lit(c.noise_start), F.col("reference") - c.peak_window_back), F.least(F.lit(c.length), F.col("reference") + c.peak_window_forward)
    r = r.withColumn("low", low).withColumn("high", high)
    inside = F.slice("env", F.col("low") + 1, F.greatest(F.col("high") - F.col("low"), F.lit(0)))
    r = r.withColumn("peak_value", F.array_max(inside)).withColumn("peak", (F.col("low") + F.array_position(inside, F.array_max(inside)) - 1).cast("int"))
    r = r.withColumn("threshold", F.col("peak_value") * c.peak_ratio).withColumn("runs", runs_above(F.col("env"), F.col("threshold"), c.noise_start))
    r = r.withColumn("anchor", F.get(F.filter("runs", lambda x: (x["start"] <= F.col("peak")) & (F.col("peak") < x["end"])), F.lit(0)))
    r = r.withColumn("m", merged_start(F.col("runs"), F.col("anchor"), c)).withColumn("automatic", F.col("m.at"))
    if corrections is None:
        r = r.withColumn("crossing", F.col("automatic")).withColumn("stale", F.lit(False)).withColumn("corrected", F.lit(False))
    else:
        r = r.join(corrections, ["sample_id", "channel"], "left")
        same = F.col("recorded") == F.col("automatic")
        r = r.withColumn("crossing", F.when(same, F.col("manual")).otherwise(F.col("automatic"))).withColumn("stale", F.coalesce(~same, F.lit(False))).withColumn("corrected", F.coalesce(same, F.lit(False)))
    start = F.greatest(F.col("crossing") - c.lead_back, F.lit(c.main_start_min))
    r = r.withColumn("start", start).withColumn("end", start + c.main_length)
    status = F.when(F.col("reference").isNull(), "no_reference").when(F.coalesce(F.col("threshold"), F.lit(0.0)) <= 0, "flat").when(F.col("stale"), "stale_correction").when(F.col("end") > c.length, "overflow").otherwise("ok")
    return r.select(
        "sample_id", "channel", "direct", "reference", "rule", "peak", "peak_value", "threshold", "runs", F.col("anchor.start").alias("premerge"), F.col("m.n").alias("n_merged"), "automatic", "crossing", "corrected",
        "start", "end", *tail_geometry(F.col("end"), c), (F.col("crossing") - c.lead_back < c.main_start_min).alias("clamped"), status.alias("status"),
    )


def tail_geometry(end: Column, c: Detector) -> list[Column]:
    """Start, valid end and right padding of the tail behind the main window."""
    stop = F.least(end + c.tail_length, F.lit(c.length))
    return [end.alias("tail_start"), stop.alias("tail_end"), (c.tail_length - (stop - end)).alias("tail_pad")]
