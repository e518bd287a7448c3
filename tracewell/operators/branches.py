"""Branches: intervals of prepared traces, padded, resampled to one length and tapered.

Tables: prepared (sample_id, channel, stream, signal), regions (region_idx, name, start_mm, end_mm), spans as located.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import REGION_PRESETS, depth_to_index, general, tapered
from ..functions.signals import resample_cubic
from .frames import interval
from .spans import Detector

#: Fixed value: schema of a region list, as pairs or as objects.
PAIRS, OBJECTS = "array<array<double>>", "array<struct<start_mm:double,end_mm:double,name:string>>"


def region_name(start: Column, end: Column) -> Column:
    return F.concat(general(start), F.lit("-"), general(end), F.lit("mm"))


def parse_regions(df: DataFrame, text: str, max_mm: float) -> DataFrame:
    """df exploded to (..., region_idx, name, start_mm, end_mm, valid) of a JSON list of regions."""
    pairs = F.transform(F.from_json(text, PAIRS), lambda p: F.struct(F.get(p, F.lit(0)).alias("start_mm"), F.get(p, F.lit(1)).alias("end_mm"), F.lit(None).cast("string").alias("name")))
    # Objects also read as pairs of nulls; a list whose first item has a start is one of objects.
    objects = F.from_json(text, OBJECTS)
    chosen = F.when(F.get(objects, F.lit(0))["start_mm"].isNotNull(), objects).otherwise(pairs)
    x = df.select(*df.columns, F.posexplode(chosen).alias("region_idx", "r"))
    a, z = F.col("r.start_mm"), F.col("r.end_mm")
    valid = F.coalesce((a >= 0) & (a < z) & (z <= max_mm), F.lit(False))
    return x.select(*df.columns, "region_idx", F.coalesce("r.name", region_name(a, z)).alias("name"), a.alias("start_mm"), z.alias("end_mm"), valid.alias("valid"))


def region_experiments(df: DataFrame, region_set: str, regions_json: str, max_mm: float) -> DataFrame:
    """df exploded to (..., name, regions) of the runs that a region set asks for.

    Given regions (JSON) make one run named custom; `all` stands for the first four presets; dyn_envelope has no fixed
    regions; an unknown set raises."""
    presets = {k: F.array(*(F.struct(F.lit(a).alias("start_mm"), F.lit(z).alias("end_mm")) for a, z in v)).cast("array<struct<start_mm:double,end_mm:double>>") for k, v in REGION_PRESETS.items()}
    run = lambda name, regions: F.struct(F.lit(name).alias("name"), regions.alias("regions"))
    chosen = F.when(F.col(region_set) == "all", F.array(*(run(k, v) for k, v in presets.items() if k != "dyn_envelope_full")))
    for k, v in presets.items():
        chosen = chosen.when(F.col(region_set) == k, F.array(run(k, v)))
    unknown = F.raise_error(F.concat(F.lit("unknown region set "), F.coalesce(region_set, F.lit("null"))))
    texts = df.where(F.col(regions_json).isNotNull())
    custom = parse_regions(texts, regions_json, max_mm).groupBy(*df.columns).agg(F.array_sort(F.collect_list(F.struct("region_idx", "start_mm", "end_mm"))).alias("r"))
    custom = custom.select(*df.columns, F.lit("custom").alias("name"), F.transform("r", lambda x: F.struct(x["start_mm"].alias("start_mm"), x["end_mm"].alias("end_mm"))).alias("regions"))
    named = df.where(F.col(regions_json).isNull()).select(*df.columns, F.explode(chosen.otherwise(unknown)).alias("x")).select(*df.columns, "x.*")
    return named.unionByName(custom)


def slice_bounds(regions: DataFrame, max_mm: float, length: int) -> DataFrame:
    """regions with `start` and `end` indices; empty ones are dropped."""
    to = lambda c: depth_to_index(F.col(c), max_mm, length)
    return regions.withColumn("start", to("start_mm")).withColumn("end", to("end_mm")).where(F.col("end") > F.col("start"))


def padded(pad: Column | None = None) -> Column:
    """The interval [start, end) of signal, followed by pad zeros."""
    part = interval(F.col("signal"), F.col("start"), F.col("end"))
    return part if pad is None else F.concat(part, F.array_repeat(F.lit(0.0), pad.cast("int")))


def cut(rows: DataFrame, target: int, alpha: float, pad: Column | None = None) -> DataFrame:
    """rows (with signal, start, end) as branches; pad zeros follow the interval before it is resampled."""
    out = rows.withColumn("signal", resample_cubic(padded(pad), target))
    return out.withColumn("signal", tapered(F.col("signal"), target, alpha)) if alpha else out


def fixed(prepared: DataFrame, regions: DataFrame, max_mm: float, length: int, target: int, alpha: float = 0.3) -> DataFrame:
    """Branches of fixed regions; regions are a few rows of settings."""
    bounds = slice_bounds(regions, max_mm, length).select("region_idx", "name", "start", "end", (F.col("end") - F.col("start")).alias("input_len"), F.lit(0).cast("long").alias("pad"))
    return cut(prepared.crossJoin(F.broadcast(bounds)), target, alpha)


#: Names of the two dynamic branches.
MAIN, TAIL = "dynamic_main_window", "dynamic_tail_window"


def bounds(spans: DataFrame, c: Detector, regions: DataFrame | None = None, max_mm: float = 0.0, length: int = 0) -> DataFrame:
    """(sample_id, channel, region_idx, name, start, end, input_len, pad): each channel's main window and padded tail, then the fixed regions, which are the same for all.

    Samples without a sound span have none. regions are a few rows of settings, and follow the two in their order."""
    sound = spans.withColumn("bad", F.count_if(F.col("status") != "ok").over(W.partitionBy("sample_id"))).where("bad = 0")
    one = lambda idx, name, a, z, n, pad: F.struct(F.lit(idx).cast("int").alias("region_idx"), F.lit(name).alias("name"), F.col(a).cast("int").alias("start"), F.col(z).cast("int").alias("end"), F.lit(n).cast("int").alias("input_len"), pad.cast("int").alias("pad"))
    each = F.array(one(0, MAIN, "start", "end", c.main_length, F.lit(0)), one(1, TAIL, "tail_start", "tail_end", c.tail_length, F.col("tail_pad")))
    if regions is not None:
        cells = slice_bounds(regions, max_mm, length).withColumn("input_len", F.col("end") - F.col("start")).withColumn("pad", F.lit(0))
        whole = [F.col(k).cast("int").alias(k) if k != "name" else F.col(k) for k in ("region_idx", "name", "start", "end", "input_len", "pad")]
        row = cells.agg(F.array_sort(F.collect_list(F.struct(*whole))).alias("fixed"))  # settings: one row
        sound = sound.crossJoin(F.broadcast(row))
        each = F.concat(each, F.transform("fixed", lambda r, i: r.withField("region_idx", (i + 2).cast("int"))))
    return sound.select("sample_id", "channel", F.explode(each).alias("b")).select("sample_id", "channel", "b.*")


def dynamic(prepared: DataFrame, spans: DataFrame, c: Detector, target: int, alpha: float = 0.3, regions: DataFrame | None = None, max_mm: float = 0.0, length: int = 0) -> DataFrame:
    """Branches of the main window and the padded tail of each channel, and of fixed regions beside them, out of one cut."""
    each = bounds(spans, c, regions, max_mm, length)
    return cut(prepared.join(each, ["sample_id", "channel"]), target, alpha, F.col("pad"))


def branch_name() -> Column:
    """Name of a branch with its region's place and its channel, which counts from 1."""
    return F.concat(F.lit("region"), F.col("region_idx").cast("string"), F.lit("_"), F.col("name"), F.lit("_ch"), (F.col("channel") + 1).cast("string"))


def tensor(branches: DataFrame, channels: int) -> DataFrame:
    """branches with `branch_id`, region by region and then by channel, and whether every value is finite."""
    ok = F.forall("signal", lambda x: ~F.isnan(x) & (F.abs(x) < float("inf")))
    return branches.withColumn("branch_id", F.col("region_idx") * channels + F.col("channel")).withColumn("finite", ok)


def tensors(branches: DataFrame, channels: int, kind: str = "float") -> DataFrame:
    """One row a sample: `inputs` [branch][stream][point] in order of branch_id and stream, `names` of the branches, and their `audit` (start, end, input_len, pad).

    A value that is not finite raises with the sample's id. A sample's rows are its branches and streams, a number that the settings bound."""
    each = tensor(branches, channels).withColumn("branch_name", branch_name())
    stop = F.raise_error(F.concat(F.lit("non-finite input for "), F.col("sample_id").cast("string")))
    signal = F.when(F.col("finite"), F.col("signal").cast(f"array<{kind}>")).otherwise(stop)
    rows = F.array_sort(F.collect_list(F.struct("branch_id", "stream", "branch_name", "start", "end", "input_len", "pad", signal.alias("signal"))))
    t = each.groupBy("sample_id").agg(rows.alias("rows"))
    first = F.filter("rows", lambda r: r["stream"] == F.get("rows", F.lit(0))["stream"])  # one of each branch
    inputs = F.transform("first", lambda h: F.transform(F.filter("rows", lambda r: r["branch_id"] == h["branch_id"]), lambda r: r["signal"]))
    audit = F.transform("first", lambda h: F.struct(*(h[c].alias(c) for c in ("start", "end", "input_len", "pad"))))
    return t.withColumn("first", first).select("sample_id", F.transform("first", lambda h: h["branch_name"]).alias("names"), inputs.alias("inputs"), audit.alias("audit"))


def geometry(branches: DataFrame, max_mm: float, length: int, target: int) -> DataFrame:
    """Input length, distance between resampled points and a title of each branch."""
    spacing = F.lit(max_mm / length) * F.col("input_len") / target
    title = F.concat(F.col("name"), F.lit(" "), general(F.col("start") * (max_mm / length)), F.lit("-"), general(F.col("end") * (max_mm / length)), F.lit("mm"))
    return branches.withColumn("spacing_mm", spacing).withColumn("title", title)


def compared(a: DataFrame, b: DataFrame, key: list[str]) -> DataFrame:
    """Rows of a whose trace differs from b's, or is not finite, or has no counterpart."""
    both = a.join(b.select(*key, F.col("signal").alias("other")), key, "full")
    problem = (
        F.when(F.col("other").isNull(), "missing").when(F.col("signal").isNull(), "extra").when(F.size("signal") != F.size("other"), "shape")
        .when(F.exists("signal", lambda x: F.isnan(x) | (F.abs(x) == float("inf"))), "not_finite").when(~F.col("signal").eqNullSafe(F.col("other")), "values")
    )
    return both.select(*key, problem.alias("problem")).where("problem is not null")


def slices(scans: DataFrame, spans: DataFrame, c: Detector) -> DataFrame:
    """(sample_id, channel, frame, name, signal): main window and zero-padded tail of every frame, as they are before they are resampled."""
    rows = scans.join(bounds(spans, c), ["sample_id", "channel"])
    return rows.select("sample_id", "channel", "frame", "name", padded(F.col("pad")).alias("signal"))


def span_problem(channels: int) -> Column:
    """Why a sample of spans has no branches to compare: it lacks a channel, or a channel lacks a sound span; else null."""
    own = W.partitionBy("sample_id")
    return F.when(F.count("*").over(own) != channels, "channels").when(F.count_if(F.col("status") != "ok").over(own) > 0, "no_span")


def verified(scans: DataFrame, spans: DataFrame, parse: DataFrame, c: Detector, target: int, channels: int = 2) -> DataFrame:
    """(sample_id, channel, name, problem, n_frames): what is wrong with the dynamic branches, held against another parse of the same traces.

    The slices of all frames must equal those of parse (sample_id, channel, frame, name, signal); the branches of each
    first frame, not tapered, must have target finite points. Samples without branches are named too, with no frames."""
    marked = spans.withColumn("problem", span_problem(channels))
    sound = marked.where("problem is null").drop("problem")
    key = ["sample_id", "channel", "name"]
    differing = compared(slices(scans, sound, c), parse, [*key, "frame"]).groupBy(*key, "problem").agg(F.count("*").alias("n_frames"))
    first = scans.groupBy("sample_id", "channel").agg(F.min_by("signal", "frame").alias("signal"))
    made = tensor(dynamic(first, sound, c, target, 0.0), channels)
    unfit = F.when(F.size("signal") != target, "branch_shape").when(~F.col("finite"), "branch_not_finite")
    unfit = made.select(*key, unfit.alias("problem"), F.lit(1).cast("long").alias("n_frames")).where("problem is not null")
    without = marked.where("problem is not null").select("sample_id", "channel", F.explode(F.array(F.lit(MAIN), F.lit(TAIL))).alias("name"), "problem", F.lit(0).cast("long").alias("n_frames"))
    return differing.unionByName(unfit).unionByName(without)


def component_limits(components: DataFrame, by: list[str]) -> DataFrame:
    """Symmetric limits that hold every value, 1 where there is next to nothing."""
    top = F.max(F.array_max(F.transform("signal", F.abs)))
    return components.groupBy(*by).agg(top.alias("top")).select(*by, F.when(F.col("top") < 1e-8, 1.0).otherwise(F.col("top") * 1.1).alias("limit"))
