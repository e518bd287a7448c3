"""Column expressions: numbers, labels, names, windows and probabilities."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Accepted spellings of the four frame forms, and the forms in their order.
FORM_ALIASES = {
    "mean_std": "mean_std",
    "mean+std": "mean_std",
    "meanstd": "mean_std",
    "raw50": "raw50",
    "raw_50": "raw50",
    "raw_50_frames": "raw50",
    "max1": "max1",
    "max_1": "max1",
    "max_1_frame": "max1",
    "top3_mean": "top3_mean",
    "top3": "top3_mean",
    "top_3_mean": "top3_mean",
}
FORMS = ("mean_std", "raw50", "max1", "top3_mean")
#: Named sets of depth regions in millimetres; `all` runs the first four.
REGION_PRESETS = {"full": [(0.0, 5.0)], "bone": [(1.0, 3.0)], "bone_plus_post": [(0.2, 1.5), (1.5, 5.0)], "dyn_envelope": [], "dyn_envelope_full": [(0.0, 5.0)]}
#: Marks in the names of runs and images.
PREPROCESSING_TAG = "headsim_cubic"
CHANNEL3_SELECTION = "independent_beam_peak_v1"
MODEL_TOKENS = {"concat": "vit", "cross_vote": "vit_cross_vote", "emd": "core"}
#: Names of the two classes where no scheme records any.
BINARY_CLASS_NAMES = ("即将穿透", "安全")


def half_up(x: Column) -> Column:
    return F.floor(x + 0.5)


def depth_to_index(depth: Column, max_mm: float, length: int, rounding: str = "half_up") -> Column:
    """Index of a depth, clamped to the trace."""
    x = depth / F.lit(max_mm) * F.lit(length)
    how = {"half_up": half_up, "floor": F.floor, "ceil": F.ceil}[rounding]
    return F.least(F.greatest(how(x), F.lit(0)), F.lit(length)).cast("long")


def index_to_depth(index: Column, max_mm: float, length: int) -> Column:
    return index * F.lit(max_mm) / F.lit(length)


def adc_zero(signal: Column, level: float, atol: float = 1e-6) -> Column:
    """Values within tolerance of plus or minus `level` become 0."""
    near = lambda x: F.abs(F.abs(x) - F.lit(level)) <= F.lit(atol + 1e-5 * level)
    return F.transform(signal, lambda x: F.when(near(x), F.lit(0.0)).otherwise(x))


def digitize(depth: Column, thresholds: Column) -> Column:
    """Class k where thresholds[k-1] <= depth < thresholds[k]."""
    return F.aggregate(thresholds, F.lit(0), lambda a, t: a + (depth >= t).cast("int"))


def once(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is worked out once a row, however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _rounded(x: Column) -> Column:
    """general() of any number but 0, by its digits."""
    cut = lambda t: F.regexp_replace(t, r"\.?0+$", "")  # noqa: E731  t has a point

    def shown(parts: Column) -> Column:
        mantissa, power = parts[0], parts[1].cast("int")
        far = F.concat(cut(mantissa), F.lit("e"), F.when(power < 0, "-").otherwise("+"), F.lpad(F.abs(power).cast("string"), 2, "0"))
        fixed = F.when((power < -4) | (power > 5), far).when(power == 5, F.format_string("%.0f", F.bround(x, 0)))
        for k in range(-4, 5):
            fixed = fixed.when(power == k, cut(F.format_string(f"%.{5 - k}f", F.bround(x, 5 - k))))  # ties to even
        return fixed

    return once(F.split(F.format_string("%.5e", x), "e"), shown)


def general(x: Column) -> Column:
    """A number in six significant digits without trailing zeros; very small and large ones with an exponent (as %g).

    Most numbers are short as they stand: then their shortest text is the answer, and nothing is rounded."""
    short = r"^-?(?=[0-9.]{1,7}$)([0-9]+[.]0|(?:0|[1-9][0-9]*)[.][0-9]*[1-9])$"
    as_text = lambda t: F.when(F.rlike(t, F.lit(short)), F.regexp_replace(t, "[.]0$", "")).otherwise(_rounded(x))
    return F.when(x == 0, "0").when(x.isNotNull(), once(x.cast("double").cast("string"), as_text))


def _shown(thresholds: Column) -> Column:
    """Thresholds as texts for tags and names."""
    return F.transform(thresholds, lambda t: F.replace(general(t), F.lit("-"), F.lit("m")))


def class_names(thresholds: Column) -> Column:
    """Names of the classes between thresholds."""

    def names(shown: Column) -> Column:
        last = F.size(shown) - 1
        middle = F.transform(F.slice(shown, 2, F.greatest(last, F.lit(1))), lambda hi, i: F.concat(F.get(shown, i), F.lit(" <= depth < "), hi))
        middle = F.when(last > 0, middle).otherwise(F.array().cast("array<string>"))
        return F.concat(F.array(F.concat(F.lit("depth < "), F.get(shown, F.lit(0)))), middle, F.array(F.concat(F.lit("depth >= "), F.get(shown, last))))

    return once(_shown(thresholds), names)


def display_names(recorded: Column, classes: Column) -> Column:
    """A name for each of `classes` labels: the recorded one, for two classes the usual pair unless two are recorded, else label=k."""
    names = F.when((classes == 2) & (F.coalesce(F.size(recorded), F.lit(-1)) != 2), F.array(*(F.lit(n) for n in BINARY_CLASS_NAMES))).otherwise(F.coalesce(recorded, F.array().cast("array<string>")))
    return F.transform(F.sequence(F.lit(0), classes - 1), lambda k: F.coalesce(F.get(names, k), F.concat(F.lit("label="), k.cast("string"))))


def scheme_tag(thresholds: Column) -> Column:
    return F.concat(F.lit("cls"), (F.size(thresholds) + 1).cast("string"), F.lit("_thr"), F.array_join(_shown(thresholds), "-"))


def recorded_tag(tag: Column, thresholds: Column) -> Column:
    """The tag under which runs are filed: the recorded one, else thr with the thresholds as recorded (texts); null for none."""
    text = F.coalesce(tag, F.when(F.size(thresholds) > 0, F.concat(F.lit("thr"), F.array_join(thresholds, "-"))))
    clean = F.regexp_replace(F.regexp_replace(text, r"[^\p{L}\p{N}._-]", "-"), r"^[-.]+|[-.]+$", "")
    return F.when(clean != "", clean)


def safe_name(x: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(x, "[^A-Za-z0-9_.-]+", "_"), "^[-._]+|[-._]+$", "")


def parse_thresholds(text: Column) -> Column:
    """Numbers of a list separated by commas or semicolons; what is no number becomes null."""
    parts = F.filter(F.transform(F.split(F.replace(text, F.lit(";"), F.lit(",")), ","), lambda p: F.trim(p)), lambda p: p != "")
    return F.transform(parts, lambda p: p.try_cast("double"))


def scheme_errors(thresholds: Column) -> Column:
    """Names of the rules that a list of thresholds breaks."""
    rises = F.forall(F.sequence(F.lit(1), F.greatest(F.size(thresholds) - 1, F.lit(1))), lambda i: (i >= F.size(thresholds)) | (F.get(thresholds, i) > F.get(thresholds, i - 1)))
    bad = F.exists(thresholds, lambda t: t.isNull() | F.isnan(t) | (F.abs(t) == F.lit(math.inf)))
    return F.array_compact(F.array(F.when(F.size(thresholds) == 0, "empty"), F.when(bad, "not_finite"), F.when(~bad & ~rises, "not_increasing")))


def _known_form(text: Column) -> Column:
    names = F.create_map(*(F.lit(x) for kv in FORM_ALIASES.items() for x in kv))
    return F.try_element_at(names, F.replace(F.lower(F.trim(text)), F.lit(" "), F.lit("_")))


def canonical_form(text: Column) -> Column:
    """One of FORMS; an unknown spelling raises."""
    return F.when(text.isNotNull(), F.coalesce(_known_form(text), F.raise_error(F.concat(F.lit("unknown frame form "), text))))


def _asked_forms(text: Column) -> Column:
    return F.filter(F.split(text, ","), lambda p: F.trim(p) != "")


def _all_forms(text: Column) -> Column:
    return F.lower(F.trim(text)) == "all"


def forms_problem(text: Column) -> Column:
    """What parse_forms raises for: `empty` or `unknown`, or null."""
    asked = _asked_forms(text)
    return F.when(_all_forms(text), None).when(F.size(asked) == 0, "empty").when(F.exists(asked, lambda p: _known_form(p).isNull()), "unknown")


def parse_forms(text: Column) -> Column:
    """Forms of a comma-separated list, each once and in the fixed order; `all` means every form.

    An unknown spelling or a list without any form raises; a null stays null."""
    order = F.array(*(F.lit(f) for f in FORMS))
    problem = forms_problem(text)
    asked = F.transform(_asked_forms(text), _known_form)
    found = F.when(_all_forms(text), order).otherwise(F.filter(order, lambda f: F.array_contains(asked, f)))
    return F.when(problem.isNull(), found).otherwise(F.raise_error(F.concat(problem, F.lit(" frame form in: "), text)))


def tukey_weights(length: int, alpha: float = 0.3) -> list[float]:
    """A window flat in the middle with cosine flanks that take up the share alpha."""
    if length == 1 or alpha == 0:
        return [1.0] * length
    flank, last = alpha / 2, length - 1
    place = [min(k, last - k) / last for k in range(length)]
    return [0.5 * (1 + math.cos(math.pi * (p / flank - 1))) if p < flank else 1.0 for p in place]


def tapered(signal: Column, length: int, alpha: float = 0.3) -> Column:
    weights = F.array(*(F.lit(w) for w in tukey_weights(length, alpha)))
    return F.zip_with(signal, weights, lambda x, w: x * w)


def softmax(z: Column) -> Column:
    e = F.transform(z, lambda x: F.exp(x - F.array_max(z)))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, y: a + y))


def argmax(p: Column) -> Column:
    """Place of the first largest value, from 0."""
    return (F.array_position(p, F.array_max(p)) - 1).cast("int")


def decide(p: Column, threshold: float | None = None) -> Column:
    """Predicted class: the first largest probability, or 1 where the second reaches the threshold."""
    return argmax(p) if threshold is None else (F.get(p, F.lit(1)) >= threshold).cast("int")


#: The policies of the learning rate.
SCHEDULES = ("warmup_cosine", "constant")


def rate_problem(peak: Column, floor: Column, warmup: Column, schedule: Column) -> Column:
    """The first rule that settings of the learning rate break, or null."""
    finite = lambda x: F.coalesce(F.abs(x) < F.lit(math.inf), F.lit(False))
    return F.when(~(finite(peak) & finite(floor) & (floor > 0) & (floor <= peak)), "rates").when(warmup < 0, "warmup").when(~schedule.isin(*SCHEDULES), "schedule")


def learning_rate(epoch: Column, epochs: int, peak: float, floor: float, warmup: int, schedule: str = "warmup_cosine", beyond: bool = False) -> Column:
    """Linear rise, then half a cosine down to the floor; or always the peak. Wrong settings, and epochs outside the run, raise; with `beyond` the curve goes on after the run's end."""
    if not 0 < floor <= peak < math.inf or warmup < 0 or schedule not in SCHEDULES:
        raise ValueError(f"learning rate from {floor} to {peak}, warm-up {warmup}, schedule {schedule}")
    rise = min(warmup, max(epochs - 2, 0))
    down = epochs - rise - 1
    part = F.lit(math.pi) * (epoch - (rise + 1)) / F.lit(float(max(down, 1)))
    fall = F.lit(floor) + F.lit(peak - floor) * (1 + F.cos(part)) / 2 if down else F.lit(peak)
    rate = F.when(epoch <= rise, F.lit(floor) + F.lit(peak - floor) * epoch / F.lit(float(max(rise, 1)))).otherwise(fall)
    inside = F.when((epoch >= 1) & (F.lit(beyond) | (epoch <= epochs)), F.lit(peak) if schedule == "constant" else rate)
    return inside.when(epoch.isNotNull(), F.raise_error(F.lit("epoch outside the run")).cast("double"))


def rate_token(x: Column) -> Column:
    """A number as mantissa and signed exponent that a file name may hold, as in 3em4."""
    text = F.format_string("%.11e", x)
    mantissa = F.replace(F.regexp_replace(F.regexp_extract(text, "^([^e]+)e", 1), r"\.?0+$", ""), F.lit("."), F.lit("p"))
    power = F.regexp_extract(text, "e(.+)$", 1).cast("int")
    return F.concat(mantissa, F.when(power < 0, "em").otherwise("ep"), F.abs(power).cast("string"))


def rate_tag(peak: Column, floor: Column, warmup: Column, schedule: Column) -> Column:
    """Part of a run's name that tells its learning rates."""
    policy = F.when(schedule == "warmup_cosine", F.concat(F.lit("warmcos"), warmup.cast("string"))).otherwise("constant")
    return F.concat(F.lit("lr_"), policy, F.lit("_peak"), rate_token(peak), F.lit("_min"), rate_token(floor))


def run_name(form: Column, region: Column, channel: Column, variant: Column, *more: Column) -> Column:
    """Name of an experiment. variant: a key of MODEL_TOKENS; channel 3 tells its selection; further parts that are null drop out."""
    model = F.create_map(*(F.lit(x) for kv in MODEL_TOKENS.items() for x in kv))[variant]
    selection = F.when(channel.cast("int") == 3, F.lit(f"sel_{CHANNEL3_SELECTION}"))
    parts = (F.concat(F.lit("form_"), form), F.concat(F.lit("regions_"), region), F.concat(F.lit("channels_"), channel.cast("string")))
    return F.concat_ws("__", *parts, model, F.lit(PREPROCESSING_TAG), selection, *more)


#: Channel and rest of a run's name; neither part before may hold the next mark.
_TO_CHANNEL, _REST = "(?:(?!__channels_).)*", "__channels_((?:(?!__).)+)__(.+)$"


def parsed_run_name(name: Column) -> Column:
    """Struct of the parts of an experiment's name; null where it is no such name."""
    pattern = f"^form_((?:(?!__regions_).)*)__regions_({_TO_CHANNEL}){_REST}"
    part = lambda i: F.regexp_extract(name, pattern, i)
    return F.when(name.rlike(pattern), F.struct(part(1).alias("form"), part(2).alias("region"), part(3).alias("channel"), part(4).alias("rest")))


def confusion_image(name: Column, split: Column) -> Column:
    """File name of an experiment's confusion image; null where the name is no experiment's."""
    pattern = f"^(form_{_TO_CHANNEL}){_REST}"
    plain = F.replace(F.replace(split, F.lit("\\"), F.lit("\\\\")), F.lit("$"), F.lit("\\$"))  # in a replacement both have a meaning
    new = F.concat(F.lit("$1__channels_$2__split_"), plain, F.lit("__$3.png"))
    return once(name, lambda n: F.when(F.rlike(n, F.lit(pattern)), F.regexp_replace(n, F.lit(pattern), new)))


def class_token(label: Column, classes: int = 2) -> Column:
    """Short class name for file names."""
    if classes != 2:
        return F.concat(F.lit("label"), label.cast("string"))
    return F.when(label == 0, "imminent").when(label == 1, "safe").otherwise(F.concat(F.lit("label"), label.cast("string")))
