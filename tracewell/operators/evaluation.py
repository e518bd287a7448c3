"""Model evaluation: decisions, metrics, votes, thresholds, epochs, leaderboards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import ranks

#: Buckets of equal width into which scores from 0 to 1 are dealt for prefix sums.
BINS = 1024


def confusion(df: DataFrame, classes: int, by: list[str] | None = None) -> DataFrame:
    """Counts of (label, prediction), empty cells too."""
    by = by or []
    cells = df.sparkSession.range(classes * classes).select((F.expr(f"cast(id div {classes} as int)")).alias("label"), (F.col("id") % classes).cast("int").alias("prediction"))
    if by:
        cells = df.select(*by).distinct().crossJoin(F.broadcast(cells))  # a few cells for each group
    found = df.groupBy(*by, F.col("label").cast("int").alias("label"), F.col("prediction").cast("int").alias("prediction")).agg(F.count("*").alias("n"))
    return cells.join(found, [*by, "label", "prediction"], "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))


def ratio(a: Column, b: Column) -> Column:
    """a / b with the denominator at least 1."""
    return a / F.greatest(b, F.lit(1))


def binary_metrics(df: DataFrame, by: list[str] | None = None, weight: float = 1.0) -> DataFrame:
    """Counts and rates of labels and predictions in 0 and 1; weighted_recall is null where a class is absent."""
    y, p = F.col("label") == 1, F.col("prediction") == 1
    cells = df.groupBy(*(by or [])).agg(F.count_if(~y & ~p).alias("tn"), F.count_if(~y & p).alias("fp"), F.count_if(y & ~p).alias("fn"), F.count_if(y & p).alias("tp"))
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    out = cells.withColumns({
        "accuracy": ratio(tn + tp, tn + fp + fn + tp), "precision": ratio(tp, tp + fp), "f1": ratio(2 * tp, 2 * tp + fp + fn),
        "sensitivity": ratio(tp, tp + fn), "specificity": ratio(tn, tn + fp),
    })
    both = (tn + fp > 0) & (fn + tp > 0)
    return out.withColumn("weighted_recall", F.when(both, (F.col("specificity") + weight * F.col("sensitivity")) / (1.0 + weight)))


def per_score(df: DataFrame, by: list[str], score: str) -> DataFrame:
    """Positives and negatives at each distinct score, and below it. A window sees one bucket of scores at a time.

    A null score is left out; one that is no number raises, as it has no place in the order."""
    number = F.when(F.isnan(score), F.raise_error(F.lit(f"{score} is not a number")).cast("double")).otherwise(F.col(score))
    counts = F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") == 0).alias("neg")
    each = df.where(F.col(score).isNotNull()).groupBy(*by, number.alias("score")).agg(*counts)
    each = each.withColumn("_b", F.least(F.greatest(F.floor(F.col("score") * BINS), F.lit(0)), F.lit(BINS)).cast("int"))
    sums = each.groupBy(*by, "_b").agg(F.sum("pos").alias("_p"), F.sum("neg").alias("_n"))
    w = W.partitionBy(*by).orderBy("_b")
    sums = sums.withColumn("_pb", F.sum("_p").over(w) - F.col("_p")).withColumn("_nb", F.sum("_n").over(w) - F.col("_n"))
    inside = W.partitionBy(*by, "_b").orderBy("score")
    out = each.join(sums.drop("_p", "_n"), [*by, "_b"])
    below = lambda c, before: (F.sum(c).over(inside) - F.col(c) + F.col(before)).alias(f"{c}_below")
    return out.select(*by, "score", "pos", "neg", below("pos", "_pb"), below("neg", "_nb"))


def roc_auc(df: DataFrame, by: list[str], score: str) -> DataFrame:
    """Share of (positive, negative) pairs in the right order, ties one half; null where a class is absent."""
    s = per_score(df, by, score).groupBy(*by).agg(F.sum(F.col("pos") * (F.col("neg_below") + F.col("neg") * 0.5)).alias("u"), F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    return s.select(*by, F.try_divide(F.col("u"), F.col("p") * F.col("n")).alias("auc"), F.col("p").alias("n_pos"), F.col("n").alias("n_neg"))


def midranks(df: DataFrame, by: list[str], score: str) -> DataFrame:
    """Mean rank of each distinct score."""
    s = per_score(df, by, score)
    n = F.col("pos") + F.col("neg")
    return s.select(*by, "score", n.alias("n"), (F.col("pos_below") + F.col("neg_below") + (n + 1) / 2).alias("midrank"))


def threshold_sweep(df: DataFrame, by: list[str], score: str, reward: float) -> DataFrame:
    """Best threshold by specificity + reward * sensitivity, ties to the higher; null means that nothing is positive."""
    s = per_score(df, by, score)
    total = s.groupBy(*by).agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    zero = total.select(*by, F.lit(0.0).alias("thr"), F.lit(0).cast("long").alias("pb"), F.lit(0).cast("long").alias("nb"), F.lit(0).alias("above"))
    top = total.select(*by, F.lit(None).cast("double").alias("thr"), F.col("p").alias("pb"), F.col("n").alias("nb"), F.lit(1).alias("above"))
    each = s.select(*by, F.col("score").alias("thr"), F.col("pos_below").alias("pb"), F.col("neg_below").alias("nb"), F.lit(0).alias("above"))
    all_ = zero.union(top).union(each).join(total, by)
    value = F.try_divide(F.col("nb"), F.col("n")) + reward * F.try_divide(F.col("p") - F.col("pb"), F.col("p"))
    best = all_.withColumn("value", value).where("value is not null").groupBy(*by).agg(F.max(F.struct("value", "above", "thr")).alias("b"))
    return best.select(*by, F.col("b.thr").alias("threshold"), F.col("b.value").alias("objective"))


def one_vs_rest(df: DataFrame, classes: int) -> DataFrame:
    """(class, label 0/1, prediction 0/1, score) of every class from label, prediction and probs."""
    each = F.transform(F.sequence(F.lit(0), F.lit(classes - 1)), lambda c: F.struct(c.alias("class"), (F.col("label") == c).cast("int").alias("label"), (F.col("prediction") == c).cast("int").alias("prediction"), F.get("probs", c).alias("score")))
    return df.select(F.explode(each).alias("x")).select("x.*")


def multiclass_metrics(df: DataFrame, classes: int) -> DataFrame:
    """Metrics of each class against the rest, with support; classes without support have a null auc."""
    rest = one_vs_rest(df, classes)
    m, a = binary_metrics(rest, ["class"]), roc_auc(rest, ["class"], "score")
    return m.join(a, "class").select("class", (F.col("tp") + F.col("fn")).alias("support"), "precision", "sensitivity", "specificity", "f1", "auc")


def macro_metrics(per_class: DataFrame) -> DataFrame:
    """Means over classes with support."""
    return per_class.where("support > 0").agg(F.avg("precision").alias("macro_precision"), F.avg("sensitivity").alias("balanced_accuracy"), F.avg("f1").alias("macro_f1"), F.avg("auc").alias("macro_auc"), F.count("*").alias("n_classes"))


def log_loss(probs: Column, label: Column) -> Column:
    return -F.log(F.greatest(F.get(probs, label), F.lit(1e-12)))


def votes(df: DataFrame, key: list[str], probs: str = "probs") -> DataFrame:
    """Sum and mean of the branches' probabilities, class by class; a key has a few branches."""
    rows = df.groupBy(*key).agg(F.array_sort(F.collect_list(probs)).alias("v"))  # sorted, so that sums do not depend on the order of rows
    total = F.aggregate(F.slice("v", 2, F.greatest(F.size("v") - 1, F.lit(1))), F.get("v", F.lit(0)), lambda a, x: F.zip_with(a, x, lambda p, q: p + q))
    rows = rows.withColumn("vote_sum", total)
    return rows.select(*key, "vote_sum", F.transform("vote_sum", lambda x: x / F.size("v")).alias("vote_mean"))


def quantiles(df: DataFrame, wanted: dict[str, tuple[str, float]]) -> DataFrame:
    """One row: for each name the interpolated quantile of a column's values (see ranks.quantiles)."""
    found = ranks.quantiles(df, wanted)
    return df.sparkSession.createDataFrame([tuple(found.values())], ", ".join(f"{k} double" for k in found))


def error_gate(cells: DataFrame, limit: float) -> DataFrame:
    """Share of missed positives and whether it is above the limit; without positives both are null."""
    share = F.try_divide(F.col("fn"), F.col("fn") + F.col("tp"))
    return cells.withColumn("label1_error", share).withColumn("stop", share > limit)


def first_improvement(df: DataFrame, by: str, epoch: str, better: Column, patience: int, start: Column, keep: list[str]) -> DataFrame:
    """Fold over the epochs of each run; `better` compares a row x with the state a, which keeps `best` and columns of it.

    The epochs of a run are one array: a run has as many as its settings allow (tens to thousands), whatever the number of runs."""
    rows = df.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(epoch, *keep))).alias("h"))
    step = lambda a, x: F.when(a["stale"] >= patience, a).when(better(a, x), F.struct(x[epoch].alias("best"), F.lit(0).alias("stale"), x[epoch].alias("last"), *(x[k].alias(k) for k in keep))).otherwise(F.struct(a["best"].alias("best"), (a["stale"] + 1).alias("stale"), x[epoch].alias("last"), *(a[k].alias(k) for k in keep)))
    return rows.withColumn("r", F.aggregate("h", start, step)).select(by, F.col("r.best").alias("best_epoch"), F.col("r.last").alias("stopped_epoch"), *(F.col(f"r.{k}").alias(f"best_{k}") for k in keep))


def best_epoch_loss(df: DataFrame, patience: int, gain: float = 1e-6) -> DataFrame:
    """First epoch after which the loss no longer improves by more than `gain` within the patience."""
    start = F.struct(F.lit(None).cast("int").alias("best"), F.lit(0).alias("stale"), F.lit(None).cast("int").alias("last"), F.lit(float("inf")).alias("val_loss"))
    return first_improvement(df, "experiment", "epoch", lambda a, x: x["val_loss"] < a["val_loss"] - gain, patience, start, ["val_loss"])


def best_epoch_auc(df: DataFrame, patience: int, gain: float = 1e-4) -> DataFrame:
    """As best_epoch_loss, by AUC; where the AUC is equal within the gain, by a loss lower by the gain."""
    start = F.struct(F.lit(None).cast("int").alias("best"), F.lit(0).alias("stale"), F.lit(None).cast("int").alias("last"), F.lit(float("-inf")).alias("val_auc"), F.lit(float("inf")).alias("val_loss"))
    better = lambda a, x: (x["val_auc"] > a["val_auc"] + gain) | ((F.abs(x["val_auc"] - a["val_auc"]) <= gain) & (x["val_loss"] < a["val_loss"] - gain))
    return first_improvement(df, "experiment", "epoch", better, patience, start, ["val_auc", "val_loss"])


def leaderboard(results: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Candidates with their place: by accuracy, then the lower loss, then the id."""
    return ranks.ranked(results, by or [], [F.col("val_accuracy").desc(), F.col("val_loss").asc(), F.col("id").asc()], "place").drop("place_of")


def array_differences(df: DataFrame, a: str, b: str, key: list[str]) -> DataFrame:
    """For two arrays of each row: equality, largest difference, rmse, relative L2 and correlation (0 for a constant)."""
    x = df.select(*key, F.posexplode(F.arrays_zip(F.col(a).alias("a"), F.col(b).alias("b"))).alias("pos", "v")).select(*key, F.col("v.a").alias("a"), F.col("v.b").alias("b"))
    d = F.col("a") - F.col("b")
    va, vb = F.var_pop("a"), F.var_pop("b")
    return x.groupBy(*key).agg(
        F.max(F.abs(d)).alias("max_abs"), F.sqrt(F.avg(d * d)).alias("rmse"), F.try_divide(F.sqrt(F.sum(d * d)), F.sqrt(F.sum(F.col("b") * F.col("b")))).alias("rel_l2"),
        F.coalesce(F.try_divide(F.covar_pop("a", "b"), F.sqrt(va * vb)), F.lit(0.0)).alias("corr"), (F.max(F.abs(d)) == 0).alias("equal"),
    )


def loss_bounds(df: DataFrame, by: list[str], pad: float = 0.05) -> DataFrame:
    """Limits of an axis that shows both losses."""
    m = df.groupBy(*by).agg(F.min(F.least("train_loss", "val_loss")).alias("lo"), F.max(F.greatest("train_loss", "val_loss")).alias("hi"))
    span = F.when(F.col("hi") > F.col("lo"), (F.col("hi") - F.col("lo")) * pad).otherwise(F.greatest(F.abs("hi") * pad, F.lit(pad)))
    return m.select(*by, (F.col("lo") - span).alias("lower"), (F.col("hi") + span).alias("upper"))


def dedupe_candidates(df: DataFrame, params: list[str], source: list[str]) -> DataFrame:
    """Each set of parameters once: the first id in source order, the last reference, and how many there are."""
    key, at = F.to_json(F.struct(*params)), F.struct(*source, "id")
    return df.withColumn("params", key).groupBy("params").agg(F.min_by("id", at).alias("id"), F.max(at).alias("last"), F.count("*").alias("n_references"))


def candidate_references(df: DataFrame, params: list[str], source: list[str]) -> DataFrame:
    """(candidate, and the columns of df): every reference beside the id under which its parameters are kept."""
    first = dedupe_candidates(df, params, source).select("params", F.col("id").alias("candidate"))
    return df.withColumn("params", F.to_json(F.struct(*params))).join(first, "params").drop("params")
