"""Evaluation queries over predictions, branch scores and training runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import evaluation as E
from ..sources.scratch import shared_path
from .registry import register
from .views import branches, history, predictions, sql, table

R = lambda c, n=6: F.round(c, n)


def decided(s, d, thr=0.5):
    return predictions(s, d).withColumn("prediction", (F.col("p1") >= thr).cast("int"))


DEC = "de AS (SELECT *, CAST(p1 >= 0.5 AS INTEGER) AS prediction FROM predictions)"


def probs(s, d):
    return branches(s, d).withColumn("probs", S.softmax(F.col("logits")))


PROBS = """ex AS (SELECT *, list_transform(logits, lambda x: exp(x - list_max(logits))) AS e FROM branches), pr AS (SELECT sample_id, label, branch_id, list_transform(e, lambda x: x / list_sum(e)) AS probs FROM ex),
 pc AS (SELECT sample_id, label, branch_id, unnest(probs) AS p, unnest(range(10)) AS class FROM pr), vt AS (SELECT sample_id, label, class, sum(p) AS s, avg(p) AS m FROM pc GROUP BY ALL),
 vl AS (SELECT sample_id, label, list(m ORDER BY class) AS probs, list(s ORDER BY class) AS sums FROM vt GROUP BY ALL)"""


def voted(s, d):
    v = E.votes(probs(s, d), ["sample_id", "label"])
    return v.withColumn("probs", F.col("vote_mean")).withColumn("prediction", S.argmax(F.transform("vote_mean", lambda x: F.round(x, 12))))


VOTED = f"{PROBS}, vo AS (SELECT sample_id, label, probs, sums, CAST(list_position(list_transform(probs, lambda x: round(x, 12)), list_max(list_transform(probs, lambda x: round(x, 12)))) - 1 AS INTEGER) AS prediction FROM vl)"
ONE = f"{VOTED}, ov AS (SELECT CAST(c AS INTEGER) AS class, CAST(label = c AS INTEGER) AS label, CAST(prediction = c AS INTEGER) AS prediction, round(probs[c + 1], 9) AS score FROM vo, range(10) AS t(c))"
AUC = "(sum(CASE WHEN label = 1 THEN mr END) - count(*) FILTER (label = 1) * (count(*) FILTER (label = 1) + 1) / 2.0) / nullif(count(*) FILTER (label = 1) * count(*) FILTER (label = 0), 0)"

register("softmax", lambda s, d: probs(s, d).select("sample_id", "branch_id", F.posexplode("probs").alias("class", "p")).select("sample_id", "branch_id", "class", R("p", 9).alias("p")), sql(f"WITH {PROBS} SELECT sample_id, branch_id, CAST(class AS INTEGER) AS class, round(p, 9) AS p FROM pc", "branches"))
register("argmax_decision", lambda s, d: predictions(s, d).withColumn("p", F.array(1 - F.col("p1"), F.col("p1"))).select("sample_id", S.decide(F.col("p")).alias("by_argmax"), S.decide(F.col("p"), 0.5).alias("by_threshold")),
         sql("SELECT sample_id, CAST(p1 > 1 - p1 AS INTEGER) AS by_argmax, CAST(p1 >= 0.5 AS INTEGER) AS by_threshold FROM predictions", "predictions"))
register("confusion_matrix", lambda s, d: E.confusion(voted(s, d), 10), sql(f"WITH {VOTED} SELECT CAST(a AS INTEGER) AS label, CAST(b AS INTEGER) AS prediction, (SELECT count(*) FROM vo WHERE label = a AND prediction = b) AS n FROM range(10) AS x(a), range(10) AS y(b)", "branches"))
BIN = """bc AS (SELECT toxic, count(*) FILTER (label = 0 AND prediction = 0) AS tn, count(*) FILTER (label = 0 AND prediction = 1) AS fp, count(*) FILTER (label = 1 AND prediction = 0) AS fn, count(*) FILTER (label = 1 AND prediction = 1) AS tp FROM de GROUP BY toxic)"""
register("binary_metrics", lambda s, d: E.binary_metrics(decided(s, d), ["toxic"]).drop("weighted_recall"), sql(f"""WITH {DEC}, {BIN} SELECT *, (tn + tp) / greatest(tn + fp + fn + tp, 1) AS accuracy, tp / greatest(tp + fp, 1) AS precision, 2 * tp / greatest(2 * tp + fp + fn, 1) AS f1,
 tp / greatest(tp + fn, 1) AS sensitivity, tn / greatest(tn + fp, 1) AS specificity FROM bc""", "predictions"))  # fmt: skip
register("weighted_recall", lambda s, d: E.binary_metrics(decided(s, d), ["toxic"], 2.0).select("toxic", R("weighted_recall").alias("weighted_recall")), sql(f"WITH {DEC}, {BIN} SELECT toxic, CASE WHEN tn + fp > 0 AND fn + tp > 0 THEN round((tn / greatest(tn + fp, 1) + 2.0 * tp / greatest(tp + fn, 1)) / 3.0, 6) END AS weighted_recall FROM bc", "predictions"))
register("roc_auc", lambda s, d: E.roc_auc(predictions(s, d), ["toxic"], "p1").withColumn("auc", R("auc", 9)), sql(f"WITH r AS (SELECT toxic, label, rank() OVER (PARTITION BY toxic ORDER BY p1) + (count(*) OVER (PARTITION BY toxic, p1) - 1) / 2.0 AS mr FROM predictions) SELECT toxic, round({AUC}, 9) AS auc, count(*) FILTER (label = 1) AS n_pos, count(*) FILTER (label = 0) AS n_neg FROM r GROUP BY toxic", "predictions"))
register("midrank", lambda s, d: E.midranks(predictions(s, d), ["toxic"], "p1"), sql("WITH g AS (SELECT toxic, p1 AS score, count(*) AS n FROM predictions GROUP BY ALL) SELECT toxic, score, n, sum(n) OVER (PARTITION BY toxic ORDER BY score) - n + (n + 1) / 2 AS midrank FROM g", "predictions"))
PER = f"""{ONE}, rk AS (SELECT *, rank() OVER (PARTITION BY class ORDER BY score) + (count(*) OVER (PARTITION BY class, score) - 1) / 2.0 AS mr FROM ov),
 mc AS (SELECT class, count(*) FILTER (label = 1) AS support, count(*) FILTER (label = 1 AND prediction = 1) / greatest(count(*) FILTER (prediction = 1), 1) AS precision,
 count(*) FILTER (label = 1 AND prediction = 1) / greatest(count(*) FILTER (label = 1), 1) AS sensitivity, count(*) FILTER (label = 0 AND prediction = 0) / greatest(count(*) FILTER (label = 0), 1) AS specificity,
 2 * count(*) FILTER (label = 1 AND prediction = 1) / greatest(count(*) FILTER (label = 1) + count(*) FILTER (prediction = 1), 1) AS f1, {AUC} AS auc FROM rk GROUP BY class)"""


def per_class(s, d):
    return E.multiclass_metrics(voted(s, d).withColumn("probs", F.transform("probs", lambda x: F.round(x, 9))), 10)


register("multiclass_metrics", lambda s, d: per_class(s, d).select("class", "support", *(R(c).alias(c) for c in ("precision", "sensitivity", "specificity", "f1", "auc"))), sql(f"WITH {PER} SELECT class, support, round(precision, 6) AS precision, round(sensitivity, 6) AS sensitivity, round(specificity, 6) AS specificity, round(f1, 6) AS f1, round(auc, 6) AS auc FROM mc", "branches"))
register("macro_metrics", lambda s, d: E.macro_metrics(per_class(s, d)).select("n_classes", *(R(c).alias(c) for c in ("macro_precision", "balanced_accuracy", "macro_f1", "macro_auc"))), sql(f"WITH {PER} SELECT count(*) AS n_classes, round(avg(precision), 6) AS macro_precision, round(avg(sensitivity), 6) AS balanced_accuracy, round(avg(f1), 6) AS macro_f1, round(avg(auc), 6) AS macro_auc FROM mc WHERE support > 0", "branches"))
register("log_loss", lambda s, d: probs(s, d).groupBy("branch_id").agg(R(F.avg(E.log_loss(F.col("probs"), F.col("label")))).alias("loss")), sql(f"WITH {PROBS} SELECT branch_id, round(avg(-ln(greatest(probs[label + 1], 1e-12))), 6) AS loss FROM pr GROUP BY 1", "branches"))
register("vote_sum", lambda s, d: voted(s, d).select("sample_id", F.posexplode("vote_sum").alias("class", "v")).select("sample_id", "class", R("v").alias("vote_sum")), sql(f"WITH {PROBS} SELECT sample_id, CAST(class AS INTEGER) AS class, round(s, 6) AS vote_sum FROM vt", "branches"))
register("vote_mean", lambda s, d: voted(s, d).select("sample_id", "prediction", R(F.array_max("vote_mean")).alias("top")), sql(f"WITH {VOTED} SELECT sample_id, prediction, round(list_max(probs), 6) AS top FROM vo", "branches"))
register("vote_nll", lambda s, d: voted(s, d).agg(R(F.avg(E.log_loss(F.col("probs"), F.col("label")))).alias("vote_nll")).crossJoin(probs(s, d).agg(R(F.avg(E.log_loss(F.col("probs"), F.col("label")))).alias("mean_head_ce"))),
         sql(f"WITH {VOTED} SELECT (SELECT round(avg(-ln(greatest(probs[label + 1], 1e-12))), 6) FROM vo) AS vote_nll, (SELECT round(avg(-ln(greatest(probs[label + 1], 1e-12))), 6) FROM pr) AS mean_head_ce", "branches"))
register("label_error_gate", lambda s, d: E.error_gate(decided(s, d).groupBy("toxic").agg(F.count_if((F.col("label") == 1) & (F.col("prediction") == 0)).alias("fn"), F.count_if((F.col("label") == 1) & (F.col("prediction") == 1)).alias("tp")), 0.4),
         sql(f"WITH {DEC}, g AS (SELECT toxic, count(*) FILTER (label = 1 AND prediction = 0) AS fn, count(*) FILTER (label = 1 AND prediction = 1) AS tp FROM de GROUP BY 1) SELECT *, fn / nullif(fn + tp, 0) AS label1_error, fn / nullif(fn + tp, 0) > 0.4 AS stop FROM g", "predictions"))
SWEEP = """c AS (SELECT toxic, p1 AS thr, 0 AS above FROM predictions GROUP BY ALL UNION SELECT toxic, 0.0, 0 FROM predictions UNION SELECT toxic, NULL, 1 FROM predictions),
 v AS (SELECT c.toxic, thr, above, count(*) FILTER (label = 0 AND (above = 1 OR p1 < thr)) / count(*) FILTER (label = 0) + {w} * count(*) FILTER (label = 1 AND above = 0 AND p1 >= thr) / count(*) FILTER (label = 1) AS obj FROM c JOIN predictions p ON p.toxic = c.toxic GROUP BY ALL),
 b AS (SELECT toxic, thr AS threshold, obj FROM v QUALIFY row_number() OVER (PARTITION BY toxic ORDER BY obj DESC, above DESC, thr DESC) = 1)"""
register("threshold_sweep", lambda s, d: E.threshold_sweep(predictions(s, d), ["toxic"], "p1", 2.0).withColumn("objective", R("objective")), sql("WITH " + SWEEP.format(w=2.0) + " SELECT toxic, threshold, round(obj, 6) AS objective FROM b WHERE obj IS NOT NULL AND NOT isnan(obj)", "predictions"))
FOLD = """st AS (SELECT experiment, CAST(NULL AS INTEGER) AS best, 0 AS stale, CAST(NULL AS INTEGER) AS last, CAST('-infinity' AS DOUBLE) AS ba, CAST('infinity' AS DOUBLE) AS bl, 0 AS k FROM (SELECT DISTINCT experiment FROM history)
 UNION ALL SELECT s.experiment, CASE WHEN s.stale >= {p} THEN s.best WHEN {better} THEN h.epoch ELSE s.best END, CASE WHEN s.stale >= {p} THEN s.stale WHEN {better} THEN 0 ELSE s.stale + 1 END,
 CASE WHEN s.stale >= {p} THEN s.last ELSE h.epoch END, CASE WHEN s.stale < {p} AND ({better}) THEN h.val_auc ELSE s.ba END, CASE WHEN s.stale < {p} AND ({better}) THEN h.val_loss ELSE s.bl END, s.k + 1
 FROM st s JOIN history h ON h.experiment = s.experiment AND h.epoch = s.k + 1), fi AS (SELECT * FROM st QUALIFY row_number() OVER (PARTITION BY experiment ORDER BY k DESC) = 1)"""
LESS = "h.val_loss < s.bl - 1e-6"
MORE = "h.val_auc > s.ba + 1e-4 OR (abs(h.val_auc - s.ba) <= 1e-4 AND h.val_loss < s.bl - 1e-4)"
register("best_epoch_loss", lambda s, d: E.best_epoch_loss(history(s, d), 12), sql("WITH " + FOLD.format(p=12, better=LESS) + " SELECT experiment, best AS best_epoch, last AS stopped_epoch, bl AS best_val_loss FROM fi", "history").replace("WITH history", "WITH RECURSIVE history", 1))
register("best_epoch_auc", lambda s, d: E.best_epoch_auc(history(s, d), 12), sql("WITH " + FOLD.format(p=12, better=MORE) + " SELECT experiment, best AS best_epoch, last AS stopped_epoch, ba AS best_val_auc, bl AS best_val_loss FROM fi", "history").replace("WITH history", "WITH RECURSIVE history", 1))
register("lr_schedule", lambda s, d: history(s, d).select("experiment", "epoch").withColumns({"lr": R(S.learning_rate(F.col("epoch"), 100, 3e-4, 1e-6, 5, beyond=True) * 1e6), "constant": S.learning_rate(F.col("epoch"), 100, 0.5, 0.25, 5, "constant", True), "problem": S.rate_problem((F.col("epoch") - 3).cast("double"), F.lit(1.0), F.col("epoch") % 7 - 1, F.when(F.col("epoch") % 5 == 0, "steps").otherwise("constant"))}),
         sql("SELECT experiment, epoch, CAST(0.5 AS DOUBLE) AS constant, CASE WHEN epoch < 4 THEN 'rates' WHEN epoch % 7 = 0 THEN 'warmup' WHEN epoch % 5 = 0 THEN 'schedule' END AS problem, round(1e6 * CASE WHEN epoch <= 5 THEN 1e-6 + (3e-4 - 1e-6) * epoch / 5.0 ELSE 1e-6 + (3e-4 - 1e-6) * (1 + cos(pi() * (epoch - 6) / 94.0)) / 2 END, 6) AS lr FROM history", "history"))
register("loss_bounds", lambda s, d: E.loss_bounds(history(s, d), ["experiment"]), sql("WITH m AS (SELECT experiment, min(least(train_loss, val_loss)) AS lo, max(greatest(train_loss, val_loss)) AS hi FROM history GROUP BY 1) SELECT experiment, lo - CASE WHEN hi > lo THEN (hi - lo) * CAST(0.05 AS DOUBLE) ELSE greatest(abs(hi) * 0.05, 0.05) END AS lower, hi + CASE WHEN hi > lo THEN (hi - lo) * CAST(0.05 AS DOUBLE) ELSE greatest(abs(hi) * 0.05, 0.05) END AS upper FROM m", "history"))
RES = "re AS (SELECT experiment AS id, max(val_auc) AS val_accuracy, min(val_loss) AS val_loss FROM history GROUP BY 1)"


def results(s, d):
    return history(s, d).groupBy(F.col("experiment").alias("id")).agg(F.max("val_auc").alias("val_accuracy"), F.min("val_loss").alias("val_loss"))


register("leaderboard", lambda s, d: E.leaderboard(results(s, d)), sql(f"WITH {RES} SELECT *, CAST(row_number() OVER (ORDER BY val_accuracy DESC, val_loss, id) AS INTEGER) AS place FROM re", "history"))
register("dedupe_candidates", lambda s, d: E.dedupe_candidates(table(s, d, "part").select(F.col("p_partkey").alias("id"), "p_size", "p_type", "p_brand"), ["p_size", "p_type"], ["p_brand"]).select("id", "n_references", F.col("last.id").alias("last_reference")),
         "SELECT arg_min(p_partkey, (p_brand, p_partkey)) AS id, count(*) AS n_references, arg_max(p_partkey, (p_brand, p_partkey)) AS last_reference FROM part GROUP BY p_size, p_type")
PAIR = "pa AS (SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS a, round(CAST(unnest(embedding) AS DOUBLE), 2) AS b FROM embeddings), df AS (SELECT vec_id, max(abs(a - b)) AS max_abs, sqrt(avg((a - b) * (a - b))) AS rmse, sqrt(sum((a - b) * (a - b))) / sqrt(sum(b * b)) AS rel_l2, coalesce(corr(a, b), 0) AS corr FROM pa GROUP BY 1)"


def differences(s, d):
    v = table(s, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("a"))
    return E.array_differences(v.withColumn("b", F.transform("a", lambda x: F.round(x, 2))), "a", "b", ["vec_id"])




def _diff_stats(s, d):
    path = shared_path(s, "differences")
    differences(s, d).write.parquet(path)
    x = s.read.parquet(path)
    one = x.agg(R(F.max("max_abs")).alias("max_abs"), R(F.sqrt(F.avg(F.col("rmse") * F.col("rmse")))).alias("rmse"), F.count_if("equal").alias("n_equal"))
    q = E.quantiles(x, {"rel_l2_median": ("rel_l2", 0.5), "corr_median": ("corr", 0.5), "corr_p10": ("corr", 0.1)})
    return one.crossJoin(q.select(*(R(c).alias(c) for c in q.columns)))  # one row each


register("array_diff_stats", _diff_stats,
         f"WITH {PAIR} SELECT round(max(max_abs), 6) AS max_abs, round(sqrt(avg(rmse * rmse)), 6) AS rmse, round(median(rel_l2), 6) AS rel_l2_median, round(median(corr), 6) AS corr_median, round(quantile_cont(corr, 0.1), 6) AS corr_p10, count(*) FILTER (max_abs = 0) AS n_equal FROM df")
register("evaluate_run", lambda s, d: _evaluate(s, d), sql("""WITH p AS (SELECT *, CASE WHEN sample_id % 20 < 12 THEN 'train' WHEN sample_id % 20 < 15 THEN 'val' ELSE 'test' END AS split FROM predictions),
 c AS (SELECT p1 AS thr, 0 AS above FROM p WHERE split = 'val' UNION SELECT 0.0, 0 UNION SELECT NULL, 1), v AS (SELECT thr, above, count(*) FILTER (label = 0 AND (above = 1 OR p1 < thr)) / count(*) FILTER (label = 0) + 2.0 * count(*) FILTER (label = 1 AND above = 0 AND p1 >= thr) / count(*) FILTER (label = 1) AS obj FROM c, p WHERE split = 'val' GROUP BY ALL),
 b AS (SELECT thr FROM v ORDER BY obj DESC, above DESC, thr DESC LIMIT 1)
 SELECT split, count(*) FILTER (label = 0 AND p1 < thr) AS tn, count(*) FILTER (label = 0 AND p1 >= thr) AS fp, count(*) FILTER (label = 1 AND p1 < thr) AS fn, count(*) FILTER (label = 1 AND p1 >= thr) AS tp FROM p, b GROUP BY split""", "predictions"))  # fmt: skip


def _evaluate(s, d):
    """The threshold is chosen on the validation split and then holds for all."""
    k = F.col("sample_id") % 20
    p = predictions(s, d).withColumn("split", F.when(k < 12, "train").when(k < 15, "val").otherwise("test"))
    best = E.threshold_sweep(p.where("split = 'val'").withColumn("one", F.lit(1)), ["one"], "p1", 2.0).select("threshold")
    return E.binary_metrics(p.crossJoin(F.broadcast(best)).withColumn("prediction", F.coalesce((F.col("p1") >= F.col("threshold")).cast("int"), F.lit(0))), ["split"]).select("split", "tn", "fp", "fn", "tp")  # best has one row
