"""Classifiers of spark.ml over branch features, scored in batches, and sweeps over their settings that can be resumed.

They take the place of the trainers that are not rebuilt here; what is kept is the flow of data, votes and choices.
"""

from __future__ import annotations

import hashlib
import json
from concurrent.futures import ThreadPoolExecutor

from pyspark.ml.classification import MultilayerPerceptronClassificationModel, MultilayerPerceptronClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import paths
from .evaluation import binary_metrics, error_gate, leaderboard, log_loss


def fit(train: DataFrame, inputs: int, classes: int, hidden: list[int], rounds: int, seed: int = 1):
    """A perceptron on (features array<double>, label)."""
    model = MultilayerPerceptronClassifier(layers=[inputs, *hidden, classes], maxIter=rounds, seed=seed, labelCol="label", featuresCol="vector")
    return model.fit(train.select(array_to_vector("features").alias("vector"), F.col("label").cast("double").alias("label")))


def _vector(features: Column) -> Column:
    """features as a vector; one that is not finite raises."""
    sound = F.forall(features, lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)))
    return array_to_vector(F.when(sound, features).otherwise(F.raise_error(F.lit("features that are not finite")).cast("array<double>")))


def scored(model, rows: DataFrame) -> DataFrame:
    """rows with `probs`; a feature that is not finite raises."""
    out = model.transform(rows.withColumn("vector", _vector(F.col("features"))))
    return out.withColumn("probs", vector_to_array("probability")).drop("vector", "rawPrediction", "probability", "prediction")


def branch_scored(models: list, rows: DataFrame) -> DataFrame:
    """rows (branches array<array<double>>) with `branch_probs` [branch][class], their sum `vote_sum` and mean `vote_mean`.

    Each model sees its own branch of a row; all of them run in one pass over the rows, without an explosion or a join.
    Other numbers of branches than of models, and features that are not finite, raise."""
    number = F.when(F.size("branches") == len(models), F.col("branches")).otherwise(F.raise_error(F.lit(f"rows without {len(models)} branches")).cast("array<array<double>>"))
    out = rows.withColumn("_branches", number)
    for b, model in enumerate(models):
        own = model.copy({model.featuresCol: f"_v{b}", model.probabilityCol: f"_p{b}", model.rawPredictionCol: f"_r{b}", model.predictionCol: f"_c{b}"})
        out = own.transform(out.withColumn(f"_v{b}", _vector(F.get("_branches", F.lit(b))))).drop(f"_v{b}", f"_r{b}", f"_c{b}")
    probs = F.array(*(vector_to_array(f"_p{b}") for b in range(len(models))))
    out = out.withColumn("branch_probs", probs).drop("_branches", *(f"_p{b}" for b in range(len(models))))
    total = F.aggregate(F.slice("branch_probs", 2, len(models)), F.get("branch_probs", F.lit(0)), lambda a, x: F.zip_with(a, x, lambda p, q: p + q))
    return out.withColumn("vote_sum", total).withColumn("vote_mean", F.transform("vote_sum", lambda x: x / len(models)))


def concatenated(rows: DataFrame, inputs: int, classes: int, hidden: list[int], rounds: int) -> DataFrame:
    """One classifier over all features, fitted on the training split."""
    return scored(fit(rows.where("split = 'train'"), inputs, classes, hidden, rounds), rows)


def branch_models(rows: DataFrame, count: int, inputs: int, classes: int, hidden: list[int], rounds: int) -> list:
    """A classifier for each branch of rows (branches, label, split), fitted on the training split."""
    train = rows.where("split = 'train'")
    return [fit(train.withColumn("features", F.get("branches", F.lit(b))), inputs, classes, hidden, rounds) for b in range(count)]


def voting(rows: DataFrame, count: int, inputs: int, classes: int, hidden: list[int], rounds: int) -> DataFrame:
    """One classifier per branch; their probabilities are added and averaged."""
    return branch_scored(branch_models(rows, count, inputs, classes, hidden, rounds), rows)


def losses(scored: DataFrame, by: list[str], probs: str = "probs") -> DataFrame:
    """Mean loss and accuracy."""
    right = F.array_position(probs, F.array_max(probs)) - 1 == F.col("label")
    return scored.groupBy(*by).agg(F.avg(log_loss(F.col(probs), F.col("label").cast("int"))).alias("val_loss"), F.avg(right.cast("double")).alias("val_accuracy"))


def batch_losses(scored: DataFrame, by: list[str]) -> DataFrame:
    """Mean loss and accuracy of each branch, and of the vote's mean (branch null), of rows of branch_scored; one pass."""
    each = F.concat(F.transform("branch_probs", lambda p, b: F.struct(b.cast("int").alias("branch"), p.alias("probs"))), F.array(F.struct(F.lit(None).cast("int").alias("branch"), F.col("vote_mean").alias("probs"))))
    return losses(scored.select(*by, "label", F.explode(each).alias("b")).select(*by, "label", "b.*"), [*by, "branch"])


class Runs:
    """A folder of fitted candidates: for each key its results and its model, written once it is fitted, and read by later sweeps.

    A key is the hash of a candidate's settings and of the profile (what its inputs are), so equal settings on equal
    inputs are fitted once, in whatever task they turn up and under whatever id."""

    RESULT = "key string, val_accuracy double, val_loss double"

    def __init__(self, spark: SparkSession, at: str):
        self.spark, self.at = spark, at.rstrip("/")

    @staticmethod
    def key(candidate: dict, profile: str) -> str:
        return hashlib.sha256(json.dumps([profile, {k: v for k, v in candidate.items() if k != "id"}], sort_keys=True).encode()).hexdigest()

    def results(self) -> DataFrame:
        if not paths.matches(self.spark, f"{self.at}/results/*"):
            return self.spark.createDataFrame([], self.RESULT)
        return self.spark.read.schema(self.RESULT).parquet(f"{self.at}/results/*")

    def put(self, key: str, model, accuracy: float, loss: float) -> None:
        """The model first: a result without its model is never seen."""
        model.write().overwrite().save(f"{self.at}/models/{key}")
        self.spark.createDataFrame([(key, accuracy, loss)], self.RESULT).coalesce(1).write.mode("overwrite").parquet(f"{self.at}/results/{key}")

    def model(self, key: str):
        return MultilayerPerceptronClassificationModel.load(f"{self.at}/models/{key}")


def sweep(rows: DataFrame, candidates: list[dict], inputs: int, classes: int, runs: Runs, profile: str = "", workers: int = 4) -> tuple[DataFrame, dict]:
    """(leaderboard, winner): candidates (id, hidden, rounds) by their validation split: accuracy, then the lower loss, then the id.

    Candidates that runs holds drop out by an anti join and are `reused`; the others are fitted side by side, and each
    is put down as soon as it is fitted, so a sweep that was cut short goes on where it was. Rows of the test split are not read."""
    spark = rows.sparkSession
    by_key = {runs.key(c, profile): c for c in reversed(candidates)}
    wanted = spark.createDataFrame([(runs.key(c, profile), c["id"]) for c in candidates], "key string, id string")
    pending = [r.key for r in wanted.select("key").distinct().join(runs.results(), "key", "left_anti").collect()]  # settings, not data
    train, val = rows.where("split = 'train'"), rows.where("split = 'val'")

    def one(key: str) -> None:
        model = fit(train, inputs, classes, by_key[key]["hidden"], by_key[key]["rounds"])
        r = losses(scored(model, val), []).first()
        runs.put(key, model, r["val_accuracy"], r["val_loss"])

    with ThreadPoolExecutor(max(1, workers)) as pool:
        list(pool.map(one, pending))
    fresh = spark.createDataFrame([(k,) for k in pending], "key string").withColumn("new", F.lit(True))
    found = wanted.join(runs.results(), "key").join(fresh, "key", "left")
    board = leaderboard(found.select("id", "val_accuracy", "val_loss", F.col("new").isNull().alias("reused")))
    best = board.where("place = 1").first()
    return board, next(c for c in candidates if c["id"] == best["id"])


def evaluated(rows: DataFrame, candidate: dict, runs: Runs, profile: str = "", limit: float = 0.4) -> DataFrame:
    """Metrics of a fitted candidate on the test split, with its share of missed positives and whether that is above the limit; one row. A test split without positives raises."""
    test = scored(runs.model(runs.key(candidate, profile)), rows.where("split = 'test'"))
    told = test.select((F.col("label") > 0).cast("int").alias("label"), (F.array_position("probs", F.array_max("probs")) > 1).cast("int").alias("prediction"))
    out = error_gate(binary_metrics(told), limit)
    positives = F.when(F.col("fn") + F.col("tp") > 0, F.col("label1_error")).otherwise(F.raise_error(F.lit("no positive label in the test split")).cast("double"))
    return out.withColumn("label1_error", positives).withColumn("winner", F.lit(candidate["id"]))


def chained(tasks: list[dict], runs: Runs, classes: int, limit: float = 0.4) -> DataFrame:
    """Tasks one after the other: (task, winner, val_accuracy, val_loss, fitted, tn, fp, fn, tp, accuracy, label1_error, stop).

    A task has name, rows, inputs and profile, and either candidates to sweep or `like`, the name of an earlier task
    whose winner it fits. A task with `gate` ends the chain where its test error is above the limit."""
    done, winners = None, {}
    for task in tasks:
        candidates = task.get("candidates") or [winners[task["like"]]]
        board, winner = sweep(task["rows"], candidates, task["inputs"], classes, runs, task["profile"])
        winners[task["name"]] = winner
        fitted = board.agg(F.count_if(~F.col("reused")).alias("fitted"))
        head = board.where("place = 1").select(F.lit(task["name"]).alias("task"), F.col("id").alias("winner"), "val_accuracy", "val_loss").crossJoin(fitted)  # one row each
        test = evaluated(task["rows"], winner, runs, task["profile"], limit).select("winner", "tn", "fp", "fn", "tp", "accuracy", "label1_error", "stop")
        row = head.join(test, "winner").select("task", "winner", "val_accuracy", "val_loss", "fitted", "tn", "fp", "fn", "tp", "accuracy", "label1_error", "stop")
        row = row.sparkSession.createDataFrame(row.collect(), row.schema)  # one row, needed now to go on or stop
        done = row if done is None else done.unionByName(row)
        if task.get("gate") and row.first()["stop"]:
            break
    return done
