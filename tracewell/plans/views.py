"""Views of the base tables in the library's data model, for Spark and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Frames per channel and sample, and points per trace, of the view.
FRAMES, POINTS = 10, 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sample_id, frame, channel, signal): one row per trace."""
    v = table(spark, sf_dir, "embeddings")
    return v.select(
        F.expr("vec_id div 20").alias("sample_id"), F.expr("vec_id % 20 div 2").alias("frame"), F.expr("vec_id % 2").alias("channel"),
        F.col("embedding").cast("array<double>").alias("signal"),
    )


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings")
    return v.where("vec_id % 20 = 0").select(F.expr("vec_id div 20").alias("sample_id"), ((4 + 2 * F.col("label")).cast("double") / 10).alias("depth_value"), F.col("label").cast("long").alias("label"))


def pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sample_id, pool_row, depth_value, split) of the sample pool."""
    k = F.col("o_orderkey") % 20
    split = F.when(k < 12, "train").when(k < 15, "val").otherwise("test")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("sample_id"), F.col("o_orderkey").alias("pool_row"), (F.col("o_totalprice") / 100000).alias("depth_value"), split.alias("split"))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sample_id, label, toxic, p1)."""
    l, d = table(spark, sf_dir, "labels"), table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return l.join(d, "doc_id").select(F.col("doc_id").alias("sample_id"), F.col("quality").alias("label"), "toxic", ((F.col("n_chars") % 50).cast("double") / 50).alias("p1"))


def branches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sample_id, label, branch_id, logits): six branches of ten classes each."""
    v = table(spark, sf_dir, "embeddings")
    parts = F.transform(F.sequence(F.lit(0), F.lit(5)), lambda b: F.slice(F.col("embedding").cast("array<double>"), b * 10 + 1, 10))
    return v.select(F.col("vec_id").alias("sample_id"), F.col("label"), F.posexplode(parts).alias("branch_id", "logits"))


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(experiment, epoch, train_loss, val_loss, val_auc) of training runs."""
    e = table(spark, sf_dir, "events")
    epoch = F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id"))
    return e.select(F.col("user_id").alias("experiment"), epoch.alias("epoch"), (F.col("event_id") % 97).cast("double").alias("train_loss"), F.col("value").alias("val_loss"), ((F.col("event_id") * 37 % 1000).cast("double") / 1000).alias("val_auc"))


#: The same views as common table expressions.
SQL = {
    "scans": "scans AS (SELECT vec_id // 20 AS sample_id, (vec_id % 20) // 2 AS frame, vec_id % 2 AS channel, CAST(embedding AS DOUBLE[]) AS signal FROM embeddings)",
    "traces": "traces AS (SELECT vec_id // 20 AS sample_id, (vec_id % 20) // 2 AS frame, vec_id % 2 AS channel, CAST(generate_subscripts(embedding, 1) - 1 AS BIGINT) AS pos, CAST(unnest(embedding) AS DOUBLE) AS value FROM embeddings)",
    "samples": "samples AS (SELECT vec_id // 20 AS sample_id, CAST(4 + 2 * label AS DOUBLE) / 10 AS depth_value, CAST(label AS BIGINT) AS label FROM embeddings WHERE vec_id % 20 = 0)",
    "pool": "pool AS (SELECT o_orderkey AS sample_id, o_orderkey AS pool_row, o_totalprice / 100000 AS depth_value, CASE WHEN o_orderkey % 20 < 12 THEN 'train' WHEN o_orderkey % 20 < 15 THEN 'val' ELSE 'test' END AS split FROM orders)",
    "predictions": "predictions AS (SELECT l.doc_id AS sample_id, l.quality AS label, l.toxic, CAST(d.n_chars % 50 AS DOUBLE) / 50 AS p1 FROM labels l JOIN documents d ON l.doc_id = d.doc_id)",
    "branches": "branches AS (SELECT vec_id AS sample_id, label, CAST(b AS INTEGER) AS branch_id, CAST(embedding[b * 10 + 1 : b * 10 + 10] AS DOUBLE[]) AS logits FROM embeddings, range(6) AS t(b))",
    "history": "history AS (SELECT user_id AS experiment, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INTEGER) AS epoch, CAST(event_id % 97 AS DOUBLE) AS train_loss, value AS val_loss, CAST(event_id * 37 % 1000 AS DOUBLE) / 1000 AS val_auc FROM events)",
}


def sql(body: str, *views: str) -> str:
    """A query over the named views; body may bring further expressions before its SELECT."""
    head = ", ".join(SQL[v] for v in views)
    body = body.strip()
    if body.upper().startswith("WITH "):
        return f"WITH {head}, {body[5:]}" if head else body
    return f"WITH {head} {body}" if head else body
