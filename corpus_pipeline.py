"""Corpus pipeline: stages over documents, each written as Parquet and read again by the next.

Every stage takes (spark, docs, sf_dir) and works on all rows that the one before kept; all but the last return the
columns of documents. Nulls, repeated rows, empty texts and empty tables pass as the operators define; a row without
doc_id is told from others by its text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm import quality, secrets
from tracewell.llm.decontam import decontaminate
from tracewell.llm.jaccard import linked
from tracewell.llm.packing import pack, tokenised
from tracewell.llm.scratch import with_keys, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the policy rejects go."""
    return docs.where(quality.kept(quality.failures(quality.measure("text"))))


def _whole(docs: DataFrame) -> DataFrame:
    """docs as one struct `row` beside doc_id and text, so that no column's name is in the way."""
    return docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), docs["doc_id"].alias("doc_id"), docs["text"].alias("text"))


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest doc_id stays (one row, if its row is repeated)."""
    own = F.coalesce(F.col("doc_id").cast("long"), -F.abs(F.xxhash64("text") % (1 << 62)) - 1)
    groups = linked(docs.select(own.alias("doc_id"), "text"))
    first = written(groups.where("n_shingles = 0 or doc_id = component_id").groupBy(F.col("doc_id").alias("id"), "text_key").agg(F.count("*").alias("rows"), F.max("n_shingles").alias("n")))
    n = first.count()
    kept = with_keys(_whole(docs).withColumn("id", own), first.select("id", "text_key"), "id", rows=n)
    kept = kept.where(F.xxhash64("text") == F.col("text_key"))
    if not first.where("rows > 1 and n > 0").isEmpty():
        kept = kept.where("text is null").unionByName(kept.where("text is not null").dropDuplicates(["id", "text"]))
    return kept.select("row.*")


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, whole or edited, go. Rows are told apart by two hashes of 64 bits, so that no clean one goes with another."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    rows = _whole(docs).withColumns({"one": F.xxhash64("doc_id", "text"), "two": F.xxhash64(F.lit("second"), "text", "doc_id")})
    named = lambda table, name: decontaminate(table.select(F.col(name).alias("doc_id"), "text"), items).select(F.col("doc_id").alias(name)).distinct()
    ids = written(named(rows, "one"))
    pairs = written(with_keys(rows, ids, "one", "left_semi").select("one", "two").distinct())
    mixed = written(pairs.groupBy("one").agg(F.count("*").alias("n")).where("n > 1").select("one"))
    if n_mixed := mixed.count():  # different rows with one hash: only those go that the second hash names
        again = written(named(with_keys(rows, mixed, "one", "left_semi", n_mixed), "two"))
        pairs = written(pairs.join(mixed, "one", "left_anti").unionByName(pairs.join(mixed, "one", "left_semi").join(again, "two", "left_semi").select("one", "two")))
    return with_keys(rows, pairs, ["one", "two"], "left_anti").select("row.*")


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret is replaced by a mark; n_chars follows."""
    return secrets.redact(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of every document with their places in sequences."""
    return pack(written(tokenised(docs)))


STAGES = [
    ("quality_rules", quality_rules),
    ("jaccard_join", jaccard_join),
    ("benchmark_decontamination", benchmark_decontamination),
    ("secret_scans", secret_scans),
    ("best_fit_packing", best_fit_packing),
]

#: Components, alignment, tokenising and packing are beyond SQL; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(docs)
    return docs
