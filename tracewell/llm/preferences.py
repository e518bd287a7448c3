"""Preference pairs from conversations.

The longest common turn prefix of a chosen and a rejected conversation is rendered once, as the prompt; what follows
in each is a completion, with the spans of characters that count for the loss (text of assistant turns).

Where a table has no preference marks, `paired` derives pairs: conversations with the same first turn are chained in
order of conv_id (each is chosen against the next); a conversation without such a successor is chosen against its own
stale form, in which the last assistant turn repeats the one before it; one with neither stays unpaired.

Defined results: turns are in order of turn, role, text, and equal turns of one conversation count once; null role and
text read as empty; rows without conv_id belong to no conversation; equal conversations give empty completions; a very
long turn, or a conversation of many, is one row and takes a small multiple of its size in memory; an empty table gives an
empty result; further columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .scratch import written

#: Conversations in a range of (first turn, conv_id) that is chained at once, and the most ranges. Ranges are linked, so
#: neither changes the chain.
CHAIN, RANGES = 10_000, 10_000


def gathered(turns: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, turns."""
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return turns.where("conv_id is not null").groupBy("conv_id").agg(F.array_sort(F.collect_set(turn)).alias("turns"))


def common(a: Column, b: Column) -> Column:
    """How many turns two conversations share from the start."""
    same = F.zip_with(a, b, lambda x, y: x["role"].eqNullSafe(y["role"]) & x["text"].eqNullSafe(y["text"]))
    until = F.array_position(same, False).cast("int")
    return F.when(until > 0, until - 1).otherwise(F.size(same))


def _turn(x: Column) -> Column:
    return F.concat(F.lit("<|"), x["role"], F.lit("|>\n"), x["text"], F.lit("\n"))


def rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, _turn), "")


def masked(turns: Column) -> Column:
    """`start-end` of each assistant text in the rendered turns (characters, end exclusive), joined by commas."""

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["role"]) + 5
        end = start + F.length(x["text"])
        span = F.when(x["role"] == "assistant", F.array(F.concat_ws("-", start, end))).otherwise(F.array().cast("array<string>"))
        return F.struct((end + 1).alias("at"), F.concat(acc["out"], span).alias("out"))

    return F.array_join(F.aggregate(turns, F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out")), step)["out"], ",")


def formatted(pairs: DataFrame) -> DataFrame:
    """pairs (with arrays of turns `chosen` and `rejected`, both whole) as prompt, completions and masks."""
    rest = lambda c: F.slice(c, F.col("_n") + 1, F.greatest(F.size(c), F.lit(1)))
    out = pairs.withColumn("_n", common(F.col("chosen"), F.col("rejected")))
    keep = [c for c in pairs.columns if c not in ("chosen", "rejected")]
    return out.select(
        *keep, F.col("_n").alias("n_common"), rendered(F.slice("chosen", 1, F.col("_n"))).alias("prompt"),
        rendered(rest(F.col("chosen"))).alias("chosen"), masked(rest(F.col("chosen"))).alias("chosen_mask"),
        rendered(rest(F.col("rejected"))).alias("rejected"), masked(rest(F.col("rejected"))).alias("rejected_mask"),
    )


def chained(conversations: DataFrame) -> DataFrame:
    """(conv_id, rejected_id): each conversation and the next one with its first turn.

    Ranges of (first turn, conv_id) are chained one by one, so a first turn of any number of conversations is spread over
    tasks; the last of a range is linked to the smallest of the next range that holds its first turn."""
    first = F.col("turns")[0]
    head = F.md5(F.concat(F.length(first["role"]).cast("string"), F.lit(":"), first["role"], first["text"]).cast("binary"))  # 128 bits tell first turns apart
    keys = conversations.select("conv_id", head.alias("head"))
    large = keys.groupBy("head").agg(F.count("*").alias("n")).where(F.col("n") > 1)
    shared = written(keys.join(large.select("head"), "head"))
    n = min(shared.count() // CHAIN + 1, RANGES)
    # Written, as both uses must see the same ranges.
    ranged = written(shared.repartitionByRange(n, "head", "conv_id").withColumn("range", F.spark_partition_id()))
    least = ranged.groupBy("head", "range").agg(F.min("conv_id").alias("least"))
    after = least.withColumn("after", F.lead("least").over(W.partitionBy("head").orderBy("range"))).where("after is not null")
    inside = ranged.withColumn("inside", F.lead("conv_id").over(W.partitionBy("head", "range").orderBy("conv_id")))
    links = inside.join(F.broadcast(after), ["head", "range"], "left")  # fewer rows than ranges
    return links.select("conv_id", F.coalesce("inside", "after").alias("rejected_id")).where("rejected_id is not null")


def paired(conversations: DataFrame) -> DataFrame:
    """(conv_id, rejected_id, kind, chosen, rejected) for each gathered conversation."""
    links = chained(conversations)
    other = conversations.select(F.col("conv_id").alias("rejected_id"), F.col("turns").alias("other"))
    all_ = conversations.join(links.join(other, "rejected_id"), "conv_id", "left")
    place = F.filter(F.transform("turns", lambda x, i: F.when(x["role"] == "assistant", i + 1)), lambda i: i.isNotNull())
    last, before = F.element_at("_at", -1), F.element_at("_at", -2)
    turns = F.col("turns")
    stale = F.concat(F.slice(turns, 1, last - 1), F.array(F.struct(F.element_at(turns, last)["turn"].alias("turn"), F.lit("assistant").alias("role"), F.element_at(turns, before)["text"].alias("text"))))
    sibling, own = F.col("rejected_id").isNotNull(), F.size("_at") >= 2
    none = F.array().cast(conversations.schema["turns"].dataType)
    return all_.withColumn("_at", place).select(
        "conv_id", "rejected_id", F.when(sibling, "sibling").when(own, "stale").otherwise("unpaired").alias("kind"),
        F.when(~sibling & own, F.slice(turns, 1, last)).otherwise(turns).alias("chosen"),
        F.when(sibling, F.col("other")).when(own, stale).otherwise(none).alias("rejected"),
    )


def op8_preference_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return formatted(paired(gathered(turns)))


OP8_SQL = r"""
WITH t AS (SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, list({'role': role, 'text': text} ORDER BY turn NULLS FIRST, role, text) AS turns FROM t GROUP BY conv_id),
l AS (SELECT *, lead(conv_id) OVER (PARTITION BY turns[1] ORDER BY conv_id) AS rejected_id FROM c),
x AS (SELECT l.*, o.turns AS other, list_filter(range(1, len(l.turns) + 1), lambda i: l.turns[i].role = 'assistant') AS at_ FROM l LEFT JOIN c o ON o.conv_id = l.rejected_id),
p AS (SELECT conv_id, rejected_id, CASE WHEN rejected_id IS NOT NULL THEN 'sibling' WHEN len(at_) >= 2 THEN 'stale' ELSE 'unpaired' END AS kind,
        CASE WHEN rejected_id IS NULL AND len(at_) >= 2 THEN turns[1 : at_[-1]] ELSE turns END AS a,
        CASE WHEN rejected_id IS NOT NULL THEN other WHEN len(at_) >= 2 THEN list_concat(turns[1 : at_[-1] - 1], [{'role': 'assistant', 'text': turns[at_[-2]].text}]) ELSE turns[1:0] END AS b FROM x),
n AS (SELECT *, list_max(list_filter(range(0, least(len(a), len(b)) + 1), lambda k: a[1:k] = b[1:k])) AS k FROM p),
r AS (SELECT conv_id, rejected_id, kind, CAST(k AS INTEGER) AS n_common, a[1:k] AS h, a[k + 1 : len(a)] AS u, b[k + 1 : len(b)] AS v FROM n)
SELECT conv_id, rejected_id, kind, n_common,
  array_to_string(list_transform(h, lambda y: '<|' || y.role || '|>' || chr(10) || y.text || chr(10)), '') AS prompt,
  array_to_string(list_transform(u, lambda y: '<|' || y.role || '|>' || chr(10) || y.text || chr(10)), '') AS chosen,
  array_to_string(list_transform(list_filter(range(1, len(u) + 1), lambda i: u[i].role = 'assistant'), lambda i:
    CAST(coalesce(list_sum(list_transform(u[1 : i - 1], lambda y: length(y.role) + length(y.text) + 6)), 0) + length(u[i].role) + 5 AS BIGINT) || '-' ||
    CAST(coalesce(list_sum(list_transform(u[1 : i - 1], lambda y: length(y.role) + length(y.text) + 6)), 0) + length(u[i].role) + 5 + length(u[i].text) AS BIGINT)), ',') AS chosen_mask,
  array_to_string(list_transform(v, lambda y: '<|' || y.role || '|>' || chr(10) || y.text || chr(10)), '') AS rejected,
  array_to_string(list_transform(list_filter(range(1, len(v) + 1), lambda i: v[i].role = 'assistant'), lambda i:
    CAST(coalesce(list_sum(list_transform(v[1 : i - 1], lambda y: length(y.role) + length(y.text) + 6)), 0) + length(v[i].role) + 5 AS BIGINT) || '-' ||
    CAST(coalesce(list_sum(list_transform(v[1 : i - 1], lambda y: length(y.role) + length(y.text) + 6)), 0) + length(v[i].role) + 5 + length(v[i].text) AS BIGINT)), ',') AS rejected_mask
FROM r
"""
