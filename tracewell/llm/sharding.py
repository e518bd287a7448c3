"""Consistent-hash ring with virtual nodes and bounded loads.

Each shard owns `vnodes` arcs of the ring. A key falls in the arc of its hash; a shard takes keys up to its
capacity and what overflows goes clockwise to the next shard with room. Capacities are whole and add up to the
row count, so counts are at most one apart (law `rows`).

Only counts per arc (shards x vnodes numbers) reach the driver; every row gets its shard from its rank inside its arc.

A row's place is decided by its contents, however the input is cut: rows are ranked in the order of the ring, and rows
that are equal in every column, between which no order exists, share a run of ranks.

Defined results: a null text has no bytes (size 16, checksum 0); a null doc_id is a key of its own; repeated rows
are placed each on its own; a very long text counts whole; an empty table gives an empty result; further columns stay
(they must be of types that can be grouped by).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .scratch import written

#: Parts into which the rows of one place on the ring are dealt, and equal rows that are counted out at once.
SALTS, RUN = 32, 10_000


def ring(shards: int, vnodes: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of all virtual nodes in clockwise order, and their shards."""
    at = [(int.from_bytes(hashlib.sha256(f"{s}/{v}".encode()).digest()[:8], "big", signed=True), s) for s in range(shards) for v in range(vnodes)]
    at.sort()
    return np.array([p for p, _ in at], np.int64), np.array([s for _, s in at], np.int64)


def placed(counts: np.ndarray, owner: np.ndarray, capacity: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(arc, first rank, rows, shard) in the order in which shards fill; an arc's pieces are in order of rank."""
    free, out, left = capacity.copy(), [], []
    for arc, n in enumerate(counts.tolist()):
        take = min(n, int(free[owner[arc]]))
        if take:
            out.append((arc, 0, take, int(owner[arc])))
            free[owner[arc]] -= take
        if n > take:
            left.append((arc, take, n - take))
    for arc, rank, n in left:
        step = 1
        while n:
            s = int(owner[(arc + step) % len(owner)])
            if take := min(n, int(free[s])):
                out.append((arc, rank, take, s))
                free[s] -= take
                rank, n = rank + take, n - take
            step += 1
    return out


def assign(rows: DataFrame, key: str = "doc_id", shards: int = 40, vnodes: int = 64) -> DataFrame:
    """rows with `shard` and `slot` (the place in it, gapless from 0); these two replace columns of their names.

    Rows go in the order of the ring; within a 65,536th of it, by a hash of all their columns, so rows of one key are
    dealt over tasks. Equal rows are combined to one with their number before they are ranked, and counted out in
    runs over tasks. They are written first, as counts and ranks read them both."""
    at, owner = ring(shards, vnodes)

    def arc_of(position: pa.Array) -> pa.Array:
        return pa.array(np.searchsorted(at, position.to_numpy()) % len(at))

    keyed = rows.select(F.struct(*rows.columns).alias("row"), F.xxhash64(key).alias("at"))
    near = F.shiftright("at", 48) - F.when(F.col("at") > int(at[-1]), 1 << 16).otherwise(0)  # what lies past the last node comes first in its arc
    salt = F.pmod(F.xxhash64("row"), F.lit(SALTS))
    keyed = keyed.select("row", "at", F.arrow_udf(arc_of, "long")("at").alias("arc"), near.alias("near"), salt.alias("salt"))
    keyed = written(keyed.groupBy("arc", "near", "salt", "at", "row").agg(F.count("*").alias("copies")))
    parts = keyed.groupBy("arc", "near", "salt").agg(F.sum("copies").alias("n"))
    counts = np.zeros(len(at), np.int64)
    for r in parts.groupBy("arc").agg(F.sum("n").alias("n")).collect():
        counts[r["arc"]] = r["n"]
    native = np.bincount(owner, counts, shards)
    capacity = np.full(shards, counts.sum() // shards)
    capacity[np.argsort(-native, kind="stable")[: counts.sum() % shards]] += 1
    base = np.concatenate(([0], np.cumsum(counts)[:-1]))
    used, pieces = np.zeros(shards, np.int64), []
    for arc, rank, n, s in placed(counts, owner, capacity):
        pieces.append((base[arc] + rank, s, used[s]))
        used[s] += n
    pieces.sort()
    first, shard, slot = (np.array(x, np.int64) for x in zip(*pieces, strict=True)) if pieces else (np.zeros(1, np.int64),) * 3

    def place(arc: pa.Array, rank: pa.Array) -> pa.Array:
        g = base[arc.to_numpy()] + rank.to_numpy()
        k = np.searchsorted(first, g, "right") - 1
        return pa.StructArray.from_arrays([pa.array(shard[k].astype(np.int32)), pa.array(slot[k] + g - first[k])], names=["shard", "slot"])

    before = parts.select("arc", "near", "salt", (F.sum("n").over(W.partitionBy("arc").orderBy("near", "salt")) - F.col("n")).alias("before"))
    upto = F.sum("copies").over(W.partitionBy("arc", "near", "salt").orderBy("at", "row"))
    starts = keyed.withColumn("inside", upto - F.col("copies")).join(before, ["arc", "near", "salt"]).select("row", "arc", "copies", (F.col("before") + F.col("inside")).alias("rank"))
    single = starts.where("copies = 1").select("row", "arc", "rank")
    last = F.col("copies") - 1
    runs = starts.where("copies > 1").select("row", "arc", "rank", "copies", F.explode(F.sequence(F.lit(0), last, F.lit(RUN))).alias("run")).repartition("row", "run")
    each = runs.select("row", "arc", "rank", F.explode(F.sequence("run", F.least(F.col("run") + (RUN - 1), last))).alias("copy"))
    ranked = single.unionByName(each.select("row", "arc", (F.col("rank") + F.col("copy")).alias("rank")))
    to = F.arrow_udf(place, "shard int, slot long")
    out = ranked.select("row", to("arc", "rank").alias("to"))
    return out.select(*(F.col("row")[c].alias(c) for c in rows.columns if c not in ("shard", "slot")), "to.shard", "to.slot")


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    text = F.coalesce("text", F.lit("")).cast("binary")
    rows = docs.select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    return assign(rows).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
