"""Ranks and quantiles without one task per group.

Rows with a hash to order by are dealt by (group, bucket of the hash), and a small table of counts per bucket gives what
comes before each. Rows in the order of their values are dealt by ranges of the whole key, whose edges Spark samples, so
neither outliers nor values that many rows share gather in one task.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.scratch import shared_path

#: Rows among which a quantile is looked up on the driver.
NEAR = 100_000
#: Places in a partition that monotonically_increasing_id() counts with.
_LOCAL = 33


def hash_bucket(digest: Column) -> Column:
    """Bucket of a hexadecimal digest: its first three digits, which order as the digest does."""
    return F.conv(F.substring(digest, 1, 3), 16, 10).cast("int")


def _same(group: list[str]) -> list[Column]:
    """That p and c are of one group, which may be null."""
    return [F.col(f"p.{g}").eqNullSafe(F.col(f"c.{g}")) for g in group]


def hash_ranked(df: DataFrame, group: list[str], bucket: Column, order: list[Column | str], name: str) -> DataFrame:
    """df with `name`: 1, 2, ... inside each group in the given order; bucket must not decrease along it and hold about as many rows as any other."""
    df = df.withColumn("_bucket", bucket)
    counts = df.groupBy(*group, "_bucket").agg(F.count("*").alias("_n"))
    sums = W.partitionBy(*group).orderBy("_bucket") if group else W.orderBy("_bucket")  # of one row per bucket
    before = counts.withColumn("_before", F.sum("_n").over(sums) - F.col("_n")).drop("_n")
    local = F.row_number().over(W.partitionBy(*group, "_bucket").orderBy(*order))
    # Null-safe: rows of a null group keep their place, and from plain equality the optimizer would carry a group's expression to the counts, where its columns are not.
    out = df.withColumn("_local", local).alias("p").join(before.alias("c"), reduce(lambda a, b: a & b, _same(group), F.col("p._bucket") == F.col("c._bucket")))
    return out.select(*(F.col(f"p.{c}") for c in df.columns if c != "_bucket"), (F.col("p._local") + F.col("c._before")).alias(name))


def ranked(df: DataFrame, group: list[str], order: list[Column | str], name: str) -> DataFrame:
    """df with `name`: 1, 2, ... inside each group in the given order, which should tell all rows apart; and `name`_of, the rows of the group.

    df is sorted by ranges of (group, order) and written with the place of each row in its range; counts by range and
    group, a few rows for each range, give what comes before. No window sees the rows."""
    at = shared_path(df.sparkSession, "ranks")
    keys = [F.col(g).asc() for g in group]
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    df.repartitionByRange(n, *keys, *order).sortWithinPartitions(*keys, *order).withColumn("_at", F.monotonically_increasing_id()).write.parquet(at)
    placed = df.sparkSession.read.parquet(at).withColumn("_part", F.shiftright("_at", _LOCAL))
    cells = placed.groupBy("_part", *group).agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    within = W.partitionBy(*group).orderBy("_part") if group else W.orderBy("_part")
    whole = W.partitionBy(*group) if group else W.partitionBy(F.lit(0))
    cells = cells.withColumns({"_before": F.sum("_n").over(within) - F.col("_n"), f"{name}_of": F.sum("_n").over(whole)})
    own = [F.col(f"p.{c}") for c in df.columns]
    same = reduce(lambda a, b: a & b, _same(group), F.col("p._part") == F.col("c._part"))
    both = placed.alias("p").join(cells.alias("c"), same)
    return both.select(*own, (F.col("p._at") - F.col("c._first") + F.col("c._before") + 1).alias(name), F.col(f"c.{name}_of"))


def quantiles(df: DataFrame, wanted: dict[str, tuple[str, float]], near: int = NEAR) -> dict[str, float | None]:
    """For each name the interpolated quantile of a column's values (null ones left out, NaN above all); exact.

    A sketch brackets all of them in one pass, another pass counts what lies below and inside the brackets, and so on
    until few rows are inside; then these are fetched and sorted."""
    names, error = list(wanted), 1e-3
    x = [F.col(wanted[k][0]).cast("double") for k in names]
    between = lambda i: (x[i] > low[i]) & (x[i] < high[i])
    low, high = [-math.inf] * len(x), [math.inf] * len(x)
    inside = [c.alias(f"i{i}") for i, c in enumerate(F.count_if(between(i)) for i in range(len(x)))]
    n = df.agg(*(F.count(c).alias(f"n{i}") for i, c in enumerate(x)), *(F.count_if(c == -math.inf).alias(f"b{i}") for i, c in enumerate(x)), *(F.count_if(F.isnan(c)).alias(f"o{i}") for i, c in enumerate(x)), *inside).first()
    start, mid = [n[f"b{i}"] for i in range(len(x))], [n[f"i{i}"] for i in range(len(x))]  # rows before the open interval and in it
    place = [q * max(n[f"n{i}"] - 1, 0) for i, (_, q) in enumerate(wanted.values())]
    values: list[dict[int, float]] = [{} for _ in x]
    for i, p in enumerate(place):
        for r in (int(p), min(int(p) + 1, max(n[f"n{i}"] - 1, 0))):
            known = -math.inf if r < start[i] else None if r < start[i] + mid[i] else math.nan if r >= n[f"n{i}"] - n[f"o{i}"] else math.inf
            values[i][r] = known
    needed = lambda i: [r for r, v in values[i].items() if v is None and n[f"n{i}"]]
    while wide := [i for i in range(len(x)) if needed(i) and mid[i] > near]:
        cut = df.select(*(F.when(between(i), x[i]).alias(f"q{i}") for i in wide))
        share = lambda i, r, d: min(max((r - start[i]) / mid[i] + d, 0.0), 1.0)
        found = cut.approxQuantile([f"q{i}" for i in wide], [p for i in wide for p in (share(i, min(needed(i)), -2 * error), share(i, max(needed(i)), 2 * error))], error)
        for k, i in enumerate(wide):
            low[i], high[i] = found[k][2 * k], found[k][2 * k + 1]
        counts = df.agg(*(F.count_if(x[i] < low[i]).alias(f"b{i}") for i in wide), *(F.count_if(x[i] == low[i]).alias(f"e{i}") for i in wide), *(F.count_if(between(i)).alias(f"i{i}") for i in wide)).first()
        for i in wide:
            start[i], mid[i] = counts[f"b{i}"] + counts[f"e{i}"], counts[f"i{i}"]
            for r in needed(i):  # the sketch puts low and high on either side of it
                values[i][r] = low[i] if r < start[i] else high[i] if r >= start[i] + mid[i] else None
    last = [i for i in range(len(x)) if needed(i)]
    if last:
        kept = F.filter(F.array(*(F.struct(F.lit(i).alias("i"), F.when(between(i), x[i]).alias("x")) for i in last)), lambda p: p["x"].isNotNull())
        rows: dict[int, list[float]] = {i: [] for i in last}
        for i, v in df.select(F.explode(kept).alias("p")).select("p.*").collect():  # near rows for each name at most
            rows[i].append(v)
        for i in last:
            ordered = np.sort(np.array(rows[i])).tolist()
            for r in needed(i):
                values[i][r] = ordered[r - start[i]]
    out: dict[str, float | None] = {}
    for i, k in enumerate(names):
        first, second = values[i][int(place[i])], values[i][max(values[i])]
        out[k] = None if not n[f"n{i}"] else first if first == second or place[i] == int(place[i]) else first + (second - first) * (place[i] - int(place[i]))
    return out
