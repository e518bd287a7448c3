"""Filter interaction audit by incremental retraction: what five filters remove in each of their 120 orders.

The files of a document table are a stream that is read to its present end in micro-batches. A row becomes a mask of
the filters it fails; the first four look at its text alone. The fifth (identical to the text of a smaller doc_id)
depends on rows still to come: every row is first counted as a copy, in counters by part and mask, and keyed state
holds for each text (128 bits of it) its smallest doc_id so far with the rows that have it. Those rows alone lose the
fifth bit. When a smaller id arrives, the earlier rows' masks are retracted from the counters and the new ones put in.
All other figures come from the counters, however many documents there are: an order needs only the masks.

State and counters of batch b are made from those of the batch before and written under its number, so a batch that is
repeated after a failure gives the same; with the same folder a later call reads new files alone. A hot text is
combined in each task before it is shuffled (smallest id), and its rows then meet the state by text and id.

Defined results: a null text is an empty one, and a null source an empty part; a null doc_id is smaller than none and
has none before it, so it never fails the fifth filter; rows that repeat a doc_id with its text count each, and are not
copies of each other; the labels of a doc_id are the largest of its rows; a very long text is a block of its own; an
empty table has no parts and gives no rows; other columns are not read.
"""

from __future__ import annotations

import itertools
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import _place, shared_dir, with_keys, written
from .textscan import blocks, hashed, mix, odd, words

LETTERS = "ABCDE"
COPY = 1 << LETTERS.index("E")
#: Micro-batches into which the bytes of a table are cut, one file at least in each.
BATCHES = 4
CELL = ["part", "mask", "good", "toxic"]
ROW = "k1 long, k2 long, doc_id long, part string, mask int"
COUNTER = "part string, mask int, good int, toxic int, n long"
STATE = "k1 long, k2 long, doc_id long, part string, mask int, good int, toxic int, n long"
_UPPER = np.zeros(256, bool)
_UPPER[ord("A") : ord("Z") + 1] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#$%&*|"]] = True


def own_masks(column: pa.Array) -> pa.Array:
    """The bits of filters A to D for each text."""
    out = np.zeros(len(column), np.int32)
    for i, j, b, at in blocks(column):

        def per_row(flags, at=at):
            return np.diff(np.concatenate(([0], np.cumsum(flags)))[at])

        start, end, row = words(b, at)
        n_words = np.bincount(row, minlength=j - i)
        _, first = np.unique(mix(hashed(b, start, end) + row.astype(np.uint64) * odd(1, 13)[0]), return_index=True)
        distinct = np.bincount(row[first], minlength=j - i)
        failed = (n_words < 200, 100 * distinct < 50 * n_words, 100 * per_row(_UPPER[b]) > 2 * per_row((b & 0xC0) != 0x80), per_row(_SYMBOL[b]) > 0)
        out[i:j] = sum(f.astype(np.int32) << k for k, f in enumerate(failed))
    return pa.array(out)


def masked(docs: DataFrame) -> DataFrame:
    """ROW of each document: its text's key, and its mask without the fifth bit."""
    text = F.coalesce("text", F.lit(""))
    digest = F.md5(text.cast("binary"))
    half = lambda i: F.conv(F.substring(digest, i, 16), 16, -10).cast("long")
    return docs.select(half(1).alias("k1"), half(17).alias("k2"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("source", F.lit("")).alias("part"), F.arrow_udf(own_masks, "int")("text").alias("mask"))


class Ledger:
    """Counters and keyed state of one folder, by the number of the batch that made them."""

    def __init__(self, spark: SparkSession, labels: DataFrame, at: str):
        self.spark, self.at = spark, at.rstrip("/")
        one = lambda c: F.max(F.coalesce((F.col(c) == 1).cast("int"), F.lit(0))).alias({"quality": "good"}.get(c, c))
        self.labels = written(labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(one("quality"), one("toxic")))
        self.n_labels = self.labels.count()

    def batches(self, table: str) -> list[int]:
        fs, at = _place(self.spark, f"{self.at}/{table}")
        if not fs.exists(at):
            return []
        return sorted(int(f.getPath().getName()) for f in fs.listStatus(at) if fs.exists(_place(self.spark, f"{f.getPath().toString()}/_SUCCESS")[1]))

    def read(self, table: str, kind: str, before: int | None = None) -> DataFrame:
        """table as the last batch left it, or the last one before that number; without any it is empty."""
        done = [b for b in self.batches(table) if before is None or b < before]
        return self.spark.read.schema(kind).parquet(f"{self.at}/{table}/{done[-1]}") if done else self.spark.createDataFrame([], kind)

    def write(self, df: DataFrame, table: str, batch: int, kind: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{self.at}/{table}/{batch}")
        return self.spark.read.schema(kind).parquet(f"{self.at}/{table}/{batch}")

    def fold(self, docs: DataFrame, batch: int) -> None:
        """One micro-batch: docs into counters and state."""
        raw = self.write(masked(docs), "rows", batch, ROW)
        rows = with_keys(raw, self.labels, "doc_id", "left", self.n_labels).fillna(0, ["good", "toxic"])
        key, id_key = ["k1", "k2"], ["k1", "k2", "doc_id"]
        # Smallest ids: of this batch, combined in each task before the shuffle, against those of the state.
        before = self.read("state", STATE, batch)
        new = raw.where("doc_id is not null").groupBy(*key).agg(F.min("doc_id").alias("doc_id"))
        old = before.groupBy(*key).agg(F.min("doc_id").alias("old"))
        least = written(new.join(old, key, "left").where("old is null or doc_id <= old"))
        first = rows.join(least.select(*id_key), id_key, "left_semi").groupBy(*id_key, *CELL).agg(F.count("*").alias("n"))
        gone = before.join(least.where("old > doc_id").select(*key), key, "left_semi")
        first, gone = written(first), written(gone)
        # Every row counts as a copy, then the first ones are taken out of that and those they replace put back.
        copy = F.col("mask").bitwiseOR(F.lit(COPY))
        signed = lambda df, mask, n: df.select("part", mask.alias("mask"), "good", "toxic", n.alias("n"))
        steps = [
            signed(rows, F.when(F.col("doc_id").isNull(), F.col("mask")).otherwise(copy), F.lit(1).cast("long")),
            signed(first, copy, -F.col("n")), signed(first, F.col("mask"), F.col("n")),
            signed(gone, F.col("mask"), -F.col("n")), signed(gone, copy, F.col("n")),
            self.read("counters", COUNTER, batch),
        ]
        total = steps[0]
        for step in steps[1:]:
            total = total.unionByName(step)
        kept = before.join(least.where("old > doc_id").select(*key), key, "left_anti").unionByName(first.select(before.columns))
        self.write(kept.groupBy(*id_key, *CELL).agg(F.sum("n").alias("n")).select(before.columns), "state", batch, STATE)
        self.write(total.groupBy(*CELL).agg(F.sum("n").alias("n")).where("n <> 0").select("part", "mask", "good", "toxic", "n"), "counters", batch, COUNTER)
        for table in ("rows", "state", "counters"):
            for b in self.batches(table)[:-2]:
                fs, place = _place(self.spark, f"{self.at}/{table}/{b}")
                fs.delete(place, True)


def _only(path: str) -> str:
    """A pattern that matches this path alone: a stream of files takes a single file only by a pattern."""
    head, _, name = path.rstrip("/").rpartition("/")
    return f"{head}/[{name[0]}]{name[1:]}"


def counted(spark: SparkSession, path: str, labels: DataFrame, at: str | None = None, batches: int = BATCHES) -> DataFrame:
    """Counters (part, mask, good, toxic, n) of the documents under path; folder `at` keeps state and progress for later calls."""
    if at is None:
        at = f"{shared_dir(spark)}/tracewell-{uuid.uuid4().hex}"
        fs, place = _place(spark, at)
        fs.deleteOnExit(place)
    fs, place = _place(spark, path)
    size = int(fs.getContentSummary(place).getLength())
    ledger = Ledger(spark, labels, at)
    docs = spark.read.parquet(path)
    stream = spark.readStream.schema(docs.schema).option("maxBytesPerTrigger", max(1, -(-size // batches))).parquet(_only(path))
    write = stream.select("doc_id", "source", "text").writeStream.foreachBatch(ledger.fold).trigger(availableNow=True).option("checkpointLocation", f"{at}/progress")
    write.start().awaitTermination()
    return ledger.read("counters", COUNTER)


def _orders() -> list[tuple[str, int, int, int]]:
    """(filter_order, step, mask of the filters before, bit of the filter) of every step of every order."""
    out = []
    for order in itertools.permutations(range(len(LETTERS))):
        done = 0
        for step, k in enumerate(order, 1):
            out.append(("".join(LETTERS[i] for i in order), step, done, 1 << k))
            done |= 1 << k
    return out


def interactions(counters: DataFrame) -> DataFrame:
    """Per part, order and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost and shapley.

    A row of counters meets the effects of its mask at each of the 80 pairs of earlier filters and filter, sums go by
    pair, and pairs are dealt to the 600 steps; both tables are fixed. A document with m failed filters is removed by
    each of them in 120 / m orders.
    """
    spark, orders = counters.sparkSession, _orders()
    pairs = sorted({(done, bit) for _, _, done, bit in orders})
    effects = [
        (mask, done, bit, int(not mask & (done | bit)), int(bool(mask & bit) and not mask & done), int(bool(mask & bit) and bool(mask & done)), int(mask == bit), len(orders) // len(LETTERS) // mask.bit_count() if mask & bit else 0)
        for mask in range(1 << len(LETTERS)) for done, bit in pairs
    ]
    names = ["kept", "removed", "redundant", "unique_fails", "shapley"]
    table = spark.createDataFrame(effects, "mask int, done int, bit int, " + ", ".join(f"_{c} long" for c in names))
    small = counters.groupBy("part", "mask").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("good")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("toxic"))
    sums = [F.sum(F.col("n") * F.col(f"_{c}")).alias(c) for c in names] + [F.sum(F.col(c) * F.col("_removed")).alias(f"{c}_lost") for c in ("good", "toxic")]
    by_pair = small.join(F.broadcast(table), "mask").groupBy("part", "done", "bit").agg(*sums)
    steps = spark.createDataFrame(orders, "filter_order string, step int, done int, bit int")
    return by_pair.join(F.broadcast(steps), ["done", "bit"]).select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def op11_filter_interaction_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interactions(counted(spark, f"{sf_dir}/documents.parquet", spark.read.parquet(f"{sf_dir}/labels.parquet")))


OP11_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, min(doc_id) OVER (PARTITION BY t) AS first FROM d),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
             CASE WHEN len(ws) < 200 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(ws)) < 50 * len(ws) THEN 2 ELSE 0 END
             + CASE WHEN 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 2 * length(t) THEN 4 ELSE 0 END
             + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END + CASE WHEN w.doc_id > first THEN 16 ELSE 0 END AS mask
      FROM w LEFT JOIN l USING (doc_id)),
c AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY ALL),
f(name, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
o AS (SELECT a.name || b.name || c.name || d.name || e.name AS filter_order FROM f a, f b, f c, f d, f e
      WHERE len(list_distinct([a.name, b.name, c.name, d.name, e.name])) = 5),
s AS (SELECT filter_order, step, f.bit, coalesce((SELECT sum(bit) FROM f g WHERE strpos(substr(filter_order, 1, step - 1), g.name) > 0), 0) AS done
      FROM o, range(1, 6) AS r(step), f WHERE f.name = substr(filter_order, step, 1)),
r AS (SELECT part, filter_order, s.step, bit,
             sum(CASE WHEN mask & (CAST(done AS BIGINT) | bit) = 0 THEN n ELSE 0 END) AS kept,
             sum(CASE WHEN mask & bit > 0 AND mask & CAST(done AS BIGINT) = 0 THEN n ELSE 0 END) AS removed,
             sum(CASE WHEN mask & bit > 0 AND mask & CAST(done AS BIGINT) > 0 THEN n ELSE 0 END) AS redundant,
             sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
             sum(CASE WHEN mask & bit > 0 AND mask & CAST(done AS BIGINT) = 0 THEN good ELSE 0 END) AS good_lost,
             sum(CASE WHEN mask & bit > 0 AND mask & CAST(done AS BIGINT) = 0 THEN toxic ELSE 0 END) AS toxic_lost
      FROM c, s GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
       CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley FROM r
"""
