"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

Words are lower-cased runs of letters and digits. Every n-gram of a test item is a possible seed; how many texts hold
each is counted over the whole corpus first. An alignment of score s with an item of L words (M matches, E edits, M - E
at least s * L) leaves at least M - (n - 1) * (E + 1) of the item's n-grams whole, which is ((n - 1) * s - (n - 2)) * L -
(n - 1) or more; items so short that this is none have seeds of fewer words. So an item drops its commonest seeds, up to
half of what it can miss, and only where as many of the others as are still needed lie within the reach of one alignment
are the words around them aligned. Nothing that reaches the score is lost. The best local alignment, as a share of a
perfect one, is the score.

The items are held by every task in parts of bounded size, as arrays (some 25 MB a part); more items mean more passes.

Defined results: null and empty texts have no words and match nothing; an item of up to n words is matched as
a whole; items with equal words score alike; a null doc_id is reported as null; rows with one doc_id are reported once
for an item; a very long text is aligned in pieces that overlap by more than an alignment can reach; further columns are
not read; empty tables give an empty result.
"""

from __future__ import annotations

import math
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .textscan import LOWER, PUNCT, blocks, columns, hashed, shingles, words

N, SCORE = 3, 0.6
#: Bytes of test items held at once.
PART = 8 << 20
_BITS = 20
#: Words of texts that are aligned with one item at once, and a piece of a text in lengths of its item.
_CELLS, _PIECE = 1 << 18, 8


def item_words(text: str) -> np.ndarray:
    b = LOWER[np.frombuffer((text or "").encode(), np.uint8)]
    start, end, _ = words(b, np.array([0, len(b)]), PUNCT)
    return hashed(b, start, end)


def seed_length(size: int, n: int, score: float) -> tuple[int, int]:
    """Words of a seed of an item of that size, and how many seeds every alignment that reaches the score leaves whole: n words, or as many fewer as leave one at least. Items of up to n words are one seed."""
    if size <= n:
        return size, 1
    least = lambda g: math.ceil(((g - 1) * score - (g - 2)) * size - (g - 1) - 1e-9)
    g = n
    while g > 1 and least(g) < 1:
        g -= 1
    return g, max(1, least(g))


class Items:
    """Test items as word hashes, with the seeds of each; all in arrays."""

    def __init__(self, rows: list[tuple[int, str]], n: int, score: float):
        each = [item_words(r[1]) for r in rows]
        self.ids = [r[0] for r in rows]
        self.size = np.array([len(w) for w in each], np.int64)
        self.ends = np.concatenate(([0], np.cumsum(self.size)))
        self.word = np.concatenate([*each, np.zeros(0, np.uint64)])
        parts = [seed_length(len(w), n, score) for w in each]
        self.lengths = sorted({g for g, _ in parts if g})
        self.need = np.array([need for _, need in parts], np.int64)
        self.reach = np.ceil((2 - score) * self.size).astype(np.int64)  # words of a text that an alignment spans at most
        grams = [shingles(w, np.zeros(len(w), np.int64), g)[0] if g else w for w, (g, _) in zip(each, parts, strict=True)]
        gram, item = np.concatenate([*grams, np.zeros(0, np.uint64)]), np.repeat(np.arange(len(each)), [len(g) for g in grams])
        order = np.lexsort((item, gram))
        gram, item = gram[order], item[order]
        first = np.ones(len(gram), bool)
        first[1:] = (gram[1:] != gram[:-1]) | (item[1:] != item[:-1])
        self.gram, self.item = gram[first], item[first].astype(np.int32)  # sorted by n-gram
        self.times = np.diff(np.append(np.flatnonzero(first), len(gram))).astype(np.int32)
        self.index()

    def index(self) -> None:
        self.known, start = np.unique(self.gram, return_index=True)
        self.start = np.append(start, len(self.gram))
        self.table = np.zeros(1 << _BITS, bool)
        self.table[(self.known & np.uint64((1 << _BITS) - 1)).astype(np.int64)] = True

    def words(self, k: int) -> np.ndarray:
        return self.word[self.ends[k] : self.ends[k + 1]]

    def keep_rare(self, seed: np.ndarray, n: np.ndarray) -> None:
        """Drops the commonest seeds of each item, as far as half of those that an alignment can miss; seeds come with the number of texts that hold them."""
        order = np.argsort(seed)
        seed, n = seed[order], n[order]
        k = np.searchsorted(seed, self.gram)
        found = k < len(seed)
        found[found] = seed[k[found]] == self.gram[found]
        count = np.zeros(len(self.gram), np.int64)
        count[found] = n[k[found]]
        order = np.lexsort((-count, self.item))
        item, times = self.item[order], self.times[order].astype(np.int64)
        upto = np.cumsum(times)
        head = np.searchsorted(item, item)  # where each item begins
        upto -= (upto - times)[head]
        gone = upto <= ((self.need - 1) // 2)[item]
        self.need -= np.bincount(item[gone], times[gone], len(self.need)).astype(np.int64)
        keep = np.ones(len(self.gram), bool)
        keep[order[gone]] = False
        self.gram, self.item, self.times = self.gram[keep], self.item[keep], self.times[keep]
        self.index()

    def hits(self, word: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First word, and place among the known ones, of each n-gram that is one of an item."""
        at, found = [], []
        for n in self.lengths:
            h, i = shingles(word, row, n)
            maybe = np.flatnonzero(self.table[(h & np.uint64((1 << _BITS) - 1)).astype(np.int64)])
            k = np.searchsorted(self.known, h[maybe])
            sure = k < len(self.known)
            sure[sure] = self.known[k[sure]] == h[maybe[sure]]
            at.append(i[maybe[sure]])
            found.append(k[sure])
        at, found = np.concatenate([*at, np.zeros(0, np.int64)]), np.concatenate([*found, np.zeros(0, np.int64)])
        order = np.argsort(at, kind="stable")
        return at[order], found[order]

    def near(self, at: np.ndarray, found: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(item, first word) of the hits that have as many of the item's hits in reach as it needs, by item and word."""
        many = self.start[found + 1] - self.start[found]
        to = np.repeat(self.start[found] - np.concatenate(([0], np.cumsum(many)[:-1])), many) + np.arange(many.sum())
        item, p = self.item[to].astype(np.int64), np.repeat(at, many)
        order = np.lexsort((p, item))
        item, p = item[order], p[order]
        own = row[p]
        last = np.arange(len(p)) + self.need[item] - 1
        inside = last < len(p)
        inside[inside] = (item[last[inside]] == item[inside]) & (own[last[inside]] == own[inside]) & (p[last[inside]] - p[inside] <= self.reach[item[inside]])
        mark = np.zeros(len(p) + 1, np.int64)
        np.add.at(mark, np.flatnonzero(inside), 1)
        np.add.at(mark, last[inside] + 1, -1)
        keep = np.cumsum(mark)[:-1] > 0
        return item[keep], p[keep]


def aligned(item: np.ndarray, texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Best local alignment of the item with each text (match 1, mismatch and gap -1), and the word where it ends.

    All texts at once, one row of the table at a time; the gap along the row is a running maximum.
    """
    width = max(map(len, texts))
    x = np.zeros((len(texts), width), np.uint64)
    pad = np.ones(x.shape, bool)
    for k, t in enumerate(texts):
        x[k, : len(t)] = t
        pad[k, : len(t)] = False
    best, end = np.zeros(len(texts), np.int32), np.zeros(len(texts), np.int64)
    last, step = np.zeros((len(texts), width + 1), np.int32), np.arange(width, dtype=np.int32)
    for w in item:
        score = np.where((x == w) & ~pad, 1, -1)
        h = np.maximum(np.maximum(last[:, :-1] + score, last[:, 1:] - 1), 0)
        h = np.maximum(h, np.maximum.accumulate(h + step, axis=1) - step)
        h[pad] = 0
        last[:, 1:] = h
        top = h.max(1)
        better = top > best
        best[better], end[better] = top[better], h[better].argmax(1)
    return best, end


def decontaminate(docs: DataFrame, items: DataFrame, n: int = N, score: float = SCORE) -> DataFrame:
    """(doc_id, item_id, score, matched, item_words, end_word) for each document and item aligned well enough."""
    spark = docs.sparkSession
    sized = items.where("text is not null").select("item_id", "text", (F.octet_length("text") + 16).alias("size"))
    parts = int(sized.agg(F.sum("size")).first()[0] or 0) // PART + 1
    found = [_part(docs, spark, sized.where(F.pmod(F.xxhash64("text"), F.lit(parts)) == p), n, score) for p in range(parts)]
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def _part(docs: DataFrame, spark: SparkSession, sized: DataFrame, n: int, score: float) -> DataFrame:
    held = Items([(r[0], r[1]) for r in sized.select("item_id", "text").collect()], n, score)
    every = spark.sparkContext.broadcast(held)  # of bounded size: one part of the items

    def word_rows(column):
        for i, _, b, at in blocks(column):
            b = LOWER[b]
            start, end, row = words(b, at, PUNCT)
            yield i, hashed(b, start, end), row

    def count(batches):
        """(seed, n): in how many texts an n-gram of an item occurs, in parts."""
        m = every.value
        for batch in batches:
            for _, word, row in word_rows(batch.column("text")):
                where, k = m.hits(word, row)
                order = np.lexsort((k, row[where]))
                r, k = row[where][order], k[order]
                once = np.ones(len(k), bool)
                once[1:] = (k[1:] != k[:-1]) | (r[1:] != r[:-1])
                seed, n = np.unique(k[once], return_counts=True)
                yield columns(seed=m.known[seed].view(np.int64), n=n)
        pa.default_memory_pool().release_unused()  # workers outlive the stage

    texts = docs.select(F.col("doc_id").cast("long"), "text")
    counted = texts.mapInArrow(count, "seed long, n long").groupBy("seed").agg(F.sum("n").alias("n"))
    got = counted.toArrow()  # at most one row a seed of this part
    held.keep_rare(got.column("seed").to_numpy().view(np.uint64), got.column("n").to_numpy())
    wanted = spark.sparkContext.broadcast(held)

    def align(batches):
        m = wanted.value
        for batch in batches:
            ids, todo, size = batch.column("doc_id").to_pylist(), defaultdict(list), 0
            for i, word, row in word_rows(batch.column("text")):
                item, where = m.near(*m.hits(word, row), row)
                ends = np.searchsorted(row, row[where], "right").tolist()
                begins = np.searchsorted(row, row[where]).tolist()
                near: dict[tuple[int, int], list[int]] = {}  # (row, item) -> words to align, as long as seeds go on
                for k, p, lo, hi in zip(item.tolist(), where.tolist(), begins, ends, strict=True):
                    more = 2 * int(m.size[k])
                    a, z = max(lo, p - more), min(hi, p + more)
                    old = near.get((lo, k))
                    if old and a <= old[1] and z - old[0] <= _PIECE * more:
                        old[1] = z
                        continue
                    near[lo, k] = new = [a, z]
                    todo[k].append((ids[i + int(row[p])], lo, new, word))
                    size += z - a
                if size > _CELLS:
                    yield _scored(m, todo, score)
                    todo, size = defaultdict(list), 0
            yield _scored(m, todo, score)
            todo = None
        pa.default_memory_pool().release_unused()  # workers outlive the stage

    hits = texts.mapInArrow(align, "doc_id long, item_id long, matched long, item_words long, end_word long")
    best = hits.groupBy("doc_id", "item_id").agg(F.max(F.struct("matched", "item_words", (-F.col("end_word")).alias("e"))).alias("x"))
    return best.select("doc_id", "item_id", (F.col("x.matched") / F.col("x.item_words")).alias("score"), "x.matched", "x.item_words", (-F.col("x.e")).alias("end_word"))


def _scored(m: Items, todo: dict[int, list], score: float) -> pa.RecordBatch:
    """Alignments that reach the score, of each item with the stretches (doc_id, first word of the text, [from, to], words of the block)."""
    rows = []
    for k, some in todo.items():
        size = int(m.size[k])
        some = sorted(((d, a - lo, word[a:z]) for d, lo, (a, z), word in some), key=lambda x: len(x[2]))
        i = 0
        while i < len(some):
            n = max(1, min(256, _CELLS // len(some[min(i + 255, len(some) - 1)][2])))
            part = some[i : i + n]
            best, end = aligned(m.words(k), [x[2] for x in part])
            rows += [(d, m.ids[k], s, size, base + e) for (d, base, _), s, e in zip(part, best.tolist(), end.tolist(), strict=True) if s >= score * size]
            i += n
    c = list(zip(*rows, strict=True)) or [()] * 5
    return columns(**{name: pa.array(v, pa.int64()) for name, v in zip(("doc_id", "item_id", "matched", "item_words", "end_word"), c, strict=True)})


def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
