"""Best-fit packing of tokenised documents by exact complements.

All pieces of one length are alike, so the plan is made from the count of each length (at most `size` numbers,
whatever the corpus): an index of single lengths, pairs and triples finds combinations that fill the gap of a longer
piece exactly, and consumes as many as are available and do not cost a sequence elsewhere; what is left goes best-fit.
A piece finds its place from its rank among the pieces of its length.

Defined results: a null text is empty and still yields its end token; repeated rows are packed each on its own, and ties
of length go by key and piece; a very long text is tokenised as a whole, in a block of its own (some 20 times its size in
memory); an empty table packs into nothing; further columns of the input are not read.
"""

from __future__ import annotations

import base64
import bisect
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .scratch import written
from .textscan import blocks

SIZE, END = 1024, 2
#: Distinct words that a worker remembers at a time; an older half is forgotten.
REMEMBERED = 150_000
_loaded: dict[tuple[str, str], "Encoder"] = {}


class Encoder:
    """Ids of whole texts as little-endian bytes.

    Before a space that a non-space follows, a token always ends, so words are encoded one by one and remembered.
    Texts with other runs of white space, or with the special token's string, are encoded whole.
    """

    def __init__(self, model: str, ranks: str):
        import public_tokenizers
        import tiktoken

        with open(ranks, "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
        self.model = model
        self.whole = None
        self.base = tiktoken.Encoding("corpus", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def __missing__(self, word: str) -> bytes:
        if not word or word[0].isspace() or "\x1c" <= word[0] <= "\x1f":
            raise ValueError
        if (ids := self.old.get(word)) is None:
            ids = np.array(self.base.encode_ordinary(" " + word), "<u4").tobytes()
        if len(word) < 40:
            if len(self.new) >= REMEMBERED:
                self.old, self.new = self.new, {}
            self.new[word] = ids
        return ids

    def __call__(self, text: str) -> bytes:
        if "<|endoftext|>" in text:
            if self.whole is None:
                from tokenizers import Tokenizer

                self.whole = Tokenizer.from_file(self.model)
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        first, *rest = text.split(" ")
        out = [np.array(self.base.encode_ordinary(first), "<u4").tobytes()]
        try:
            for w in rest:
                out.append(self.new.get(w) or self.__missing__(w))
        except ValueError:
            return np.array(self.base.encode_ordinary(text), "<u4").tobytes()
        return b"".join(out)


def pieces(text: Column, model: str, ranks: str, size: int = SIZE, end: int = END) -> Column:
    """The pieces of each text: array of (piece, start, length, ids_crc32)."""
    tail = np.array([end], "<u4").tobytes()

    def cut(column: pa.Array) -> pa.Array:
        encode = _loaded.get((model, ranks)) or _loaded.setdefault((model, ranks), Encoder(model, ranks))
        at, out = [0], ([], [], [], [])
        for i, j, _, _ in blocks(column):
            for text in column.slice(i, j - i).to_pylist():
                ids = encode(text or "") + tail
                n = len(ids) // 4
                first = (n - 1) % size + 1
                for k, (a, z) in enumerate(((max(0, x), x + size) for x in range(first - size, n, size))):
                    for values, v in zip(out, (k, a, z - a, zlib.crc32(ids[4 * a : 4 * z])), strict=True):
                        values.append(v)
                at.append(len(out[0]))
        kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64())
        values = pa.StructArray.from_arrays([pa.array(v, k) for v, k in zip(out, kinds, strict=True)], names=["piece", "start", "length", "ids_crc32"])
        return pa.ListArray.from_arrays(pa.array(at, pa.int32()), values)

    return F.arrow_udf(cut, "array<struct<piece:int,start:long,length:long,ids_crc32:long>>")(text)


Patterns = list[tuple[list[int], int]]


def plan(counts: dict[int, int], size: int = SIZE) -> Patterns:
    """(lengths of one sequence, how many such sequences) that use up the counts of each length.

    The exact fillings that the indexes find are taken, and what they leave goes best-fit. A filling can eat short
    pieces that the rest needs more; so fillings are taken together as long as the whole plan has no more sequences
    than without them, and else by halves, down to single kinds of filling. The plan thus never has more sequences than
    best fit alone."""
    taken, least = [], _sequences(best_fit(counts, size))

    def rest(more: Patterns) -> dict[int, int]:
        left = dict(counts)
        for lengths, n in [*taken, *more]:
            for x in lengths:
                left[x] -= n
        return left

    def take(found: Patterns) -> None:
        nonlocal least
        total = _sequences([*taken, *found]) + _sequences(best_fit(rest(found), size))
        if total <= least:
            taken.extend(found)
            least = total
        elif len(found) > 1:
            take(found[: len(found) // 2])
            take(found[len(found) // 2 :])

    found = fillings(counts, size)
    for kind in range(1, 5):  # whole pieces, then complements of one, two and three pieces
        if own := [f for f in found if len(f[0]) == kind]:
            take(own)
    return taken + best_fit(rest([]), size)


def _sequences(patterns: Patterns) -> int:
    return sum(n for _, n in patterns)


def fillings(counts: dict[int, int], size: int) -> Patterns:
    """Full sequences: a piece with one, two or three others whose lengths add up to its gap, as many as are available."""
    left, out = defaultdict(int, counts), []

    def use(*lengths: int) -> None:
        need = defaultdict(int)
        for x in lengths:
            need[x] += 1
        if n := min(left[x] // k for x, k in need.items()):
            out.append((list(lengths), n))
            for x, k in need.items():
                left[x] -= n * k

    use(size)
    for long in range(size - 1, (size - 1) // 2, -1):
        use(long, size - long)
    for long in range(size - 2, (size - 1) // 3, -1):
        gap = size - long
        for a in range(min(long, gap - 1), (gap - 1) // 2, -1) if left[long] else ():
            if left[a] and left[gap - a]:
                use(long, a, gap - a)
                if not left[long]:
                    break
    for long in range(size - 3, (size - 1) // 4, -1):
        gap = size - long
        for a in range(min(long, gap - 2), (gap - 1) // 3, -1) if left[long] else ():
            for b in range(min(a, gap - a - 1), (gap - a - 1) // 2, -1) if left[a] else ():
                if left[b] and left[gap - a - b]:
                    use(long, a, b, gap - a - b)
                    if not left[a] or not left[long]:
                        break
            if not left[long]:
                break
    return out


def best_fit(counts: dict[int, int], size: int) -> Patterns:
    """Longest pieces first, each into the smallest gap that takes it; sequences that are alike are kept as one entry with a count."""
    open_: dict[int, Patterns] = {}
    gaps: list[int] = []  # of open_, sorted
    for x in range(size, 0, -1):
        n = counts.get(x, 0)
        while n:
            k = bisect.bisect_left(gaps, x)
            if k < len(gaps):
                gap = gaps[k]
                lengths, have = open_[gap].pop()
            else:
                gap, lengths, have = size, [], n
            each = min(gap // x, n)
            m = min(have, n // each)
            if have > m and gap < size:
                open_[gap].append((lengths, have - m))
            if gap < size and not open_[gap]:
                del open_[gap], gaps[k]
            to = gap - each * x
            if to not in open_:
                open_[to] = []
                bisect.insort(gaps, to)
            open_[to].append((lengths + [x] * each, m))
            n -= m * each
    return [y for g in open_ for y in open_[g]]


def slots(patterns: list[tuple[list[int], int]]) -> tuple[np.ndarray, ...]:
    """For runs of ranks of one length, sorted by length and first rank: key, sequence of the first, offset there."""
    seen, sequence, rows = defaultdict(int), 0, []
    for lengths, n in patterns:
        offset = 0
        for x in lengths:
            rows.append((x << 44 | seen[x], sequence, offset))
            seen[x] += n
            offset += x
        sequence += n
    rows.sort()
    return tuple(np.array(x, np.int64) for x in zip(*rows, strict=True)) if rows else (np.zeros(1, np.int64),) * 3


def pack(table: DataFrame, key: str = "doc_id", size: int = SIZE) -> DataFrame:
    """table of pieces (key, piece, start, length, ...) with sequence_id and offset. It is read twice: pass a written one."""
    spark = table.sparkSession
    salts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    salted = table.select(F.struct(*table.columns).alias("row"), F.col(key).alias("key"), "piece", "length", F.pmod(F.xxhash64(key, "piece"), F.lit(salts)).alias("salt"))
    counts = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = counts.select("length", "salt", (F.sum("n").over(W.partitionBy("length").orderBy("salt")) - F.col("n")).alias("before"))
    totals = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    first, sequence, offset = slots(plan(totals, size))

    def place(length: pa.Array, rank: pa.Array) -> pa.Array:
        g = (length.to_numpy() << 44) | rank.to_numpy()
        k = np.searchsorted(first, g, "right") - 1
        return pa.StructArray.from_arrays([pa.array(sequence[k] + g - first[k]), pa.array(offset[k])], names=["sequence_id", "offset"])

    local = F.row_number().over(W.partitionBy("length", "salt").orderBy("key", "piece")) - 1
    to = F.arrow_udf(place, "sequence_id long, offset long")
    ranked = salted.withColumn("local", local).join(before, ["length", "salt"]).select("row", to("length", F.col("local") + F.col("before")).alias("to"))
    return ranked.select("row.*", "to.sequence_id", "to.offset")


def tokenised(docs: DataFrame, model: str | None = None, ranks: str | None = None, size: int = SIZE, end: int = END) -> DataFrame:
    """doc_id and one row per piece; model and ranks are files of one vocabulary in the two libraries' forms."""
    import public_tokenizers

    model, ranks = model or public_tokenizers.path("byte_bpe_50k.json"), ranks or public_tokenizers.path("byte_bpe_50k.tiktoken")
    return docs.select("doc_id", F.explode(pieces(F.col("text"), str(model), str(ranks), size, end)).alias("p")).select("doc_id", "p.*")


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack(written(tokenised(docs)))
