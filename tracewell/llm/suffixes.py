"""Removal of repeated byte strings by a hash-compared suffix sort.

A byte goes when a string of LENGTH bytes that covers it also starts somewhere else. Sorting every suffix of a corpus
is out of reach, so suffixes are sampled by content: of the hashes of all GRAM bytes inside a window of LENGTH bytes
the smallest mark anchors, and equal windows mark equal anchors. Only anchors met twice go on, with the bytes around
them. Among the suffixes of one anchor a mergesort compares two by binary search on prefix polynomial hashes, which
finds their common extension in logarithmic time; one sort runs to the right of the anchor and one to the left, and
extensions of neighbours are checked byte by byte against collisions. Two windows are equal when both extensions reach.

Anchors held by more than HOT suffixes are spread instead: their windows are counted by 128-bit hashes, and the windows
behind each hash that occurs again are compared by their bytes.

Defined results: a null text is empty; texts shorter than LENGTH lose nothing; equal texts (repeated rows too) of at
least LENGTH bytes lose everything; a null doc_id stays null; a very long text is read in pieces that overlap by a
window; further columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import BROADCAST_ROWS, among, few, with_keys, written
from .textscan import BLOCK, BYTE, blocks, columns, mix, odd, piece, powers, prefix_hash

LENGTH, GRAM, HOT = 200, 64, 20_000
#: Rows whose suffixes are sorted together in a task (whole anchors, so one anchor's may be more).
TOGETHER = 4096
#: Contexts that are handed on at once.
_TOGETHER = 8192


def _sliding(x: np.ndarray, width: int, f: np.ufunc) -> np.ndarray:
    """f over every `width` consecutive values."""
    have = 1
    while have * 2 <= width:
        x = f(x[:-have], x[have:])
        have *= 2
    return f(x[: len(x) - (width - have)], x[width - have :]) if width > have else x


def anchors(b: np.ndarray, at: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Place and hash of each gram that is smallest in some window of `length` bytes of one row."""
    none = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    if len(b) < length:
        return none
    h, i = prefix_hash(b), np.arange(len(b) - gram + 1)
    key = mix(piece(h, i, i + gram))
    order = (key >> np.uint64(33)).astype(np.uint32) + np.uint32(1)  # 0 is left for places without a window
    least = _sliding(order, length - gram + 1, np.minimum)
    row_end = np.repeat(at[1:], np.diff(at))[: len(least)]
    inside = np.arange(len(least)) + length <= row_end
    least = np.where(inside, least, np.uint32(0))
    wide = length - gram
    most = _sliding(np.concatenate((np.zeros(wide, np.uint32), least, np.zeros(wide, np.uint32))), wide + 1, np.maximum)
    chosen = np.flatnonzero((most == order) & (most > 0))
    return chosen, key[chosen]


def row_anchors(column: pa.Array, length: int, gram: int):
    """(row, place, hash) of the anchors of each row, block by block; long texts in pieces that share a window."""
    for i, _, b, at in blocks(column):
        if len(at) > 2 or len(b) <= BLOCK:
            place, key = anchors(b, at, length, gram)
            row = np.searchsorted(at, place, "right") - 1
            yield row + i, place - at[row], key
            continue
        last = -1
        for s in range(0, len(b), BLOCK):
            part = b[s : s + BLOCK + length]
            place, key = anchors(part, np.array([0, len(part)]), length, gram)
            new = place + s > last
            place, key = place[new] + s, key[new]
            last = max(last, int(place[-1])) if len(place) else last
            yield np.full(len(place), i), place, key


def _anchor_counts(length: int, gram: int):
    """(key, n): how often an anchor occurs, in parts."""

    def run(batches):
        for batch in batches:
            keys = [k for _, _, k in row_anchors(batch.column("text"), length, gram)]
            key, n = np.unique(np.concatenate([*keys, np.zeros(0, np.uint64)]), return_counts=True)
            yield columns(key=key.view(np.int64), n=n)

    return run


def _anchors(length: int, gram: int):
    """Anchors with their places."""

    def run(batches):
        for batch in batches:
            for row, place, key in row_anchors(batch.column("text"), length, gram):
                take = pa.array(row)
                yield columns(key=key.view(np.int64), doc_id=batch.column("doc_id").take(take), tk=batch.column("tk").take(take), pos=place)

    return run


def _cut_around(batch: pa.RecordBatch, parts, length: int, gram: int):
    """Batches (key, hot, doc_id, tk, pos, left, right) of bounded size for anchors given as arrays (row, place, key, hot).

    left and right are the bytes around an anchor: length - gram before it and `length` from it, as far as the text goes."""
    side, text = length - gram, batch.column("text")
    for rows, places, keys, hots in parts:
        for i in range(0, len(rows), _TOGETHER):
            row, place = rows[i : i + _TOGETHER], places[i : i + _TOGETHER]
            left, right, last, t = [], [], -1, None
            for r, a in zip(row.tolist(), place.tolist(), strict=True):
                if r != last:
                    last, t = r, memoryview(text[r].as_buffer())
                left.append(bytes(t[max(0, a - side) : a]))
                right.append(bytes(t[a : a + length]))
            take = pa.array(row)
            yield columns(
                key=keys[i : i + _TOGETHER], hot=hots[i : i + _TOGETHER], doc_id=batch.column("doc_id").take(take), tk=batch.column("tk").take(take), pos=place,
                left=pa.array(left, pa.binary()), right=pa.array(right, pa.binary()),
            )


def _contexts(length: int, gram: int, wanted: list[np.ndarray] | None, hot: int):
    """Contexts of the wanted anchors found in texts, or of those that come as columns key, pos and hot of the texts."""

    def run(batches):
        for batch in batches:
            if wanted is None:
                flat = lambda c, r: batch.column(c)[r].values.to_numpy(zero_copy_only=False)
                parts = ((np.full(len(batch.column("pos")[r]), r), flat("pos", r), flat("key", r), flat("hot", r)) for r in range(batch.num_rows))
            else:
                found = ((row, place, key.view(np.int64), *among(key.view(np.int64), wanted[0])) for row, place, key in row_anchors(batch.column("text"), length, gram))
                parts = ((row[f], place[f], key[f], wanted[1][at] > hot) for row, place, key, f, at in found)
            yield from _cut_around(batch, parts, length, gram)

    return run


class Suffixes:
    """One row of bytes per suffix, each of its own size, with hashes of all prefixes."""

    def __init__(self, rows: list[bytes], width: int):
        self.size = np.array([len(r) for r in rows], np.int64)
        self.bytes = np.zeros((len(rows), width), np.uint8)
        flat = np.frombuffer(b"".join(rows), np.uint8)
        self.bytes[np.arange(width) < self.size[:, None]] = flat
        self.hash = np.zeros((len(rows), width + 1), np.uint64)
        np.cumsum(BYTE[self.bytes] * powers(width)[0], axis=1, out=self.hash[:, 1:])

    def extension(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Common prefix of suffixes i and j, by binary search on the hashes."""
        low, high = np.zeros(len(i), np.int64), np.minimum(self.size[i], self.size[j])
        while (low < high).any():
            mid = (low + high + 1) >> 1
            same = self.hash[i, mid] == self.hash[j, mid]
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
        return low

    def less(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether suffix i comes before suffix j; of equal ones the first row does."""
        n = self.extension(i, j)
        end_i, end_j = n == self.size[i], n == self.size[j]
        at = np.minimum(n, self.bytes.shape[1] - 1)
        return np.where(end_i & end_j, i < j, np.where(end_i, True, np.where(end_j, False, self.bytes[i, at] < self.bytes[j, at])))

    def sorted(self, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Mergesort of the rows inside each group (given as first rows, contiguous): the order, and the common prefix with the one before (0 across groups)."""
        n = len(group)
        order, start = np.arange(n), group
        size = np.bincount(group, minlength=n)[group] if n else group
        width = 1
        while n and width < size.max():
            at = np.flatnonzero(size > width)  # places in the order; runs of `width` are sorted
            local = at - start[at]
            run = local // width * width
            other = np.where(run // width % 2 == 0, run + width, run - width)
            first = np.minimum(start[at] + other, start[at] + size[at])
            low, high = first.copy(), np.minimum(first + width, start[at] + size[at])
            while (open_ := low < high).any():
                k = np.flatnonzero(open_)
                mid = (low[k] + high[k]) >> 1
                before = self.less(order[mid], order[at[k]])
                low[k] = np.where(before, mid + 1, low[k])
                high[k] = np.where(before, high[k], mid)
            new = start[at] + np.minimum(run, other) + (local - run) + (low - first)
            merged = order.copy()
            merged[new] = order[at]
            order, width = merged, width * 2
        common = np.zeros(n, np.int64)
        if n > 1:
            same = np.flatnonzero(group[1:] == group[:-1]) + 1
            common[same] = self.extension(order[same - 1], order[same])
            differ = (self.bytes[order[same - 1]] != self.bytes[order[same]]) & (np.arange(self.bytes.shape[1]) < common[same][:, None])
            if differ.any():  # hashes collided: order by the bytes themselves
                order = np.array(sorted(range(n), key=lambda i: (group[i], bytes(self.bytes[i, : self.size[i]]), i)))
                pair = np.arange(self.bytes.shape[1]) < np.minimum(self.size[order[same - 1]], self.size[order[same]])[:, None]
                common[same] = np.logical_and.accumulate((self.bytes[order[same - 1]] == self.bytes[order[same]]) & pair, axis=1).sum(1)
        return order, common


def repeated(key: np.ndarray, left: list[bytes], right: list[bytes], length: int, gram: int) -> np.ndarray:
    """For each suffix (rows of one key adjoin) and each i: does its window with i bytes before the anchor occur again?"""
    n, side = len(key), length - gram
    group = np.concatenate(([0], np.flatnonzero(key[1:] != key[:-1]) + 1)) if n else np.zeros(0, np.int64)
    group = np.repeat(group, np.diff(np.concatenate((group, [n]))))
    reach = []
    for rows, width in ((right, length), ([x[::-1] for x in left], side)):
        s = Suffixes(rows, width)
        order, common = s.sorted(group)
        reach.append((order, common, s.size))
    (to_right, r_common, r_size), (to_left, l_common, l_size) = reach
    out = np.zeros((n, side + 1), bool)
    first = np.concatenate(([True], group[1:] != group[:-1])) if n else np.zeros(0, bool)
    alike, place_l = np.zeros(n, np.int64), np.zeros(n, np.int64)
    # The longest extension that any other suffix of the anchor shares on the right.
    best = np.zeros(n, np.int64)
    best[to_right] = np.maximum(r_common, np.concatenate((r_common[1:], [0])))
    for i in range(side + 1):
        ok = (best >= length - i) & (l_size >= i) & (r_size >= length - i)
        if not ok.any():
            continue
        alike[to_right] = np.cumsum(first | (r_common < length - i))
        place_l[to_left] = np.cumsum(first | (l_common < i))
        at = np.flatnonzero(ok)
        both = alike[at] * np.int64(n + 1) + place_l[at]
        order = np.argsort(both, kind="stable")
        same = both[order[1:]] == both[order[:-1]]
        out[at[order[1:][same]], i] = True
        out[at[order[:-1][same]], i] = True
    return out


def _intervals(hit: np.ndarray, pos: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, start and end of the bytes that each row's run of windows covers."""
    edge = np.diff(np.pad(hit, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    row, low = np.nonzero(edge == 1)
    _, high = np.nonzero(edge == -1)
    return row, pos[row] - (high - 1), pos[row] - low + length


def _sorts(length: int, gram: int, together: int):
    def run(batches):
        held, names = None, ("key", "doc_id", "tk", "pos", "left", "right")

        def work(t: pa.Table):
            t = t.combine_chunks()
            hit = repeated(t["key"].to_numpy(), t["left"].to_pylist(), t["right"].to_pylist(), length, gram)
            row, a, z = _intervals(hit, t["pos"].to_numpy(), length)
            take = pa.array(row)
            return columns(doc_id=t["doc_id"].combine_chunks().take(take), tk=t["tk"].combine_chunks().take(take), a=pa.array(a), z=pa.array(z))

        for t in (pa.Table.from_batches([batch.slice(i, together)]).select(names) for batch in batches for i in range(0, batch.num_rows, together)):
            held = t if held is None else pa.concat_tables([held, t])
            if len(held) < together:
                continue
            key = held["key"].to_numpy()
            if last := int(np.searchsorted(key, key[-1])):  # the last key may go on in the next batch
                yield work(held.slice(0, last))
                held = held.slice(last)
        if held is not None and len(held):
            yield work(held)

    return run


def _windows(length: int, gram: int, bits: int, whole: bool):
    """Twofold hash of `bits` each and start of each window around the given anchors, or the hash and the window's bytes."""
    side, salt, shift = length - gram, odd(2, 17), np.uint64(64 - bits)

    def run(batches):
        for batch in batches:
            for part in (batch.slice(i, 512) for i in range(0, batch.num_rows, 512)):
                left, right = part.column("left").to_pylist(), part.column("right").to_pylist()
                row, start, keys = [], [], [[], []]
                for r, (x, y) in enumerate(zip(left, right, strict=True)):
                    b = np.frombuffer(x + y, np.uint8)
                    if len(b) < length:
                        continue
                    i = np.arange(min(len(x), side), max(len(x) - (len(b) - length), 0) - 1, -1)  # bytes before the anchor
                    s = len(x) - i
                    row.append(np.full(len(s), r))
                    start.append(s - len(x))
                    for k, other in enumerate((b, b[::-1])):
                        h = prefix_hash(other)
                        a = s if k == 0 else len(b) - length - s
                        keys[k].append((mix(piece(h, a, a + length) ^ salt[k]) >> shift).view(np.int64))
                row, start, ka, kb = (np.concatenate(v) if v else np.zeros(0, np.int64) for v in (row, start, *keys))
                row = row.astype(np.int64)
                # The anchors of a text adjoin, and most of its windows hold several of them: each is handed on once.
                doc, tk, at = part.column("doc_id").to_numpy()[row], part.column("tk").to_numpy()[row], part.column("pos").to_numpy()[row] + start
                order = np.lexsort((at, tk, doc))
                new = np.ones(len(order), bool)
                new[1:] = (np.diff(doc[order]) != 0) | (np.diff(tk[order]) != 0) | (np.diff(at[order]) != 0)
                once = order[new]
                if whole:
                    w = [(left[r] + right[r])[len(left[r]) + k : len(left[r]) + k + length] for r, k in zip(row[once].tolist(), start[once].tolist(), strict=True)]
                    yield columns(ka=ka[once], kb=kb[once], w=pa.array(w, pa.binary()))
                else:
                    yield columns(doc_id=doc[once], tk=tk[once], a=at[once], ka=ka[once], kb=kb[once])

    return run


def _hot_windows(length: int, gram: int, wanted: list[np.ndarray] | None, hot: int, bits: int, whole: bool):
    """_windows of the hot anchors' contexts, in one worker with them."""
    contexts, windows = _contexts(length, gram, wanted, hot), _windows(length, gram, bits, whole)

    def run(batches):
        yield from windows(batch.filter(batch.column("hot")) for batch in contexts(batches))

    return run


def _kept(text: pa.Array, starts: pa.Array, ends: pa.Array) -> pa.Array:
    """What stays of each text: bytes, and how many went in how many runs."""
    out, gone, runs_ = [], [], []
    for t, a, z in zip(text, starts, ends, strict=True):
        t = t.as_buffer().to_pybytes() if t.is_valid else b""
        a, z = a.values.to_numpy(), z.values.to_numpy()
        order = np.argsort(a, kind="stable")
        a, z = a[order], np.maximum.accumulate(z[order])
        new = np.concatenate(([True], a[1:] > z[:-1]))
        a, z = a[new], z[np.concatenate((new[1:], [True]))]
        out.append(b"".join(t[x:y] for x, y in zip([0, *z.tolist()], [*a.tolist(), len(t)], strict=True)))
        gone.append(int((z - a).sum()))
        runs_.append(len(a))
    return pa.StructArray.from_arrays([pa.array(out, pa.binary()), pa.array(gone, pa.int64()), pa.array(runs_, pa.int64())], names=["kept", "n_removed", "n_spans"])


def _spread(sources: DataFrame, around: DataFrame, length: int, gram: int, bits: int, wanted: list[np.ndarray] | None, hot: int) -> DataFrame:
    """Spans of the windows around hot anchors that occur again, without a task that sees all suffixes of one."""
    windows = written(sources.mapInArrow(_hot_windows(length, gram, wanted, hot, bits, False), "doc_id long, tk long, a long, ka long, kb long").distinct())
    again = written(windows.groupBy("ka", "kb").agg(F.count("*").alias("n")).where("n > 1").drop("n"))
    texts = sources.mapInArrow(_hot_windows(length, gram, wanted, hot, bits, True), "ka long, kb long, w binary").join(again, ["ka", "kb"], "left_semi")
    mixed = written(texts.groupBy("ka", "kb").agg(F.min("w").alias("low"), F.max("w").alias("high")).where("low <> high").select("ka", "kb"))
    n_mixed = mixed.count()
    sure = windows.join(again, ["ka", "kb"], "left_semi")
    if not n_mixed:
        return sure.select("doc_id", "tk", "a", (F.col("a") + length).alias("z"))
    sure = with_keys(sure, mixed, ["ka", "kb"], "left_anti", n_mixed).select("doc_id", "tk", "a")
    # Hashes collided: these windows are told apart by their bytes.
    places = with_keys(windows, mixed, ["ka", "kb"], "left_semi", n_mixed).select("doc_id", "tk", "a")
    whole = around.select("doc_id", "tk", (F.col("pos") - F.length("left")).alias("from"), F.concat("left", "right").alias("bytes"))
    cut = places.join(whole, ["doc_id", "tk"]).where(f"a >= from and a - from + {length} <= length(bytes)").select("doc_id", "tk", "a", F.expr(f"substring(bytes, cast(a - from + 1 as int), {length})").alias("w")).distinct()
    equal = cut.groupBy("w").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    return sure.union(cut.join(equal, "w", "left_semi").select("doc_id", "tk", "a")).select("doc_id", "tk", "a", (F.col("a") + length).alias("z"))


def dedup(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT, together: int = TOGETHER, bits: int = 64, rows: int = BROADCAST_ROWS) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of each row, and kept: the bytes that stay, null where all do."""
    docs = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).withColumn("tk", F.xxhash64("text"))
    meta = written(docs.select("doc_id", "tk", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2(F.col("text").cast("binary"), 256).alias("sha")))
    hashes = meta.groupBy("sha").agg(F.count("*").alias("copies"), F.min(F.struct(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("doc_id"), "tk")).alias("rep"), F.max("n_bytes").alias("n"))
    reps = written(hashes.where(F.col("n") >= length).select("rep.doc_id", "rep.tk").distinct())
    ids = docs.withColumn("doc_id", F.coalesce("doc_id", F.lit(-(1 << 63))))
    n_reps = reps.count()
    one = with_keys(ids, reps.withColumnRenamed("tk", "tk_"), "doc_id", rows=n_reps).where("tk = tk_").select("doc_id", "tk", "text")
    # Anchors are counted first, so that only those met twice travel with their places, and no task sees all of one.
    twice = written(one.mapInArrow(_anchor_counts(length, gram), "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).where("n > 1"))
    wanted = few(twice.select("key", "n"), rows)
    sources = one
    if wanted is None:  # too many to be held beside the kernel: find their places, and bring these back to the texts
        met = one.mapInArrow(_anchors(length, gram), "key long, doc_id long, tk long, pos long").join(twice, "key")
        per_text = met.groupBy("doc_id", "tk").agg(F.collect_list(F.struct("key", "pos", (F.col("n") > hot).alias("hot"))).alias("m"))
        sources = written(one.join(per_text, ["doc_id", "tk"]).select("doc_id", "tk", "text", "m.key", "m.pos", "m.hot"))
    around = sources.mapInArrow(_contexts(length, gram, wanted, hot), "key long, hot boolean, doc_id long, tk long, pos long, left binary, right binary")
    spans = around.where("not hot").drop("hot").repartition("key").sortWithinPartitions("key").mapInArrow(_sorts(length, gram, together), "doc_id long, tk long, a long, z long")
    if not twice.where(F.col("n") > hot).isEmpty():
        spans = spans.union(_spread(sources, around.where("hot"), length, gram, bits, wanted, hot))
    cuts = written(spans.groupBy("doc_id", "tk").agg(F.collect_set(F.struct("a", "z")).alias("s")).select("doc_id", "tk", "s.a", "s.z"))
    cut = F.arrow_udf(_kept, "kept binary, n_removed long, n_spans long")
    changed = with_keys(one, cuts.select("doc_id", "tk"), ["doc_id", "tk"], "left_semi").dropDuplicates(["doc_id", "tk"])
    changed = changed.join(cuts, ["doc_id", "tk"]).select("doc_id", "tk", cut("text", "a", "z").alias("c")).select("doc_id", "tk", "c.*")
    out = meta.withColumn("id", F.coalesce("doc_id", F.lit(-(1 << 63)))).join(changed.withColumnRenamed("doc_id", "id"), ["id", "tk"], "left")
    out = out.join(hashes.select("sha", "copies"), "sha")
    whole = (F.col("copies") > 1) & (F.col("n_bytes") >= length)
    return out.select(
        "doc_id", "n_bytes", F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(whole, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(whole, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce(F.sha2("kept", 256), "sha")).alias("kept_sha256"),
        F.when(whole, F.lit(b"")).otherwise(F.col("kept")).alias("kept"),
    )


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("kept")
