"""Substring dedup by sliding runs of sentences.

A sentence ends at a line's end, or after `.`, `!` or `?` before white space. Of the runs of at least MIN_SENTENCES
sentences and MIN_WORDS words, the shortest that starts at each sentence and the shortest that ends with each are hashed
(over lower-cased words); each longer run is the union of such runs within it. Where a run occurs more than once in the
corpus, the occurrence with the smallest (doc_id, place) stays and the sentences of all others go; what stays is the
rest of the bytes as they were. Runs are counted by a 64-bit hash first; those met twice are told apart by 128 bits.

A sentence of more than LONG words (a word list, a text without stops) is split before the words with the smallest hash
in any WINDOW consecutive ones, and each piece counts as a sentence. Places depend on the words near them only, so of
50 words repeated inside such a sentence at least 50 - 2 * WINDOW + 1 lie in whole pieces and go.

Shorter runs are left alone, as they recur by chance: see the README for how many there are. Hot runs are counted in each task
before they are shuffled; their places are joined back by key, where Spark splits large keys.

Defined results: null and empty texts have no sentences and stay as they are; a text too short for a run stays, and so
does a repeated sentence of up to LONG words between others that differ; rows
with equal doc_id and text are one place (all stay or all lose the same sentences); a null doc_id sorts first; a very
long text is one block of its own; an empty table gives an empty result; columns other than doc_id and text are kept.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import with_keys, written
from .textscan import LOWER, SPACE, blocks, columns, hashed, mix, odd, words

MIN_SENTENCES, MIN_WORDS = 2, 12
#: Words from which on a sentence is not split; consecutive words of a longer one of which one starts a piece.
LONG, WINDOW = 24, 12
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".!?"]] = True
_M = int(odd(1, 21)[0])
_INV = pow(_M, -1, 1 << 64)
_SECOND = int(odd(1, 23)[0])


def smallest(h: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Indices of the last smallest value in each WINDOW consecutive ones of one group."""
    m = len(h) - WINDOW + 1
    if m < 1:
        return np.zeros(0, np.int64)
    least, at = h[:m].copy(), np.arange(m)
    for k in range(1, WINDOW):
        lower = h[k : k + m] <= least
        least[lower] = h[k : k + m][lower]
        at[lower] = np.flatnonzero(lower) + k
    return np.unique(at[group[:m] == group[WINDOW - 1 :]])


def sentences(b: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end (with the white space that follows), row and first word of each sentence or piece of a long one."""
    start, end, row = words(b, at)
    if not len(start):
        return start, end, row, np.zeros(0, np.int64)
    lines = np.concatenate(([0], np.cumsum(b == 0x0A)))
    new = np.ones(len(start), bool)
    new[1:] = _STOP[b[end[:-1] - 1]] | (row[1:] != row[:-1]) | (lines[start[1:]] != lines[end[:-1]])
    size = np.diff(np.flatnonzero(np.append(new, True)))
    long = np.flatnonzero(np.repeat(size > LONG, size))  # words of long sentences
    if len(long):
        new[long[smallest(hashed(LOWER[b], start[long], end[long]), np.cumsum(new)[long])]] = True
    first = np.flatnonzero(new)  # the first word of each sentence
    begin = start[first]
    begin[np.concatenate(([True], row[first][1:] != row[first][:-1]))] = at[row[first][np.concatenate(([True], row[first][1:] != row[first][:-1]))]]
    stop = np.concatenate((begin[1:], [len(b)]))
    stop = np.minimum(stop, at[row[first] + 1])
    return begin, stop, row[first], first


def runs(b: np.ndarray, at: np.ndarray, both: bool = False) -> tuple[np.ndarray, ...]:
    """Row, first sentence in the row, sentences and hash of each run of a block of texts; with `both` a second hash."""
    low = LOWER[b]
    start, end, word_row = words(low, at)
    begin, _, row, first = sentences(b, at)
    if not len(first):
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * (1 + both)
    n = len(start)
    power, back = np.full(n, _M, np.uint64), np.full(n, _INV, np.uint64)
    power[0] = back[0] = 1
    power, back = np.multiply.accumulate(power), np.multiply.accumulate(back)
    edge = np.concatenate((first, [n]))  # first words of sentences, and the end
    s = np.arange(len(first))
    last_of_row = np.searchsorted(row, row, "right")  # one past the row's last sentence
    first_of_row = np.searchsorted(row, row)
    stop = np.maximum(s + MIN_SENTENCES, np.searchsorted(edge, edge[s] + MIN_WORDS))
    ok = stop <= last_of_row
    a, z = s[ok], stop[ok]
    tail = s + 1  # one past each sentence, where a run may end
    from_ = np.minimum(tail - MIN_SENTENCES, np.searchsorted(edge, edge[tail] - MIN_WORDS, "right") - 1)
    fits = from_ >= first_of_row
    fits &= stop[from_] != tail  # else it is the shortest from its start, and there already
    a, z = np.concatenate((a, from_[fits])), np.concatenate((z, tail[fits]))
    word, keys = hashed(low, start, end), []
    for salt in (0, _SECOND)[: 1 + both]:
        h = np.concatenate((np.zeros(1, np.uint64), np.cumsum((mix(word ^ np.uint64(salt)) if salt else word) * power)))
        keys.append(mix((h[edge[z]] - h[edge[a]]) * back[edge[a]] + (edge[z] - edge[a]).astype(np.uint64)))
    return row[a], a - first_of_row[a], z - a, *keys


def _counts(batches):
    """(key, n): how often a run occurs, in parts."""
    for batch in batches:
        for _, _, b, at in blocks(batch.column("text")):
            key, n = np.unique(runs(b, at)[3], return_counts=True)
            yield columns(key=key.view(np.int64), n=n)


def _spans(batches):
    """Runs with their places."""
    for batch in batches:
        for i, _, b, at in blocks(batch.column("text")):
            row, place, size, key, second = runs(b, at, True)
            take = pa.array(row + i)
            yield columns(
                key=key.view(np.int64), second=second.view(np.int64), **{c: batch.column(c).take(take) for c in ("doc_id", "ka", "kb")},
                place=place.astype(np.int32), size=size.astype(np.int32),
            )


def _cut(text: pa.Array, places: pa.Array, sizes: pa.Array, whole: pa.Array) -> pa.Array:
    """Texts without the runs at the given places; of those marked `whole` every run goes, and so every sentence if there is a run."""
    kept, total, gone = [], np.zeros(len(text), np.int64), np.zeros(len(text), np.int64)
    whole = whole.to_numpy(zero_copy_only=False)
    for i, j, b, at in blocks(text):
        begin, stop, row, _ = sentences(b, at)
        edge = np.searchsorted(row, np.arange(j - i + 1))
        total[i:j] = np.diff(edge)
        n_words = np.bincount(words(b, at)[2], minlength=j - i) if whole[i:j].any() else total[i:j]
        for k in range(j - i):
            if not text[i + k].is_valid:
                kept.append(None)
                continue
            if whole[i + k]:
                drop = np.full(total[i + k], total[i + k] >= MIN_SENTENCES and n_words[k] >= MIN_WORDS)
            elif places[i + k].is_valid:
                edges = np.zeros(total[i + k] + 1, np.int64)
                p, n = places[i + k].values.to_numpy(), sizes[i + k].values.to_numpy()
                np.add.at(edges, p, 1)
                np.add.at(edges, p + n, -1)
                drop = np.cumsum(edges)[:-1] > 0
            else:
                drop = np.zeros(total[i + k], bool)
            if not drop.any():
                kept.append(b[at[k] : at[k + 1]].tobytes())
                continue
            gone[i + k] = drop.sum()
            stay = edge[k] + np.flatnonzero(~drop)
            kept.append(b"".join(b[a:z].tobytes() for a, z in zip(begin[stay], stop[stay], strict=True)))
    names = ["text", "n_sentences", "n_removed"]
    return pa.StructArray.from_arrays([pa.array(kept, pa.binary()).cast(pa.string()), pa.array(total), pa.array(gone)], names=names)


def dedup(docs: DataFrame, out: str = "_dedup") -> DataFrame:
    """docs with the struct `out`: text without repeated runs, n_sentences, n_removed.

    Of equal texts (by 128 bits) the one with the smallest doc_id is searched; all runs of the others are repeats of it.
    Texts are scanned twice: runs are counted by their keys alone, and those met twice are picked out by a join."""
    keys = {"ka": F.xxhash64(docs["text"]), "kb": F.xxhash64(F.lit("second"), docs["text"])}
    held = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"), *(v.alias(k) for k, v in keys.items()))
    equal = written(held.where("text is not null").groupBy("ka", "kb").agg(F.min(F.struct("doc_id")).alias("first"), F.max(F.struct("doc_id")).alias("last")))
    first = equal.select(F.col("ka").alias("first_ka"), F.col("kb").alias("first_kb"), F.col("first.doc_id").alias("first_id"))
    same = (F.col("ka") == F.col("first_ka")) & (F.col("kb") == F.col("first_kb")) & F.col("doc_id").eqNullSafe(F.col("first_id"))
    texts = with_keys(held.select("doc_id", "ka", "kb", "text"), first, same, "left_semi")
    twice = written(texts.mapInArrow(_counts, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).where("n > 1").select("key"))
    spans = texts.mapInArrow(_spans, "key long, second long, doc_id long, ka long, kb long, place int, size int")
    spans = written(spans.join(twice, "key", "left_semi"))
    place = F.struct("doc_id", "ka", "kb", "place", "size")
    # One place twice (equal rows, or the run that ends a text) is one occurrence.
    repeated = spans.groupBy("key", "second").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first <> last").select("key", "second", "first")
    later = spans.join(repeated, ["key", "second"]).where(~place.eqNullSafe(F.col("first")))
    cuts = later.groupBy("ka", "kb").agg(F.collect_set(F.struct("place", "size")).alias("cuts"))
    known = equal.join(cuts, ["ka", "kb"], "left").where("cuts is not null or first <> last")
    known = known.select(F.col("ka").alias("cut_ka"), F.col("kb").alias("cut_kb"), "first", "cuts.place", "cuts.size")
    joined = held.join(known, (F.col("ka") == F.col("cut_ka")) & (F.col("kb") == F.col("cut_kb")) & F.col("text").isNotNull(), "left")
    copy = F.coalesce(~F.col("first.doc_id").eqNullSafe(F.col("doc_id")) & F.col("first").isNotNull(), F.lit(False))
    cut = F.arrow_udf(_cut, "text string, n_sentences long, n_removed long")
    return joined.select("row", cut("text", "place", "size", copy).alias("cut")).select("row.*", F.col("cut").alias(out))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup(docs).select("doc_id", "_dedup.n_sentences", "_dedup.n_removed", F.sha2(F.coalesce("_dedup.text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))
