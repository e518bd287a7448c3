"""Language identification by averaged hashed subword embeddings and a linear softmax.

Subwords are the runs of 2 to 4 bytes of each lower-cased word with its edges marked. Training is stochastic gradient
descent in numpy on a bounded sample of labelled rows; the temperature of the scores and the limit below which a
prediction is rejected come from a part of that sample kept aside. To predict, embeddings and weights are multiplied
out to one row of scores per bucket, so a text costs one look-up per subword of its distinct words.

Defined results: a null text and one without a letter get `und` and score 0; with no labelled row to learn from every
text gets `und`; an empty table gives no rows; a null doc_id is never held out; repeated rows give repeated rows, and of a
repeated doc_id one row is learned from (the smallest hash of text and language); a very long text is a block of its own (some 60 times
its size in memory); other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .textscan import PUNCT, blocks, columns, hashed, mix, prefix_hash, piece, words

#: At most so many labelled rows are learned from: those with the smallest hashes of their doc_id.
SAMPLE = 3000
BUCKETS, DIMS, SIZES = 1 << 15, 16, (2, 3, 4)
UND = "und"
_SPACED = np.arange(256, dtype=np.uint8)
_SPACED[PUNCT] = 0x20
_SPACED[ord("A") : ord("Z") + 1] += 32
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True


def folded(b: np.ndarray) -> np.ndarray:
    """Bytes with separators as spaces and the capitals of ASCII and Latin-1 lowered."""
    out = _SPACED[b]
    capital = (b[1:] >= 0x80) & (b[1:] <= 0x9E) & (b[1:] != 0x97) & (b[:-1] == 0xC3)
    out[1:][capital] += 0x20
    return out


def subwords(b: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For a block of texts: bucket and distinct-word number of each subword; distinct-word number and row of each word."""
    b = folded(b)
    start, end, row = words(b, at, PUNCT)
    _, first, word = np.unique(hashed(b, start, end), return_index=True, return_inverse=True)
    size = end[first] - start[first] + 2
    edge = np.concatenate(([0], np.cumsum(size)))
    of = np.repeat(np.arange(len(first)), size)
    from_ = np.arange(edge[-1]) - edge[of] + start[first][of] - 1
    text = np.full(edge[-1], 0x20, np.uint8)
    inner = (from_ >= start[first][of]) & (from_ < end[first][of])
    text[inner] = b[from_[inner]]
    h, bucket, owner = prefix_hash(text), [], []
    for n in SIZES:
        i = np.flatnonzero(of[: len(of) - n + 1] == of[n - 1 :]) if len(of) >= n else np.zeros(0, np.int64)
        bucket.append((mix(piece(h, i, i + n) + np.uint64(n)) % np.uint64(BUCKETS)).astype(np.int64))
        owner.append(of[i])
    return np.concatenate(bucket), np.concatenate(owner), word, row


def counted(batches):
    """doc_id, lang and the bag of subwords (buckets, counts) of each row."""
    for batch in batches:
        bags = []
        for i, j, b, at in blocks(batch.column("text")):
            bucket, owner, word, row = subwords(b, at)
            order = np.argsort(owner, kind="stable")
            bucket, owner = bucket[order], owner[order]
            edge = np.searchsorted(owner, np.arange(len(word) + 1 if len(word) else 1))
            cut = np.searchsorted(row, np.arange(j - i + 1))
            for k in range(j - i):
                w, n = np.unique(word[cut[k] : cut[k + 1]], return_counts=True)
                parts = [bucket[edge[x] : edge[x + 1]] for x in w]
                total = np.bincount(np.concatenate(parts), np.repeat(n, [len(p) for p in parts])) if parts else np.zeros(0)
                at_ = np.flatnonzero(total)
                bags.append((at_.astype(np.int32), total[at_].astype(np.float32)))
        yield columns(
            lang=batch.column("lang"),
            buckets=pa.array([x for x, _ in bags], pa.list_(pa.int32())), counts=pa.array([x for _, x in bags], pa.list_(pa.float32())),
        )


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def gradients(mean: np.ndarray, w: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the mean cross-entropy of softmax(mean @ w), by the weights and by the mean embeddings."""
    g = softmax(mean @ w)
    g[np.arange(len(y)), y] -= 1
    return mean.T @ g / len(y), g @ w.T / len(y)


def trained(bags: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, classes: int, epochs: int = 6, rate: float = 0.5, seed: int = 0) -> np.ndarray:
    """Scores of each bucket and class: the product of the embeddings and the weights after descent."""
    rng = np.random.default_rng(seed)
    e, w = rng.normal(0, 0.1, (BUCKETS, DIMS)).astype(np.float32), np.zeros((DIMS, classes), np.float32)
    w[:] = rng.normal(0, 0.1, w.shape)
    for epoch in range(epochs):
        order, step = rng.permutation(len(bags)), rate * (1 - epoch / epochs)
        for i in range(0, len(order), 32):
            some = [k for k in order[i : i + 32] if len(bags[k][0])]
            if not some:
                continue
            at = np.concatenate([bags[k][0] for k in some])
            share = np.concatenate([bags[k][1] / bags[k][1].sum() for k in some])
            edge = np.cumsum([0] + [len(bags[k][0]) for k in some])
            mean = np.add.reduceat(e[at] * share[:, None], edge[:-1])
            to_w, to_mean = gradients(mean, w, y[some])
            w -= 4 * step * to_w
            of = np.repeat(np.arange(len(some)), np.diff(edge))
            np.subtract.at(e, at, 30 * 32 * step * share[:, None] * to_mean[of])  # a bucket is met far less often than a weight
    return e @ w


def scores(bags: list[tuple[np.ndarray, np.ndarray]], table: np.ndarray) -> np.ndarray:
    return np.array([(table[b] * c[:, None]).sum(0) / max(c.sum(), 1) for b, c in bags]).reshape(len(bags), table.shape[1])


def fit(labelled: DataFrame, sample: int = SAMPLE) -> dict:
    """A model from rows (doc_id, text, lang): languages, table of scores, temperature, and the limit of rejection."""
    rows = labelled.where("lang is not null and text is not null")
    chosen = rows.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    one = F.min(F.struct(F.xxhash64("text", "lang").alias("h"), "text", "lang")).alias("one")  # of a repeated doc_id one row
    own = rows.join(F.broadcast(chosen), "doc_id", "left_semi").groupBy("doc_id").agg(one)
    bags = own.select("one.text", "one.lang").mapInArrow(counted, "lang string, buckets array<int>, counts array<float>").toArrow()
    langs = sorted(set(bags.column("lang").to_pylist()))
    if not langs:
        return {"langs": [], "table": np.zeros((BUCKETS, 1), np.float32), "scale": 1.0, "reject": 1.0}
    x = [(np.array(b.as_py(), np.int64), np.array(c.as_py(), np.float32)) for b, c in zip(bags.column("buckets"), bags.column("counts"), strict=True)]
    y = np.array([langs.index(v) for v in bags.column("lang").to_pylist()])
    order = sorted(range(len(x)), key=lambda k: (len(x[k][0]), float(x[k][1].sum()), y[k], x[k][0][:8].tolist()))  # whatever order the rows came in
    x, y = [x[k] for k in order], y[order]
    aside = np.arange(len(x)) % 5 == 0
    table = trained([v for v, a in zip(x, aside, strict=True) if not a], y[~aside], len(langs))
    z, truth = scores([v for v, a in zip(x, aside, strict=True) if a], table), y[aside]
    loss = {s: -np.log(np.maximum(softmax(z * s)[np.arange(len(z)), truth], 1e-9)).mean() for s in (0.25, 0.5, 1.0, 2.0, 4.0, 8.0)}
    scale = min(loss, key=loss.get)
    p = softmax(z * scale)
    right = p.argmax(1) == truth
    # Rejected below: the lowest score from which 99 of 100 predictions kept aside are right.
    top = np.sort(p.max(1))
    reject = next((float(t) for t in top if right[p.max(1) >= t].mean() >= 0.99), 1.0)
    return {"langs": langs, "table": table, "scale": scale, "reject": reject}


def predict(docs: DataFrame, model: dict) -> DataFrame:
    """docs with lang_pred, score, and accepted (the score reaches the calibrated limit)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size: BUCKETS x languages

    def of(column: pa.Array) -> pa.Array:
        m = shared.value
        table, langs = m["table"], m["langs"]
        name, score = np.full(len(column), UND, object), np.zeros(len(column))
        for i, j, b, at in blocks(column):
            has = np.diff(np.concatenate(([0], np.cumsum(_LETTER[b])))[at]) > 0
            for k in np.flatnonzero(~has & (np.diff(at) > 0)):
                has[k] = any(c.isalpha() for c in column[i + int(k)].as_py())
            if not langs or not has.any():
                continue
            bucket, owner, word, row = subwords(b, at)
            n_words = int(word.max()) + 1 if len(word) else 0
            size = np.bincount(owner, minlength=n_words)
            z = np.zeros((j - i, len(langs)))
            for c in range(len(langs)):
                z[:, c] = np.bincount(row, np.bincount(owner, table[bucket, c], n_words)[word], j - i)
            p = softmax(z / np.maximum(np.bincount(row, size[word], j - i), 1)[:, None] * m["scale"])
            for k in np.flatnonzero(has):
                name[i + k], score[i + k] = langs[int(p[k].argmax())], p[k].max()
        return pa.StructArray.from_arrays([pa.array(name, pa.string()), pa.array(score), pa.array(score >= m["reject"])], names=["lang_pred", "score", "accepted"])

    to = F.arrow_udf(of, "lang_pred string, score double, accepted boolean")
    return docs.select(F.struct(*docs.columns).alias("row"), to("text").alias("to")).select("row.*", "to.*")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    model = fit(docs.where(~held_out).select("doc_id", "text", "lang"))
    return predict(docs.select("doc_id", held_out.alias("held_out"), "text"), model).select("doc_id", "held_out", "lang_pred", "score", "accepted")
