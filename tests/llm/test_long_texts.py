"""Very long texts, ties and repeated ids through the operators and the pipeline."""

import random
import zlib
from collections import Counter, defaultdict

import corpus_pipeline as cp
import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewell.llm import jaccard, langid, packing, preferences, sentences, sharding


def prose(seed, words, stop=11):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(50_000)}" + ("." if k % stop == stop - 1 else "") for k in range(words))


@pytest.fixture(scope="module")
def long():
    """Some 1.3 MB of text, many times a block."""
    return prose(1, 180_000)


def test_jaccard_join_reads_long_texts_whole(spark, long):
    words = long.split()
    near, far = list(words), list(words)
    near[5::100] = ["other"] * len(near[5::100])
    far[5::12] = ["other"] * len(far[5::12])
    rows = [(3, long), (9, " ".join(near)), (7, " ".join(far)), (8, "short text of no length at all")]
    got = {r.doc_id: (r.component_id, r.n_shingles) for r in jaccard.linked(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {k: c for k, (c, _) in got.items()} == {3: 3, 9: 3, 7: 7, 8: 8}
    assert got[3][1] == len({tuple(words[i : i + 5]) for i in range(len(words) - 4)})


def test_sentence_runs_of_long_texts_are_cut_at_any_depth(spark, long):
    passage = prose(2, 66)
    rows = [(1, "Start here. " + passage + " The end of it."), (2, long + " " + passage + " " + prose(3, 40)), (3, long)]
    got = {r.doc_id: r for r in sentences.dedup(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "text", "_dedup").collect()}
    assert got[1]._dedup.n_removed == 0 and got[1]._dedup.text == rows[0][1]
    assert passage[:-20] not in got[2]._dedup.text and got[2]._dedup.text.startswith(long[:1_000_000]) and got[2]._dedup.text.endswith(prose(3, 40))
    assert len(got[3]._dedup.text) < 100


def test_preferences_of_long_turns(spark, long):
    rows = [(c, t, role, text) for c, end in ((1, "yes"), (2, long[::-1])) for t, role, text in ((0, "user", long), (1, "assistant", end))]
    one = {r.conv_id: r for r in preferences.formatted(preferences.paired(preferences.gathered(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")))).collect()}[1]
    assert one.rejected_id == 2 and one.n_common == 1 and long in one.prompt and long[::-1] in one.rejected and one.chosen_mask == "14-17"


def test_sharding_query_with_long_and_empty_texts(spark, tmp_path, long):
    rows = [(1, long), (2, None), (3, ""), (None, "é"), (1, long)] + [(10 + i, "t") for i in range(78)]
    spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, shard string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sharding.op10_sharding(spark, str(tmp_path)).collect()
    data = lambda t: (t or "").encode()
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == Counter((d, len(data(t)) + 16, zlib.crc32(data(t))) for d, t in rows)
    sizes = Counter(r.shard for r in got)
    assert sum(sizes.values()) == 83 and set(sizes.values()) == {2, 3} and len(sizes) == 40


def test_ties_of_length_are_packed_each_once(spark):
    rows = [(d % 7 if d % 3 else None, "same few words here" if d % 2 else "w " * (d % 40)) for d in range(120)]
    pieces = packing.tokenised(spark.createDataFrame(rows, "doc_id long, text string")).cache()
    per = defaultdict(list)
    for r in packing.pack(pieces).collect():
        per[r.sequence_id].append((r.offset, r.length))
    assert sum(map(len, per.values())) == 120
    for v in per.values():
        v.sort()
        assert [o for o, _ in v] == np.concatenate(([0], np.cumsum([n for _, n in v])))[:-1].tolist() and sum(n for _, n in v) <= 1024


def test_languages_of_repeated_ids_empty_tables_and_long_texts(spark, long):
    texts = {"aa": "aba bab abba baab ", "xx": "xyz zyx xxyz yzzx "}
    rows = [(i % 20, t * (1 + i % 5), k) for i, (k, t) in enumerate(list(texts.items()) * 60)] + [(3, "zyx xyz", "aa"), (None, "aba", "aa")]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(table)
    again = langid.fit(table.repartition(7))
    assert model["langs"] == again["langs"] and np.allclose(model["table"], again["table"])  # of a repeated id one row, the same one
    assert langid.predict(table.limit(0), model).count() == 0
    odd = spark.createDataFrame([(1, "xyz zyx " * 100_000), (2, None), (3, "12 34"), (4, long)], "doc_id long, text string")
    got = {r.doc_id: r for r in langid.predict(odd, model).collect()}
    assert got[1].lang_pred == "xx" and (got[2].lang_pred, got[2].score) == ("und", 0) and got[3].lang_pred == "und" and got[4].lang_pred in ("aa", "xx")


def test_pipeline_passes_long_texts_whole(spark, long):
    other = prose(4, 150_000)
    rows = [(1, long, "en", "s", len(long)), (2, long + " more", "en", "s", len(long) + 5), (3, other, None, None, None), (4, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in cp.STAGES:
        docs = cp.written(stage(spark, docs, "/root/testdata/sf0.001"))
    lengths = {r.doc_id: r.n for r in docs.groupBy("doc_id").agg(F.sum("length").alias("n")).collect()}
    want = {r.doc_id: r.n for r in packing.tokenised(spark.createDataFrame([r[:2] for r in rows if r[0] in (1, 3)], "doc_id long, text string")).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()}
    assert lengths == want
