"""The pipeline's stages against plain versions on the small tables, and their edges."""

import re

import corpus_pipeline as cp
import duckdb
from pyspark.sql import functions as F
from test_jaccard import expected
from test_operators import measured, spans_of

SF = "/root/testdata/sf0.001"


def test_stages_on_small_tables(spark):
    documents = spark.read.parquet(f"{SF}/documents.parquet")
    bench = duckdb.sql(f"select item_id, text from '{SF}/benchmark.parquet'").fetchall()
    now = documents
    for name, stage in cp.STAGES:
        before = {r.doc_id: r for r in now.collect()}
        after = stage(spark, now, SF)
        if name != "best_fit_packing":
            assert after.columns == documents.columns
        after = after.persist()
        rows = after.collect()
        if name == "quality_rules":
            fails = lambda t: (lambda m: m[0] < 50 or 100 * m[5] > 50 * m[0] or 100 * m[2] > 20 * m[0] or 100 * m[4] > 50 * m[3] or m[1] < 2 * m[0] or m[1] > 25 * m[0] or 100 * m[6] > 50 * m[7])(measured(t))
            assert {r.doc_id for r in rows} == {d for d, r in before.items() if not fails(r.text)}
        elif name == "jaccard_join":
            want = expected(sorted((d, r.text) for d, r in before.items()))
            assert {r.doc_id for r in rows} == {d for d, _, c in want if d == c}
        elif name == "benchmark_decontamination":
            low = lambda t: " ".join(re.findall(r"[^\W_]+", t.lower()))
            leaked = {d for d, r in before.items() if any(low(t) in low(r.text) for _, t in bench)}
            assert {r.doc_id for r in rows} == set(before) - leaked and leaked
        elif name == "secret_scans":
            assert len(rows) == len(before)
            for r in rows:
                assert not spans_of(r.text) and r.n_chars == len(r.text)
                assert r.text == before[r.doc_id].text or spans_of(before[r.doc_id].text)
        else:
            assert {r.doc_id for r in rows} == set(before)
        now = after


def test_edges(spark):
    long = " ".join(f"w{i} v{i % 977}" for i in range(400))
    rows = [(1, long), (1, long), (2, long + " more"), (None, long + " other words"), (None, "x " + long.replace("w", "q")), (3, None), (4, ""), (5, "short")]
    table = spark.createDataFrame([(d, t, "en", None, 1, 7, 8, 9, 1, 2, 3) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long, n int, length int, id int, row int, one long, base int")
    for size, docs in ((len(rows), table), (0, table.limit(0))):
        for name, stage in cp.STAGES:
            docs = cp.written(stage(spark, docs, SF))
        assert (docs.count() > 0) == (size > 0)
    kept = cp.jaccard_join(spark, table, SF)
    assert sorted((r.doc_id or 0, (r.text or "")[:3]) for r in kept.collect()) == [(0, "w0 "), (0, "x q"), (3, ""), (4, ""), (5, "sho")]
    assert kept.columns == table.columns and kept.where(F.col("n") != 7).count() == 0
