"""Registered queries against their SQL on tables of other shapes than the smallest ones: each failed there once."""

import os
import subprocess
import sys

import duckdb
import pytest
from pyspark.sql import functions as F
from test_queries import SF, TABLES, norm

from tracewell.functions import scalars as S
from tracewell.operators import branches as B
from tracewell.operators import frames as Fr
from tracewell.plans import dataset_queries as D
from tracewell.plans.everything import oracle_sql, queries
from tracewell.plans.trace_queries import DET
from tracewell.sources import files as Fi


@pytest.fixture
def other(tmp_path):
    """A folder of the smallest tables, of which the named ones are given by a SELECT over all of them."""

    def make(**changed):
        c = duckdb.connect()
        for t in TABLES:
            c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
        for t in TABLES:
            if t in changed:
                c.execute(f"copy ({changed[t]}) to '{tmp_path}/{t}.parquet' (format parquet)")
            else:
                os.symlink(f"{SF}/{t}.parquet", tmp_path / f"{t}.parquet")
        return str(tmp_path)

    return make


def agrees(spark, folder, name):
    """Whether query and SQL give the same rows, and some at all."""
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    df = queries()[name](spark, folder)
    cols = sorted(df.columns)
    got = sorted((tuple(map(norm, r)) for r in df.select(*cols).collect()), key=repr)
    cur = c.execute(oracle_sql()[name])
    order = [[d[0] for d in cur.description].index(x) for x in cols]
    assert got == sorted((tuple(norm(r[i]) for i in order) for r in cur.fetchall()), key=repr)
    return bool(got)


@pytest.mark.parametrize("name", ["scan_split", "scan_pool_split", "write_dataset", "relabel_dataset", "freeze_dataset", "scan_label_scheme"])
def test_last_sample_lacks_traces(spark, other, name):
    """F1 to F4, F6, F7: the number of vectors is no multiple of a sample's twenty."""
    assert agrees(spark, other(embeddings="select * from embeddings where vec_id < 496 and vec_id <> 63"), name)


@pytest.mark.parametrize("name", ["scan_pool_split"])
def test_more_samples_than_pool_rows(spark, other, name):
    """more samples than the fixed limit of pool rows make a split that is not sound, as in SQL."""
    assert agrees(spark, other(embeddings="select vec_id + 20 * i as vec_id, embedding, label from embeddings, range(10002) r(i) where vec_id = 0"), name)


def test_more_epochs_than_the_schedule(spark, other):
    """F8: experiments go on after the hundredth epoch."""
    assert agrees(spark, other(events="select * replace (user_id % 3 as user_id) from events"), "lr_schedule")


def test_mean_of_frames_in_any_order(spark):
    """the same traces in another order give the same mean, to the last bit."""
    rows = [(7, 0, 2, [-1e16]), (7, 0, 0, [1e16]), (7, 0, 1, [1.0])]
    means = [Fr.mean_of(spark.createDataFrame([rows[i] for i in p], "sample_id int, channel int, frame int, signal array<double>").coalesce(1), ["sample_id", "channel"]).first().signal for p in ((0, 1, 2), (1, 2, 0), (2, 0, 1))]
    assert means[0] == means[1] == means[2] == [0.0]


def test_names_that_end_in_a_key(spark, other):
    """thr13 and key 1220 make the same name as thr1 and key 31220, but are two runs."""
    assert agrees(spark, other(part="select * replace (k as p_partkey, z as p_size) from part, (values (1220::bigint, 13::integer), (31220::bigint, 1::integer)) v(k, z) where p_partkey = (select min(p_partkey) from part)"), "run_guard")


def test_numbers_are_worked_out_once(spark):
    """the text of a threshold is named once in the expression of the class names, not for each digit and class."""
    plan = spark.range(1).select(S.class_names(F.array(F.col("id") / 10, F.col("id") / 5)))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("format_string") < 40
    odd = [0.1234565, 123456.7, 999999.5, 1e6, 1e-5, 0.00012345, -0.8, 100000.0, 12.0, 9.9999951]
    got = [r.g for r in spark.createDataFrame([(x,) for x in odd], "x double").coalesce(1).select(S.general(F.col("x")).alias("g")).collect()]
    assert got == ["0.123456", "123457", "1e+06", "1e+06", "1e-05", "0.00012345", "-0.8", "100000", "12", "10"]


@pytest.mark.parametrize("name", ["provenance_hash", "experiment_catalog", "scan_experiments", "scan_candidates"])
def test_no_file_for_each_row(spark, name, monkeypatch):
    """F11, F12, F13, F16: the number of written files does not grow with the rows; the scans of packed folders give what those of folders give."""
    made = []
    monkeypatch.setattr(D, "shared_path", lambda s, n, own=D.shared_path: made.append(own(s, n)) or made[-1])
    queries()[name](spark, SF).collect()
    assert 0 < sum(len(files) for at in made for _, _, files in os.walk(at.removeprefix("file:"))) < 100


def test_packed_folders_read_as_folders(spark, tmp_path):
    """F11, F13, F16: the same files, packed or not."""
    texts = {
        "r1/config.json": '{"feature_layout": "headsim_cubic", "form": "max1"}', "r1/metrics.json": '{"metrics": {"test": {"accuracy": 0.5}}}', "r2/config.json": "{broken", "r1/deep/config.json": "{}",
        "a_top15.json": '{"method": "m", "configurations": [{"id": "c", "parameters": {"lr": 0.1}}]}', "a_other.json": "{}", "r1/history.json": "none",
    }
    for path, text in texts.items():
        os.makedirs((tmp_path / "plain" / path).parent, exist_ok=True)
        (tmp_path / "plain" / path).write_text(text)
    Fi.pack(spark.createDataFrame(list(texts.items()), "path string, value string"), str(tmp_path / "packed"))
    for read in (Fi.run_folders, Fi.candidate_files):
        a, b = (read(spark, str(tmp_path / k)).collect() for k in ("plain", "packed"))
        assert len(a) == 1 and a == b
    a, b = (sorted(Fi.file_hashes(spark, str(tmp_path / k), "/(?:plain|packed)/(.*)$").collect()) for k in ("plain", "packed"))
    assert len(a) == len(texts) and a == b


def test_image_name_is_worked_out_once(spark):
    """an image's name takes one test and one replacement of the run's name, which is worked out once; marks of replacements in it are plain."""
    name = F.concat(F.lit("form_a__regions_$1__channels_"), F.col("id").cast("string"), F.lit("__vit__x"))
    image = spark.range(2).select(S.confusion_image(name, F.lit("te$1\\st")).alias("i"), S.confusion_image(F.lit("form_a"), F.lit("test")).alias("none"))
    assert image._jdf.queryExecution().optimizedPlan().toString().count("form_a__regions_") == 1
    assert [tuple(r) for r in image.collect()] == [(f"form_a__regions_$1__channels_{k}__split_te$1\\st__vit__x.png", None) for k in (0, 1)]


def test_split_of_a_small_class(spark, other):
    """a class with too few rows for every split is dealt as its SQL deals it."""
    assert agrees(spark, other(orders="select * replace (case when o_orderkey % 700 = 3 then 90000.0 when o_totalprice < 120000 then 50000.0 else o_totalprice end as o_totalprice) from orders"), "stratified_split")


FIRST = """
import sys
from pyspark.sql import SparkSession
from tracewell.plans.everything import queries
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.local.dir", sys.argv[3]).getOrCreate()
print("rows", sorted(tuple(r) for r in queries()[sys.argv[1]](spark, sys.argv[2]).collect()))
"""


def test_class_sample_is_the_first_query(tmp_path):
    """in a session of its own, as the optimizer's fault depends on how many columns were named before."""
    ran = subprocess.run([sys.executable, "-c", FIRST, "class_sample", SF, str(tmp_path)], capture_output=True, text=True, timeout=300)
    assert ran.returncode == 0, ran.stderr[-2000:]
    c = duckdb.connect()
    c.execute(f"create view orders as select * from '{SF}/orders.parquet'")
    want = sorted(c.execute(f"select sample_id, label, short from ({oracle_sql()['class_sample']})").fetchall())
    assert want and f"rows {want}" in ran.stdout


ODD = """select vec_id, case when vec_id // 20 = 2 or (vec_id // 20 = 8 and vec_id % 2 = 0) then list_transform(embedding, lambda x: 0::float) else embedding end::float[] as embedding, label from embeddings
 where vec_id < 495 and vec_id <> 63 and not (vec_id // 20 = 9 and vec_id % 2 = 1) and not (vec_id // 20 = 10 and vec_id % 20 < 4)"""


def test_both_branches_of_all_frames_are_verified(spark, other):
    """tails and windows of all frames; flat traces, a lone channel and absent frames are told."""
    folder = other(embeddings=ODD)
    assert agrees(spark, folder, "verify_branches")
    found = {(r.name, r.problem) for r in queries()["verify_branches"](spark, folder).collect()}
    content = {(n, p) for n in (B.MAIN, B.TAIL) for p in ("missing", "extra", "values")}
    assert found == content | {(B.TAIL, "shape")} | {(n, p) for n in (B.MAIN, B.TAIL) for p in ("channels", "no_span")}


def test_what_verification_finds(spark):
    """one point of one frame, padding that is not zero or absent, an infinite point, a frame that is not there."""
    trace = [float(i) for i in range(64)]
    scans = [(k, f, c, [float("inf") if (k, f, c, i) == (4, 0, 1, 20) else x for i, x in enumerate(trace)]) for k in range(1, 8) for f in range(3) for c in range(2) if (k, c) != (6, 1)]
    spans = [(k, c, 10, 34, 34, 64, 2, "overflow" if (k, c) == (7, 1) else "ok") for k in range(1, 8) for c in range(2) if (k, c) != (6, 1)]
    parse = {(k, f, c, n): list(x) for k in range(1, 6) for f in range(3) for c in range(2) for n, x in ((B.MAIN, trace[10:34]), (B.TAIL, trace[34:] + [0.0, 0.0]))}
    parse[1, 2, 0, B.MAIN][23] += 1e-9
    parse[2, 1, 1, B.TAIL][31] = 1e-9
    parse[3, 0, 0, B.TAIL] = parse[3, 0, 0, B.TAIL][:30]
    parse[4, 0, 1, B.MAIN][10] = float("inf")
    del parse[5, 1, 0, B.MAIN]
    own = spark.createDataFrame(scans, "sample_id long, frame long, channel long, signal array<double>")
    at = spark.createDataFrame(spans, "sample_id long, channel long, start int, end int, tail_start int, tail_end int, tail_pad int, status string")
    theirs = spark.createDataFrame([(k, c, f, n, x) for (k, f, c, n), x in parse.items()], "sample_id long, channel long, frame long, name string, signal array<double>")
    got = sorted(tuple(r) for r in B.verified(own, at, theirs, DET, 24).select("sample_id", "channel", "name", "problem", "n_frames").collect())
    assert got == sorted([
        (1, 0, B.MAIN, "values", 1), (2, 1, B.TAIL, "values", 1), (3, 0, B.TAIL, "shape", 1), (4, 1, B.MAIN, "not_finite", 1), (4, 1, B.MAIN, "branch_not_finite", 1), (5, 0, B.MAIN, "missing", 1),
        *((6, 0, n, "channels", 0) for n in (B.MAIN, B.TAIL)), *((7, c, n, "no_span", 0) for c in range(2) for n in (B.MAIN, B.TAIL)),
    ])
