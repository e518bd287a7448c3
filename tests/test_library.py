"""Boundary cases and properties of the library's operators, against independent arithmetic."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewell.functions import ranks
from tracewell.functions import scalars as S
from tracewell.functions import signals as G
from tracewell.operators import branches as B
from tracewell.operators import catalog as K
from tracewell.operators import curation as C
from tracewell.operators import evaluation as E
from tracewell.operators import features as Fe
from tracewell.operators import frames as Fr
from tracewell.operators import models as M
from tracewell.operators import spans as Sp
from tracewell.sources import arrays, datasets, files, paths, sinks

rng = np.random.default_rng(3)


def test_spline_reproduces_cubics():
    for n, target in ((4, 9), (170, 512), (600, 512), (24, 24)):
        x = np.arange(n) / n
        y = 1 - 2 * x + 3 * x**2 - 4 * x**3
        at = np.linspace(0, n - 1, target) / n
        assert np.allclose(G.spline_weights(n, target) @ y, 1 - 2 * at + 3 * at**2 - 4 * at**3, atol=1e-9)
    with pytest.raises(ValueError):
        G.spline_weights(3, 8)


def test_envelope_of_a_tone_is_flat():
    x = np.cos(2 * np.pi * 8 * np.arange(64) / 64)[None]
    assert np.allclose(G.envelope_of(x), 1)
    assert G.envelope_of(np.zeros((1, 7))).tolist() == [[0] * 7]


def sifted(x, modes=5, sifts=30, limit=0.2):
    """A plain version of the decomposition of one trace."""

    def ext(h):
        up = [i for i in range(1, len(h) - 1) if h[i] > h[i - 1] and h[i] >= h[i + 1]]
        return up, [i for i in range(1, len(h) - 1) if h[i] < h[i - 1] and h[i] <= h[i + 1]]

    def env(h, k):
        return np.interp(range(len(h)), sorted({0, len(h) - 1, *k}), h[sorted({0, len(h) - 1, *k})]) if k else np.full(len(h), h.mean())

    rest, out = x.copy(), []
    if len(x) < 4:
        return out, rest
    for _ in range(modes):
        if sum(map(len, ext(rest))) < 2:
            break
        h = rest.copy()
        for _ in range(sifts):
            up, down = ext(h)
            if len(up) + len(down) < 2:
                break
            c = h - (env(h, up) + env(h, down)) / 2
            sd = (c**2).sum() / ((h**2).sum() + 1e-12)
            h = c
            if sd < limit and abs(int((h[:-1] * h[1:] < 0).sum()) - sum(map(len, ext(h)))) <= 1:
                break
        out.append(h)
        rest = rest - h
        if sum(map(len, ext(rest))) < 2:
            break
    return out, rest


def test_decomposition_equals_plain_version_and_adds_up():
    x = np.cumsum(rng.normal(size=(12, 80)), axis=1)
    x[0], x[1] = 0, np.arange(80)
    comp, n = G.decompose(x)
    assert np.allclose(comp.sum(1), x)
    for row, c, k in zip(x, comp, n, strict=True):
        modes, rest = sifted(row)
        assert k == len(modes)
        assert np.allclose(c[:k], np.array(modes).reshape(k, 80)) and np.allclose(c[5], rest)
    assert G.decompose(np.ones((1, 3)))[1].tolist() == [0]


def test_labels_at_thresholds(spark):
    df = spark.createDataFrame([(1.2999,), (1.3,), (2.0,), (None,)], "depth_value double")
    got = [r.label for r in C.labelled(df, [1.3, 2.0]).collect()]
    assert got == [0, 1, 2, None]
    names = spark.range(1).select(S.class_names(C.thresholds_of([1.3])).alias("n"), S.scheme_tag(C.thresholds_of([1.0, 2.5])).alias("t")).first()
    assert names.n == ["depth < 1.3", "depth >= 1.3"] and names.t == "cls3_thr1-2.5"


def test_scheme_errors(spark):
    rows = [("1.3",), ("1;2",), ("2,1",), ("a,1",), (" , ",)]
    df = spark.createDataFrame(rows, "t string")
    got = [r.e for r in df.select(S.scheme_errors(S.parse_thresholds(F.col("t"))).alias("e")).collect()]
    assert got == [[], [], ["not_increasing"], ["not_finite"], ["empty"]]


def test_half_up_and_clamp(spark):
    df = spark.createDataFrame([(0.0,), (0.5 * 5 / 896,), (1.5 * 5 / 896,), (9.0,), (-1.0,)], "d double")
    got = [r[0] for r in df.select(S.depth_to_index(F.col("d"), 5.0, 896)).collect()]
    assert got == [0, 1, 2, 896, 0]


def test_tie_decisions(spark):
    p = spark.createDataFrame([([0.5, 0.5],)], "p array<double>").select(S.decide(F.col("p")).alias("a"), S.decide(F.col("p"), 0.5).alias("t")).first()
    assert (p.a, p.t) == (0, 1)


@pytest.mark.parametrize(("fn", "tp", "stop"), [(10, 16, False), (11, 15, True), (2, 3, False), (0, 0, None)])
def test_gate(spark, fn, tp, stop):
    r = E.error_gate(spark.createDataFrame([(fn, tp)], "fn long, tp long"), 0.4).first()
    assert r.stop is stop


def test_auc_with_ties_and_absent_class(spark):
    y, s = rng.integers(0, 2, 300), rng.integers(0, 9, 300) / 8
    df = spark.createDataFrame([(1, int(a), float(b)) for a, b in zip(y, s, strict=True)] + [(2, 1, 0.3), (3, 0, 0.5), (3, 1, 0.5)], "g int, label int, p double")
    got = {r.g: r.auc for r in E.roc_auc(df, ["g"], "p").collect()}
    d = s[y == 1][:, None] - s[y == 0][None]
    assert got[1] == pytest.approx(((d > 0) + 0.5 * (d == 0)).mean()) and got[2] is None and got[3] == 0.5


def test_threshold_sweep_equals_all_thresholds(spark):
    y, s = rng.integers(0, 2, 60), rng.integers(0, 20, 60) / 20
    df = spark.createDataFrame([(1, int(a), float(b)) for a, b in zip(y, s, strict=True)], "g int, label int, p double")
    best = max(((s[y == 0] < t).mean() + 2 * (s[y == 1] >= t).mean(), t) for t in [0.0, *s, np.nextafter(s.max(), 9)])
    got = E.threshold_sweep(df, ["g"], "p", 2.0).first()
    assert got.objective == pytest.approx(best[0]) and (got.threshold or best[1]) == pytest.approx(best[1])


def test_schedule_ends(spark):
    e = spark.range(1, 41).select(S.learning_rate(F.col("id"), 40, 3e-4, 1e-6, 5).alias("r"))
    r = [x.r for x in e.collect()]
    assert r[4] == pytest.approx(3e-4) and r[5] == pytest.approx(3e-4) and r[-1] == pytest.approx(1e-6)
    assert all(a >= b for a, b in zip(r[5:], r[6:], strict=False))


def test_largest_remainder_and_split(spark):
    pool = spark.range(103).select(F.col("id").alias("sample_id"), (F.col("id") % 3).cast("int").alias("label"), F.lit("x").alias("split"))
    out = C.stratified_split(pool, {"train": 0.6, "val": 0.15, "test": 0.25}, 1).collect()
    assert sorted(r.sample_id for r in out) == list(range(103))
    for k, n in ((0, 35), (1, 34), (2, 34)):
        exact = [n * r for r in (0.6, 0.15, 0.25)]
        want = [math.floor(x) for x in exact]
        for i in sorted(range(3), key=lambda i: (-(exact[i] - want[i]), i))[: n - sum(want)]:
            want[i] += 1
        assert [sum(r.label == k and r.split == s for r in out) for s in ("train", "val", "test")] == want


def test_bad_manifests(spark):
    pool = spark.createDataFrame([(1, "a"), (2, "a"), (3, "a")], "sample_id int, split string")
    manifest = spark.createDataFrame([(1, "train"), (1, "val"), (9, "test")], "sample_id int, split string")
    got = {(r.sample_id, r.problem) for r in C.missing_extra(manifest, pool).collect()}
    assert got == {(1, "duplicate"), (9, "missing"), (2, "extra"), (3, "extra")}
    tiles = {(r.pool_row, r.problem) for r in C.pool_tiling(spark.createDataFrame([(0,), (0,), (5,)], "pool_row long"), 2).collect()}
    assert tiles == {(0, "duplicate"), (1, "missing"), (5, "extra")}


def stack(spark, peaks1, peaks2, extra=()):
    """50 frames of 20 points: channel 0 peaks at point 0, channel 1 at point 10."""
    x = np.zeros((50, 2, 20))
    for f, v in peaks1.items():
        x[f, 0, 0] = v
    for f, v in peaks2.items():
        x[f, 1, 10] = v
    for f, c, p, v in extra:
        x[f, c, p] = v
    rows = [(1, f, c, x[f, c].tolist()) for f in range(50) for c in range(2)]
    scans = spark.createDataFrame(rows, "sample_id int, frame int, channel int, signal array<double>")
    return scans, spark.createDataFrame([(1, 0, 0, 10), (1, 1, 10, 20)], "sample_id int, channel int, start int, end int")


def test_shared_frames_and_fallback(spark):
    first = {f: 20.0 - f for f in range(10)}
    scans, spans = stack(spark, first, {f: 20.0 - f for f in (4, 2, 30, 31, 32, 33, 34, 35, 36, 37)})
    one = Fr.select_c4(scans, spans, 1).collect()
    assert [(r.frame, r.used_overlap) for r in one] == [(2, True)]
    three = Fr.select_c4(scans, spans, 3).collect()
    assert len(three) == 3 and not any(r.used_overlap for r in three)


def test_own_windows_and_ties(spark):
    scans, spans = stack(spark, {3: 5.0, 7: 5.0}, {4: 6.0, 8: 6.0}, [(40, 1, 0, 1000.0)])
    got = {r.channel: r.frame for r in Fr.select_c3(scans, spans, 1).collect()}
    assert got == {0: 3, 1: 4}


def test_detector_against_plain_walk(spark):
    c = Sp.Detector(4, 0.3, 4, 8, 16, 0.5, 3, 2, 0.05, 16, 2, 3, 10, 32, 64, 3)
    assert c.errors() == [] and Sp.Detector(peak_ratio=1.5, noise_start=-1).errors() == ["noise_start", "peak_ratio"]
    env = np.abs(rng.normal(size=(40, 64))) * 0.4
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(env)], "i int, x array<double>")
    got = df.select("i", Sp.runs_above(F.col("x"), F.lit(0.2), 4).alias("runs"), Sp.moving_average(F.col("x"), 4, 4).alias("m"), Sp.first_above(F.col("x"), F.lit(0.9), 4).alias("f")).collect()
    for r in got:
        x, runs = env[r.i], []
        for p in range(4, 64):
            if x[p] > 0.2:
                if p > 4 and x[p - 1] > 0.2:
                    runs[-1][1] = p + 1
                else:
                    runs.append([p, p + 1])
        assert [[q.start, q.end] for q in r.runs] == runs
        assert np.allclose(r.m, [0 if p < 4 else np.mean([x[min(max(q, 4), 63)] for q in range(p - 1, p + 3)]) for p in range(64)])
        hits = [p for p in range(4, 64) if x[p] > 0.9]
        assert r.f == (hits[0] if hits else None)


def test_pooling_counts_absent_components(spark):
    comp = spark.createDataFrame([(1, 0, [2.0, 2.0])], "sample_id int, component int, signal array<double>")
    r = Fe.pooled(comp, ["sample_id"], 1).first()
    assert r["mean"] == pytest.approx(2 / 6) and r["peak_abs"] == pytest.approx(2 / 6)


def test_scaler_flags_flat_features(spark):
    f = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 5.0), ("b", 5.0)], "stat string, value double")
    out = {(r.stat, r.value) for r in Fe.scaled(f, Fe.scaler(f, ["stat"]), ["stat"]).collect()}
    assert out == {("a", -1.0), ("a", 1.0), ("b", 0.0)}


def test_regions(spark):
    df = spark.createDataFrame([(1, "[[0.2,1.5],[3,2]]"), (2, '[{"start_mm":1,"end_mm":3,"name":"bone"}]'), (3, "nothing")], "k int, t string")
    got = [(r.k, r.name, r.valid) for r in B.parse_regions(df, "t", 5.0).collect()]
    assert got == [(1, "0.2-1.5mm", True), (1, "3-2mm", False), (2, "bone", True)]


def numbers(n):
    return np.arange(n * 6, dtype=np.float64).reshape(n, 2, 3)


def test_arrays_of_one_file_are_read_by_ranges_and_small_batches(spark, tmp_path):
    x = numbers(10)
    np.save(tmp_path / "x.npy", x)
    np.save(tmp_path / "y.npy", np.arange(10) * 2)
    df = arrays.read_aligned(spark, f"file://{tmp_path}", [("x", "x.npy", "array<double>"), ("y", "y.npy", "long")], bytes=3 * 56, batch=60)
    assert df.rdd.getNumPartitions() == 4
    got = sorted(df.collect(), key=lambda r: r.position)
    assert [(r.position, r.x, r.y) for r in got] == [(i, x[i].ravel().tolist(), 2 * i) for i in range(10)]


def test_arrays_are_written_in_order_and_read_again(spark, tmp_path):
    rows = spark.range(37).select(F.col("id").alias("row"), F.array(*(F.col("id") * k for k in (1.0, 2.0, 3.0, 4.0, 5.0, 6.0))).alias("values")).repartition(5)
    arrays.write_arrays(rows, f"file://{tmp_path}/x.npy", (2, 3), "float32", part_bytes=24 * 10)
    assert arrays.shape(f"file://{tmp_path}/x.npy") == (37, 2, 3)
    assert [np.load(f).shape[0] for f in sorted((tmp_path / "x.npy").iterdir())] == [10, 10, 10, 7]
    got = arrays.read_arrays(spark, f"file://{tmp_path}/x.npy").orderBy("row").collect()
    assert [r["row"] for r in got] == list(range(37)) and all(r["values"] == [r["row"] * k for k in range(1, 7)] for r in got)


def test_columns_and_ranges_that_are_not_asked_for_are_not_read(spark, tmp_path):
    for split, n in (("a", 9), ("b", 4)):
        (tmp_path / split).mkdir()
        np.save(tmp_path / split / "x.npy", numbers(n))
        np.save(tmp_path / split / "y.npy", np.arange(n))
        (tmp_path / split / "r.json").write_text(json.dumps([{"sample_id": f"{split}{i}"} for i in range(n)]))
    spec = [("x", "x.npy", "array<double>"), ("y", "y.npy", "long")]
    df = arrays.read_aligned(spark, f"{tmp_path}", spec, ["a", "b"], "r.json", bytes=100)
    layout = arrays.Layout({"path": str(tmp_path), "spec": json.dumps({"arrays": spec, "splits": ["a", "b"], "records": "r.json", "bytes": 100})})
    reader = arrays.AlignedReader(layout, df.select("split", "y").schema)
    assert {c for p in reader.partitions() for c in p.pieces} == {"y"} and {p.records for p in reader.partitions()} == {None}
    left = list(reader.pushFilters([arrays.EqualTo(("split",), "a"), arrays.GreaterThan(("position",), 1), arrays.LessThanOrEqual(("position",), 5)]))
    assert len(left) == 3 and {p.split for p in reader.partitions()} == {"a"} and all(p.last > 2 and p.first < 6 for p in reader.partitions())
    assert sorted((r.sample_id, r.y) for r in df.where("split = 'a' and position between 3 and 6").collect()) == [(f"a{i}", i) for i in (3, 4, 5, 6)]
    assert "Exchange" not in df._jdf.queryExecution().toString()


def test_records_of_a_list_are_found_at_any_chunk(tmp_path):
    items = [{"sample_id": "é" * k + '\\"]},[', "n": [{}, [k]], "depth_value": k / 3} for k in range(40)]
    for text in (json.dumps(items, ensure_ascii=False), json.dumps(items, ensure_ascii=False, indent=2), " [ ] ", "[]"):
        (tmp_path / "r.json").write_text(text)
        at, file = arrays.store(str(tmp_path / "r.json"))
        want = json.loads(text)
        for chunk in (1, 7, 64, 1 << 20):
            found = list(arrays.list_items(at, file, chunk=chunk))
            assert [v for _, _, v in found] == want
            if want:
                assert [v for _, _, v in arrays.list_items(at, file, found[3][0], found[9][1], chunk)] == want[3:10]
    for text in ("", "{}", "[{]", "[1", "3"):
        (tmp_path / "r.json").write_text(text)
        with pytest.raises(ValueError, match="JSON list"):
            list(arrays.list_items(*arrays.store(str(tmp_path / "r.json"))))


def test_a_failed_write_leaves_nothing_and_bad_rows_raise(spark, tmp_path):
    spec = [("v", "v.npy", "float32", (2,))]
    good = spark.range(20).select(F.lit("a").alias("split"), F.col("id").alias("position"), F.array(F.lit(1.0), F.col("id").cast("double")).alias("v"))
    bad = {
        "numbers each": good.withColumn("v", F.when(F.col("position") == 7, F.array(F.lit(1.0))).otherwise(F.col("v"))), "count from 0": good.withColumn("position", F.col("position") + 16), "one after the other": good.where("position <> 4"),
        "no split": good.withColumn("split", F.when(F.col("position") == 3, "z").otherwise("a")), "repeat": good.unionByName(good.where("position = 3")), "failed": good.withColumn("v", F.when(F.col("position") == 19, F.raise_error(F.lit("failed"))).otherwise(F.col("v"))),
    }
    for k, (word, rows) in enumerate(bad.items()):
        with pytest.raises(Exception, match="one after the other" if word == "repeat" else word):
            arrays.write_aligned(rows, f"{tmp_path}/{k}", spec, ["a"], part_bytes=64)
        assert not [f for f in (tmp_path / str(k)).rglob("*") if f.is_file()]
    arrays.write_aligned(good.repartition(7), f"{tmp_path}/good", spec, ["a", "empty"], part_bytes=64)
    assert sorted(str(f.relative_to(tmp_path / "good")) for f in (tmp_path / "good").rglob("*") if f.is_file()) == [f"a/v.npy/part-{i:012d}.npy" for i in (0, 8, 16)] + ["empty/v.npy/part-000000000000.npy"]
    assert arrays.read_aligned(spark, f"{tmp_path}/good", [("v", "v.npy", "array<float>")], ["a", "empty"]).count() == 20


def test_paths_that_cannot_be_reached_are_told_from_absent_ones(spark, tmp_path):
    assert not paths.exists(spark, f"file://{tmp_path}/none") and datasets.label_scheme(spark, f"file://{tmp_path}/none").count() == 0
    for call in (lambda p: paths.exists(spark, p), lambda p: datasets.label_scheme(spark, p), lambda p: files.discover(spark, p)):
        with pytest.raises(OSError, match="cannot be reached"):
            call("nosuchscheme://host/data")
    with pytest.raises(Exception, match="nosuchscheme"):
        arrays.shape("nosuchscheme://host/data/x.npy")


SHAPE = (3, 2, 5)


def reference_folder(at, n=4, shape=SHAPE, labels=None, records=None, first=10, more=None):
    """A split in the layout of single files."""
    at.mkdir(parents=True)
    np.save(at / "X.npy", (np.arange(n * np.prod(shape), dtype=np.float32) / 7 + first).reshape(n, *shape))
    np.save(at / "y.npy", np.arange(n if labels is None else labels) % 3)
    np.save(at / "indices.npy", np.arange(n) + first)
    rows = [{"sample_id": f"s{first + i}", "point_id": f"p{i}", "depth_value": (first + i) / 20, "label": i, "bone": {"side": "é", "n": i}, "note": None} | (more or {}) for i in range(n if records is None else records)]
    (at / "samples.json").write_text(json.dumps(rows, indent=1, ensure_ascii=False))


def whole_folder(at, sizes=(24, 6, 10), **more):
    first = 0
    for split, n in zip(C.SPLITS, sizes, strict=True):
        reference_folder(at / split, n, first=first, **more)
        first += n
    return str(at)


def test_split_folders_are_checked(spark, tmp_path):
    reference_folder(tmp_path / "good" / "train")
    got = datasets.load_split(spark, f"file://{tmp_path}/good", "train", SHAPE, True).orderBy("position").collect()
    assert [(r.position, r.label, r.pool_row, r.sample_id, r.point_id, r.depth_value) for r in got] == [(i, i % 3, 10 + i, f"s{10 + i}", f"p{i}", (10 + i) / 20) for i in range(4)]
    assert got[1].extra == {"bone": '{"side": "é", "n": 1}', "note": "null"}
    one = datasets.traces(datasets.load_split(spark, f"file://{tmp_path}/good", "train", SHAPE), *SHAPE).where("position = 1 and frame = 2 and channel = 1").first()
    assert np.allclose(one.signal, np.arange(55, 60) / 7 + 10)
    (tmp_path / "good" / "train" / "samples.json").unlink()
    assert datasets.load_split(spark, f"file://{tmp_path}/good", "train", SHAPE).where("sample_id is null").count() == 4
    with pytest.raises(FileNotFoundError):
        datasets.load_split(spark, f"file://{tmp_path}/good", "train", SHAPE, True)
    with pytest.raises(ValueError, match="shape"):
        datasets.load_split(spark, f"file://{tmp_path}/good", "train", (3, 2, 6))
    for name, more in (("labels", {"labels": 3}), ("records", {"records": 5})):
        reference_folder(tmp_path / name / "train", **more)
        with pytest.raises(ValueError, match="numbers"):
            datasets.load_split(spark, f"file://{tmp_path}/{name}", "train", SHAPE, True)
    with pytest.raises(FileNotFoundError):
        datasets.load_split(spark, f"file://{tmp_path}/none", "train", SHAPE)
    reference_folder(tmp_path / "far" / "train", first=9_998)
    with pytest.raises(Exception, match="beyond 0 to 9999"):
        datasets.load_split(spark, f"{tmp_path}/far", "train", SHAPE, True).collect()
    assert datasets.load_split(spark, f"{tmp_path}/far", "train", SHAPE, True, None).agg(F.max("pool_row")).first()[0] == 10_001


def test_unsound_pools_raise(spark, tmp_path):
    assert datasets.load_pool(spark, whole_folder(tmp_path / "good"), SHAPE).count() == 40
    bad = {"gaps": {}, "duplicate_ids": {"sample_id": "same"}, "empty_ids": {"sample_id": ""}, "bad_depth": {"depth_value": None}, "duplicate_rows": {}}
    for word, more in bad.items():
        at = whole_folder(tmp_path / word, more=more)
        if word in ("gaps", "duplicate_rows"):
            np.save(tmp_path / word / "val" / "indices.npy", np.arange(6) + {"gaps": 100, "duplicate_rows": 0}[word])
        with pytest.raises(ValueError, match=word):
            datasets.load_pool(spark, at, SHAPE)


def by_row(spark, at, columns=None):
    return {r.pool_row: r for r in datasets.load_pool(spark, at, SHAPE, columns=columns).collect()}


@pytest.mark.parametrize("keep", [False, True])
def test_relabelling_keeps_traces_and_records(spark, tmp_path, keep):
    source, at = whole_folder(tmp_path / "source"), str(tmp_path / "out")
    report = datasets.relabel_dataset(spark, source, at, SHAPE, [0.5, 1.25], {"train": 0.6, "val": 0.15, "test": 0.25}, keep_source_split=keep)
    old, new = by_row(spark, source), by_row(spark, at)
    assert old.keys() == new.keys() == set(range(40)) and report["total_samples"] == 40 and report["smallest_class"] == 10
    assert [e["count"] for e in report["per_class"]] == [10, 15, 15] and not report["old_label_matches_thresholds"] and json.loads((tmp_path / "out" / "relabel_report.json").read_text()) == report
    for k, r in new.items():
        assert np.array_equal(np.float32(r["values"]), np.float32(old[k]["values"])) and (r.sample_id, r.point_id, r.depth_value, r.extra) == (old[k].sample_id, old[k].point_id, old[k].depth_value, old[k].extra)
        assert r.label == int(r.depth_value >= 0.5) + int(r.depth_value >= 1.25) and r.source_label == old[k].label
    for split in C.SPLITS:
        own = sorted((r.position, r.pool_row) for r in new.values() if r.split == split)
        assert [p for p, _ in own] == list(range(len(own))) and [k for _, k in own] == sorted(k for _, k in own)
        if keep:  # the bytes of the arrays are the source's own
            assert b"".join(np.load(f).tobytes() for f in sorted((tmp_path / "out" / split / "X.npy").iterdir())) == np.load(tmp_path / "source" / split / "X.npy").tobytes()
    tag = datasets.label_scheme(spark, at).first().tag
    assert tag == "cls3_thr0.5-1.25" + ("_keepsplit" if keep else "") and sum(1 for _ in datasets.read_manifest(spark, f"{at}/manifest.csv").collect()) == 40


def test_relabelling_refuses_and_leaves_nothing(spark, tmp_path):
    source = whole_folder(tmp_path / "source")
    ratios = {"train": 0.6, "val": 0.15, "test": 0.25}
    before = sorted(tmp_path.rglob("*"))
    with pytest.raises(ValueError, match="fewer than 1"):
        datasets.relabel_dataset(spark, source, f"{tmp_path}/out", SHAPE, [0.12], ratios)
    for target in (source, f"{source}/inner", f"file://{tmp_path}"):
        with pytest.raises(ValueError, match="overlaps"):
            datasets.relabel_dataset(spark, source, target, SHAPE, [1.0], ratios)
    assert sorted(tmp_path.rglob("*")) == before
    datasets.relabel_dataset(spark, source, f"{tmp_path}/out", SHAPE, [0.12], ratios, allow_small_classes=True)
    with pytest.raises(FileExistsError):
        datasets.relabel_dataset(spark, source, f"{tmp_path}/out", SHAPE, [1.0], ratios)


def frozen(ids, **more):
    counts = {s: {"0": sum(int(x[1:]) < 20 for x in v), "1": sum(int(x[1:]) >= 20 for x in v)} for s, v in ids.items()}
    return {"schema_version": 1, "num_classes": 2, "thresholds_mm": [1.0], "tag": "unified", "display_name": "one", "seed": 7, "ratios": [0.6, 0.15, 0.25], "splits": ids, "class_distribution": counts} | more


def test_freezing_follows_the_manifest_or_leaves_nothing(spark, tmp_path):
    source = whole_folder(tmp_path / "source")
    order = [f"s{k * 7 % 40}" for k in range(40)]
    ids = {"train": order[:20], "val": order[20:29], "test": order[29:]}
    (tmp_path / "m.json").write_text(json.dumps(frozen(ids)))
    meta = datasets.freeze_dataset(spark, source, f"{tmp_path}/good", f"{tmp_path}/m.json", SHAPE)
    new = by_row(spark, f"{tmp_path}/good")
    for split, want in ids.items():
        assert [r.sample_id for r in sorted(new.values(), key=lambda r: r.position) if r.split == split] == want
    assert meta["sample_counts"] == {"train": 20, "val": 9, "test": 11} and datasets.label_scheme(spark, f"{tmp_path}/good").first().tag == "unified"
    assert "display_name" in json.loads((tmp_path / "good" / "label_scheme.json").read_text()) and all(r.label == int(r.depth_value >= 1) for r in new.values())
    bad = [
        frozen(ids, schema_version=2), frozen(ids, num_classes=3), frozen(ids, class_distribution=frozen(ids)["class_distribution"] | {"val": {"0": 9, "1": 0}}), frozen(ids | {"val": []}), frozen(ids | {"val": ids["val"][:-1]}), frozen(ids | {"val": [*ids["val"], "s99"]}),
        frozen(ids | {"val": [*ids["val"][:-1], ids["train"][0]]}), frozen(ids | {"val": [*ids["val"], ids["val"][0]]}), frozen(ids | {"more": []}), frozen({k: v for k, v in ids.items() if k != "val"}),
    ]
    there = sorted(p.name for p in tmp_path.iterdir())
    for m in bad:
        (tmp_path / "m.json").write_text(json.dumps(m))
        with pytest.raises(ValueError):
            datasets.freeze_dataset(spark, source, f"{tmp_path}/bad", f"{tmp_path}/m.json", SHAPE)
        assert sorted(p.name for p in tmp_path.iterdir()) == there


def test_data_sets_are_found_behind_their_base(spark, tmp_path):
    (tmp_path / "raw").mkdir()
    for name, text in (("b", '{"thresholds_mm": [0.8, 1.2], "tag": "x"}'), ("a", "{broken"), ("c", None)):
        (tmp_path / "sets" / name).mkdir(parents=True)
        if text:
            (tmp_path / "sets" / name / "label_scheme.json").write_text(text)
    found = lambda *a: [(r.data_dir, r.num_classes, r.tag) for r in files.discover(spark, *a).orderBy("place", "data_dir").collect()]
    assert found(f"{tmp_path}/sets", f"file://{tmp_path}/raw") == [("raw", 2, None), ("a", 2, None), ("b", 3, "x")]
    assert found(f"{tmp_path}/sets", f"{tmp_path}/sets/b") == [("b", 3, "x"), ("a", 2, None)]
    assert found(f"{tmp_path}/none", f"{tmp_path}/none") == [] and found(f"{tmp_path}/sets") == [("a", 2, None), ("b", 3, "x")]


def test_manifest_is_sorted_over_its_parts(spark, tmp_path):
    rows = spark.range(200).select(F.element_at(F.array(F.lit("test"), F.lit("train"), F.lit("val")), (F.col("id") % 3 + 1).cast("int")).alias("split"), (F.col("id") * 7 % 200).alias("pool_row"), F.col("id").alias("sample_id"), (F.col("id") / 3).alias("depth_value"), (F.col("id") % 2).alias("label")).repartition(6)
    datasets.write_manifest(rows, f"file://{tmp_path}/manifest.csv")
    lines = [x for f in sorted((tmp_path / "manifest.csv").glob("part-*")) for x in f.read_text().splitlines()[1:]]
    order = [(("train", "val", "test").index(x.split(",")[0]), int(x.split(",")[1])) for x in lines]
    assert order == sorted(order) and len(order) == 200 and lines[0].split(",")[3] == f"{int(lines[0].split(',')[2]) / 3:.4f}"


def test_config_hash_is_canonical(spark):
    df = spark.sql("select named_struct('b', 1, 'a', map('y', 2.0, 'x', 1.5)) s, 3 n, 3.0D d, array(1, 2) l")
    one = spark.sql("select array(1.0D, 2.0D) l, 3.0D n, 3 d, named_struct('a', map('x', 1.5D, 'y', 2), 'b', 1.0D) s")
    other = spark.sql("select array(2, 1) l, 3 n, 3 d, named_struct('a', map('x', 1.5D, 'y', 2), 'b', 1) s")
    a, b, c = (x.select(sinks.config_hash(x, *x.columns)).first()[0] for x in (df, one, other))
    assert a == b != c


def test_unknown_names_raise(spark):
    t = spark.createDataFrame([("max1, nonsense",), (" , ",)], "t string")
    for row in ("t like 'max%'", "t not like 'max%'"):
        with pytest.raises(Exception, match="frame form"):
            t.where(row).select(S.parse_forms(F.col("t"))).collect()
    with pytest.raises(Exception, match="unknown preset"):
        K.resolve_hyperparameters(spark.createDataFrame([("none", "concat", "full")], "hyperparameter_preset string, model_variant string, region_set string").withColumns({k: F.lit(None).cast(v) for k, v in K.PARAMETERS.items()})).collect()
    with pytest.raises(Exception, match="not a number"):
        E.roc_auc(spark.createDataFrame([(1, 0.5), (0, float("nan"))], "label int, p double").withColumn("g", F.lit(1)), ["g"], "p").collect()
    with pytest.raises(ValueError):
        S.learning_rate(F.lit(1), 10, 1e-3, 2e-3, 1)
    with pytest.raises(Exception, match="outside the run"):
        spark.range(1).select(S.learning_rate(F.lit(11), 10, 1e-3, 1e-4, 1)).collect()


def test_pool_problems_count_infinite_depths_and_empty_ids(spark):
    pool = spark.createDataFrame([("a", 0, 1.0), ("", 1, float("inf")), (None, 2, float("nan")), ("b", 3, None)], "sample_id string, pool_row long, depth_value double")
    got = C.pool_problems(pool).first()
    assert (got.bad_depth, got.empty_ids) == (3, 2)


def test_recorded_tags_and_names(spark):
    tags = spark.createDataFrame([("x/y!", ["1"]), (None, ["0.8", "1.2"]), (None, []), ("..", None)], "tag string, t array<string>")
    assert [r[0] for r in tags.select(S.recorded_tag(F.col("tag"), F.col("t"))).collect()] == ["x-y", "thr0.8-1.2", None, None]
    shown = spark.createDataFrame([(v,) for v in (0.8, 1e-7, 123456789.0, 2.578125, 0.0, 1.0)], "v double").select(S.general(F.col("v"))).collect()
    assert [r[0] for r in shown] == [f"{v:g}" for v in (0.8, 1e-7, 123456789.0, 2.578125, 0.0, 1.0)]


def test_moving_average_of_few_points(spark):
    got = spark.range(1).select(Sp.moving_average(F.array(F.lit(1.0), F.lit(3.0), F.lit(5.0)), 9)).first()[0]
    assert got == pytest.approx([5 / 3, 3.0, 13 / 3])  # the window is cut to three points


def test_features_that_are_not_finite_raise(spark):
    rows = spark.createDataFrame([(i, i % 2, [float(i % 2), 1.0]) for i in range(8)], "sample_id int, label int, features array<double>")
    model = M.fit(rows, 2, 2, [], 5)
    assert M.scored(model, rows).count() == 8
    with pytest.raises(Exception, match="not finite"):
        M.scored(model, rows.withColumn("features", F.array(F.lit(float("inf")), F.lit(0.0)))).collect()


def test_publish_guards(spark, tmp_path):
    df = spark.range(5)
    at = f"file://{tmp_path}/out"
    sinks.publish(df, at)
    with pytest.raises(FileExistsError):
        sinks.publish(df, at)
    with pytest.raises(ValueError):
        sinks.publish(df, f"{at}/deeper", [at])
    sinks.publish(spark.range(2), at, overwrite=True)
    assert spark.read.parquet(at).count() == 2


def test_unsound_manifest_and_scheme(spark):
    m = spark.createDataFrame([('{"schema_version":2,"num_classes":2,"thresholds_mm":[1.3],"splits":{"train":["b","a"]}}',)], "t string")
    got = [(r.sound, r.split, r.position, r.sample_id) for r in files.manifests(m, "t").collect()]
    assert got == [(False, "train", 0, "b"), (False, "train", 1, "a")]
    s = files.label_schemes(spark.createDataFrame([("{",), (None,)], "t string"), "t").collect()
    assert all(r.thresholds is None and r.tag is None for r in s)


def test_ranks_by_ranges_equal_a_sort_and_are_even(spark):
    n = 20_000
    v = np.where(rng.random(n) < 0.4, 7.0, rng.normal(size=n))
    v[:3] = 1e12, np.inf, -np.inf
    df = spark.createDataFrame([(i, "a" if i % 3 else None, float(x)) for i, x in enumerate(v)], "id long, g string, v double").repartition(3)
    got = {r.id: (r.r, r.r_of) for r in ranks.ranked(df, ["g"], [F.col("v").desc(), F.col("id")], "r").collect()}
    for g in (True, False):
        own = sorted((i for i in range(n) if bool(i % 3) == g), key=lambda i: (-v[i], i))
        assert [got[i] for i in own] == [(k, len(own)) for k in range(1, len(own) + 1)]
    alone = ranks.ranked(df, [], ["v", "id"], "r")
    assert [r.id for r in alone.orderBy("r").collect()] == sorted(range(n), key=lambda i: (v[i], i))
    ends = [f for f in alone.inputFiles()]
    sizes = [spark.read.parquet(f).count() for f in ends]
    assert max(sizes) < 2 * n / 4, sizes  # four ranges, although one value has 40 % of the rows and one is 1e12


def test_hash_ranks_in_one_group(spark):
    df = spark.range(500).withColumn("k", F.md5(F.col("id").cast("string").cast("binary")))
    got = ranks.hash_ranked(df, [], ranks.hash_bucket(F.col("k")), ["k"], "r").orderBy("r").collect()
    assert [r.r for r in got] == list(range(1, 501)) and [r.k for r in got] == sorted(r.k for r in got)


def test_hash_ranks_of_a_null_group(spark):
    """rows whose group is null are a group."""
    df = spark.range(90).select("id", F.when(F.col("id") % 3 > 0, F.col("id") % 3).alias("g"), F.md5(F.col("id").cast("string").cast("binary")).alias("k"))
    got = ranks.hash_ranked(df, ["g"], ranks.hash_bucket(F.col("k")), ["k"], "r")
    assert got.columns == ["id", "g", "k", "r"]
    for g in (None, 1, 2):
        assert [r.r for r in sorted((r for r in got.collect() if r.g == g), key=lambda r: r.k)] == list(range(1, 31))


@pytest.mark.parametrize("near", [10, 100_000])
def test_quantiles_are_exact(spark, near):
    n = 5000
    columns = {"plain": rng.normal(size=n), "hot": np.where(rng.random(n) < 0.6, 3.0, rng.normal(size=n)), "wild": np.where(np.arange(n) == 0, 1e12, rng.random(n)), "same": np.ones(n), "ends": np.where(rng.random(n) < 0.2, np.inf, -np.inf)}
    rows = list(zip(*(c.tolist() for c in columns.values()), strict=True))
    df = spark.createDataFrame([*rows, (None,) * len(columns)], ", ".join(f"{c} double" for c in columns))
    wanted = {f"{c}_{q}": (c, q) for c in columns for q in (0.0, 0.1, 0.5, 0.999, 1.0)}
    got = ranks.quantiles(df, wanted, near)
    for k, (c, q) in wanted.items():
        x = np.sort(columns[c])
        place = q * (n - 1)
        low, high = x[int(place)], x[min(int(place) + 1, n - 1)]
        assert got[k] == pytest.approx(low if low == high else low + (high - low) * (place - int(place)), rel=1e-12), k
    odd = spark.createDataFrame([(1.0, None), (float("nan"), None)], "a double, b double")
    got = ranks.quantiles(odd, {"a": ("a", 0.0), "top": ("a", 1.0), "b": ("b", 0.5)})
    assert got["a"] == 1 and math.isnan(got["top"]) and got["b"] is None


def test_summaries_put_what_is_no_finite_number_last(spark):
    values = ["2", "NaN", "abc", "-1", "inf", None, "10", "-Infinity", "2"]
    df = spark.createDataFrame(list(enumerate(values)), "id int, v string")
    order = lambda down, **k: [r.id for r in K.sort_place(df, "v", down, "id", **k).orderBy("place").collect()]
    assert order(False) == [3, 0, 8, 6, 1, 2, 4, 5, 7] and order(True) == [6, 0, 8, 3, 1, 2, 4, 5, 7]
    assert order(False, text=True) == sorted(range(9), key=lambda i: (values[i] is None, (values[i] or "").lower(), i))


def test_images_of_one_label(spark):
    e = spark.createDataFrame([(f"r{i:03d}", "one" if i < 90 else f"l{i}") for i in range(100)], "name string, label string")
    got = K.with_images(e, e.select(F.concat("name", F.lit(".png")).alias("file")).where("name <> 'r005'"), F.concat("name", F.lit(".png"))).orderBy("name").collect()
    assert [r.shown for r in got] == [f"one ({i + 1 - (i > 5)})" for i in range(90) if i != 5] + [f"l{i}" for i in range(90, 100)]


def branch_rows(spark, bad=False):
    rows = [(s, c, r, name, 4 * r, 4 * r + 8, 8, 0, k, [float(100 * r + 10 * c + k + s / 10 + p) for p in range(8)]) for s in (1, 2) for r, name in enumerate((B.MAIN, B.TAIL, "0-5mm")) for c in (0, 1) for k in (0, 1)]
    if bad:
        rows[5][-1][3] = float("nan")
    return spark.createDataFrame(rows, "sample_id int, channel int, region_idx int, name string, start int, end int, input_len int, pad int, stream int, signal array<double>").repartition(5)


def test_tensors_are_in_order_and_stop_at_values_that_are_not_finite(spark):
    got = {r.sample_id: r for r in B.tensors(branch_rows(spark), 2, "double").collect()}
    for s, r in got.items():
        assert r.names == [f"region{i}_{n}_ch{c}" for i, n in enumerate(("dynamic_main_window", "dynamic_tail_window", "0-5mm")) for c in (1, 2)]
        assert np.allclose(np.array(r.inputs), [[[100 * i + 10 * c + k + s / 10 + p for p in range(8)] for k in (0, 1)] for i in range(3) for c in (0, 1)])
        assert [a.start for a in r.audit] == [0, 0, 4, 4, 8, 8]
    with pytest.raises(Exception, match="non-finite input for 1"):
        B.tensors(branch_rows(spark, True), 2).collect()


def test_fixed_regions_stand_beside_the_dynamic_ones(spark):
    c = Sp.Detector(4, 0.3, 5, 8, 16, 0.5, 3, 2, 0.05, 16, 2, 3, 24, 32, 64, 3)
    spans = spark.createDataFrame([(1, 0, 5, 29, "ok", 29, 61, 0), (1, 1, 9, 33, "ok", 33, 64, 1), (2, 0, 45, 69, "overflow", 69, 64, 37), (2, 1, 5, 29, "ok", 29, 61, 0)], "sample_id int, channel int, start int, end int, status string, tail_start int, tail_end int, tail_pad int")
    regions = spark.createDataFrame([(0, "0-5mm", 0.0, 5.0), (1, "bone", 1.0, 3.0)], "region_idx int, name string, start_mm double, end_mm double")
    got = B.bounds(spans, c, regions, 5.0, 64).orderBy("region_idx", "channel").collect()
    assert [(r.region_idx, r.name, r.channel, r.start, r.end, r.input_len, r.pad) for r in got] == [
        (0, B.MAIN, 0, 5, 29, 24, 0), (0, B.MAIN, 1, 9, 33, 24, 0), (1, B.TAIL, 0, 29, 61, 32, 0), (1, B.TAIL, 1, 33, 64, 32, 1),
        (2, "0-5mm", 0, 0, 64, 64, 0), (2, "0-5mm", 1, 0, 64, 64, 0), (3, "bone", 0, 13, 38, 25, 0), (3, "bone", 1, 13, 38, 25, 0),
    ]
    assert {r.sample_id for r in got} == {1} and B.bounds(spans, c).count() == 4


def plain_stats(x, spacing):
    power = np.abs(np.fft.rfft(x)) ** 2
    return [x.mean(), x.std(), np.sqrt((x * x).mean()), (x * x).mean(), np.abs(x).mean(), np.abs(x).max(), (x[:-1] * x[1:] < 0).sum() / (len(x) - 1), (np.fft.rfftfreq(len(x), spacing) * power).sum() / (power.sum() + 1e-12)]


def test_features_and_curves_of_components_equal_a_plain_version(spark):
    x = {(s, c, r): np.cumsum(rng.normal(size=40)) for s in (1, 2, 3) for c in (0, 1) for r in (0, 1)}
    x[1, 0, 0] = np.zeros(40)
    rows = [(s, c, r, f"b{r}", 0.5 + r, v.tolist()) for (s, c, r), v in x.items()]
    branches = spark.createDataFrame(rows, "sample_id int, channel int, region_idx int, name string, spacing_mm double, signal array<double>")
    key = ["sample_id", "channel", "region_idx", "name"]
    got = Fe.vectors(Fe.long_features(Fe.pooled(Fe.components(branches), key, 1, spacing="spacing_mm"), key)).collect()
    plain = {}
    for k, v in x.items():
        modes, rest = sifted(v)
        plain[k] = np.array([*modes, *[np.zeros(40)] * (5 - len(modes)), rest])
    for r in got:
        want, names = [], []
        for c in (0, 1):
            for b in (0, 1):
                modes, rest = sifted(x[r.sample_id, c, b])
                want += (np.array([plain_stats(m, 0.5 + b) for m in [*modes, rest]]).sum(0) / 6).tolist()
                names += [f"b{b}[ch{c + 1}].{stat}" for stat in G.STATS]
        assert r.names == names and np.allclose(r.features, want, atol=1e-9)
    curves = Fe.component_curves(branches, key).collect()
    top = {(c, r, k): max(abs(plain[s, c, r][k]).max() for s in (1, 2, 3)) for c in (0, 1) for r in (0, 1) for k in range(6)}
    assert len(curves) == 12 * 6 * 40
    for r in curves:
        assert r.value == pytest.approx(plain[r.sample_id, r.channel, r.region_idx][r.component][r.pos], abs=1e-9) and r.mm == pytest.approx(r.pos * (0.5 + r.region_idx))
        t = top[r.channel, r.region_idx, r.component]
        assert r.limit == pytest.approx(1.0 if t < 1e-8 else 1.1 * t) and r.is_residue == (r.component == 5)


def labelled_vectors(spark, n=240):
    x = rng.normal(size=(n, 6))
    label = (x[:, 0] + x[:, 3] > 0).astype(int)
    rows = [(i, int(label[i]), ("train", "val", "test")[i % 3], x[i].tolist(), [x[i, :3].tolist(), x[i, 3:].tolist()]) for i in range(n)]
    return spark.createDataFrame(rows, "sample_id int, label int, split string, features array<double>, branches array<array<double>>").repartition(3)


def test_one_classifier_over_all_features(spark):
    got = M.concatenated(labelled_vectors(spark), 6, 2, [4], 40).collect()
    assert len(got) == 240 and all(sum(r.probs) == pytest.approx(1) for r in got)
    assert np.mean([(r.probs[1] > 0.5) == r.label for r in got if r.split != "train"]) > 0.9


def test_votes_of_branches_equal_separate_models_in_one_scan(spark):
    rows = labelled_vectors(spark)
    models = M.branch_models(rows, 2, 3, 2, [3], 15)
    out = M.branch_scored(models, rows)
    got = {r.sample_id: r for r in out.collect()}
    for b, model in enumerate(models):
        for r in M.scored(model, rows.withColumn("features", F.get("branches", F.lit(b)))).collect():
            assert got[r.sample_id].branch_probs[b] == pytest.approx(r.probs)
    for r in got.values():
        assert r.vote_sum == pytest.approx(np.sum(r.branch_probs, axis=0)) and r.vote_mean == pytest.approx(np.mean(r.branch_probs, axis=0))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") == 1 and "Join" not in plan and "Union" not in plan
    table = {(r.split, r.branch): r for r in M.batch_losses(out, ["split"]).collect()}
    for split in ("train", "val", "test"):
        own = [r for r in got.values() if r.split == split]
        for b in (0, 1, None):
            p = np.array([r.vote_mean if b is None else r.branch_probs[b] for r in own])
            y = np.array([r.label for r in own])
            assert table[split, b].val_loss == pytest.approx(-np.log(np.maximum(p[range(len(y)), y], 1e-12)).mean()) and table[split, b].val_accuracy == pytest.approx((p.argmax(1) == y).mean())
    for bad, word in ((F.array(F.get("branches", F.lit(0))), "without 2 branches"), (F.transform("branches", lambda x: F.transform(x, lambda v: v / 0.0 if False else F.lit(float("nan")))), "not finite")):
        with pytest.raises(Exception, match=word):
            M.branch_scored(models, rows.withColumn("branches", bad)).collect()
    voted = {r.sample_id: r.vote_mean for r in M.voting(rows, 2, 3, 2, [3], 15).collect()}
    assert all(voted[i] == pytest.approx(r.vote_mean) for i, r in got.items())


def test_a_sweep_goes_on_where_it_was_and_leaves_the_test_split_alone(spark, tmp_path, monkeypatch):
    rows = labelled_vectors(spark)
    sealed = rows.withColumn("features", F.when(F.col("split") == "test", F.raise_error(F.lit("test was read")).cast("array<double>")).otherwise(F.col("features")))
    grid = [{"id": "b", "hidden": [4], "rounds": 10}, {"id": "a", "hidden": [4], "rounds": 10}, {"id": "c", "hidden": [2], "rounds": 1}]
    runs, fits, whole = M.Runs(spark, f"file://{tmp_path}/runs"), [], M.fit
    monkeypatch.setattr(M, "fit", lambda *a: (fits.append(a[3]), whole(*a))[1])
    M.sweep(sealed, grid[2:], 6, 2, runs)
    board, winner = M.sweep(sealed, grid, 6, 2, runs)
    assert sorted(fits) == [[2], [4]] and winner["id"] == "a"  # equal settings are fitted once; ties go to the smaller id
    assert {r.id: r.reused for r in board.collect()} == {"a": False, "b": False, "c": True}
    again, same = M.sweep(sealed, grid, 6, 2, runs)
    assert len(fits) == 2 and same == winner and again.where("not reused").isEmpty()
    assert [(r.id, r.place) for r in again.orderBy("place").collect()] == [("a", 1), ("b", 2), ("c", 3)]
    with pytest.raises(Exception, match="test was read"):
        M.evaluated(sealed, winner, runs).collect()
    got = M.evaluated(rows, winner, runs).first()
    p = M.scored(runs.model(runs.key(winner, "")), rows.where("split = 'test'")).collect()
    fn = sum(r.label == 1 and r.probs[1] <= r.probs[0] for r in p)
    assert got.fn == fn and got.fn + got.tp == sum(r.label for r in p) and got.stop == (fn > 0.4 * (got.fn + got.tp))
    with pytest.raises(Exception, match="no positive label"):
        M.evaluated(rows.where("label = 0"), winner, runs).collect()
    M.sweep(sealed, grid[:1], 6, 2, runs, "other inputs")
    assert len(fits) == 3


def test_tasks_follow_each_other_until_the_gate(spark, tmp_path):
    rows, grid = labelled_vectors(spark), [{"id": "a", "hidden": [4], "rounds": 10}, {"id": "b", "hidden": [2], "rounds": 1}]
    half = rows.withColumn("features", F.slice("features", 1, 3))
    tasks = [
        {"name": "1", "rows": half, "inputs": 3, "profile": "half", "candidates": grid, "gate": True}, {"name": "2", "rows": rows, "inputs": 6, "profile": "whole", "like": "1"},
        {"name": "3", "rows": rows, "inputs": 6, "profile": "whole", "candidates": grid},
    ]
    got = M.chained(tasks, M.Runs(spark, str(tmp_path)), 2, limit=1.0).orderBy("task").collect()
    assert [r.task for r in got] == ["1", "2", "3"] and [r.fitted for r in got] == [2, 1, 1] and got[0].winner == got[1].winner
    assert [r.task for r in M.chained(tasks, M.Runs(spark, str(tmp_path)), 2, limit=-1.0).collect()] == ["1"]


def test_labels_meet_their_probabilities_or_raise(spark):
    labels = spark.createDataFrame([(1, 0), (2, 1), (3, 1)], "sample_id int, label int")
    rows = [(3, [0.2, 0.8]), (1, [0.6, 0.4]), (2, [0.5, 0.5])]
    table = lambda rows: spark.createDataFrame(rows, "sample_id int, probs array<double>")
    assert sorted((r.sample_id, r.label, r.probs[1]) for r in sinks.labelled_probs(labels, table(rows)).collect()) == [(1, 0, 0.4), (2, 1, 0.5), (3, 1, 0.8)]
    for bad in (rows[:2], [*rows, (4, [1.0, 0.0])], [*rows, rows[0]], [*rows[:2], (2, [1.0])], [*rows[:2], (None, [0.5, 0.5])]):
        with pytest.raises(ValueError, match="do not match"):
            sinks.labelled_probs(labels, table(bad))
