"""Branch, decomposition and feature queries."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions import signals as G
from ..operators import branches as B
from ..operators import curation as C
from ..operators import features as Fe
from ..operators import frames as Fr
from .registry import register
from .trace_queries import DET, SPAN, located, spans
from .views import history, pool, samples, scans, sql, table

R = lambda c, n=6: F.round(c, n)
MM = 5.0
STAT_LIST = ", ".join(G.STATS)


def exploded(df, key, column="signal", name="value"):
    return df.select(*key, F.posexplode(column).alias("pos", "_v")).select(*key, "pos", R("_v").alias(name))


KEY = ["sample_id", "frame", "channel"]
register("depth_to_index", lambda s, d: pool(s, d).select("sample_id", *(S.depth_to_index(F.col("depth_value"), MM, 896, h).alias(h) for h in ("half_up", "floor", "ceil")), S.index_to_depth(S.depth_to_index(F.col("depth_value"), MM, 896, "floor"), MM, 896).alias("back")),
         sql("WITH x AS (SELECT sample_id, depth_value / 5.0 * 896 AS x FROM pool) SELECT sample_id, CAST(least(greatest(floor(x + 0.5), 0), 896) AS BIGINT) AS half_up, CAST(least(greatest(floor(x), 0), 896) AS BIGINT) AS floor, CAST(least(greatest(ceil(x), 0), 896) AS BIGINT) AS ceil, least(greatest(floor(x), 0), 896) * CAST(5.0 AS DOUBLE) / 896 AS back FROM x", "pool"))


def region_texts(s, d):
    """JSON region lists out of part sizes, as pairs or as objects; some regions are empty or leave the range."""
    a, z = F.format_string("%.1f", F.col("p_size") / 10), F.format_string("%.1f", (F.col("p_partkey") % 60) / 10)
    pairs = F.concat(F.lit("[[0.0,1.5],["), a, F.lit(","), z, F.lit("]]"))
    objects = F.concat(F.lit('[{"start_mm":0.0,"end_mm":1.5,"name":"near"},{"start_mm":'), a, F.lit(',"end_mm":'), z, F.lit("}]"))
    return table(s, d, "part").select("p_partkey", F.when(F.col("p_partkey") % 2 == 0, pairs).otherwise(objects).alias("regions"))


G_ = "printf('%g', CAST({0} AS DOUBLE))"
REG = f"""rg AS (SELECT p_partkey, 0 AS region_idx, CASE WHEN p_partkey % 2 = 0 THEN '0-1.5mm' ELSE 'near' END AS name, CAST(0.0 AS DOUBLE) AS start_mm, CAST(1.5 AS DOUBLE) AS end_mm FROM part
 UNION ALL SELECT p_partkey, 1, {G_.format('CAST(p_size AS DOUBLE) / 10')} || '-' || {G_.format('CAST(p_partkey % 60 AS DOUBLE) / 10')} || 'mm', CAST(p_size AS DOUBLE) / 10, CAST(p_partkey % 60 AS DOUBLE) / 10 FROM part)"""
register("parse_regions", lambda s, d: B.parse_regions(region_texts(s, d), "regions", MM).drop("regions"), f"WITH {REG} SELECT p_partkey, CAST(region_idx AS INTEGER) AS region_idx, name, start_mm, end_mm, start_mm >= 0 AND start_mm < end_mm AND end_mm <= 5.0 AS valid FROM rg")
register("slice_bounds", lambda s, d: B.slice_bounds(B.parse_regions(region_texts(s, d), "regions", MM).where("valid"), MM, 896).select("p_partkey", "region_idx", "start", "end"),
         f'WITH {REG} SELECT p_partkey, CAST(region_idx AS INTEGER) AS region_idx, CAST(floor(start_mm / 5.0 * 896 + 0.5) AS BIGINT) AS start, CAST(floor(end_mm / 5.0 * 896 + 0.5) AS BIGINT) AS "end" FROM rg WHERE start_mm >= 0 AND start_mm < end_mm AND end_mm <= 5.0')


SETS = ("all", "full", "bone", "bone_plus_post", "dyn_envelope", "dyn_envelope_full")


def _presets(s, d):
    """The run grid: each frame form with the runs of each part's region set, or of its own regions."""
    own = region_texts(s, d).select("p_partkey", F.when(F.col("p_partkey") % 7 == 3, F.col("regions")).alias("own"), F.element_at(F.array(*(F.lit(x) for x in SETS)), (F.col("p_partkey") % 6 + 1).cast("int")).alias("region_set"))
    runs = B.region_experiments(own, "region_set", "own", MM)
    grid = runs.select("p_partkey", "name", F.size("regions").alias("n_regions"), F.get("regions", F.lit(0))["start_mm"].alias("first_mm"), F.get("regions", F.size("regions") - 1)["end_mm"].alias("last_mm"))
    return grid.withColumn("form", F.explode(F.array(*(F.lit(f) for f in S.FORMS))))


register("region_presets", _presets, f"""WITH {REG}, p(name, n_regions, first_mm, last_mm) AS (VALUES ('full', 1, CAST(0.0 AS DOUBLE), CAST(5.0 AS DOUBLE)), ('bone', 1, 1.0, 3.0), ('bone_plus_post', 2, 0.2, 5.0), ('dyn_envelope', 0, NULL, NULL), ('dyn_envelope_full', 1, 0.0, 5.0)),
 a AS (SELECT p_partkey, ['all', 'full', 'bone', 'bone_plus_post', 'dyn_envelope', 'dyn_envelope_full'][p_partkey % 6 + 1] AS region_set FROM part WHERE p_partkey % 7 <> 3),
 r AS (SELECT p_partkey, name, n_regions, first_mm, last_mm FROM a JOIN p ON name = region_set OR region_set = 'all' AND name <> 'dyn_envelope_full' UNION ALL SELECT p_partkey, 'custom', 2, min(start_mm) FILTER (region_idx = 0), min(end_mm) FILTER (region_idx = 1) FROM rg WHERE p_partkey % 7 = 3 GROUP BY 1)
 SELECT p_partkey, name, n_regions, first_mm, last_mm, form FROM r, (VALUES ('mean_std'), ('raw50'), ('max1'), ('top3_mean')) AS f(form)""")  # fmt: skip


def form_texts(s, d):
    """Lists of two spellings each, some with an unknown name, some empty, some `all`."""
    k = F.col("p_partkey")
    spelling = lambda i: F.element_at(F.array(*(F.lit(x) for x in S.FORM_ALIASES)), (i % 12 + 1).cast("int"))
    two = F.concat(F.lit(" "), F.upper(F.replace(spelling(k), F.lit("_"), F.lit(" "))), F.lit(" ,"), spelling(F.floor(k / 12)))
    return table(s, d, "part").select("p_partkey", F.when(k % 11 == 0, " ALL ").when(k % 13 == 0, " , ").when(k % 17 == 0, F.concat(two, F.lit(",nonsense"))).otherwise(two).alias("t"))


def _forms(s, d):
    """Forms of sound lists, and what others raise for."""
    t = form_texts(s, d).withColumn("problem", S.forms_problem(F.col("t")))
    return t.select("p_partkey", "problem", F.when(F.col("problem").isNull(), F.array_join(S.parse_forms(F.col("t")), ",")).alias("forms"))


register("parse_forms", _forms, """WITH al(i, form) AS (VALUES (0, 'mean_std'), (1, 'mean_std'), (2, 'mean_std'), (3, 'raw50'), (4, 'raw50'), (5, 'raw50'), (6, 'max1'), (7, 'max1'), (8, 'max1'), (9, 'top3_mean'), (10, 'top3_mean'), (11, 'top3_mean')),
 t AS (SELECT p_partkey, [a.form, b.form] AS f, CASE WHEN p_partkey % 11 = 0 THEN NULL WHEN p_partkey % 13 = 0 THEN 'empty' WHEN p_partkey % 17 = 0 THEN 'unknown' END AS problem FROM part JOIN al a ON a.i = p_partkey % 12 JOIN al b ON b.i = (p_partkey // 12) % 12)
 SELECT p_partkey, problem, CASE WHEN problem IS NOT NULL THEN NULL WHEN p_partkey % 11 = 0 THEN 'mean_std,raw50,max1,top3_mean' ELSE array_to_string(list_filter(['mean_std', 'raw50', 'max1', 'top3_mean'], lambda x: list_contains(f, x)), ',') END AS forms FROM t""")  # fmt: skip

TUKEY = "CASE WHEN pos < 0.15 * 63 THEN 0.5 * (1 + cos(pi() / 0.15 * (pos / 63.0 - 0.15))) WHEN pos > 63 - 0.15 * 63 THEN 0.5 * (1 + cos(pi() / 0.15 * ((63 - pos) / 63.0 - 0.15))) ELSE 1 END"
register("tukey_window", lambda s, d: exploded(scans(s, d).withColumn("signal", S.tapered(F.col("signal"), 64)), KEY), sql(f"SELECT sample_id, frame, channel, CAST(pos AS INTEGER) AS pos, round(value * {TUKEY}, 6) AS value FROM traces", "traces"))
register("resample_linear", lambda s, d: exploded(scans(s, d).withColumn("signal", G.resample_linear(F.col("signal"), 48)), KEY), sql("""WITH k AS (SELECT k, k * 63 / 47.0 AS x, least(CAST(floor(k * 63 / 47.0) AS BIGINT), 62) AS i FROM range(48) AS t(k))
 SELECT a.sample_id, a.frame, a.channel, CAST(k AS INTEGER) AS pos, round(a.value + (x - i) * (b.value - a.value), 6) AS value FROM k JOIN traces a ON a.pos = i JOIN traces b ON b.pos = i + 1 AND a.sample_id = b.sample_id AND a.frame = b.frame AND a.channel = b.channel""", "traces"))  # fmt: skip


def spline_table(n: int, target: int) -> str:
    """SQL rows (k, i, w): the share w of point i of n in point k of a not-a-knot spline at `target` places.

    Solved here for the second derivatives of all unit signals at once, apart from the library's own weights."""
    system, right = np.zeros((n, n)), np.zeros((n, n))
    for i in range(1, n - 1):
        system[i, i - 1 : i + 2], right[i, i - 1 : i + 2] = (1, 4, 1), (6, -12, 6)
    system[0, :3] = system[-1, -3:] = (1, -2, 1)
    second = np.linalg.solve(system, right)
    rows = []
    for k in range(target):
        x = k * (n - 1) / (target - 1)
        i = min(int(x), n - 2)
        t, u = x - i, 1 - x + i
        w = (u**3 - u) / 6 * second[i] + (t**3 - t) / 6 * second[i + 1]
        w[i] += u
        w[i + 1] += t
        rows += [f"({k},{j},{v:.15g})" for j, v in enumerate(w) if abs(v) > 1e-13]
    return f"(SELECT k, i, CAST(w AS DOUBLE) AS w FROM (VALUES {','.join(rows)}) AS v(k, i, w))"


register("resample_cubic", lambda s, d: exploded(scans(s, d).withColumn("signal", G.resample_cubic(F.col("signal"), 48)), KEY), sql(f"SELECT sample_id, frame, channel, CAST(k AS INTEGER) AS pos, round(sum(value * w), 6) AS value FROM traces JOIN {spline_table(64, 48)} ON i = pos GROUP BY ALL", "traces"))

EX = """lg AS (SELECT *, lag(value) OVER w AS l, lead(value) OVER w AS r FROM traces WINDOW w AS (PARTITION BY sample_id, frame, channel ORDER BY pos)),
 xt AS (SELECT *, coalesce(value > l AND value >= r, false) AS up, coalesce(value < l AND value <= r, false) AS dn FROM lg)"""
ENV = EX + """, kn AS (SELECT *, count(*) FILTER (up) OVER g AS nu, count(*) FILTER (dn) OVER g AS nd, avg(value) OVER g AS mn, CASE WHEN up OR pos IN (0, 63) THEN pos END AS ku, CASE WHEN dn OR pos IN (0, 63) THEN pos END AS kd FROM xt WINDOW g AS (PARTITION BY sample_id, frame, channel)),
 nb AS (SELECT *, max(ku) OVER b AS u0, min(ku) OVER f AS u1, max(kd) OVER b AS d0, min(kd) OVER f AS d1 FROM kn WINDOW b AS (PARTITION BY sample_id, frame, channel ORDER BY pos ROWS UNBOUNDED PRECEDING), f AS (PARTITION BY sample_id, frame, channel ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
 ev AS (SELECT n.sample_id, n.frame, n.channel, n.pos, n.value, CASE WHEN nu = 0 THEN mn ELSE a.value + (b.value - a.value) * (n.pos - u0) / greatest(u1 - u0, 1) END AS upper, CASE WHEN nd = 0 THEN mn ELSE c.value + (e.value - c.value) * (n.pos - d0) / greatest(d1 - d0, 1) END AS lower
 FROM nb n JOIN traces a ON (a.sample_id, a.frame, a.channel, a.pos) = (n.sample_id, n.frame, n.channel, u0) JOIN traces b ON (b.sample_id, b.frame, b.channel, b.pos) = (n.sample_id, n.frame, n.channel, u1)
 JOIN traces c ON (c.sample_id, c.frame, c.channel, c.pos) = (n.sample_id, n.frame, n.channel, d0) JOIN traces e ON (e.sample_id, e.frame, e.channel, e.pos) = (n.sample_id, n.frame, n.channel, d1))"""
register("local_extrema", lambda s, d: scans(s, d).withColumn("x", G.local_extrema(F.col("signal"))).select(*KEY, F.array_join("x.maxima", ",").alias("maxima"), F.array_join("x.minima", ",").alias("minima")), sql(f"WITH {EX} SELECT sample_id, frame, channel, coalesce(string_agg(CAST(pos AS VARCHAR), ',' ORDER BY pos) FILTER (up), '') AS maxima, coalesce(string_agg(CAST(pos AS VARCHAR), ',' ORDER BY pos) FILTER (dn), '') AS minima FROM xt GROUP BY ALL", "traces"))
register("linear_envelope", lambda s, d: scans(s, d).select(*KEY, F.posexplode(F.arrays_zip(G.linear_envelope(F.col("signal")).alias("u"), G.linear_envelope(F.col("signal"), False).alias("l"))).alias("pos", "e")).select(*KEY, "pos", R("e.u").alias("upper"), R("e.l").alias("lower")), sql(f"WITH {ENV} SELECT sample_id, frame, channel, CAST(pos AS INTEGER) AS pos, round(upper, 6) AS upper, round(lower, 6) AS lower FROM ev", "traces"))
register("zero_crossings", lambda s, d: scans(s, d).select(*KEY, G.zero_crossings(F.col("signal")).cast("long").alias("n")), sql(f"WITH {EX} SELECT sample_id, frame, channel, count(*) FILTER (value * r < 0) AS n FROM xt GROUP BY ALL", "traces"))
register("sift_once", lambda s, d: scans(s, d).withColumn("x", G.sift_once(F.col("signal"))).select(*KEY, R("x.sd").alias("sd"), "x.n_extrema", "x.n_crossings"), sql(f"""WITH {ENV}, cd AS (SELECT *, value - (upper + lower) / 2 AS c FROM ev), c2 AS (SELECT *, lag(c) OVER w AS cl, lead(c) OVER w AS cr FROM cd WINDOW w AS (PARTITION BY sample_id, frame, channel ORDER BY pos))
 SELECT sample_id, frame, channel, round(sum(c * c) / (sum(value * value) + 1e-12), 6) AS sd, count(*) FILTER ((c > cl AND c >= cr) OR (c < cl AND c <= cr)) AS n_extrema, count(*) FILTER (c * cr < 0) AS n_crossings FROM c2 GROUP BY ALL""", "traces"))  # fmt: skip
register("emd_decompose", lambda s, d: Fe.components(scans(s, d)).select(*KEY, "component", "is_residue", "n_modes", R(F.aggregate("signal", F.lit(0.0), lambda a, x: a + x * x)).alias("energy")))
STATS7 = "avg(value) AS mean, stddev_pop(value) AS std, sqrt(avg(value * value)) AS rms, avg(value * value) AS energy, avg(abs(value)) AS abs_mean, max(abs(value)) AS peak_abs, count(*) FILTER (value * r < 0) / 63 AS zero_crossing_rate"
CST = EX + f""", s7 AS (SELECT sample_id, frame, channel, {STATS7} FROM xt GROUP BY ALL), ft AS (SELECT sample_id, frame, channel, f, sum(value * cos(2 * pi() * f * pos / 64)) AS re, sum(value * sin(2 * pi() * f * pos / 64)) AS im FROM traces, range(33) AS t(f) GROUP BY ALL),
 ce AS (SELECT sample_id, frame, channel, sum(f / 64.0 * (re * re + im * im)) / (sum(re * re + im * im) + 1e-12) AS spectral_centroid FROM ft GROUP BY ALL), st AS (SELECT * FROM s7 JOIN ce USING (sample_id, frame, channel))"""
ROUNDED = ", ".join(f"round({k}, 6) AS {k}" for k in G.STATS)
register("component_stats", lambda s, d: scans(s, d).withColumn("x", G.component_stats(F.col("signal"))).select(*KEY, *(R(f"x.{k}").alias(k) for k in G.STATS)), sql(f"WITH {CST} SELECT sample_id, frame, channel, {ROUNDED} FROM st", "traces"))


def _pool_table(s, d):
    """The ten frames of each channel stand for components, so two of twelve slots are absent."""
    return Fe.pooled(scans(s, d), ["sample_id", "channel"], 1, 11)


POOL = CST + ", po AS (SELECT sample_id, channel, " + ", ".join(f"sum({k}) / 12 AS {k}" for k in G.STATS) + " FROM st GROUP BY ALL)"
LONG = POOL + ", lo AS (SELECT sample_id, channel, stat_idx, stat, value FROM (" + " UNION ALL ".join(f"SELECT sample_id, channel, {i} AS stat_idx, '{k}' AS stat, {k} AS value FROM po" for i, k in enumerate(G.STATS)) + "))"
SCALE = LONG + ", ms AS (SELECT channel, stat, avg(value) AS mean, stddev_pop(value) AS std FROM lo WHERE sample_id % 5 < 3 GROUP BY ALL), sc AS (SELECT channel, stat, mean, std <= 1e-8 + 1e-6 * abs(mean) AS degenerate, CASE WHEN std <= 1e-8 + 1e-6 * abs(mean) THEN 1.0 ELSE std END AS scale FROM ms)"


def longs(s, d):
    return Fe.long_features(_pool_table(s, d), ["sample_id", "channel"])


def fitted(s, d):
    return Fe.scaler(longs(s, d).where("sample_id % 5 < 3"), ["channel", "stat"])


register("feature_pool", lambda s, d: _pool_table(s, d).select("sample_id", "channel", *(R(k).alias(k) for k in G.STATS)), sql(f"WITH {POOL} SELECT sample_id, channel, {ROUNDED} FROM po", "traces"))
register("feature_vector", lambda s, d: Fe.vectors(longs(s, d).withColumn("region_idx", F.lit(0)).withColumn("name", F.lit("all"))).select("sample_id", F.array_join("names", "|").alias("names"), F.size("features").alias("n"), R(F.aggregate("features", F.lit(0.0), lambda a, x: a + x)).alias("total")),
         sql(f"WITH {LONG} SELECT sample_id, string_agg('all[ch' || (channel + 1) || '].' || stat, '|' ORDER BY channel, stat_idx) AS names, CAST(count(*) AS INTEGER) AS n, round(sum(value), 6) AS total FROM lo GROUP BY 1", "traces"))
register("scaler_fit", lambda s, d: fitted(s, d).select("channel", "stat", R("mean").alias("mean"), R("scale").alias("scale"), "degenerate"), sql(f"WITH {SCALE} SELECT channel, stat, round(mean, 6) AS mean, round(scale, 6) AS scale, degenerate FROM sc", "traces"))
register("scaler_apply", lambda s, d: Fe.scaled(longs(s, d), fitted(s, d), ["channel", "stat"]).select("sample_id", "channel", "stat", R("value", 5).alias("value")), sql(f"WITH {SCALE} SELECT sample_id, lo.channel, lo.stat, round(CASE WHEN degenerate THEN 0 ELSE (value - mean) / scale END, 5) AS value FROM lo JOIN sc USING (channel, stat)", "traces"))
register("component_limits", lambda s, d: B.component_limits(scans(s, d), ["frame"]), sql("SELECT frame, CASE WHEN max(abs(value)) < 1e-8 THEN 1.0 ELSE max(abs(value)) * CAST(1.1 AS DOUBLE) END AS \"limit\" FROM traces GROUP BY 1", "traces"))

# Whole pipelines.
LP = SPAN + """, lp AS (SELECT t.sample_id, t.channel, t.frame, row_number() OVER (PARTITION BY t.sample_id, t.channel ORDER BY max(abs(value)) DESC, t.frame) AS r FROM traces t JOIN lo USING (sample_id, channel) WHERE pos >= start AND pos < "end" GROUP BY t.sample_id, t.channel, t.frame),
 pr AS (SELECT t.sample_id, t.channel, pos, avg(value) AS value FROM traces t JOIN lp USING (sample_id, channel, frame) WHERE r <= 3 GROUP BY ALL)"""


def frames3(s, d, at=None):
    at = spans(s, d) if at is None else at
    return Fr.prepared(scans(s, d), at.select("sample_id", "channel", "start", "end"), "top3_mean", 3)


register("prepare_frames", lambda s, d: exploded(frames3(s, d), ["sample_id", "channel", "stream"]), sql(f"WITH {LP} SELECT sample_id, channel, 0 AS stream, CAST(pos AS INTEGER) AS pos, round(value, 6) AS value FROM pr", "traces"))


def region_rows(s):
    return s.createDataFrame([(0, "full", 0.0, 5.0), (1, "bone", 1.0, 3.0)], "region_idx int, name string, start_mm double, end_mm double")


def whole(s, d):
    return B.fixed(Fr.prepared(scans(s, d), None, "mean_std", 3), region_rows(s), MM, 64, 64)


def tukey(n: int, place: str) -> str:
    return f"CASE WHEN {place} < 0.15 * {n - 1} THEN 0.5 * (1 + cos(pi() / 0.15 * ({place} / {n - 1}.0 - 0.15))) WHEN {place} > {n - 1} - 0.15 * {n - 1} THEN 0.5 * (1 + cos(pi() / 0.15 * (({n - 1} - {place}) / {n - 1}.0 - 0.15))) ELSE 1 END"


register("prepare_fixed", lambda s, d: exploded(whole(s, d), ["sample_id", "channel", "name", "stream"]), sql(f"""WITH m AS (SELECT sample_id, channel, pos, avg(value) AS a, stddev_pop(value) AS b FROM traces GROUP BY ALL), st AS (SELECT sample_id, channel, k AS stream, pos, CASE WHEN k = 0 THEN a ELSE b END AS value FROM m, range(2) AS t(k)),
 rs AS (SELECT 'full' AS name, sample_id, channel, stream, pos AS k, value FROM st UNION ALL SELECT 'bone', sample_id, channel, stream, k, sum(value * w) FROM st JOIN {spline_table(25, 64)} ON i = pos - 13 WHERE pos >= 13 AND pos < 38 GROUP BY ALL)
 SELECT sample_id, channel, name, CAST(stream AS INTEGER) AS stream, CAST(k AS INTEGER) AS pos, round(value * {tukey(64, 'k')}, 6) AS value FROM rs""", "traces"))  # fmt: skip


def main_tail(s, d, target=24, alpha=0.0):
    at = located(s, d)
    return B.dynamic(frames3(s, d, at), at, DET, target, alpha)


TWO = SPAN + """, br AS (SELECT sample_id, channel, 0 AS region_idx, 'dynamic_main_window' AS name, start, "end", 24 AS input_len, 0 AS pad FROM lo UNION ALL SELECT sample_id, channel, 1, 'dynamic_tail_window', "end", least("end" + 32, 64), 32, 32 - (least("end" + 32, 64) - "end") FROM lo), bo AS (SELECT * FROM br WHERE sample_id NOT IN (SELECT sample_id FROM lo WHERE "end" > 64))"""
register("prepare_dynamic", lambda s, d: exploded(main_tail(s, d, 24, 0.3), ["sample_id", "channel", "name"]), sql(f"""WITH {LP}{TWO[len(SPAN):]}, cu AS (SELECT p.sample_id, p.channel, name, pos - start AS i, value FROM pr p JOIN bo USING (sample_id, channel) WHERE pos >= start AND pos < "end"),
 rs AS (SELECT sample_id, channel, name, i AS k, value FROM cu WHERE name = 'dynamic_main_window' UNION ALL SELECT b.sample_id, b.channel, 'dynamic_tail_window', k, coalesce(sum(value * w), 0) FROM bo b CROSS JOIN {spline_table(32, 24)} v LEFT JOIN cu ON cu.sample_id = b.sample_id AND cu.channel = b.channel AND cu.name = 'dynamic_tail_window' AND cu.i = v.i WHERE b.name = 'dynamic_tail_window' GROUP BY ALL)
 SELECT sample_id, channel, name, CAST(k AS INTEGER) AS pos, round(value * {tukey(24, 'k')}, 6) AS value FROM rs""", "traces"))  # fmt: skip


def full_region(s):
    """The fixed region that the six-branch set puts beside the dynamic windows."""
    return s.createDataFrame([(0, "0-5mm", 0.0, 5.0)], "region_idx int, name string, start_mm double, end_mm double")


def six(s, d, target=24, alpha=0.3):
    at = located(s, d)
    return B.dynamic(frames3(s, d, at), at, DET, target, alpha, full_region(s), MM, 64)


def _tensor(s, d):
    """Nested inputs of each sample: main window, tail and full region of both channels, told branch by branch."""
    t = B.tensors(six(s, d), 2, "double")
    each = t.select("sample_id", F.size("inputs").alias("branches"), F.posexplode(F.arrays_zip("names", "inputs", "audit")).alias("branch_id", "b"))
    total = F.aggregate(F.get("b.inputs", F.lit(0)), F.lit(0.0), lambda a, x: a + x)
    weighed = F.aggregate(F.transform(F.get("b.inputs", F.lit(0)), lambda x, i: x * i), F.lit(0.0), lambda a, x: a + x)
    return each.select("sample_id", "branches", "branch_id", F.col("b.names").alias("name"), "b.audit.start", "b.audit.end", "b.audit.pad", F.size(F.get("b.inputs", F.lit(0))).alias("points"), F.size("b.inputs").alias("streams"), R(total, 5).alias("total"), R(weighed, 4).alias("weighed"))


SIX = f"""{LP}{TWO[len(SPAN):]}, b6 AS (SELECT sample_id, channel, region_idx, name, start, "end", pad FROM bo UNION ALL SELECT DISTINCT sample_id, channel, 2, '0-5mm', 0, 64, 0 FROM bo),
 c6 AS (SELECT p.sample_id, p.channel, region_idx, pos - start AS i, value FROM pr p JOIN b6 USING (sample_id, channel) WHERE pos >= start AND pos < "end"),
 r6 AS (SELECT sample_id, channel, region_idx, i AS k, value FROM c6 WHERE region_idx = 0
  UNION ALL SELECT b.sample_id, b.channel, 1, k, coalesce(sum(value * w), 0) FROM b6 b CROSS JOIN {spline_table(32, 24)} v LEFT JOIN c6 ON c6.sample_id = b.sample_id AND c6.channel = b.channel AND c6.region_idx = 1 AND c6.i = v.i WHERE b.region_idx = 1 GROUP BY b.sample_id, b.channel, k
  UNION ALL SELECT sample_id, channel, 2, k, sum(value * w) FROM c6 JOIN {spline_table(64, 24)} v USING (i) WHERE region_idx = 2 GROUP BY sample_id, channel, k),
 t6 AS (SELECT sample_id, channel, region_idx, k, value * {tukey(24, 'k')} AS value FROM r6)"""
register("branch_tensor", _tensor, sql(f"""WITH {SIX} SELECT sample_id, 6 AS branches, CAST(region_idx * 2 + channel AS INTEGER) AS branch_id, 'region' || region_idx || '_' || name || '_ch' || (channel + 1) AS name, CAST(start AS INTEGER) AS start, CAST("end" AS INTEGER) AS "end", CAST(pad AS INTEGER) AS pad,
 CAST(count(*) AS INTEGER) AS points, 1 AS streams, round(sum(value), 5) AS total, round(sum(value * k), 4) AS weighed FROM b6 JOIN t6 USING (sample_id, channel, region_idx) GROUP BY ALL""", "traces"))  # fmt: skip
register("branch_geometry", lambda s, d: B.geometry(main_tail(s, d), MM, 64, 24).select("sample_id", "channel", "name", "input_len", R("spacing_mm").alias("spacing_mm"), "title"), sql(f"""WITH {TWO} SELECT sample_id, channel, name, CAST(input_len AS INTEGER) AS input_len, round(CAST(5.0 AS DOUBLE) / 64 * input_len / 24, 6) AS spacing_mm, name || ' ' || {G_.format('start * CAST(0.078125 AS DOUBLE)')} || '-' || {G_.format('"end" * CAST(0.078125 AS DOUBLE)')} || 'mm' AS title FROM bo""", "traces"))


#: Added to the id of a sample that the other parse names otherwise.
RENAMED = 1_000_000_000


def other_parse(traces, at):
    """Main windows and padded tails of all frames by their absolute indices, as an external parse would give them.

    It names every seventh sample otherwise, moves one point of one frame of some main windows and of some tails, and leaves some tails without their padding."""
    k, frame = F.col("sample_id"), F.col("frame")
    some = traces.join(at.where("status = 'ok'").select("sample_id", "channel", "start", "end"), ["sample_id", "channel"])
    place = lambda n: F.sequence(F.lit(0), F.lit(n - 1))
    point = lambda i: F.when(i < 64, F.get("signal", i)).otherwise(0.0)
    moved = lambda x, here: F.when(here, x + 1).otherwise(x)
    main = F.transform(place(24), lambda i: moved(point(F.col("start") + i), (k % 5 == 0) & (frame == k % 10) & (i == k % 24)))
    tail = F.transform(place(32), lambda i: moved(point(F.col("end") + i), (k % 3 == 1) & (frame == (k + 4) % 10) & (i == k % 32)))
    tail = F.when(k % 4 == 1, F.slice(tail, F.lit(1), F.least(64 - F.col("end"), F.lit(32)))).otherwise(tail)
    each = F.explode(F.array(F.struct(F.lit(B.MAIN).alias("name"), main.alias("signal")), F.struct(F.lit(B.TAIL).alias("name"), tail.alias("signal"))))
    return some.select("sample_id", "channel", "frame", each.alias("b")).select("channel", "frame", "b.*", (k + F.when(k % 7 == 3, RENAMED).otherwise(0)).alias("sample_id"))


def _verify(s, d):
    """Main windows and padded tails of all frames against another parse of the traces, and the branches of each first frame; the level of the converter is taken out before."""
    traces = scans(s, d).withColumn("signal", S.adc_zero(F.col("signal"), 0.25, 0.02))
    at = located(s, d, traces)
    whole = at.withColumn("problem", B.span_problem(2)).where("problem is null")
    return B.verified(traces, at, other_parse(traces, whole), DET, 24)


CLEAN = f"traces AS (WITH {sql('SELECT sample_id, frame, channel, pos, CASE WHEN abs(abs(value) - 0.25) <= 0.02 + 1e-5 * 0.25 THEN 0.0 ELSE value END AS value FROM traces', 'traces')[5:]})"
register("verify_branches", _verify, f"""WITH {CLEAN}, {TWO}, fs AS (SELECT DISTINCT sample_id, channel, frame FROM traces), nc AS (SELECT sample_id, count(DISTINCT channel) AS n FROM traces GROUP BY 1),
 bs AS (SELECT * FROM bo WHERE sample_id IN (SELECT sample_id FROM bo WHERE region_idx = 0 GROUP BY 1 HAVING count(*) = 2)),
 sl AS (SELECT b.sample_id, b.channel, b.name, pad, fs.frame, coalesce(bool_and(isfinite(value)), true) AS finite FROM bs b JOIN fs ON fs.sample_id = b.sample_id AND fs.channel = b.channel LEFT JOIN traces t ON t.sample_id = b.sample_id AND t.channel = b.channel AND t.frame = fs.frame AND pos >= start AND pos < "end" GROUP BY ALL),
 co AS (SELECT sample_id, channel, name, CASE WHEN sample_id % 7 = 3 THEN 'missing' WHEN name = '{B.TAIL}' AND sample_id % 4 = 1 AND pad > 0 THEN 'shape' WHEN NOT finite THEN 'not_finite'
   WHEN name = '{B.MAIN}' AND sample_id % 5 = 0 AND frame = sample_id % 10 THEN 'values' WHEN name = '{B.TAIL}' AND sample_id % 3 = 1 AND frame = (sample_id + 4) % 10 THEN 'values' END AS problem FROM sl
  UNION ALL SELECT sample_id + {RENAMED}, channel, name, 'extra' FROM sl WHERE sample_id % 7 = 3),
 f1 AS (SELECT t.sample_id, t.channel, pos, value FROM traces t JOIN (SELECT sample_id, channel, min(frame) AS frame FROM fs GROUP BY ALL) USING (sample_id, channel, frame)),
 c1 AS (SELECT sample_id, channel, name, pos - start AS i, value FROM f1 JOIN bs USING (sample_id, channel) WHERE pos >= start AND pos < "end"),
 r1 AS (SELECT sample_id, channel, name, i AS k, value FROM c1 WHERE name = '{B.MAIN}' UNION ALL SELECT b.sample_id, b.channel, b.name, k, coalesce(sum(value * w), 0) FROM bs b CROSS JOIN {spline_table(32, 24)} v LEFT JOIN c1 ON c1.sample_id = b.sample_id AND c1.channel = b.channel AND c1.name = b.name AND c1.i = v.i WHERE b.name = '{B.TAIL}' GROUP BY ALL),
 u1 AS (SELECT sample_id, channel, name, CASE WHEN count(*) <> 24 THEN 'branch_shape' WHEN NOT bool_and(isfinite(value)) THEN 'branch_not_finite' END AS problem FROM r1 GROUP BY ALL)
 SELECT sample_id, channel, name, problem, count(*) AS n_frames FROM co WHERE problem IS NOT NULL GROUP BY ALL UNION ALL SELECT sample_id, channel, name, problem, 1 FROM u1 WHERE problem IS NOT NULL
 UNION ALL SELECT sample_id, channel, name, CASE WHEN n <> 2 THEN 'channels' ELSE 'no_span' END, 0 FROM (SELECT DISTINCT sample_id, channel FROM fs) JOIN nc USING (sample_id), (VALUES ('{B.MAIN}'), ('{B.TAIL}')) AS v(name) WHERE sample_id NOT IN (SELECT sample_id FROM bs)""")  # fmt: skip


def vectors(s, d):
    comp = Fe.components(B.geometry(main_tail(s, d, 24, 0.3), MM, 64, 24))
    return Fe.vectors(Fe.long_features(Fe.pooled(comp, ["sample_id", "channel", "region_idx", "name"], 1, spacing="spacing_mm"), ["sample_id", "channel", "region_idx", "name"]))


register("emd_features", lambda s, d: vectors(s, d).select("sample_id", F.posexplode(F.arrays_zip("names", "features")).alias("i", "f")).select("sample_id", "i", F.col("f.names").alias("name"), R("f.features").alias("value")))
register("entry_slice", lambda s, d: Fr.select_c3(scans(s, d).withColumn("signal", S.adc_zero(F.col("signal"), 0.25, 0.02)), scans(s, d).select("sample_id", "channel").distinct().withColumn("start", F.lit(0)).withColumn("end", F.lit(64)), 1).withColumn("x", G.component_stats(F.col("signal"))).select("sample_id", "channel", "frame", *(R(f"x.{k}").alias(k) for k in G.STATS[:7])),
         sql(f"""WITH z AS (SELECT sample_id, frame, channel, pos, CASE WHEN abs(abs(value) - 0.25) <= 0.02 + 1e-5 * 0.25 THEN 0.0 ELSE value END AS value FROM traces), k AS (SELECT sample_id, channel, frame FROM (SELECT sample_id, channel, frame, row_number() OVER (PARTITION BY sample_id, channel ORDER BY max(abs(value)) DESC, frame) AS r FROM z GROUP BY sample_id, channel, frame) WHERE r = 1),
 xt AS (SELECT *, lead(value) OVER (PARTITION BY sample_id, frame, channel ORDER BY pos) AS r FROM z JOIN k USING (sample_id, channel, frame)), s7 AS (SELECT sample_id, channel, frame, {STATS7} FROM xt GROUP BY ALL) SELECT sample_id, channel, frame, {', '.join(f'round({k}, 6) AS {k}' for k in G.STATS[:7])} FROM s7""", "traces"))  # fmt: skip


def _component_curves(s, d):
    """Components of all six branches of one sample of each class, as curves over millimetres."""
    chosen = C.class_sample(samples(s, d), 1, 7).select("sample_id", "label")
    own = B.geometry(six(s, d).join(chosen, "sample_id"), MM, 64, 24)
    return Fe.component_curves(own, ["label", "sample_id", "region_idx", "name", "channel", "stream"]).withColumns({k: R(k) for k in ("mm", "value", "limit")})


register("component_curves", _component_curves)


def _curves(s, d):
    """Long-form curves: the mean trace of each label and channel, and both losses of each run."""
    lab = samples(s, d).select("sample_id", "label")
    mean = scans(s, d).join(lab, "sample_id").select("label", "channel", F.posexplode("signal").alias("x", "v")).groupBy("label", "channel", "x").agg(R(F.avg("v")).alias("value"), F.count("*").alias("n"))
    mean = mean.select(F.lit("trace").alias("kind"), F.concat_ws("/", F.col("label").cast("string"), F.col("channel").cast("string")).alias("series"), "x", "value", "n")
    runs = history(s, d).select(F.col("experiment").cast("string").alias("series"), F.col("epoch").alias("x"), F.explode(F.create_map(F.lit("train_loss"), F.col("train_loss"), F.lit("val_loss"), F.col("val_loss"))).alias("kind", "value"))
    return mean.union(runs.select("kind", "series", "x", R("value").alias("value"), F.lit(1).cast("long").alias("n")))


register("curve_table", _curves, sql("SELECT 'trace' AS kind, s.label || '/' || channel AS series, CAST(pos AS INTEGER) AS x, round(avg(value), 6) AS value, count(*) AS n FROM traces t JOIN samples s USING (sample_id) GROUP BY ALL UNION ALL SELECT 'train_loss', CAST(experiment AS VARCHAR), epoch, round(train_loss, 6), 1 FROM history UNION ALL SELECT 'val_loss', CAST(experiment AS VARCHAR), epoch, round(val_loss, 6), 1 FROM history", "traces", "samples", "history"))
