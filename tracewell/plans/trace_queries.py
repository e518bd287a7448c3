"""Frame and span queries over the traces."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions import signals as G
from ..operators import frames as Fr
from ..operators import spans as Sp
from ..sources.scratch import shared_path
from .registry import register
from .views import scans, sql

R = lambda c, n=6: F.round(c, n)
#: Detector settings for traces of 64 points.
DET = Sp.Detector(4, 0.3, 5, 8, 16, 0.5, 3, 2, 0.05, 16, 2, 3, 24, 32, 64, 3)
TOP = 5


def windows(s, d):
    """Main windows of both channels by a rule of their ids, where a query needs windows but not their location."""
    x = scans(s, d).select("sample_id", "channel").distinct()
    return x.select("sample_id", "channel", (F.col("channel") * 8 + F.col("sample_id") % 4).cast("int").alias("start"), (F.col("channel") * 8 + F.col("sample_id") % 4 + 24).cast("int").alias("end"))


WIN = "wn AS (SELECT DISTINCT sample_id, channel, channel * 8 + sample_id % 4 AS a, channel * 8 + sample_id % 4 + 24 AS z FROM traces)"
PEAKS = f"{WIN}, pk AS (SELECT t.sample_id, t.frame, t.channel, max(abs(value)) AS peak FROM traces t JOIN wn USING (sample_id, channel) WHERE pos >= a AND pos < z GROUP BY ALL), rk AS (SELECT *, row_number() OVER (PARTITION BY sample_id, channel ORDER BY peak DESC, frame) AS r FROM pk)"
OVER = f"{PEAKS}, ovl AS (SELECT sample_id, frame, peak, row_number() OVER (PARTITION BY sample_id ORDER BY r) AS place FROM rk x WHERE channel = 0 AND r <= {TOP} AND EXISTS (SELECT 1 FROM rk y WHERE y.sample_id = x.sample_id AND y.frame = x.frame AND y.channel = 1 AND y.r <= {TOP}))"
SIM = f"""{OVER}, fr AS (SELECT sample_id, frame, peak FROM rk WHERE channel = 0 AND r <= {TOP}),
 lf AS (SELECT t.sample_id, t.frame, t.pos - a AS p, value AS v FROM traces t JOIN wn ON wn.sample_id = t.sample_id AND wn.channel = 0 JOIN fr ON fr.sample_id = t.sample_id AND fr.frame = t.frame WHERE t.channel = 0 AND pos >= a AND pos < z),
 rt AS (SELECT t.sample_id, t.frame, t.pos - a AS p, value AS v FROM traces t JOIN wn ON wn.sample_id = t.sample_id AND wn.channel = 0 JOIN fr ON fr.sample_id = t.sample_id AND fr.frame = t.frame WHERE t.channel = 1 AND pos >= a AND pos < z),
 rms AS (SELECT l.sample_id, l.frame, sqrt(avg(l.v * l.v)) AS ra, sqrt(avg(r.v * r.v)) AS rb FROM lf l JOIN rt r USING (sample_id, frame, p) GROUP BY ALL),
 cr AS (SELECT l.sample_id, l.frame, lag, coalesce(abs(corr(l.v, r.v)), 0) AS c FROM lf l CROSS JOIN (SELECT unnest(range(-5, 6)) AS lag) g JOIN rt r ON r.sample_id = l.sample_id AND r.frame = l.frame AND l.p = r.p + lag GROUP BY ALL),
 sc AS (SELECT cr.sample_id, cr.frame, round(max(c) * any_value(least(ra, rb) / greatest(ra, rb)), 12) AS score FROM cr JOIN rms USING (sample_id, frame) GROUP BY ALL),
 sr AS (SELECT sample_id, frame, peak, score, row_number() OVER (PARTITION BY sample_id ORDER BY score DESC, peak DESC, frame) AS place FROM sc JOIN fr USING (sample_id, frame)),
 on_ AS (SELECT sample_id, count(*) AS n FROM ovl GROUP BY 1),
 c4 AS (SELECT sample_id, place, frame, true AS used_overlap FROM ovl JOIN on_ USING (sample_id) WHERE n >= 3 AND place <= 3 UNION ALL SELECT sample_id, place, frame, false FROM sr WHERE place <= 3 AND sample_id NOT IN (SELECT sample_id FROM on_ WHERE n >= 3))"""


def ranked(s, d):
    return Fr.frame_rank(Fr.frame_peaks(scans(s, d), windows(s, d)))


register("adc_zero", lambda s, d: scans(s, d).select("sample_id", "frame", "channel", F.posexplode(S.adc_zero(F.col("signal"), 0.25, 0.02)).alias("pos", "value")), sql("SELECT sample_id, frame, channel, CAST(pos AS INTEGER) AS pos, CASE WHEN abs(abs(value) - 0.25) <= 0.02 + 1e-5 * 0.25 THEN 0.0 ELSE value END AS value FROM traces", "traces"))
register("select_channels", lambda s, d: Fr.select_channels(scans(s, d), 2).select("sample_id", "frame", "channel", F.posexplode("signal").alias("pos", "value")), sql("SELECT sample_id, frame, channel, CAST(pos AS INTEGER) AS pos, value FROM traces WHERE channel = 1", "traces"))
register("interval_slice", lambda s, d: scans(s, d).join(windows(s, d), ["sample_id", "channel"]).select("sample_id", "frame", "channel", F.posexplode(Fr.interval(F.col("signal"), F.col("start"), F.col("end"))).alias("i", "value")), sql(f"WITH {WIN} SELECT t.sample_id, t.frame, t.channel, CAST(pos - a AS INTEGER) AS i, value FROM traces t JOIN wn USING (sample_id, channel) WHERE pos >= a AND pos < z", "traces"))
register("frame_peak", lambda s, d: Fr.frame_peaks(scans(s, d), windows(s, d)).select("sample_id", "frame", "channel", "peak"), sql(f"WITH {PEAKS} SELECT * FROM pk", "traces"))
register("frame_rank", lambda s, d: ranked(s, d).select("sample_id", "frame", "channel", "rank"), sql(f"WITH {PEAKS} SELECT sample_id, frame, channel, CAST(r AS INTEGER) AS rank FROM rk", "traces"))
register("frame_mean_std", lambda s, d: Fr.mean_std(scans(s, d)).select("sample_id", "channel", "pos", R("mean").alias("mean"), R("std").alias("std")), sql("SELECT sample_id, channel, CAST(pos AS INTEGER) AS pos, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std FROM traces GROUP BY ALL", "traces"))
register("frame_select_c3", lambda s, d: Fr.select_c3(scans(s, d), windows(s, d), 3).select("sample_id", "channel", "rank", "frame", "peak"), sql(f"WITH {PEAKS} SELECT sample_id, channel, CAST(r AS INTEGER) AS rank, frame, peak FROM rk WHERE r <= 3", "traces"))
register("topk_mean", lambda s, d: Fr.mean_of(Fr.select_c3(scans(s, d), windows(s, d), 3), ["sample_id", "channel"]).select("sample_id", "channel", F.posexplode("signal").alias("pos", "v")).select("sample_id", "channel", "pos", R("v").alias("value")), sql(f"WITH {PEAKS} SELECT t.sample_id, t.channel, CAST(pos AS INTEGER) AS pos, round(avg(value), 6) AS value FROM traces t JOIN rk USING (sample_id, channel, frame) WHERE r <= 3 GROUP BY ALL", "traces"))
register("frame_overlap", lambda s, d: Fr.overlap(ranked(s, d), TOP).select("sample_id", "frame", "place"), sql(f"WITH {OVER} SELECT sample_id, frame, CAST(place AS INTEGER) AS place FROM ovl", "traces"))
register("topk_intersect", lambda s, d: ranked(s, d).where(f"channel = 0 and rank <= {TOP}").select("sample_id", "frame").intersect(ranked(s, d).where(f"channel = 1 and rank <= {TOP}").select("sample_id", "frame")), sql(f"WITH {PEAKS} SELECT sample_id, frame FROM rk WHERE channel = 0 AND r <= {TOP} INTERSECT SELECT sample_id, frame FROM rk WHERE channel = 1 AND r <= {TOP}", "traces"))
register("lagged_similarity", lambda s, d: Fr.similarity_rank(scans(s, d), windows(s, d), TOP).select("sample_id", "frame", R("score").alias("score")), sql(f"WITH {SIM} SELECT sample_id, frame, round(score, 6) AS score FROM sc", "traces"))
register("similarity_rank", lambda s, d: Fr.similarity_rank(scans(s, d), windows(s, d), TOP).select("sample_id", "frame", "place"), sql(f"WITH {SIM} SELECT sample_id, frame, CAST(place AS INTEGER) AS place FROM sr", "traces"))
register("frame_select_c4", lambda s, d: Fr.select_c4(scans(s, d), windows(s, d), 3, TOP), sql(f"WITH {SIM} SELECT sample_id, CAST(place AS INTEGER) AS place, frame, used_overlap FROM c4", "traces"))
SHARED = "sp AS (SELECT sample_id, arg_max(frame, (peak, -frame)) AS frame, max(peak) AS peak FROM (SELECT sample_id, frame, max(abs(value)) AS peak FROM traces GROUP BY ALL) GROUP BY 1)"
register("frame_select_shared_peak", lambda s, d: Fr.select_shared_peak(scans(s, d)), sql(f"WITH {SHARED} SELECT * FROM sp", "traces"))
register("frame_select_energy_cosine", lambda s, d: Fr.select_energy_cosine(scans(s, d), TOP).withColumn("score", R("score")), sql(f"""WITH w AS (SELECT sample_id, frame FROM (SELECT sample_id, frame, row_number() OVER (PARTITION BY sample_id ORDER BY max(abs(value)) DESC, frame) AS r FROM traces WHERE channel = 0 GROUP BY sample_id, frame) WHERE r <= {TOP}),
 c AS (SELECT x.sample_id, x.frame, round(sum(x.value * x.value * y.value * y.value) / sqrt(sum(x.value * x.value * x.value * x.value) * sum(y.value * y.value * y.value * y.value)), 12) AS score FROM traces x JOIN traces y ON y.sample_id = x.sample_id AND y.frame = x.frame AND y.pos = x.pos AND x.channel = 0 AND y.channel = 1 JOIN w ON w.sample_id = x.sample_id AND w.frame = x.frame GROUP BY ALL)
 SELECT sample_id, arg_max(frame, (score, -frame)) AS frame, round(max(score), 6) AS score FROM c GROUP BY 1""", "traces"))  # fmt: skip


def _stats(s, d):
    a = Fr.select_c3(scans(s, d).where("channel = 0"), windows(s, d), 3).withColumn("part", F.col("sample_id") % 3)
    return Fr.choice_stats(a, Fr.select_c4(scans(s, d), windows(s, d), 3, TOP), ["part"])


register("frame_choice_stats", _stats, sql(f"""WITH {SIM}, fa AS (SELECT sample_id, list(frame ORDER BY frame) AS f FROM rk WHERE channel = 0 AND r <= 3 GROUP BY 1), fb AS (SELECT sample_id, list(frame ORDER BY frame) AS f, min(used_overlap) AS direct FROM c4 GROUP BY 1)
 SELECT fa.sample_id % 3 AS part, count(*) AS n, count(*) FILTER (fa.f <> fb.f) AS n_differ, count(*) FILTER (NOT direct) AS n_fallback FROM fa JOIN fb USING (sample_id) GROUP BY ROLLUP (part)""", "traces"))  # fmt: skip

# The locator, step by step.
LOC = """wp AS (SELECT sample_id, channel, frame, row_number() OVER (PARTITION BY sample_id, channel ORDER BY max(abs(value)) DESC, frame) AS r FROM traces GROUP BY sample_id, channel, frame),
 ls AS (SELECT t.sample_id, t.channel, t.pos, avg(value) AS v FROM traces t JOIN wp USING (sample_id, channel, frame) WHERE r <= 3 GROUP BY ALL),
 hb AS (SELECT a.sample_id, a.channel, a.pos, any_value(a.v) AS v, sum(CASE WHEN abs(a.pos - b.pos) % 2 = 1 THEN b.v * 2.0 / 64 / tan(pi() * (a.pos - b.pos) / 64) ELSE 0 END) AS h FROM ls a JOIN ls b ON a.sample_id = b.sample_id AND a.channel = b.channel GROUP BY ALL),
 en AS (SELECT sample_id, channel, pos, sqrt(v * v + h * h) AS e FROM hb)"""
SMOOTH = f"{LOC}, sm AS (SELECT a.sample_id, a.channel, a.pos, CASE WHEN a.pos < 4 THEN 0 ELSE avg(b.e) END AS v FROM en a CROSS JOIN (SELECT unnest(range(-2, 3)) AS o) k JOIN en b ON a.sample_id = b.sample_id AND a.channel = b.channel AND b.pos = least(greatest(a.pos + o, 4), 63) GROUP BY a.sample_id, a.channel, a.pos)"
REFS = f"""{SMOOTH}, dr AS (SELECT sample_id, channel, min(pos) FILTER (pos >= 4 AND v > 0.3) AS direct FROM sm GROUP BY ALL),
 jt AS (SELECT sample_id, pos, sqrt(avg(v * v)) AS j FROM sm GROUP BY ALL), jl AS (SELECT sample_id, max(j) * 0.5 AS level FROM jt WHERE pos >= 4 GROUP BY 1), ja AS (SELECT jt.sample_id, min(pos) AS joint_at FROM jt JOIN jl USING (sample_id) WHERE pos >= 4 AND j > level GROUP BY 1),
 rf AS (SELECT d.*, CASE WHEN d.direct IS NOT NULL THEN d.direct WHEN o.direct IS NOT NULL THEN o.direct ELSE joint_at END AS reference, CASE WHEN d.direct IS NOT NULL THEN 'direct' WHEN o.direct IS NOT NULL THEN 'paired_fallback' ELSE 'rms_joint_fallback' END AS rule
 FROM dr d JOIN dr o ON o.sample_id = d.sample_id AND o.channel = 1 - d.channel JOIN ja ON ja.sample_id = d.sample_id)"""
SPAN = f"""{REFS}, wi AS (SELECT *, greatest(4, reference - 8) AS low, least(64, reference + 16) AS high FROM rf),
 pe AS (SELECT wi.sample_id, wi.channel, any_value(direct) AS direct, any_value(reference) AS reference, any_value(rule) AS rule, arg_max(pos, (v, -pos)) AS peak, max(v) AS pv FROM wi JOIN sm USING (sample_id, channel) WHERE pos >= low AND pos < high GROUP BY ALL),
 ab AS (SELECT sample_id, channel, pos, sm.v, pos - row_number() OVER (PARTITION BY sample_id, channel ORDER BY pos) AS g FROM sm JOIN pe USING (sample_id, channel) WHERE pos >= 4 AND sm.v > pv * 0.5),
 ru AS (SELECT sample_id, channel, min(pos) AS a, max(pos) + 1 AS z, count(*) AS w, sum(v) AS area FROM ab GROUP BY sample_id, channel, g),
 an AS (SELECT pe.*, ru.a AS aa, ru.area AS aarea FROM pe JOIN ru USING (sample_id, channel) WHERE ru.a <= peak AND peak < ru.z),
 ch AS (SELECT ru.*, aa, min(CASE WHEN nx - ru.z <= 3 AND w >= 2 AND ru.area >= 0.05 * aarea AND aa - ru.a <= 16 THEN 1 ELSE 0 END) OVER (PARTITION BY sample_id, channel ORDER BY ru.a DESC) AS ok FROM (SELECT *, lead(a) OVER (PARTITION BY sample_id, channel ORDER BY a) AS nx FROM ru) ru JOIN an USING (sample_id, channel) WHERE ru.a < aa),
 mg AS (SELECT an.*, coalesce(m.a, aa) AS crossing, coalesce(m.n, 0) AS n_merged FROM an LEFT JOIN (SELECT sample_id, channel, min(a) AS a, count(*) AS n FROM ch WHERE ok = 1 GROUP BY ALL) m USING (sample_id, channel)),
 lo AS (SELECT *, greatest(crossing - 2, 3) AS start, greatest(crossing - 2, 3) + 24 AS "end" FROM mg)"""


def spans(s, d, traces=None):
    return Sp.located(scans(s, d) if traces is None else traces, DET)


def located(s, d, traces=None):
    """The spans, of other traces too, located once and written, for plans that read them more than once."""
    path = shared_path(s, "spans")
    spans(s, d, traces).select("sample_id", "channel", "start", "end", "status", "tail_start", "tail_end", "tail_pad", "automatic", "rule").write.parquet(path)
    return s.read.parquet(path)


register("locator_signal", lambda s, d: Fr.locator_signal(scans(s, d)).select("sample_id", "channel", F.posexplode("signal").alias("pos", "v")).select("sample_id", "channel", "pos", R("v").alias("value")), sql(f"WITH {LOC} SELECT sample_id, channel, CAST(pos AS INTEGER) AS pos, round(v, 6) AS value FROM ls", "traces"))
register("hilbert_envelope", lambda s, d: Fr.locator_signal(scans(s, d)).select("sample_id", "channel", F.posexplode(G.envelope(F.col("signal"))).alias("pos", "v")).select("sample_id", "channel", "pos", R("v").alias("envelope")), sql(f"WITH {LOC} SELECT sample_id, channel, CAST(pos AS INTEGER) AS pos, round(e, 6) AS envelope FROM en", "traces"))
register("moving_average", lambda s, d: Sp.smoothed(scans(s, d), DET).select("sample_id", "channel", F.posexplode("env").alias("pos", "v")).select("sample_id", "channel", "pos", R("v").alias("value")), sql(f"WITH {SMOOTH} SELECT sample_id, channel, CAST(pos AS INTEGER) AS pos, round(v, 6) AS value FROM sm", "traces"))
register("first_crossing", lambda s, d: Sp.smoothed(scans(s, d), DET).select("sample_id", "channel", Sp.first_above(F.col("env"), F.lit(0.3), 4).alias("direct")), sql(f"WITH {REFS} SELECT sample_id, channel, CAST(direct AS INTEGER) AS direct FROM dr", "traces"))
register("paired_fallback", lambda s, d: Sp.references(Sp.smoothed(scans(s, d), DET), DET).select("sample_id", "channel", "reference", "rule"), sql(f"WITH {REFS} SELECT sample_id, channel, CAST(reference AS INTEGER) AS reference, rule FROM rf", "traces"))
register("joint_rms", lambda s, d: Sp.smoothed(scans(s, d), DET).select("sample_id", F.posexplode("env").alias("pos", "v")).groupBy("sample_id", "pos").agg(R(F.sqrt(F.avg(F.col("v") * F.col("v")))).alias("rms")), sql(f"WITH {REFS} SELECT sample_id, CAST(pos AS INTEGER) AS pos, round(j, 6) AS rms FROM jt", "traces"))
register("threshold_runs", lambda s, d: spans(s, d).select("sample_id", "channel", F.explode("runs").alias("r")).select("sample_id", "channel", "r.start", "r.end", "r.width", R("r.area").alias("area")), sql(f'WITH {SPAN} SELECT sample_id, channel, CAST(a AS INTEGER) AS start, CAST(z AS INTEGER) AS "end", CAST(w AS INTEGER) AS width, round(area, 6) AS area FROM ru', "traces"))
register("peak_search", lambda s, d: spans(s, d).select("sample_id", "channel", "peak", R("peak_value").alias("peak_value"), R("threshold").alias("threshold")), sql(f"WITH {SPAN} SELECT sample_id, channel, CAST(peak AS INTEGER) AS peak, round(pv, 6) AS peak_value, round(pv * 0.5, 6) AS threshold FROM pe", "traces"))
register("merge_runs", lambda s, d: spans(s, d).select("sample_id", "channel", "premerge", "crossing", "n_merged"), sql(f"WITH {SPAN} SELECT sample_id, channel, CAST(aa AS INTEGER) AS premerge, CAST(crossing AS INTEGER) AS crossing, CAST(n_merged AS INTEGER) AS n_merged FROM mg", "traces"))
LOCATED = "CAST(direct AS INTEGER) AS direct, CAST(reference AS INTEGER) AS reference, rule, CAST(peak AS INTEGER) AS peak, CAST(crossing AS INTEGER) AS crossing, CAST(start AS INTEGER) AS start, CAST(\"end\" AS INTEGER) AS \"end\", crossing - 2 < 3 AS clamped, CASE WHEN \"end\" > 64 THEN 'overflow' ELSE 'ok' END AS status"
register("locate_span", lambda s, d: spans(s, d).select("sample_id", "channel", "direct", "reference", "rule", "peak", "crossing", "start", "end", "clamped", "status"), sql(f"WITH {SPAN} SELECT sample_id, channel, {LOCATED} FROM lo", "traces"))
register("tail_geometry", lambda s, d: spans(s, d).where("status = 'ok'").select("sample_id", "channel", "tail_start", "tail_end", "tail_pad"), sql(f'WITH {SPAN} SELECT sample_id, channel, CAST("end" AS INTEGER) AS tail_start, CAST(least("end" + 32, 64) AS INTEGER) AS tail_end, CAST(32 - (least("end" + 32, 64) - "end") AS INTEGER) AS tail_pad FROM lo WHERE "end" <= 64', "traces"))


def _corrected(s, d):
    """Hand corrections for every third sample; every ninth names a crossing that no longer is the automatic one."""
    auto = located(s, d).where("sample_id % 3 = 0").select("sample_id", "channel", (F.col("automatic") + F.when(F.col("sample_id") % 9 == 0, 1).otherwise(0)).alias("recorded"), (F.col("automatic") + 2).alias("manual"))
    return Sp.located(scans(s, d), DET, auto).select("sample_id", "channel", "automatic", "crossing", "corrected", "status")


register("manual_corrections", _corrected, sql(f"""WITH {SPAN}, x AS (SELECT sample_id, channel, CAST(crossing AS INTEGER) AS automatic, CASE WHEN sample_id % 3 = 0 AND sample_id % 9 <> 0 THEN crossing + 2 ELSE crossing END AS nc FROM lo)
 SELECT sample_id, channel, automatic, CAST(nc AS INTEGER) AS crossing, sample_id % 3 = 0 AND sample_id % 9 <> 0 AS corrected, CASE WHEN sample_id % 9 = 0 THEN 'stale_correction' WHEN greatest(nc - 2, 3) + 24 > 64 THEN 'overflow' ELSE 'ok' END AS status FROM x""", "traces"))  # fmt: skip


def _verify(s, d):
    """Spans against the same spans as an external parse would give them: some moved by a point, some absent."""
    a = located(s, d).select("sample_id", "channel", "start", "end")
    b = a.where("sample_id % 7 <> 3").select("sample_id", "channel", (F.col("start") + F.when(F.col("sample_id") % 5 == 0, 1).otherwise(0)).alias("start_ref"), F.col("end").alias("end_ref"))
    return a.join(b, ["sample_id", "channel"], "full").where(~(F.col("start").eqNullSafe(F.col("start_ref")) & F.col("end").eqNullSafe(F.col("end_ref"))))


register("verify_spans", _verify, sql(f"""WITH {SPAN} SELECT sample_id, channel, CAST(start AS INTEGER) AS start, CAST("end" AS INTEGER) AS "end", CAST(CASE WHEN sample_id % 7 <> 3 THEN start + CASE WHEN sample_id % 5 = 0 THEN 1 ELSE 0 END END AS INTEGER) AS start_ref, CAST(CASE WHEN sample_id % 7 <> 3 THEN "end" END AS INTEGER) AS end_ref FROM lo WHERE sample_id % 7 = 3 OR sample_id % 5 = 0""", "traces"))


def _cases(s, d):
    """Samples of which a channel fell back, located again by each channel alone."""
    odd = spans(s, d).where("rule <> 'direct'").select("sample_id").distinct()
    alone = scans(s, d).join(odd, "sample_id", "left_semi").withColumn("sample_id", F.col("sample_id") * 2 + F.col("channel"))
    out = Sp.located(alone, DET)
    return out.select(F.expr("sample_id div 2").alias("sample_id"), "channel", "rule", "start", "status")


register("case_probe", _cases, sql(f"""WITH {SPAN}, al AS (SELECT d.sample_id, d.channel, coalesce(direct, (SELECT min(pos) FROM sm x WHERE x.sample_id = d.sample_id AND x.channel = d.channel AND pos >= 4 AND v > (SELECT max(v) * 0.5 FROM sm y WHERE y.sample_id = d.sample_id AND y.channel = d.channel AND pos >= 4))) AS reference, direct FROM dr d WHERE d.sample_id IN (SELECT sample_id FROM rf WHERE rule <> 'direct')),
 p2 AS (SELECT al.sample_id, al.channel, any_value(al.direct) AS direct, arg_max(pos, (v, -pos)) AS peak, max(v) AS pv FROM al JOIN sm USING (sample_id, channel) WHERE pos >= greatest(4, reference - 8) AND pos < least(64, reference + 16) GROUP BY ALL),
 a2 AS (SELECT sample_id, channel, pos, sm.v, pos - row_number() OVER (PARTITION BY sample_id, channel ORDER BY pos) AS g FROM sm JOIN p2 USING (sample_id, channel) WHERE pos >= 4 AND sm.v > pv * 0.5),
 r2 AS (SELECT sample_id, channel, min(pos) AS a, max(pos) + 1 AS z, count(*) AS w, sum(v) AS area FROM a2 GROUP BY sample_id, channel, g), n2 AS (SELECT p2.*, r2.a AS aa, r2.area AS aarea FROM p2 JOIN r2 USING (sample_id, channel) WHERE r2.a <= peak AND peak < r2.z),
 c2 AS (SELECT r.sample_id, r.channel, r.a, min(CASE WHEN nx - r.z <= 3 AND w >= 2 AND r.area >= 0.05 * aarea AND aa - r.a <= 16 THEN 1 ELSE 0 END) OVER (PARTITION BY r.sample_id, r.channel ORDER BY r.a DESC) AS ok FROM (SELECT *, lead(a) OVER (PARTITION BY sample_id, channel ORDER BY a) AS nx FROM r2) r JOIN n2 USING (sample_id, channel) WHERE r.a < aa),
 s2 AS (SELECT n2.sample_id, n2.channel, direct, greatest(coalesce((SELECT min(a) FROM c2 WHERE c2.sample_id = n2.sample_id AND c2.channel = n2.channel AND ok = 1), aa) - 2, 3) AS start FROM n2)
 SELECT sample_id, channel, CASE WHEN direct IS NOT NULL THEN 'direct' ELSE 'rms_joint_fallback' END AS rule, CAST(start AS INTEGER) AS start, CASE WHEN start + 24 > 64 THEN 'overflow' ELSE 'ok' END AS status FROM s2""", "traces"))  # fmt: skip
