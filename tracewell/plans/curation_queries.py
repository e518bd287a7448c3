"""Curation queries over the sample pool."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import curation as C
from .registry import register
from .views import pool, sql, table

T = [0.8, 1.2]
RATIOS = {"train": 0.6, "val": 0.15, "test": 0.25}
#: Labels as SQL.
LABEL = "CAST((CASE WHEN depth_value >= 0.8 THEN 1 ELSE 0 END) + (CASE WHEN depth_value >= 1.2 THEN 1 ELSE 0 END) AS INTEGER)"
LP = f"lp AS (SELECT *, {LABEL} AS label FROM pool)"
#: Shares by largest remainder as SQL.
ALLOCATED = f"""{LP}, sz AS (SELECT label, count(*) AS n FROM lp GROUP BY label),
 sh AS (SELECT label, n, i, split, n * ratio AS exact FROM sz, (VALUES (0, 'train', CAST(0.6 AS DOUBLE)), (1, 'val', CAST(0.15 AS DOUBLE)), (2, 'test', CAST(0.25 AS DOUBLE))) AS v(i, split, ratio)),
 od AS (SELECT *, n - sum(floor(exact)) OVER (PARTITION BY label) AS lft, row_number() OVER (PARTITION BY label ORDER BY exact - floor(exact) DESC, i) AS o FROM sh),
 al AS (SELECT label, i, split, exact, CAST(floor(exact) AS BIGINT) + CASE WHEN o <= lft THEN 1 ELSE 0 END AS allocated FROM od)"""
SPLITTED = f"""{ALLOCATED}, cu AS (SELECT label, i, split, sum(allocated) OVER (PARTITION BY label ORDER BY i) AS hi, sum(allocated) OVER (PARTITION BY label ORDER BY i) - allocated AS lo FROM al),
 rk AS (SELECT sample_id, pool_row, depth_value, label, row_number() OVER (PARTITION BY label ORDER BY md5('42:' || CAST(sample_id AS VARCHAR)), sample_id) AS r FROM lp),
 st AS (SELECT rk.sample_id, rk.pool_row, rk.depth_value, rk.label, cu.split FROM rk JOIN cu ON rk.label = cu.label AND rk.r > cu.lo AND rk.r <= cu.hi)"""


def lpool(spark, d):
    return C.labelled(pool(spark, d), T)


def manifest(spark, d):
    """A frozen manifest as another run would have left it: other ids for part of the pool, stored order by hash."""
    p = pool(spark, d).select("split", (F.col("sample_id") + F.when(F.col("sample_id") % 97 == 0, 1_000_000_000).otherwise(0)).alias("sample_id"))
    return p.withColumn("position", F.md5(F.col("sample_id").cast("string").cast("binary")))


MANIFEST = "mf AS (SELECT split, sample_id + CASE WHEN sample_id % 97 = 0 THEN 1000000000 ELSE 0 END AS sample_id FROM pool), mo AS (SELECT split, sample_id, md5(CAST(sample_id AS VARCHAR)) AS position FROM mf)"

register("digitize", lambda s, d: lpool(s, d).select("sample_id", "label"), sql(f"SELECT sample_id, {LABEL} AS label FROM pool", "pool"))
register("rebuild_pool", lambda s, d: C.pool_problems(C.split_union({k: pool(s, d).where(F.col("split") == k).drop("split") for k in C.SPLITS})), sql("""
SELECT count(*) AS n_rows, count(*) - count(DISTINCT pool_row) AS duplicate_rows, max(pool_row) + 1 - count(DISTINCT pool_row) AS gaps,
 count(*) FILTER (depth_value IS NULL OR isnan(depth_value) OR isinf(depth_value)) AS bad_depth, count(*) FILTER (sample_id IS NULL OR CAST(sample_id AS VARCHAR) = '') AS empty_ids, count(*) - count(DISTINCT sample_id) AS duplicate_ids FROM pool""", "pool"))  # fmt: skip
register("scan_all_splits", lambda s, d: C.split_union({k: pool(s, d).where(F.col("split") == k).drop("split") for k in C.SPLITS}).select("sample_id", "split"), sql("SELECT sample_id, split FROM pool", "pool"))
register("split_union", lambda s, d: lpool(s, d).where(F.col("split").isin("train", "val")).withColumn("part", F.lit("dev")).unionByName(lpool(s, d).where("split = 'test'").withColumn("part", F.lit("test"))).groupBy("part", "label").agg(F.count("*").alias("n")),
         sql(f"WITH {LP} SELECT CASE WHEN split = 'test' THEN 'test' ELSE 'dev' END AS part, label, count(*) AS n FROM lp GROUP BY ALL", "pool"))
register("pool_tiling", lambda s, d: C.pool_tiling(pool(s, d).where("sample_id % 101 <> 0").union(pool(s, d).where("sample_id % 211 = 0")), table(s, d, "orders").count()), sql("""
WITH x AS (SELECT pool_row FROM pool WHERE sample_id % 101 <> 0 UNION ALL SELECT pool_row FROM pool WHERE sample_id % 211 = 0), c AS (SELECT pool_row, count(*) AS n FROM x GROUP BY 1),
 a AS (SELECT coalesce(c.pool_row, r.i) AS pool_row, CASE WHEN n IS NULL THEN 'missing' WHEN r.i IS NULL THEN 'extra' WHEN n > 1 THEN 'duplicate' END AS problem FROM c FULL JOIN (SELECT unnest(range((SELECT count(*) FROM orders))) AS i) r ON c.pool_row = r.i)
SELECT * FROM a WHERE problem IS NOT NULL""", "pool"))  # fmt: skip
register("keep_split", lambda s, d: C.keep_split(pool(s, d)).select("sample_id", "split", "split_rank"), sql("SELECT sample_id, split, row_number() OVER (PARTITION BY split ORDER BY pool_row) - 1 AS split_rank FROM pool", "pool"))
register("limit_split", lambda s, d: C.limit_split(pool(s, d), 50).select("sample_id", "split"), sql("SELECT sample_id, split FROM pool QUALIFY row_number() OVER (PARTITION BY split ORDER BY pool_row) <= 50", "pool"))
register("allocate_counts", lambda s, d: C.allocate_counts(lpool(s, d).groupBy("label").agg(F.count("*").alias("n")), RATIOS).select("label", "split", "allocated"), sql(f"WITH {ALLOCATED} SELECT label, split, allocated FROM al", "pool"))
register("stratified_split", lambda s, d: C.stratified_split(lpool(s, d), RATIOS, 42, allow_small_classes=True).select("sample_id", "label", "split"), sql(f"WITH {SPLITTED} SELECT sample_id, label, split FROM st", "pool"))
register("class_sample", lambda s, d: C.class_sample(lpool(s, d), 25, 7).select("sample_id", "label", "short"), sql(f"""WITH {LP}, r AS (SELECT sample_id, label FROM lp QUALIFY row_number() OVER (PARTITION BY label ORDER BY md5('7:' || CAST(sample_id AS VARCHAR)), sample_id) <= 25)
 SELECT sample_id, label, count(*) OVER (PARTITION BY label) < 25 AS short FROM r""", "pool"))  # fmt: skip
COUNTS = f"""{LP}, ce AS (SELECT CAST(l AS INTEGER) AS label, split FROM range(4) AS t(l), (VALUES ('train'), ('val'), ('test')) AS v(split)),
 f AS (SELECT split, label, count(*) AS n, min(depth_value) AS depth_min, max(depth_value) AS depth_max FROM lp GROUP BY ALL),
 cc AS (SELECT split, label, coalesce(n, 0) AS n, depth_min, depth_max FROM ce LEFT JOIN f USING (split, label))"""
register("class_counts", lambda s, d: C.class_counts(lpool(s, d), 4), sql(f"WITH {COUNTS} SELECT split, label, n, n / greatest(sum(n) OVER (PARTITION BY split), 1) AS share, depth_min, depth_max FROM cc", "pool"))
register("relabel_report", lambda s, d: C.relabel_report(C.labelled(lpool(s, d), [1.0, 2.0], "new"), "label", "new", 20), sql(f"""WITH {LP}, n AS (SELECT label, CAST((CASE WHEN depth_value >= 1.0 THEN 1 ELSE 0 END) + (CASE WHEN depth_value >= 2.0 THEN 1 ELSE 0 END) AS INTEGER) AS new FROM lp),
 z AS (SELECT new, count(*) AS n FROM n GROUP BY 1) SELECT (SELECT arg_min(new, (n, new)) FROM z) AS smallest_class, (SELECT min(n) FROM z) AS smallest_n, (SELECT min(n) FROM z) < 20 AS is_tiny, (SELECT count(*) FROM z) AS classes,
 count(*) FILTER (label = new) AS agree, count(*) AS n_rows FROM n""", "pool"))  # fmt: skip
register("manifest_align", lambda s, d: C.manifest_align(manifest(s, d), lpool(s, d)).select("split", "position", "sample_id", "label", "depth_value"), sql(f"WITH {LP}, {MANIFEST} SELECT mo.split, position, sample_id, label, depth_value FROM mo JOIN lp USING (sample_id)", "pool"))
MISSING = f"""{MANIFEST}, me AS (SELECT sample_id, 'missing' AS problem FROM mf WHERE sample_id NOT IN (SELECT sample_id FROM pool) UNION ALL SELECT sample_id, 'extra' FROM pool WHERE sample_id NOT IN (SELECT sample_id FROM mf)
 UNION ALL SELECT sample_id, 'duplicate' FROM mf GROUP BY 1 HAVING count(*) > 1)"""
register("pool_missing_extra", lambda s, d: C.missing_extra(manifest(s, d), pool(s, d)), sql(f"WITH {MISSING} SELECT * FROM me", "pool"))


def _class_check(s, d):
    found = lpool(s, d).groupBy("split", "label").agg(F.count("*").alias("n"))
    wanted = lpool(s, d).join(manifest(s, d).select("sample_id"), "sample_id", "left_semi").groupBy("split", "label").agg(F.count("*").alias("n"))
    return C.class_check(wanted, found)


register("manifest_class_check", _class_check, sql(f"""WITH {LP}, {MANIFEST}, w AS (SELECT split, label, count(*) AS wanted FROM lp WHERE sample_id IN (SELECT sample_id FROM mf) GROUP BY ALL), g AS (SELECT split, label, count(*) AS found FROM lp GROUP BY ALL)
 SELECT split, label, coalesce(wanted, 0) AS wanted, coalesce(found, 0) AS found FROM w FULL JOIN g USING (split, label) WHERE coalesce(wanted, 0) <> coalesce(found, 0)""", "pool"))  # fmt: skip
register("class_count_dev", lambda s, d: C.class_count_dev(lpool(s, d)), sql(f"WITH {LP} SELECT CAST(max(label) + 1 AS INTEGER) AS num_classes FROM lp WHERE split IN ('train', 'val')", "pool"))


# Schemes and names, from numbers and strings of the tables.
PRICES = "SELECT p_partkey, [CAST(p_size AS DOUBLE) / 10, CAST(p_size + p_partkey % 7 - 1 AS DOUBLE) / 10] AS t FROM part"


def schemes(s, d):
    t = F.array((F.col("p_size").cast("double") / 10), ((F.col("p_size") + F.col("p_partkey") % 7 - 1).cast("double") / 10))
    return table(s, d, "part").select("p_partkey", t.alias("t"))


G = "printf('%g', CAST({0} AS DOUBLE))"
register("scheme_tag", lambda s, d: schemes(s, d).select("p_partkey", S.scheme_tag(F.col("t")).alias("tag")), f"SELECT p_partkey, 'cls3_thr' || {G.format('t[1]')} || '-' || {G.format('t[2]')} AS tag FROM ({PRICES})")
register("class_names", lambda s, d: schemes(s, d).select("p_partkey", F.array_join(S.class_names(F.col("t")), "|").alias("names")), f"SELECT p_partkey, 'depth < ' || {G.format('t[1]')} || '|' || {G.format('t[1]')} || ' <= depth < ' || {G.format('t[2]')} || '|depth >= ' || {G.format('t[2]')} AS names FROM ({PRICES})")
register("scheme_validate", lambda s, d: schemes(s, d).select("p_partkey", F.array_join(S.scheme_errors(S.parse_thresholds(F.concat_ws(";", F.transform("t", lambda x: x.cast("string"))))), ",").alias("errors")), f"SELECT p_partkey, CASE WHEN t[1] >= t[2] THEN 'not_increasing' ELSE '' END AS errors FROM ({PRICES})")
