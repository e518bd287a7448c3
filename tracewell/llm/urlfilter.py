"""URL filters: rules on a host with its subdomains and on the start of a path.

Each url is expanded into the expressions that a rule could hold: every suffix of its host, cut at dots, with every
prefix of its path, cut behind slashes. Rules and expressions meet by an equi-join on a short prefix of their SHA-256;
then the whole digests, and the rest of a rule's path behind its last slash, are compared. Of the rules that fit, the
longest wins. Expressions with more dots or slashes than any rule has are not made: none could fit.

A url's rule depends on its host and path alone, so the winners are kept by these (as 128 bits), and joined back to the
pages: rows without a rule are never exploded beyond one task, and a hot url or host costs no more than its rows.

Defined results: a null url, and one without `://`, has an empty host and path, which no rule with a host fits; null
and repeated page_ids, and repeated rows, stay rows of their own; a very long url makes as many expressions as the
rules' dots and slashes allow, not more; an empty table gives no rows; without rules every page gets the default.
Other columns of the pages are not read. Rules with a null part, or of another verdict than allow or block, raise.
Of rules with one text the blocking one counts; of different rules of one length the one with the longer host.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import with_keys, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Hexadecimal digits of a digest by which rules and expressions are joined (32 bits).
PREFIX = 8
RULE = "host string, path string, verdict string"
#: The rules of the query.
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def lowered(text: Column) -> Column:
    """A-Z in lower case, nothing else changed."""
    return F.translate(text, UPPER, LOWER)


def host_and_path(url: str) -> tuple[Column, Column]:
    """Host: behind the first `://` up to a slash, question mark or hash; path: from there up to the latter two."""
    at = F.locate("://", F.col(url))
    rest = F.when(at > 0, F.substring(F.col(url), at + 3, F.length(url))).otherwise("")
    return lowered(F.regexp_extract(rest, r"^([^/?#]*)([^?#]*)", 1)), F.regexp_extract(rest, r"^([^/?#]*)([^?#]*)", 2)


def count_of(text: Column, mark: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(mark), F.lit("")))


def _last(host: Column, labels: Column) -> Column:
    """The last labels of a host, with the dots between them."""
    return F.call_function("substring_index", host, F.lit("."), -labels)


def _first(path: Column, slashes: Column) -> Column:
    """path up to and with the slash of that number; empty for 0."""
    return F.when(slashes == 0, "").otherwise(F.concat(F.call_function("substring_index", path, F.lit("/"), slashes), F.lit("/")))


def expressions(host: Column, path: Column, dots: int, slashes: int) -> Column:
    """Every suffix of host with up to `dots` dots, joined to every prefix of path that ends with one of its first `slashes` slashes, or is empty."""
    suffixes = F.transform(F.sequence(F.lit(1), F.least(count_of(host, "."), F.lit(dots)) + 1), lambda i: _last(host, i))
    prefixes = F.transform(F.sequence(F.lit(0), F.least(count_of(path, "/"), F.lit(slashes))), lambda k: _first(path, k))
    return F.flatten(F.transform(suffixes, lambda h: F.transform(prefixes, lambda p: F.concat(h, p))))


def checked(rules: DataFrame) -> DataFrame:
    """rules, written, with their key (host, and path up to its last slash), its digest and the rank of the rule; bad rows raise."""
    own = rules.select(lowered(F.col("host")).alias("rule_host"), F.col("path").alias("rule_path"), F.col("verdict").alias("rule_verdict"))
    bad = own.where("rule_host is null or rule_path is null or rule_verdict is null or rule_verdict not in ('allow', 'block')")
    if wrong := bad.limit(1).collect():
        raise ValueError(f"rule {tuple(wrong[0])}: host, path and a verdict of allow or block are needed")
    key = F.concat("rule_host", F.regexp_extract("rule_path", r"(?s)^.*/", 0))
    text = F.concat("rule_host", "rule_path")
    rank = F.struct(F.length(text).alias("len"), F.length("rule_host").alias("host_len"), (F.col("rule_verdict") == "block").alias("blocks"), text.alias("text"), F.col("rule_verdict").alias("verdict"))
    return written(own.distinct().select("rule_host", "rule_path", F.sha2(key, 256).alias("rule_digest"), rank.alias("rank")))


def judged(pages: DataFrame, rules: DataFrame, default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(id, host, path, rule, verdict) of every row of pages, under rules (host, path, verdict)."""
    rules = checked(rules)
    n_rules, dots, slashes = rules.agg(F.count("*"), F.max(count_of(F.col("rule_host"), ".")), F.max(count_of(F.col("rule_path"), "/"))).first()
    host, path = host_and_path("_url")
    urls = pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url")).select("_id", host.alias("host"), path.alias("path"))
    urls = urls.withColumns({"k1": F.xxhash64("host", "path"), "k2": F.xxhash64(F.lit("second"), "path", "host")})
    out = lambda df, rule, verdict: df.select(F.col("_id").alias(id_col), "host", "path", rule.alias("rule"), verdict.alias("verdict"))
    if not n_rules:
        return out(urls, F.lit(None).cast("string"), F.lit(default))
    each = urls.select("k1", "k2", "path", F.explode(expressions(F.col("host"), F.col("path"), dots, slashes)).alias("e"))
    each = each.select("k1", "k2", "path", F.sha2("e", 256).alias("digest"))
    short = lambda c: F.substring(c, 1, PREFIX)
    met = with_keys(each.withColumn("short", short("digest")), rules.withColumn("short", short("rule_digest")), "short", rows=n_rules)
    fits = met.where((F.col("digest") == F.col("rule_digest")) & F.startswith("path", "rule_path"))
    best = written(fits.groupBy("k1", "k2").agg(F.max("rank").alias("rank")).select("k1", "k2", F.col("rank.text").alias("rule"), F.col("rank.verdict").alias("verdict")))
    n = 4 * best.count()  # rows with two short texts: a quarter as many may be broadcast
    return out(with_keys(urls, best, ["k1", "k2"], "left", rows=n), F.col("rule"), F.coalesce("verdict", F.lit(default)))


def op12_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(spark.read.parquet(f"{sf_dir}/pages.parquet"), spark.createDataFrame(RULES, RULE))


OP12_SQL = r"""
WITH u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '^([^/?#]*)([^?#]*)', 2) AS path FROM u),
q AS (SELECT *, CASE WHEN ('.' || host) LIKE '%.example.net' AND starts_with(path, '/en/') THEN 'example.net/en/'
                     WHEN ('.' || host) LIKE '%.example.com' AND starts_with(path, '/de/') THEN 'example.com/de/'
                     WHEN ('.' || host) LIKE '%.org' AND starts_with(path, '/fr/') THEN 'org/fr/'
                     WHEN ('.' || host) LIKE '%.net' AND starts_with(path, '/') THEN 'net/' END AS rule FROM p)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict FROM q
"""
