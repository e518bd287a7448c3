"""Quality rules kept as a ledger of failure bits and measurements.

Every rule is evaluated once per document; its outcome is one bit of `failures`. A policy is a versioned
bit mask, so applying another policy or asking what a rule costs reads the ledger alone.

Defined results: a null or empty text has no words, symbols or lines (it fails too_short); a null doc_id
stays null; repeated rows give repeated rows; a very long text is a block of its own; an empty table gives an empty
ledger; further columns of the input are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import written
from .textscan import SPACE, blocks, hashed, mix, odd, shingles, words

MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_upper", "n_letters")
SYMBOL = np.zeros(256, bool)
SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_LINE = np.zeros(256, bool)
_LINE[0x0A] = True
_UPPER = np.zeros(256, bool)
_UPPER[ord("A") : ord("Z") + 1] = True
_LETTER = _UPPER.copy()
_LETTER[ord("a") : ord("z") + 1] = True


def _repeated(keys: np.ndarray) -> np.ndarray:
    """Which keys occur twice or more."""
    order = np.argsort(keys, kind="stable")
    same = keys[order[1:]] == keys[order[:-1]]
    out = np.zeros(len(keys), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def measured(column: pa.Array) -> pa.Array:
    """MEASURES of each text, as a struct."""
    out = {k: np.zeros(len(column), np.int64) for k in MEASURES}
    for i, j, b, at in blocks(column):
        n, here = j - i, slice(i, j)

        def per_row(flags, at=at):
            return np.diff(np.concatenate(([0], np.cumsum(flags)))[at])

        start, end, row = words(b, at)
        out["n_words"][here] = np.bincount(row, minlength=n)
        out["word_chars"][here] = per_row(~SPACE[b] & ((b & 0xC0) != 0x80))
        for k, table in (("n_symbols", SYMBOL), ("n_upper", _UPPER), ("n_letters", _LETTER)):
            out[k][here] = per_row(table[b])
        salt = odd(1, 11)[0]
        h, first = shingles(hashed(b, start, end), row, 3)
        again = first[_repeated(mix(h + row[first].astype(np.uint64) * salt))]
        hit = np.zeros(len(row) + 2, bool)
        for k in range(3):
            hit[again + k] = True
        out["n_repeat_words"][here] = np.bincount(row[hit[: len(row)]], minlength=n)
        a, z, at_row = words(b, at, _LINE)
        full = np.searchsorted(start, z) > np.searchsorted(start, a)
        a, z, at_row = a[full], z[full], at_row[full]
        keys = mix(hashed(b, a, z) + at_row.astype(np.uint64) * salt)
        _, first = np.unique(keys, return_index=True)
        out["n_lines"][here] = np.bincount(at_row, minlength=n)
        out["n_dup_lines"][here] = out["n_lines"][here] - np.bincount(at_row[first], minlength=n)
    return pa.StructArray.from_arrays([pa.array(v) for v in out.values()], names=list(out))


def measure(text: str) -> Column:
    return F.arrow_udf(measured, ", ".join(f"{k} long" for k in MEASURES))(text)


#: Rule names in the order of their bits, each with its condition on a struct of measurements.
RULES = {
    "too_short": lambda m: m.n_words < 50,
    "repeats_itself": lambda m: 100 * m.n_repeat_words > 50 * m.n_words,
    "symbols": lambda m: 100 * m.n_symbols > 20 * m.n_words,
    "duplicate_lines": lambda m: 100 * m.n_dup_lines > 50 * m.n_lines,
    "word_length": lambda m: (m.word_chars < 2 * m.n_words) | (m.word_chars > 25 * m.n_words),
    "shouting": lambda m: 100 * m.n_upper > 50 * m.n_letters,
}
#: Rules that each version of the policy enforces.
POLICIES = {
    "base": ("too_short", "repeats_itself"),
    "v1": tuple(RULES),
    "v2": ("too_short", "repeats_itself", "duplicate_lines", "word_length"),
}


def mask(rules: tuple[str, ...] | list[str]) -> int:
    return sum(1 << list(RULES).index(r) for r in rules)


class _Fields:
    def __init__(self, m: Column):
        self.m = m

    def __getattr__(self, name: str) -> Column:
        return self.m.getField(name)


def failures(m: Column) -> Column:
    """The bits of the rules that a struct of measurements fails."""
    bits = [F.when(rule(_Fields(m)), F.lit(1 << i)).otherwise(F.lit(0)) for i, rule in enumerate(RULES.values())]
    return sum(bits[1:], bits[0]).cast("long")


def ledger(docs: DataFrame) -> DataFrame:
    """doc_id, every measurement, and `failures`."""
    m = docs.select("doc_id", measure("text").alias("m"))
    return m.select("doc_id", "m.*", failures(F.col("m")).alias("failures"))


def kept(bits: Column, version: str = "v1") -> Column:
    return bits.bitwiseAND(F.lit(mask(POLICIES[version]))) == 0


def ablations(ledger: DataFrame, version: str = "v1") -> DataFrame:
    """For each rule of a policy: rows that fail it, rows that only it rejects, and rows kept without it.

    The ledger is first counted by its bits, at most 2**rules rows however large the corpus is.
    """
    names, spark = POLICIES[version], ledger.sparkSession
    combos = ledger.groupBy(F.col("failures").bitwiseAND(mask(names)).alias("bits")).count()
    rules = spark.createDataFrame([(n, mask([n])) for n in names], "rule string, bit long")
    fails = F.col("bits").bitwiseAND(F.col("bit")) != 0
    return (
        combos.join(F.broadcast(rules))
        .groupBy("rule")
        .agg(
            F.sum(F.when(fails, F.col("count")).otherwise(0)).alias("n_failed"),
            F.sum(F.when(F.col("bits") == F.col("bit"), F.col("count")).otherwise(0)).alias("n_only"),
            F.sum(F.when(F.col("bits").bitwiseAND(F.bitwise_not("bit")) == 0, F.col("count")).otherwise(0)).alias("n_kept_without"),
        )
    )


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    bits = F.col("failures")
    base_failed = bits.bitwiseAND(mask(POLICIES["base"])) != 0
    return ledger(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base_failed.alias("base_failed"), (~base_failed & kept(bits)).alias("kept"), "n_lines", "failures",
    )


def quality_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each version of the policy, what each of its rules costs, from the ledger of all documents."""
    rows = written(ledger(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    each = [ablations(rows, v).withColumn("version", F.lit(v)) for v in POLICIES]
    return each[0].unionByName(each[1]).unionByName(each[2])


_LEDGER = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
p AS (SELECT r, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM w),
g AS (SELECT r, i, struct_pack(a := word, b := lead(word) OVER q, c := lead(word, 2) OVER q) AS k,
             lead(word, 2) OVER q AS third FROM p WINDOW q AS (PARTITION BY r ORDER BY i)),
c AS (SELECT r, i, count(*) OVER (PARTITION BY r, k) AS n FROM g WHERE third IS NOT NULL),
h AS (SELECT r, count(DISTINCT i + o) AS n FROM c, range(3) AS t(o) WHERE n > 1 GROUP BY r),
m AS (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
             CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(len(ls) AS BIGINT) AS n_lines, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
             CAST(coalesce(h.n, 0) AS BIGINT) AS n_repeat_words,
             length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS n_upper,
             length(t) - length(regexp_replace(t, '[A-Za-z]', '', 'g')) AS n_letters
      FROM w LEFT JOIN h USING (r)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
             CAST((CASE WHEN n_words < 50 THEN 1 ELSE 0 END) + (CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END)
             + (CASE WHEN 100 * n_symbols > 20 * n_words THEN 4 ELSE 0 END) + (CASE WHEN 100 * n_dup_lines > 50 * n_lines THEN 8 ELSE 0 END)
             + (CASE WHEN word_chars < 2 * n_words OR word_chars > 25 * n_words THEN 16 ELSE 0 END)
             + (CASE WHEN 100 * n_upper > 50 * n_letters THEN 32 ELSE 0 END) AS BIGINT) AS failures FROM m)
"""
OP5_SQL = _LEDGER + "SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, failures = 0 AS kept, n_lines, failures FROM f"
ABLATIONS_SQL = _LEDGER + """, po(version, rule, bit, mask) AS (VALUES ('base', 'too_short', 1, 3), ('base', 'repeats_itself', 2, 3), ('v1', 'too_short', 1, 63), ('v1', 'repeats_itself', 2, 63), ('v1', 'symbols', 4, 63),
 ('v1', 'duplicate_lines', 8, 63), ('v1', 'word_length', 16, 63), ('v1', 'shouting', 32, 63), ('v2', 'too_short', 1, 27), ('v2', 'repeats_itself', 2, 27), ('v2', 'duplicate_lines', 8, 27), ('v2', 'word_length', 16, 27))
SELECT version, rule, count(*) FILTER (failures & bit <> 0) AS n_failed, count(*) FILTER (failures & mask = bit) AS n_only, count(*) FILTER (failures & mask & ~bit = 0) AS n_kept_without FROM f, po GROUP BY ALL"""
