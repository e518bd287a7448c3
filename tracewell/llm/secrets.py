"""Secret scan in DataFrame functions alone.

Base spans come from three patterns. The method adds candidate strings of one character class (hexadecimal digits,
base-64 characters) in which some window of fixed length has a high Shannon entropy. The window slides by one
character; counts and the sum of n log n change only for the character that enters and the one that leaves.
Candidates that an allow-list pattern matches, or that overlap a base span, are suppressed.

A candidate has 24 characters or more and a digit. Shorter ones, and the 1.7 % of random base-64 strings of 24
characters that have no digit, are left to the base kinds, as words joined by capitals look alike.

Defined results: a null or empty text has no spans; a null doc_id stays null; repeated rows give repeated rows; a very
long text is scanned whole; an empty table gives an empty result; further columns of the input are not read by `scan`
and are kept by `redact`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Base kinds in their order: pattern, group whose length counts, least length. For runs of one class, a least
#: repetition in the pattern finds the same spans as filtering the runs afterwards, and far fewer strings.
BASE = {
    "assign": (r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    "access": (r"AKIA[A-Z0-9]{12,}", 0, 16),
    "hex": (r"[0-9a-f]{32,}", 0, 32),
}
#: Kinds that the method adds: alphabet, pattern of candidates, window, bits a character from which it is a secret.
CLASSES = {
    "entropy_hex": ("0123456789ABCDEF", r"(?<![A-Za-z0-9+/_-])(?=[A-Fa-f]*[0-9])[0-9A-Fa-f]{24,}(?![A-Za-z0-9+/_-])", 24, 3.0),
    "entropy_b64": (
        "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-",
        r"(?<![A-Za-z0-9+/_-])(?=[a-z+/_-]*[A-Z0-9])(?=[A-Za-z+/_-]*[0-9])[A-Za-z0-9+/_-]{24,}", 24, 3.9,
    ),
}
#: Fixed strings, and shapes of whole candidates (identifiers, paths of small letters), that are no secrets however mixed they look.
ALLOW = r"(?i)example|sample|dummy|placeholder|changeme|xxxxxx|0123456789|1234567890|abcdefgh|^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$|^(?-i:/?(?:[a-z_-]+[0-9]{0,4}/){2,}[a-z_-]*[0-9]{0,4})$"
MARK = "[SECRET]"
_SPAN = "array<struct<start:int,rank:int,end:int,kind:string,value:string>>"


def _found(text: Column, pattern: str, group: int, least: int, rank: int, kind: str) -> Column:
    """Spans of the matches whose group is long enough: the pieces between matches give the places."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    groups = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else matches
    between = F.slice(F.split(text, pattern, -1), 1, F.size(matches))
    parts = F.arrays_zip(between.alias("gap"), matches.alias("match"), groups.alias("group"))
    none = F.array().cast(_SPAN)

    def step(acc: Column, x: Column) -> Column:
        at = acc["at"] + F.length(x["gap"])
        end = at + F.length(x["match"])
        span = F.struct(at.alias("start"), F.lit(rank).alias("rank"), end.alias("end"), F.lit(kind).alias("kind"), x["group"].alias("value"))
        ok = F.length(x["group"]) >= least
        return F.struct(end.alias("at"), F.when(ok, F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).cast(_SPAN).alias("out"))

    spans = F.aggregate(parts, F.struct(F.lit(0).alias("at"), none.alias("out")), step)["out"]
    return F.when(text.rlike(pattern), spans).otherwise(none)


def entropy(value: str, alphabet: str, window: int) -> str:
    """SQL for the largest entropy, in bits a character, of any window of a string over the alphabet."""
    n = len(alphabet)
    f = lambda x: f"if({x} > 1, ({x}) * log2({x}), 0D)"
    x, o, full = "ix[i]", f"ix[i - {window}]", f"i >= {window}"
    left = f"(st.c[{x}] - if({full}, if({o} = {x}, 1, 0), 0))"
    s = f"(st.s + if({full}, {f(f'(st.c[{o}] - 1)')} - {f(f'st.c[{o}]')}, 0D) + {f(f'({left} + 1)')} - {f(left)})"
    return f"""
    element_at(transform(array(filter(transform(split({value}, ''), ch -> instr('{alphabet}', ch) - 1), k -> k >= 0)), ix ->
      aggregate(sequence(0, size(ix) - 1),
        named_struct('c', array_repeat(0, {n}), 's', 0D, 'best', 0D),
        (st, i) -> named_struct(
          'c', transform(st.c, (v, k) -> v + if(k = {x}, 1, 0) - if({full}, if(k = {o}, 1, 0), 0)),
          's', {s},
          'best', if(i >= {window} - 1, greatest(st.best, log2({window}) - {s} / {window}), st.best)),
        st -> st.best)), 1)"""


def scan(docs: DataFrame) -> DataFrame:
    """(row, text, base, added): docs as the struct `row`, and arrays of spans in order."""
    text = F.coalesce("text", F.lit(""))
    base = [_found(text, p, g, n, i, k) for i, (k, (p, g, n)) in enumerate(BASE.items())]
    out = docs.select(F.struct(*docs.columns).alias("row"), "text").withColumn("base", F.array_sort(F.concat(*base)))
    for i, (kind, (alphabet, pattern, window, bits)) in enumerate(CLASSES.items()):
        value = "upper(x.value)" if kind == "entropy_hex" else "x.value"
        out = out.withColumn(kind, _found(text, pattern, 0, window, len(BASE) + i, kind))
        out = out.withColumn(
            kind,
            F.expr(f"""filter({kind}, x -> not exists(base, y -> y.start < x.end and x.start < y.end)
                       and not rlike(x.value, r'{ALLOW}') and {entropy(value, alphabet, window)} >= {bits}D)"""),
        )
    hexes, b64 = CLASSES
    added = F.expr(f"array_sort(concat({hexes}, filter({b64}, x -> not exists({hexes}, y -> y.start < x.end and x.start < y.end))))")
    return out.withColumn("added", added).drop(hexes, b64)


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def redact(docs: DataFrame) -> DataFrame:
    """docs with every span replaced by MARK in text, and n_chars as it then is."""

    def step(acc: Column, x: Column) -> Column:
        gap = F.when(x["start"] >= acc["at"], F.concat(F.substring(F.col("text"), acc["at"] + 1, x["start"] - acc["at"]), F.lit(MARK))).otherwise(F.lit(""))
        return F.struct(F.greatest(acc["at"], x["end"]).alias("at"), F.concat(acc["out"], F.array(gap)).alias("out"))

    spans = F.array_sort(F.concat("base", "added"))
    cut = F.aggregate(spans, F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out")), step, lambda a: F.concat(F.array_join(a["out"], ""), F.substring(F.col("text"), a["at"] + 1, F.length("text"))))
    out = scan(docs).withColumn("text", F.when(F.size(spans) > 0, cut).otherwise(F.col("text")))
    own = {"text": F.col("text"), "n_chars": F.length("text").cast(docs.schema["n_chars"].dataType) if "n_chars" in docs.columns else None}
    return out.select(*(own[c].alias(c) if c in own else F.col("row")[c].alias(c) for c in docs.columns))


def op4_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    return scan(docs).select(
        "row.doc_id", *(count(k) for k in BASE), F.sha2(listed(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        listed(F.array_sort(F.concat("base", "added"))).alias("spans"), F.size("added").cast("long").alias("n_entropy"),
    )
