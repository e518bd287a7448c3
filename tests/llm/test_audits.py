"""Filter audit, URL filters and whitening against brute force, and the edges of their input."""

import itertools
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tracewell.llm import filteraudit, urlfilter, whitening

# Filter interaction audit.
DOCS, LABELS = "doc_id long, text string, source string, part string, mask int, k1 string", "doc_id long, quality int, toxic int"


def plain_masks(rows):
    """Part, labels and failed letters of every row (doc_id, text, source, good, toxic)."""
    least = {}
    for d, t, *_ in rows:
        if d is not None:
            least[t or ""] = min(d, least.get(t or "", d))
    for d, t, s, good, toxic in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        failed = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": d is not None and d > least[t]}
        yield s or "", good, toxic, {k for k, f in failed.items() if f}


def plain_audit(rows):
    out, shapley = {}, Counter()
    docs = list(plain_masks(rows))
    for part in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == part]
        for order in map("".join, itertools.permutations("ABCDE")):
            for step, f in enumerate(order, 1):
                there = [d for d in own if not d[3] & set(order[: step - 1])]
                gone = [d for d in there if f in d[3]]
                out[part, order, step] = [len(there) - len(gone), len(gone), sum(f in d[3] for d in own) - len(gone), sum(d[3] == {f} for d in own), sum(d[1] for d in gone), sum(d[2] for d in gone)]
                shapley[part, f] += len(gone)
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def audit_rows(n=260):
    rng = random.Random(4)
    long = [" ".join(f"w{rng.randrange(m)}" for _ in range(230)) for m in (60, 5000)]
    texts = [None, "", "few words", "FEW words", "a $ b", *long, long[1].upper(), long[1] + " %", "é" * 30_000, "a b " * 40_000]
    rows = [(rng.choice([None, *range(150)]), rng.choice(texts), rng.choice([None, "", "s1", "s2"])) for _ in range(n)]
    labels = {d: (rng.randrange(2), rng.randrange(2)) for d in range(0, 150, 2)}
    return [(d, t, s, *labels.get(d, (0, 0))) for d, t, s in rows], [(d, *v) for d, v in labels.items()] + [(None, 1, 1), (0, 0, 0), (1, None, None)]


def audit_table(spark, rows):
    return spark.createDataFrame([(d, t, s, "x", 7, "y") for d, t, s, *_ in rows], DOCS)


def collected(df):
    return {tuple(r)[:3]: tuple(r)[3:] for r in df.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley").collect()}


def test_audit_equals_brute_force_over_many_batches(spark, tmp_path):
    rows, labels = audit_rows()
    audit_table(spark, rows).repartition(9).write.parquet(f"{tmp_path}/documents.parquet")
    counters = filteraudit.counted(spark, f"{tmp_path}/documents.parquet", spark.createDataFrame(labels, LABELS), batches=9)
    assert collected(filteraudit.interactions(counters)) == plain_audit(rows)
    assert counters.where("n <= 0").isEmpty()


def test_audit_takes_up_new_files_and_retracts(spark, tmp_path):
    rows, labels = audit_rows(120)
    late = [(-1, t, "late", 0, 0) for t in {r[1] for r in rows}]  # smaller than every id before
    table, at = spark.createDataFrame(labels, LABELS), f"{tmp_path}/state"
    for part in (rows[:50], rows[50:], late):
        audit_table(spark, part).coalesce(1).write.mode("append").parquet(f"{tmp_path}/documents.parquet")
        counters = filteraudit.counted(spark, f"{tmp_path}/documents.parquet", table, at)
    assert collected(filteraudit.interactions(counters)) == plain_audit(rows + late)
    again = filteraudit.counted(spark, f"{tmp_path}/documents.parquet", table, at)  # nothing new
    assert collected(filteraudit.interactions(again)) == plain_audit(rows + late)


def test_audit_repeats_a_batch_without_counting_it_twice(spark, tmp_path):
    rows, labels = audit_rows(80)
    ledger = filteraudit.Ledger(spark, spark.createDataFrame(labels, LABELS), str(tmp_path))
    for batch, part in ((0, rows[:30]), (1, rows[30:]), (1, rows[30:])):
        ledger.fold(audit_table(spark, part), batch)
    assert collected(filteraudit.interactions(ledger.read("counters", filteraudit.COUNTER))) == plain_audit(rows)


def test_audit_of_one_file_and_of_none(spark, tmp_path):
    rows, labels = audit_rows(40)
    table = spark.createDataFrame(labels, LABELS)
    audit_table(spark, rows).coalesce(1).write.parquet(f"{tmp_path}/a")
    file = next((tmp_path / "a").glob("part-*.parquet"))
    assert collected(filteraudit.interactions(filteraudit.counted(spark, str(file), table))) == plain_audit(rows)
    audit_table(spark, []).write.parquet(f"{tmp_path}/none")
    assert filteraudit.interactions(filteraudit.counted(spark, f"{tmp_path}/none", table)).count() == 0


# URL filters.
def plain_verdict(url, rules, default="allow"):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [(len(h + p), len(h), v == "block", h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *max(fits)[3:]) if fits else (host, path, None, default)


URLS = [
    None, "", "no scheme", "http://", "http://net", "http://net/", "HTTP://A.NET/x", "http://a.net?q=/en/", "http://a.net#/", "x://example.net/en/", "x://EXAMPLE.net/en", "x://www.example.net/en/a/b?c#d",
    "x://example.net/EN/", "x://notexample.net/en/a", "x://example.com/de/", "x://a.b.example.com/de/x", "x://example.com.evil.org/fr/", "x://org/fr/1", "x://user@net/", "x://net:80/", "x://.net/", "x://net./",
    "x://a..net//", "x://É.net/É/", "a://b://c.net/", "x://" + "a." * 3000 + "net/" + "b/" * 20_000, "x://net/" + "é" * 30_000, "x://net/\n/x", "/://net/y",
]


@pytest.mark.parametrize(
    "rules",
    [
        urlfilter.RULES,
        [("net", "", "allow"), ("net", "/e", "block"), ("net", "/en/", "allow"), ("NET", "/en/", "block"), ("a.net", "/", "allow"), ("", "", "block"), ("net", "x", "block"), ("b.net", "/b/", "allow"), ("", "/b/b/", "allow")],
    ],
)
def test_url_filters_equal_brute_force(spark, rules):
    rng = random.Random(2)
    urls = URLS + ["x://" + ".".join(rng.choices(["a", "b", "net", "example"], k=rng.randrange(1, 4))) + "/" + "".join(rng.choices(["en/", "e", "b/", "/"], k=rng.randrange(5))) for _ in range(150)]
    rows = [(i if i % 9 else None, u, "h", "p", "v") for i, u in enumerate(urls + urls[:30])]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, path string, verdict string")
    lower = [(h.lower(), p, v) for h, p, v in rules]
    got = urlfilter.judged(pages, spark.createDataFrame(rules, urlfilter.RULE)).select("page_id", "host", "path", "rule", "verdict").collect()
    assert sorted(map(tuple, got), key=repr) == sorted(((i, *plain_verdict(u, lower)) for i, u, *_ in rows), key=repr)


def test_url_filters_join_large_tables_by_shuffle(spark, monkeypatch):
    monkeypatch.setattr("tracewell.llm.scratch.BROADCAST_ROWS", 0)
    pages = spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string")
    got = urlfilter.judged(pages, spark.createDataFrame(urlfilter.RULES, urlfilter.RULE))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(((i, *plain_verdict(u, urlfilter.RULES)) for i, u in enumerate(URLS)), key=repr)


def test_url_filters_without_rows_or_rules(spark):
    pages = spark.createDataFrame([(1, "x://a.net/")], "page_id long, url string")
    rules = spark.createDataFrame(urlfilter.RULES, urlfilter.RULE)
    assert urlfilter.judged(pages.limit(0), rules).count() == 0
    assert tuple(urlfilter.judged(pages, rules.limit(0), default="block").first()) == (1, "a.net", "/", None, "block")
    for bad in ((None, "/", "block"), ("net", None, "block"), ("net", "/", "maybe"), ("net", "/", None)):
        with pytest.raises(ValueError, match="verdict"):
            urlfilter.judged(pages, spark.createDataFrame([bad], urlfilter.RULE))


def test_expressions(spark):
    one = spark.createDataFrame([("a.b.net", "/x/y")], "h string, p string")
    made = one.select(urlfilter.expressions(one.h, one.p, 9, 9).alias("e")).first().e
    assert sorted(made) == sorted(h + p for h in ("net", "b.net", "a.b.net") for p in ("", "/", "/x/"))
    assert sorted(one.select(urlfilter.expressions(one.h, one.p, 1, 1).alias("e")).first().e) == sorted(h + p for h in ("net", "b.net") for p in ("", "/"))


# Whitening.
VECTORS = "vec_id long, embedding array<double>, n string, x int, deviation string"


def vector_table(spark, vectors, ids=None):
    rows = [(i, None if v is None else [None if c is None else float(c) for c in v], "n", 1, "d") for i, v in zip(ids or range(len(vectors)), vectors, strict=True)]
    return spark.createDataFrame(rows, VECTORS)


def holds(got, vectors, k=32, rtol=1e-8):
    """got against a dense decomposition of the exact covariance: projections are compared by their spaces where eigenvalues are equal."""
    x = np.floor(64 * np.array(vectors, np.float64)).astype(np.int64) + 1_000_000
    n, s = len(x), x.sum(axis=0)
    y = (n * x - s) / n
    e = np.linalg.eigh(y.T @ y / n)[0][::-1]
    m = min(k, int((e > e[0] * 1e-17 * len(e) * n).sum()))
    table = defaultdict(dict)
    for r in got:
        table[r.vec_id][r.component] = r
    assert sorted(table) == list(range(n)) and all(sorted(v) == list(range(1, m + 1)) for v in table.values())
    z = np.array([[table[i][c].whitened for c in range(1, m + 1)] for i in range(n)])
    first = [table[0][c] for c in range(1, m + 1)]
    assert np.allclose([r.explained for r in first], e[:m] / e.sum(), rtol=rtol) and {r.n for r in got} == {n}
    assert len({r.identity_error for r in got}) == 1 and first[0].identity_error < 1e-9
    assert np.abs(z.T @ z / n - np.eye(m)).max() < 1e-9
    back = z.T @ y / n / np.sqrt(e[:m])[:, None]  # the components, if they are eigenvectors
    assert np.allclose(back @ back.T, np.eye(m), atol=1e-7) and np.allclose(back @ (y.T @ y / n), e[:m, None] * back, atol=1e-7 * e[0])
    for i in range(n):
        assert {r.deviation for r in table[i].values()} == {sum(int(v) ** 2 for v in n * x[i] - s)}


def test_whitening_equals_a_dense_decomposition(spark):
    rng = np.random.default_rng(1)
    v = rng.standard_normal((300, 40)) * np.linspace(1, 3, 40) + rng.standard_normal(40) * 50
    holds(whitening.whitened(vector_table(spark, v).repartition(5)).collect(), v)


@pytest.mark.parametrize("kind", ["few rows", "equal values", "low rank", "a hot vector", "one dimension", "large numbers"])
def test_whitening_of_special_tables(spark, kind):
    rng = np.random.default_rng(3)
    v = {
        "few rows": rng.standard_normal((6, 12)),
        "equal values": np.concatenate([np.eye(8), -np.eye(8)]),
        "low rank": np.round(rng.standard_normal((50, 3)) * 64) @ np.round(rng.standard_normal((3, 9)) * 4) / 64,
        "a hot vector": np.concatenate([rng.standard_normal((20, 5)), np.ones((200, 5))]),
        "one dimension": rng.standard_normal((30, 1)),
        "large numbers": np.round(rng.standard_normal((30, 4)) * 1e5),
    }[kind]
    holds(whitening.whitened(vector_table(spark, v).repartition(3)).collect(), v)


def test_whitening_leaves_out_what_cannot_count(spark):
    good = [[1.0, 2.0], [2.0, 1.0], [0.5, -1.0], [-0.25, 3.0]]
    bad = [None, [], [1.0, None], [float("nan"), 1.0], [float("inf"), 0.0], [0.0, -float("inf")], [1e300, 0.0], [1.0, 2.0, 3.0], [1.0]]
    got = whitening.whitened(vector_table(spark, good + bad)).collect()
    holds(got, good)
    repeated = whitening.whitened(vector_table(spark, [*good, good[0]], [7, 7, None, None, 1])).collect()
    assert sorted(Counter(r.vec_id for r in repeated).items(), key=repr) == [(1, 2), (7, 4), (None, 4)]
    for few in ([], bad[:1], [[1.0, 2.0]], [[1.0, 2.0]] * 3):
        assert whitening.whitened(vector_table(spark, few)).count() == 0


def test_whitening_beyond_64_bits(spark):
    v = [[1e15, 0.0], [-1e15, 1.0], [0.0, 2.0]]
    got = whitening.whitened(vector_table(spark, v)).collect()
    assert {r.vec_id: r.deviation for r in got}[0] is None and got[0].identity_error < 1e-6


def test_bidiagonal_matrix_and_its_steps():
    rng = np.random.default_rng(5)
    x = rng.standard_normal((80, 20))
    calls = []

    def product(w):
        calls.append(len(w))
        u = x @ w.T
        return u.T @ u[:, -1], x.T @ u[:, -1]

    b, v = whitening.bidiagonalised(product, 20, 20, np.linalg.norm(x))
    assert np.allclose(np.triu(b) - np.triu(b, 2), b) and np.allclose(v.T @ v, np.eye(20), atol=1e-13)
    u = x @ v @ np.linalg.inv(b)
    assert np.allclose(u.T @ u, np.eye(20), atol=1e-11) and np.allclose(np.linalg.svd(b)[1], np.linalg.svd(x)[1], rtol=1e-13)
    assert len(calls) < 30
