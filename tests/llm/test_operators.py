"""The other operators against brute force, and the edges of their input."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewell.llm import decontam, langid, packing, preferences, quality, secrets, sentences, sharding

EMPTY = "doc_id long, text string"


def docs(spark, rows, extra=True):
    """A table of documents, with further columns whose names clash with the operators' own."""
    if not extra:
        return spark.createDataFrame(rows, EMPTY)
    return spark.createDataFrame([(d, t, 5, "x") for d, t in rows], "doc_id long, text string, n_words long, shard string")


EDGES = [(1, None), (2, ""), (3, "  \n\t "), (None, "word"), (4, "same text here"), (4, "same text here"), (5, "é" * 30_000), (6, "a b " * 40_000)]


# Quality rules.
def measured(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    seen = Counter(zip(w, w[1:], w[2:], strict=False))
    hit = {i + k for i in range(len(w) - 2) for k in range(3) if seen[tuple(w[i : i + 3])] > 1}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines), len(lines) - len(set(lines)), len(hit), sum("A" <= c <= "Z" for c in t), sum(c.isascii() and c.isalpha() for c in t)


def test_quality_measures(spark):
    rng = random.Random(1)
    rows = [*EDGES, *((10 + i, "".join(rng.choice(["a ", "b ", "c#", "é", "\n", "A\x0b", "x y z "]) for _ in range(rng.randrange(90)))) for i in range(60))]
    got = sorted(tuple(r)[:9] for r in quality.ledger(docs(spark, rows)).fillna(-1, ["doc_id"]).collect())
    assert got == sorted((-1 if d is None else d, *measured(t)) for d, t in rows)
    assert quality.ledger(docs(spark, rows).limit(0)).count() == 0


def test_quality_policy_and_ablations(spark):
    rows = [(1, "few words"), (2, " ".join(f"w{i}" for i in range(60))), (3, " ".join(f"w{i}%" for i in range(60)))]
    led = quality.ledger(docs(spark, rows))
    kept = {r.doc_id: (r.base, r.v1) for r in led.select("doc_id", quality.kept(F.col("failures"), "base").alias("base"), quality.kept(F.col("failures")).alias("v1")).collect()}
    assert kept == {1: (False, False), 2: (True, True), 3: (True, False)}
    ab = {r.rule: (r.n_failed, r.n_only, r.n_kept_without) for r in quality.ablations(led).collect()}
    assert ab["too_short"] == (1, 1, 2) and ab["symbols"] == (1, 1, 2) and ab["shouting"] == (0, 0, 1)


# Sharding.
def test_sharding(spark):
    rows = [(i, f"t{i % 7}") for i in range(997)] + EDGES
    out = sharding.assign(docs(spark, rows).select("doc_id", "text"), shards=40).collect()
    per = defaultdict(list)
    for r in out:
        per[r.shard].append(r.slot)
    assert sorted((r.doc_id or -1, r.text or "") for r in out) == sorted((d or -1, t or "") for d, t in rows)
    assert max(map(len, per.values())) - min(map(len, per.values())) <= 1 and all(sorted(v) == list(range(len(v))) for v in per.values())
    assert sharding.assign(docs(spark, rows).select("doc_id", "text").limit(0)).count() == 0


def test_ring_overflow_goes_clockwise_and_moves_little():
    at, owner = sharding.ring(10, 64)
    keys = np.random.default_rng(0).integers(-(1 << 63), 1 << 63 - 1, 20_000)
    counts = np.bincount(np.searchsorted(at, keys) % len(at), minlength=len(at))
    cap = np.full(10, 2100)
    pieces = sharding.placed(counts, owner, cap)
    load = np.zeros(10, int)
    for _, _, n, s in pieces:
        load[s] += n
    assert load.sum() == 20_000 and (load <= cap).all()
    for arc, _, n, s in pieces:  # a row leaves its own shard only if that one is full
        assert s == owner[arc] or load[owner[arc]] == cap[owner[arc]]


def test_sharding_is_the_same_however_the_input_is_cut(spark, monkeypatch):
    """One key has a third of the rows, and one row is repeated in all its columns."""
    monkeypatch.setattr(sharding, "RUN", 7)
    keys = spark.range(6000).select(F.when(F.col("id") % 3 == 0, 5).otherwise(F.col("id")).alias("doc_id"), F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("id")).alias("size"))
    got = []
    for parts in (1, 3, 17):
        rows = sharding.assign(keys.repartition(parts)).collect()
        got.append(Counter((r.doc_id, r.size, r.shard, r.slot) for r in rows))
        per = Counter(r.shard for r in rows)
        assert len(rows) == 6000 and set(per.values()) == {150} and len({(r.shard, r.slot) for r in rows}) == 6000
    assert got[0] == got[1] == got[2]


def plain_ring(position, salt, at, owner, shards):
    """Shard of each key: its own while there is room, else the next one clockwise with room. Keys in order of the ring, and within a 65,536th of it by salt."""
    arc = np.searchsorted(at, position) % len(at)
    native = np.bincount(owner[arc], minlength=shards)
    free = np.full(shards, len(position) // shards)
    free[np.argsort(-native, kind="stable")[: len(position) % shards]] += 1
    order = sorted(range(len(position)), key=lambda k: (arc[k], (position[k] >> 48) - (position[k] > at[-1]) * 65536, salt[k], position[k]))
    out, late = {}, []
    for k in order:
        s = owner[arc[k]]
        if free[s]:
            out[k] = s
            free[s] -= 1
        else:
            late.append(k)
    for k in late:
        out[k] = next(s for s in (owner[(arc[k] + i) % len(at)] for i in range(1, len(at) + 1)) if free[s])
        free[out[k]] -= 1
    return [int(out[k]) for k in range(len(position))]


def test_sharding_equals_a_plain_ring_and_moves_little(spark):
    keys = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("x").alias("shard"), F.lit(1).alias("at"))
    position, salt = np.array(keys.orderBy("doc_id").select(F.xxhash64("doc_id"), F.pmod(F.xxhash64(F.struct(*keys.columns)), F.lit(sharding.SALTS))).collect()).T
    got = {n: [r.shard for r in sharding.assign(keys.repartition(3), shards=n).orderBy("doc_id").collect()] for n in (40, 41)}
    for n, shards in got.items():
        assert shards == plain_ring(position, salt, *sharding.ring(n, 64), n)
    moved = np.mean(np.array(got[40]) != np.array(got[41]))
    assert moved < 0.25, moved  # a plain modulus moves 0.98


def test_sharding_query(spark, tmp_path):
    rows = [(i, f"text {i} é" * (i % 5)) for i in range(300)] + [(7, None), (None, "a"), (None, "a")]
    spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, slot int").repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    out = sharding.op10_sharding(spark, str(tmp_path)).collect()
    want = Counter((d, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t in rows)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in out) == want
    per = Counter(r.shard for r in out)
    assert max(per.values()) - min(per[k] for k in range(40)) <= 1 and {r.law for r in out} == {"rows"} and {r.grown_shard for r in out} == {None}
    assert sorted((r.shard, r.slot) for r in out) == [(s, k) for s in sorted(per) for k in range(per[s])]


# Packing.
@pytest.fixture(scope="module")
def vocabulary():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_packing_pieces_equal_the_tokenizer(spark, vocabulary):
    rng = random.Random(4)
    parts = ["a", " the", "  x", "\n", " \n ", "\t", "é", "don't", " 12345", "…", " z", " ", "\x1c", "<|endoftext|>", "%%", " ", "word "]
    rows = [(10 + i, "".join(rng.choice(parts) for _ in range(rng.randrange(300)))) for i in range(80)] + EDGES + [(99, " many words" * 1500), (98, "a  b"), (97, " "), (96, "x ")]
    got = defaultdict(list)
    table = packing.tokenised(docs(spark, rows)).cache()
    for r in table.collect():
        got[r.doc_id].append((r.piece, r.start, r.length, r.ids_crc32))
    want = defaultdict(list)
    for d, t in rows:
        ids = [*vocabulary.encode(t or "", add_special_tokens=False).ids, 2]
        first = (len(ids) - 1) % 1024 + 1
        for k, z in enumerate(range(first, len(ids) + 1, 1024)):
            a = max(0, z - 1024) if k else 0
            want[d].append((k, a, z - a, zlib.crc32(np.array(ids[a:z], "<u4").tobytes())))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    out = packing.pack(table).collect()
    per = defaultdict(list)
    for r in out:
        per[r.sequence_id].append((r.offset, r.length))
    assert len(out) == sum(map(len, want.values()))
    for v in per.values():
        v.sort()
        assert [o for o, _ in v] == [sum(n for _, n in v[:i]) for i in range(len(v))] and sum(n for _, n in v) <= 1024
    assert packing.pack(table.limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_plan_uses_every_piece_and_few_sequences(seed):
    rng = np.random.default_rng(seed)
    size = 64
    lengths = rng.integers(1, [10, 33, 65, 65, 40, 65][seed], 3000)
    counts = Counter(lengths.tolist())
    used, n = Counter(), 0
    for pattern, k in packing.plan(counts, size):
        assert sum(pattern) <= size
        n += k
        for x in pattern:
            used[x] += k
    assert used == counts
    bins = []
    for x in sorted(lengths.tolist(), reverse=True):  # plain best fit
        fit = [i for i, g in enumerate(bins) if g >= x]
        i = min(fit, key=bins.__getitem__) if fit else len(bins)
        bins[i : i + 1] = [(bins[i] if fit else size) - x]
    assert n <= len(bins)


@pytest.mark.parametrize(("low", "high"), [(1, 1024), (300, 1024), (260, 499), (1, 300)])
def test_plan_is_never_longer_than_best_fit(low, high):
    lengths = np.random.default_rng(low).integers(low, high + 1, 8000)
    open_, n = [0] * 1025, 0
    for x in sorted(lengths.tolist(), reverse=True):
        g = next((g for g in range(x, 1025) if open_[g]), None)
        n, g = (n, g) if g else (n + 1, 1024)
        open_[g] -= g < 1024
        open_[g - x] += 1
    assert sum(k for _, k in packing.plan(Counter(lengths.tolist()))) <= n


@pytest.mark.parametrize(("name", "lengths"), [
    ("corpus", [1024] * 500 + [k % 700 + 60 for k in range(900)] + [k % 90 + 5 for k in range(400)]), ("even", list(range(1, 1025)) * 4), ("middle", [100 + k * 7 % 501 for k in range(5000)]),
    ("third", [260 + k * 11 % 240 for k in range(5000)]), ("short", [1 + k * k % 300 for k in range(5000)]),
])
def test_exact_fillings_are_in_the_plan_and_cost_no_sequence(name, lengths):
    counts = Counter(lengths)
    plan, alone = packing.plan(counts), packing.best_fit(counts, 1024)
    offered = packing.fillings(counts, 1024)
    assert all(sum(f) == 1024 for f, _ in offered)
    assert sum(n for _, n in plan) <= sum(n for _, n in alone)
    kinds = lambda p: Counter({len(f): n for k in range(1, 5) for f, n in [([0] * k, sum(n for g, n in p if len(g) == k and sum(g) == 1024))]})
    for kind, n in kinds(offered).items():
        assert not n or kinds(plan)[kind] > 0, (kind, kinds(offered), kinds(plan))


# Secrets.
def spans_of(t):
    t, out = t or "", []
    kinds = [
        ("assign", re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A), 2, 8),
        ("access", re.compile("AKIA[A-Z0-9]+"), 0, 16), ("hex", re.compile("[0-9a-f]+"), 0, 32),
    ]
    for rank, (kind, pattern, group, least) in enumerate(kinds):
        out += [(m.start(), rank, m.end(), kind) for m in pattern.finditer(t) if len(m[group]) >= least]
    return ",".join(f"{k}:{a}:{z}" for a, _, z, k in sorted(out))


def test_secret_base_spans(spark):
    rng = random.Random(9)
    parts = ["password", "Token", "api_key", "APIKEY", " = ", ":", "'", '"', "abc", "DEADbeef", "AKIA", "ABCD1234", "é", " ", "0123456789abcdef", "secret=", "\n", "==", "x" * 9]
    rows = [(10 + i, "".join(rng.choice(parts) for _ in range(rng.randrange(40)))) for i in range(300)] + EDGES
    got = secrets.scan(docs(spark, rows)).select("row.doc_id", "text", secrets.listed(F.col("base")).alias("s")).collect()
    assert all(r.s == spans_of(r.text) for r in got) and len(got) == len(rows)
    assert secrets.scan(docs(spark, rows).limit(0)).count() == 0


def test_secret_entropy(spark):
    token, upper = "aZ3kQ9xW7mB2vN8cL5jH1gT6", "A1B2C3D4E5F60718293A4B5C6D7E8F90"
    rows = [(1, f"see {token} now"), (2, "the quickbrownfoxjumpsoverthelazydog is a word"), (3, "id example" + token), (4, upper), (5, "password=" + token), (6, "a" * 500 + "1")]
    got = {r.doc_id: r.s for r in secrets.scan(docs(spark, rows)).select("row.doc_id", secrets.listed(F.col("added")).alias("s")).collect()}
    assert got == {1: f"entropy_b64:4:{4 + len(token)}", 2: "", 3: "", 4: "entropy_hex:0:32", 5: "", 6: ""}
    table = docs(spark, rows).withColumns({"n_chars": F.length("text"), "base": F.lit(1), "row": F.lit(2)})
    red = {r.doc_id: (r.text, r.n_chars) for r in secrets.redact(table).collect()}
    assert red[1] == ("see [SECRET] now", 16) and red[5][0] == "[SECRET]" and red[2][0] == rows[1][1]


def added_spans(t):
    """Spans that the method adds, by plain counts over each window."""
    t, base = t or "", [tuple(map(int, x.split(":")[1:])) for x in spans_of(t).split(",") if x]
    allow = re.compile(secrets.ALLOW.replace("^(?-i:", "^(?:").replace("(?i)", ""), re.I)
    lower_path = re.compile(r"/?(?:[a-z_-]+[0-9]{0,4}/){2,}[a-z_-]*[0-9]{0,4}")
    out = []
    for kind, least in (("entropy_hex", 3.0), ("entropy_b64", 3.9)):
        own = []
        for m in re.finditer(r"[A-Za-z0-9+/_-]{24,}", t):
            v = m[0]
            is_hex = bool(re.fullmatch(r"[A-Fa-f0-9]+", v))
            if not re.search("[0-9]", v) or (kind == "entropy_hex") != is_hex and kind == "entropy_hex":
                continue
            paths = allow.search(v) and (re.search(allow.pattern.rsplit("|", 1)[0], v, re.I) or lower_path.fullmatch(v))
            value = v.upper() if kind == "entropy_hex" else v
            high = max(-sum(n / 24 * np.log2(n / 24) for n in Counter(value[i : i + 24]).values()) for i in range(len(value) - 23))
            if not paths and high >= least and not any(a < m.end() and m.start() < z for a, z in base + [x[:2] for x in out]):
                own.append((m.start(), m.end(), kind))
        out += own
    return ",".join(f"{k}:{a}:{z}" for a, z, k in sorted(out, key=lambda x: (x[0], x[2] != "entropy_hex")))


def test_added_secrets_equal_plain_windows(spark):
    rng = random.Random(19)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    pieces = [lambda: "".join(rng.choice(letters) for _ in range(rng.randrange(10, 60))), lambda: "".join(rng.choice("0123456789ABCDEF") for _ in range(rng.randrange(20, 40)))]
    pieces += [lambda: "/usr/lib2/python/site-packages", lambda: "password=" + "q" * 9, lambda: "x9" * 20, lambda: "plain words here", lambda: "aB3" * 9 + "example", lambda: "ab9/cde/fgh/" + "".join(rng.choice(letters) for _ in range(24))]
    rows = [(10 + i, " ".join(rng.choice(pieces)() for _ in range(rng.randrange(6)))) for i in range(250)]
    got = secrets.scan(docs(spark, rows)).select("text", secrets.listed(F.col("added")).alias("s")).collect()
    assert [r.s for r in got] == [added_spans(r.text) for r in got] and sum(bool(r.s) for r in got) > 50


def test_sliding_entropy_equals_plain_counts(spark):
    rng, w = random.Random(3), 8
    values = ["".join(rng.choice("0123456789ABCDEF") for _ in range(rng.randrange(8, 30))) for _ in range(40)]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    got = df.select("v", F.expr(secrets.entropy("v", "0123456789ABCDEF", w)).alias("h")).collect()
    for r in got:
        best = max(-sum(n / w * np.log2(n / w) for n in Counter(r.v[i : i + w]).values()) for i in range(len(r.v) - w + 1))
        assert r.h == pytest.approx(best)


# Decontamination.
def test_decontamination(spark):
    rng = random.Random(6)
    vocabulary = [f"w{i}" for i in range(3000)]
    some = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(i, some(rng.randrange(15, 50))) for i in range(12)] + [(20, some(3)), (21, [])]
    rows, leaks = [(100 + i, " ".join(some(200))) for i in range(40)], set()
    for i, w in items[:13]:
        copy = list(w)
        for k in range(3, len(copy), 9):  # every ninth word is another one
            copy[k] = "edited"
        for d, words in ((i, w), (50 + i, copy)):
            if len(w) > 3 or d == i:
                text = some(80)
                text[40:40] = words
                rows.append((d, ", ".join(text).upper()))
                leaks.add((d, i))
    rows += EDGES[:4] + [(0, rows[-1][1])]
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items] + [(22, None)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.score for r in decontam.decontaminate(docs(spark, rows), bench).collect()}
    assert leaks <= set(got) and {k for k in got if k not in leaks} <= {(0, 20)}
    assert all(v == 1 for (d, i), v in got.items() if d == i and d)
    assert decontam.decontaminate(docs(spark, rows).limit(0), bench).count() == 0
    assert decontam.decontaminate(docs(spark, rows), bench.limit(0)).count() == 0


def test_seeds_miss_no_alignment_that_reaches_the_score():
    rng = random.Random(11)
    found = missed = 0
    for size in (4, 6, 10, 13, 20, 35, 60) * 6:
        item = [f"i{rng.randrange(400)}" for _ in range(size)]
        m = decontam.Items([(1, " ".join(item)), (2, " ".join(reversed(item)))], 3, 0.6)
        known = m.gram[m.item == 0]
        m.keep_rare(known, np.array([rng.randrange(50) for _ in known]))
        for _ in range(25):
            text, rate = [], rng.random() * 0.4
            for w in item[rng.randrange(1 + size // 4) : size - rng.randrange(1 + size // 4)]:
                text += {0: [w], 1: ["x"], 2: [w, "y"], 3: []}[rng.choice([1, 2, 3]) if rng.random() < rate else 0]
            text = ["z"] * 5 + text + ["z"] * 5
            word = decontam.item_words(" ".join(text))
            row = np.zeros(len(word), np.int64)
            if plain_score(item, text) >= 0.6:
                found += 1
                missed += 0 not in m.near(*m.hits(word, row), row)[0]
    assert found > 200 and not missed


def plain_score(item, text):
    """Best local alignment (match 1, mismatch and gap -1) as a share of the item."""
    last, best = [0] * (len(text) + 1), 0
    for w in item:
        now = [0]
        for j, t in enumerate(text):
            now.append(max(0, last[j] + (1 if w == t else -1), last[j + 1] - 1, now[j] - 1))
        best, last = max(best, *now), now
    return best / len(item)


def test_decontamination_query_equals_all_alignments(spark, tmp_path):
    """Copies with every fourth word replaced, or a word put in after every third, too; repeated rows, and one long text."""
    rng = random.Random(16)
    some = lambda n: [f"w{rng.randrange(900)}" for _ in range(n)]
    items = [(i, some(n)) for i, n in enumerate((7, 11, 15, 24, 40, 40))]
    edited = lambda w: [[x if (k + 1) % 4 else "other" for k, x in enumerate(w)], [y for k, x in enumerate(w) for y in ([x, "more"] if k % 3 == 2 else [x])], w[: len(w) * 7 // 10], w]
    texts = [some(60) for _ in range(20)] + [some(20) + e + some(20) for _, w in items for e in edited(w)]
    texts += [texts[-1], sum(texts, []), some(3000) + items[4][1] + some(3000)]
    rows = [(100 + i, " ".join(t)) for i, t in enumerate(texts)] + [(None, " ".join(texts[30])), (7, None), (8, "")]
    spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, n long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {(r.doc_id, r.item_id): r.score for r in decontam.op1_benchmark_decontamination(spark, str(tmp_path)).collect()}
    want = {(d, i): max(plain_score(w, t.split()) for e, t in rows if e == d and t) for d, t in rows if t for i, w in items}
    assert got == pytest.approx({k: v for k, v in want.items() if v >= 0.6})


def test_alignment_equals_plain_smith_waterman():
    rng = np.random.default_rng(2)
    for _ in range(30):
        item = rng.integers(0, 6, rng.integers(1, 12)).astype(np.uint64)
        texts = [rng.integers(0, 6, rng.integers(1, 25)).astype(np.uint64) for _ in range(5)]
        got, _ = decontam.aligned(item, texts)
        for t, g in zip(texts, got, strict=True):
            h = np.zeros((len(item) + 1, len(t) + 1), int)
            for a in range(len(item)):
                for b in range(len(t)):
                    h[a + 1, b + 1] = max(0, h[a, b] + (1 if item[a] == t[b] else -1), h[a, b + 1] - 1, h[a + 1, b] - 1)
            assert g == h.max()


# Sentence runs.
def test_sentence_dedup(spark):
    rng = random.Random(8)
    sentence = lambda: " ".join(rng.choice(["aa", "Bb", "cc", "dd", "ee", "é"]) + str(rng.randrange(50)) for _ in range(rng.randrange(1, 9))) + rng.choice([". ", "! ", "\n", ".\n", "?  "])
    passages = ["".join(sentence() for _ in range(6)) for _ in range(3)]
    rows = [(10 + i, "".join(rng.choice(passages) if rng.random() < 0.2 else sentence() for _ in range(rng.randrange(9)))) for i in range(60)]
    rows += [(200, rows[3][1]), (201, rows[3][1]), *EDGES[:6]]
    got = sentences.dedup(docs(spark, rows)).select("doc_id", "text", "_dedup.*").toDF("doc_id", "was", "kept", "n", "gone").collect()
    occ, parts = defaultdict(set), {}
    for d, t in rows:
        at = [(m.start(), m.end()) for m in re.finditer(r"[^\x20\x09-\x0D]+", t or "")]
        sent = []
        for k, (a, _) in enumerate(at):
            if not k or t[at[k - 1][1] - 1] in ".!?" or "\n" in t[at[k - 1][1] : a]:
                sent.append([k, k + 1])
            sent[-1][1] = k + 1
        parts[d, t] = at, sent
        n, runs = len(sent), set()
        for a in range(n):
            z = next((z for z in range(a + 2, n + 1) if sent[z - 1][1] - sent[a][0] >= 12), None)
            if z:
                runs.add((a, z))
        a = next((a for a in range(n - 2, -1, -1) if sent[n - 1][1] - sent[a][0] >= 12), None)
        if a is not None:
            runs.add((a, n))
        for a, z in runs:
            occ[tuple(t[p:q].lower() for p, q in at[sent[a][0] : sent[z - 1][1]])].add((-1 if d is None else d, t, a, z))
    drop = defaultdict(set)
    for v in occ.values():
        for d, t, a, z in sorted(v, key=lambda x: (x[0], x[2], x[3]))[1:]:
            drop[d, t] |= set(range(a, z))
    assert len(got) == len(rows)
    for r in got:
        at, sent = parts[r.doc_id, r.was]
        cut = drop[-1 if r.doc_id is None else r.doc_id, r.was]
        edge = [0 if k == 0 else at[s[0]][0] for k, s in enumerate(sent)] + [len(r.was or "")]
        kept = "".join(r.was[edge[k] : edge[k + 1]] for k in range(len(sent)) if k not in cut) if sent else r.was
        assert (r.n, r.gone, r.kept) == (len(sent), len(cut), kept)
    assert sentences.dedup(docs(spark, rows).limit(0)).count() == 0


def test_sentence_dedup_removes_all_that_any_repeated_run_covers(spark):
    rng = random.Random(12)
    sentence = lambda most: " ".join(f"w{rng.randrange(4000)}" for _ in range(rng.randrange(1, most))) + ". "
    passages = ["".join(sentence(18) for _ in range(3)) + "".join(sentence(3) for _ in range(rng.randrange(1, 4))) for _ in range(8)]
    rows = [(i, "".join(rng.choice(passages) if rng.random() < 0.3 else sentence(10) for _ in range(12))) for i in range(40)]
    occ, want = defaultdict(list), {}
    for d, t in rows:
        sent = [x.split() for x in re.findall(r"[^.]+\. ", t)]
        want[d] = set()
        for a in range(len(sent)):
            for z in range(a + 2, len(sent) + 1):
                run = tuple(w for x in sent[a:z] for w in x)
                if len(run) >= 12:
                    occ[run].append((d, a, z))
    for v in occ.values():
        for d, a, z in sorted(v)[1:]:
            want[d] |= set(range(a, z))
    got = sentences.dedup(docs(spark, rows)).select("doc_id", "_dedup.*").collect()
    for r in got:
        sent = re.findall(r"[^.]+\. ", dict(rows)[r.doc_id])
        assert (r.n_removed, r.text) == (len(want[r.doc_id]), "".join(x for k, x in enumerate(sent) if k not in want[r.doc_id]))
    assert sum(map(len, want.values())) > 100


def test_sentence_dedup_splits_long_sentences(spark):
    rng = random.Random(13)
    some = lambda n: [f"w{rng.randrange(50_000)}" for _ in range(n)]
    whole, line, passages = some(60), some(40), [some(50) for _ in range(20)]
    rows = [(1, " ".join(whole)), (2, " ".join(whole)), (3, " ".join(w.title() for w in whole))]  # one sentence is all
    rows += [(10 + i, f"{' '.join(some(5))}.\n{' '.join(line)}\n{' '.join(some(9))}. ") for i in range(2)]
    rows += [(100 * k + i, " ".join(some(30) + p + some(40))) for i, p in enumerate(passages) for k in (1, 2)]
    got = {r.doc_id: r for r in sentences.dedup(docs(spark, rows)).select("doc_id", F.col("text").alias("was"), "_dedup.*").collect()}
    assert got[1].text == rows[0][1] and got[2].text == got[3].text == "" and got[2].n_removed == got[2].n_sentences
    assert got[10].text == rows[3][1] and got[11].text == rows[4][1].replace(" ".join(line) + "\n", "")
    for i, p in enumerate(passages):
        assert got[100 + i].text == got[100 + i].was
        was, kept = got[200 + i].was.split(), got[200 + i].text.split()
        assert len(was) - len(kept) >= 27 and set(was) - set(kept) <= set(p)


# Preference pairs.
def test_preferences(spark):
    turns = [
        (1, 0, "user", "hi"), (1, 1, "assistant", "yes"), (1, 2, "user", "more"), (1, 3, "assistant", "good"),
        (2, 0, "user", "hi"), (2, 1, "assistant", "yes"), (2, 2, "user", "more"), (2, 3, "assistant", "bad é"), (2, 3, "assistant", "bad é"),
        (3, 0, "system", "s"), (3, 1, "user", "q"), (3, 2, "assistant", "a1"), (3, 3, "user", "again"), (3, 4, "assistant", "a2"), (3, 5, "user", "bye"),
        (4, 0, "user", "alone"), (4, None, None, None), (None, 0, "user", "lost"),
    ]
    table = spark.createDataFrame([(*t, 1) for t in turns], "conv_id long, turn long, role string, text string, rejected_id int")
    out = {r.conv_id: r for r in preferences.formatted(preferences.paired(preferences.gathered(table))).collect()}
    assert sorted(out) == [1, 2, 3, 4]
    a = out[1]
    assert (a.kind, a.rejected_id, a.n_common) == ("sibling", 2, 3)
    assert a.prompt == "<|user|>\nhi\n<|assistant|>\nyes\n<|user|>\nmore\n" and a.chosen == "<|assistant|>\ngood\n" and a.rejected == "<|assistant|>\nbad é\n"
    assert a.chosen_mask == "14-18" and a.rejected[slice(*map(int, a.rejected_mask.split("-")))] == "bad é"
    assert out[2].kind == "stale" and out[2].rejected == "<|assistant|>\nyes\n"
    assert out[3].chosen == "<|assistant|>\na2\n" and out[3].rejected == "<|assistant|>\na1\n" and out[3].n_common == 4
    assert out[4].kind == "unpaired" and out[4].prompt == ""
    assert preferences.formatted(preferences.paired(preferences.gathered(table.limit(0)))).count() == 0


def test_preferences_keep_one_chain_at_every_size(spark, monkeypatch):
    monkeypatch.setattr(preferences, "CHAIN", 4)
    ids = random.Random(5).sample(range(-500, 500), 90)
    turns = [(i, 0, "user", "hot" if i % 3 else f"t{i % 4}") for i in ids] + [(i, 1, "assistant", str(i)) for i in ids]
    table = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r.rejected_id for r in preferences.paired(preferences.gathered(table)).collect()}
    groups = defaultdict(list)
    for i in sorted(ids):
        groups["hot" if i % 3 else f"t{i % 4}"].append(i)
    assert got == {a: b for v in groups.values() for a, b in zip(v, [*v[1:], None], strict=True)}


# Language.
def test_language(spark):
    rng = random.Random(2)
    stems = {"en": ["the", "of", "thing", "and", "other"], "de": ["der", "und", "schön", "über", "nicht"], "fr": ["été", "le", "vous", "où", "était"]}
    rows = [(i, " ".join(rng.choice(stems[lang]) for _ in range(rng.randrange(5, 60))), lang) for i, lang in enumerate(list(stems) * 60)]
    table = spark.createDataFrame(rows + [(900, None, "en"), (901, "12 34 …", "de"), (902, "ÜBER NICHT SCHÖN", None), (None, "the other thing", None)], "doc_id long, text string, lang string")
    model = langid.fit(table.where("coalesce(doc_id, 0) % 7 <> 1"), sample=100)
    out = {r.doc_id: r for r in langid.predict(table, model).collect()}
    assert sum(out[i].lang_pred == lang for i, _, lang in rows) >= 0.98 * len(rows)
    assert (out[900].lang_pred, out[901].lang_pred, out[900].score) == ("und", "und", 0.0) and out[902].lang_pred == "de" and out[None].lang_pred == "en"
    assert all(0 <= r.score <= 1 for r in out.values())
    none = langid.predict(table, langid.fit(table.limit(0))).collect()
    assert {r.lang_pred for r in none} == {"und"}


def test_language_gradients_equal_differences():
    rng = np.random.default_rng(5)
    mean, w, y = rng.normal(size=(7, 4)), rng.normal(size=(4, 3)), rng.integers(0, 3, 7)
    loss = lambda m, v: -np.log(langid.softmax(m @ v)[np.arange(7), y]).mean()
    for x, got, at in ((w, langid.gradients(mean, w, y)[0], lambda v: loss(mean, v)), (mean, langid.gradients(mean, w, y)[1], lambda v: loss(v, w))):
        for i in np.ndindex(x.shape):
            step = np.zeros(x.shape)
            step[i] = 1e-6
            assert got[i] == pytest.approx((at(x + step) - at(x - step)) / 2e-6, abs=1e-6)


def test_language_predictions_equal_plain_averages(spark):
    """Scores are softmax of the mean over all subwords of each word, also for repeated rows, a long text and an empty one."""
    rng = random.Random(23)
    texts = [" ".join(rng.choice(["der", "the", "Été", "und", "of", "x1"]) for _ in range(rng.randrange(1, 30))) for _ in range(20)]
    rows = [*enumerate(texts), (3, texts[3]), (50, "the end " * 60_000), (51, "")]
    table = np.random.default_rng(2).normal(size=(langid.BUCKETS, 3)).astype(np.float32)
    model = {"langs": ["de", "en", "fr"], "table": table, "scale": 2.0, "reject": 0.5}
    got = Counter((r.doc_id, r.lang_pred, round(r.score, 4)) for r in langid.predict(docs(spark, rows), model).collect())

    def plain(text):
        buckets = []
        for w in re.findall(r"[^\W_]+", text.lower()):
            b = f" {w} ".encode()
            for n in langid.SIZES:
                for i in range(len(b) - n + 1):
                    h = langid.piece(langid.prefix_hash(np.frombuffer(b[i : i + n], np.uint8)), np.array([0]), np.array([n]))
                    buckets.append(int(langid.mix(h + np.uint64(n))[0] % np.uint64(langid.BUCKETS)))
        p = langid.softmax(table[buckets].astype(np.float64).mean(0)[None] * 2.0)[0]
        return model["langs"][int(p.argmax())], round(float(p.max()), 4)

    known = {}
    want = Counter((d, *(known.setdefault(t[:500], plain(t[:480_000])) if t else ("und", 0.0))) for d, t in rows)
    assert got == want
