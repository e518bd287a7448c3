"""The Jaccard join against all pairs, on texts with near copies, common passages and edge cases."""

import random
import re
from itertools import combinations

import pytest

from tracewell.llm.graph import components
from tracewell.llm.jaccard import linked

LOW = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})


def shingle_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def expected(rows):
    sets = [shingle_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in combinations([i for i, r in enumerate(rows) if r[0] is not None], 2):
        both = len(sets[a] & sets[b])
        if sets[a] and 100 * both >= 75 * len(sets[a] | sets[b]):
            root[find(a)] = find(b)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted((d, len(sets[i]), least[find(i)]) for i, (d, _) in enumerate(rows) if d is not None)


def corpus(seed, groups=12, passage=30):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    some = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    common, texts = [some(passage) for _ in range(2)], []
    for _ in range(groups):
        base = some(rng.choice([6, 12, 40, 90]))
        if rng.random() < 0.7:
            base[3:3] = rng.choice(common)
        for _ in range(rng.choice([1, 2, 5, 9])):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            texts.append(" ".join(w).upper() if rng.random() < 0.2 else "  ".join(w))
    texts += [None, "", " \n", "one", "One", "a b c", "a b c d e", common[0] and " ".join(common[0]), " ".join(common[0] + some(4))]
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize(("seed", "held", "block", "broadcast"), [(1, 48, 1 << 18, 10**6), (2, 1, 2000, 0), (5, 3, 300, 10**6), (6, 2, 1 << 18, 0)])
def test_components_equal_brute_force(spark, seed, held, block, broadcast):
    rows = corpus(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = linked(docs, held=held, block=block, broadcast=broadcast)
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in out.collect()) == expected(rows)


@pytest.mark.parametrize(("held", "block"), [(8, 3000), (8, 1 << 18), (500, 1 << 18)])
def test_near_copies_around_the_limit_equal_brute_force(spark, held, block):
    rng = random.Random(held)
    base, texts = [f"b{i}" for i in range(90)], []
    for _ in range(150):
        w = list(base)
        for _ in range(rng.choice([1, 2, 3, 4, 5])):
            w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
        texts.append(" ".join(w[: rng.choice([70, 80, 90])]))
    texts += [" ".join(base[:30] + [f"o{rng.randrange(10**6)}" for _ in range(60)]) for _ in range(40)]
    rows = list(enumerate(texts))
    out = linked(spark.createDataFrame(rows, "doc_id long, text string"), held=held, block=block)
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in out.collect()) == expected(rows)


@pytest.mark.parametrize(("seed", "held"), [(2, 1), (3, 2)])
def test_repeated_rows_and_ids_equal_brute_force(spark, seed, held):
    rows = [(d, t) for d, t in corpus(seed) for _ in range(1 + d % 3)]
    rows += [(d, f"other {t} text of {d}") for d, t in rows[::9]]  # another text with the same doc_id
    rng = random.Random(seed)
    rows += [(d, " ".join(f"v{rng.randrange(400)}" for _ in range(20))) for d, _ in rows[:60:4]]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = linked(docs, held=held)
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in out.collect()) == expected(rows)


def test_edges_of_input(spark):
    rows = [(7, "a b c d e f"), (7, "a b c d e f"), (None, "a b c d e f"), (3, "a b c d e f"), (9, None), (9, "")]
    docs = spark.createDataFrame([(d, t, 1, 2, 3) for d, t in rows], "doc_id long, text string, n long, comp long, ka long")
    got = sorted((r.doc_id or -1, r.n_shingles, r.component_id) for r in linked(docs).collect())
    assert got == [(-1, 2, None), (3, 2, 3), (7, 2, 3), (7, 2, 3), (9, 0, 9), (9, 0, 9)]
    assert linked(docs.limit(0)).count() == 0


def test_components_of_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 99), (5, 5)], "a long, b long")
    got = {r.node: r.root for r in components(edges).collect()}
    assert got == {**{i: 0 for i in range(41)}, 99: 99, 100: 99}
