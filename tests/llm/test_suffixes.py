"""Suffix dedup against a count of every window."""

import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tracewell.llm import suffixes
from tracewell.llm.suffixes import Suffixes, anchors, dedup, row_anchors


def expected(rows, length):
    texts = [(t or "").encode() for _, t in rows]
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for (d, _), t in zip(rows, texts, strict=True):
        gone = np.zeros(len(t) + 2, bool)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i + 1 : i + length + 1] = True
        edge = np.flatnonzero(np.diff(gone.astype(int)) == 1)
        kept = bytes(b for b, g in zip(t, gone[1:], strict=False) if not g)
        out.append((d, len(t), int(gone.sum()), len(edge), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def corpus(seed):
    rng = random.Random(seed)
    some = lambda n: "".join(rng.choice("abcdeé \n") for _ in range(n))
    shared, rows = [some(n) for n in (30, 60, 90, 200)], []
    for _ in range(25):
        t = some(rng.randrange(150))
        for _ in range(rng.randrange(4)):
            s = rng.choice(shared)
            a = rng.randrange(len(s) // 2)
            t += s[a : a + rng.randrange(20, len(s))] + some(rng.randrange(40))
        rows.append(t)
    rows += [rows[0], rows[1] + "x", "ab" * 60, "a" * 100, "a" * 41, None, "", "é" * 40, "q" + "ab" * 30]
    return [(i, t) for i, t in enumerate(rows)]


@pytest.mark.parametrize(("seed", "gram", "hot", "together", "bits"), [(1, 16, 10_000, 4096, 64), (2, 16, 10_000, 3, 64), (3, 8, 2, 16, 64), (4, 25, 0, 16, 4)])
def test_equals_every_window(spark, seed, gram, hot, together, bits):
    rows = corpus(seed)
    docs = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, key long, tk string")
    got = dedup(docs, length=40, gram=gram, hot=hot, together=together, bits=bits, rows=seed % 2 * 10**6).drop("kept").collect()
    assert sorted(map(tuple, got), key=repr) == expected(rows, 40)


def test_repeated_rows_null_ids_and_empty_table(spark):
    rows = [(1, "abcdefgh" * 30), (1, "abcdefgh" * 30), (None, "z" * 250), (None, "pq" * 10), (2, "pq" * 10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = dedup(docs).drop("kept").collect()
    assert sorted(map(tuple, got), key=repr) == expected(rows, 200)
    assert dedup(docs.limit(0)).count() == 0


def test_mergesort_orders_like_bytes():
    rng = random.Random(5)
    rows = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(9))) for _ in range(300)]
    group = np.sort(np.array([rng.choice([0, 40, 90, 91, 200]) for _ in rows]))
    first = {g: int(np.searchsorted(group, g)) for g in set(group.tolist())}
    group = np.array([first[g] for g in group.tolist()])
    order, common = Suffixes(rows, 8).sorted(group)
    want = sorted(range(len(rows)), key=lambda i: (group[i], rows[i], i))
    assert order.tolist() == want
    for k in range(1, len(rows)):
        a, b = rows[want[k - 1]], rows[want[k]]
        n = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
        assert common[k] == (n if group[k] == group[k - 1] else 0)


@pytest.mark.parametrize("least", [0, 1, (1 << 33) - 1])
def test_smallest_hash_marks_an_anchor(monkeypatch, least):
    """A gram whose hash is as small as can be, in a text of one window, is its anchor."""
    mix = lambda x: np.concatenate((np.full(len(x) // 2, 1 << 60, np.uint64), np.full(1, least, np.uint64), np.full(len(x) - len(x) // 2 - 1, 1 << 60, np.uint64)))
    monkeypatch.setattr(suffixes, "mix", mix)
    place, _ = anchors(np.arange(200, dtype=np.uint8), np.array([0, 200]), 200, 64)
    assert place.tolist() == [137 // 2]


def test_long_texts_in_pieces(monkeypatch):
    rng = np.random.default_rng(1)
    text = rng.integers(97, 123, 5000, np.uint8).tobytes()
    column = pa.array([b"short", text, None, text[:300]])
    whole = sorted((int(r), int(p), int(k)) for row, place, key in row_anchors(column, 200, 64) for r, p, k in zip(row, place, key, strict=True))
    monkeypatch.setattr(suffixes, "BLOCK", 700)
    monkeypatch.setattr(suffixes, "blocks", lambda c: ((i, i + 1, np.frombuffer(c[i].as_py() or b"", np.uint8), np.array([0, len(c[i].as_py() or b"")])) for i in range(len(c))))
    assert sorted((int(r), int(p), int(k)) for row, place, key in row_anchors(column, 200, 64) for r, p, k in zip(row, place, key, strict=True)) == whole
