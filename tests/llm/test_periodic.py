"""Runs of words against all periods and places; wavelet tree against sorting; odd texts."""

import random

import numpy as np

from costweave.llm import periodic


def plain(w):
    """Every (start, length, period) by trying all periods."""
    found = {}
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            n = j - i + q
            if n >= max(6, 4 * q) and not any(q % p == 0 and any(s <= i and s + m >= i + n for s, m in own) for p, own in found.items()):
                found.setdefault(q, []).append((i, n))
            i = max(j, i + 1)
    return sorted(((s, n, q) for q, own in found.items() for s, n in own), key=lambda r: (r[0], r[2]))


def text_of(rng):
    w = [rng.randrange(rng.choice([1, 2, 2, 3, 5])) for _ in range(rng.randrange(70))]
    for _ in range(rng.randrange(4)):
        a, p = rng.randrange(len(w) + 1), rng.randrange(1, 14)
        w[a:a] = (w[a : a + p] * rng.randrange(1, 8))[: rng.randrange(1, 80)]
    return w


def test_runs_equal_all_periods():
    rng = random.Random(6)
    for _ in range(1500):
        texts = [text_of(rng) for _ in range(3)]
        starts = np.concatenate([[0], np.cumsum([len(w) for w in texts])])
        assert periodic.runs_of(np.array([x for w in texts for x in w], np.int64), starts) == [plain(w) for w in texts]


def test_wavelet_tree_neighbours():
    rng = np.random.default_rng(3)
    for n in (1, 2, 7, 300):
        values = rng.permutation(n)
        tree = periodic.WaveletTree(values)
        at = rng.integers(0, n, 200)
        first, last = rng.integers(0, at + 1), rng.integers(at + 1, n + 1)
        for a, i, j, before, after in zip(at, first, last, *tree.beside(first, last, values[at]), strict=True):
            own = sorted(values[i:j].tolist())
            k = own.index(values[a])
            assert (before, after) == (own[k - 1] if k else -1, own[k + 1] if k + 1 < len(own) else -1)


def test_rows_of_any_kind(spark, monkeypatch):
    monkeypatch.setattr(periodic, "BATCH", 2000)
    rng = random.Random(8)
    texts = [None, "", " \n\t ", "a", "A a a a a a a", " x\x0by\rx y x  y\nx y x\xa0y ", "é ü " * 9, "one " * 60_000, *(" ".join(f"w{x}" for x in text_of(rng)) for _ in range(200))]
    rows = [(i, x, "n", 1) for i, x in enumerate(texts)] + [(None, "b b b b b b b b", "n", 2), (1, "", "n", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string, period int")
    got = sorted(((r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in periodic.periodic_runs(docs).collect()), key=repr)
    want = []
    for i, x, *_ in rows:
        w = [b.decode() for b in (x or "").encode().split()]
        runs = plain(w) if len(w) < 1000 else [(0, len(w), 1)]
        gone = {k for s, n, q in runs for k in range(s + q, s + n)}
        want.append((i, len(w), runs, " ".join(v for k, v in enumerate(w) if k not in gone)))
    assert got == sorted(want, key=repr)
    assert periodic.digests(periodic.periodic_runs(docs.limit(0))).collect() == []
    same = {r.doc_id: r.text for r in periodic.planted(docs).where("doc_id < 40").collect()}
    assert same[0] is None and sum(same[i] != texts[i] for i in same) > 0
