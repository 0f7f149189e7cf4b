"""Whole-catalogue fuzzy top-k: the ratio against difflib, scores and ranking against all pairs."""

import random
from difflib import SequenceMatcher

import pytest

from costweave.functions.similarity import sequence_ratios
from costweave.operators import fuzzy_top


def texts(n, seed, alphabet="abcd ef", longest=40):
    r = random.Random(seed)
    out = []
    for _ in range(n):
        x = "".join(r.choice(alphabet) for _ in range(r.randrange(longest)))
        if out and r.random() < 0.5:
            y = r.choice(out)
            cut = r.randrange(len(y) + 1)
            x = y[cut:] + x[: r.randrange(6)] + y[:cut]
        out.append(x)
    return out


def test_ratio_equals_difflib():
    a = texts(400, 1) + texts(60, 2, "ab é😀", 300) + ["", "", "x", "ab" * 150, "the cat " * 40]
    b = texts(400, 3) + texts(60, 4, "ab é😀", 300) + ["", "x", "", "ba" * 130 + "c", "a hat " * 50]
    for x, y in ((a, b), (b, a), (a, random.Random(5).sample(a, len(a)))):
        assert sequence_ratios(x, y).tolist() == pytest.approx([SequenceMatcher(None, u, v).ratio() for u, v in zip(x, y, strict=True)])


def score(a, b):
    if a == b:
        return 1.0
    x, y = set(a.split()), set(b.split())
    return round(0.6 * SequenceMatcher(None, a, b).ratio() + 0.4 * len(x & y) / max(len(x), len(y)), 9)


@pytest.mark.parametrize("words", [["pump", "valve", "pipe", "steel"], [f"w{i}" for i in range(40)], None])
def test_top_equals_all_pairs(spark, words):
    r = random.Random(9)
    line = lambda: " ".join(r.choice(words) for _ in range(r.randrange(1, 7))) if words else "".join(r.choice("abcde ") for _ in range(r.randrange(1, 14)))
    items = [line() for _ in range(120)] + ["  Pump   VALVE ", "", " ", None, "zzz"]
    masters = [(i, line()) for i in range(150)] + [(900, None), (901, " "), (902, items[0]), (903, items[0]), (904, "xq " * 30)]
    got = {(x.text, x.place): (x.master_id, x.score) for x in fuzzy_top.top_matches(spark.createDataFrame([(x,) for x in items], "description string"), spark.createDataFrame(masters, "master_id long, description string")).collect()}
    clean = lambda x: " ".join((x or "").lower().split())
    ids = {}
    for i, x in masters:
        if clean(x):
            ids[clean(x)] = min(i, ids.get(clean(x), i))
    want = {}
    for x in {clean(x) for x in items} - {""}:
        best = sorted((-s, i) for t, i in ids.items() if (s := score(x, t)) > 0.3)[:5]
        want |= {(x, k + 1): (i, -s) for k, (s, i) in enumerate(best)}
    assert got == want


def test_empty_sides(spark):
    none, one = spark.createDataFrame([], "master_id long, description string"), spark.createDataFrame([(1, "pump")], "master_id long, description string")
    assert fuzzy_top.top_matches(none, one).collect() == fuzzy_top.top_matches(one, none).collect() == []
