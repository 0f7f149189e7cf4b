"""Sequential masters against a plain loop; the vector index against all pairs, with its recall; four tiers."""

import random
from difflib import SequenceMatcher

import numpy as np

from costweave.operators import masters, vector_index


def score(a, b, ua, ub):
    if a == b:
        s = 1.0
    else:
        x, y = set(a.split()), set(b.split())
        s = 0.6 * SequenceMatcher(None, a, b).ratio() + 0.4 * len(x & y) / max(len(x), len(y))
    return round(min(1.0, s + (0.05 if ua is not None and ua == ub else 0)), 9)


def plain(lines):
    made, out = [], {}
    for order, block, text, unit in sorted(lines):
        text = " ".join((text or "").lower().split())
        if not text or block is None:
            continue
        same = [m for m in made if m[1:] == (block, text, unit)]
        best = max(((score(text, t, unit, u), -m) for m, b, t, u in made if b == block), default=(0, 0))
        if same or best[0] >= 0.8:
            out[order] = (same[0][0] if same else -best[1])
        else:
            made.append((order, block, text, unit))
            out[order] = order
    return out


def test_masters_equal_a_plain_loop(spark):
    rng = random.Random(3)
    words = ["pump", "valve", "pipe", "steel", "dn50", "dn80", "long", "short"]
    lines = [(i, rng.choice(["A", "B", None]), rng.choice([" ".join(rng.choices(words, k=rng.randrange(1, 6))), "", None, " Pump  valve"]), rng.choice(["m", "kg", None])) for i in range(400)]
    frame = spark.createDataFrame(lines, "line_id long, code string, description string, unit string")
    rows = masters.sequential(frame.repartition(4), "code", "line_id").collect()
    want = plain(lines)
    assert {r.line_id: r.master for r in rows} == want
    assert {r.kind for r in rows if r.line_id == r.master} == {"new"}
    assert masters.sequential(frame.limit(0), "code", "line_id").collect() == []


def test_chains_of_leaders(spark):
    nodes = spark.range(1, 12).withColumnRenamed("id", "node")
    links = spark.createDataFrame([(i + 1, i) for i in range(1, 9)] + [(11, 3), (11, 2), (5, 5)], "node long, earlier long")
    got = {r.node for r in masters.leaders(nodes, links).collect() if r.leader}
    assert got == {1, 3, 5, 7, 9, 10}


def all_pairs(vectors, queries, k, cutoff):
    out = set()
    for q, x in queries.items():
        near = sorted((-round(float(x @ y / np.linalg.norm(x) / np.linalg.norm(y)), 9), i) for i, y in vectors.items())
        out |= {(q, i) for s, i in near[:k] if -s >= cutoff}
    return out


def test_index_is_exact_by_bounds_and_near_by_probes(spark, monkeypatch):
    monkeypatch.setattr(vector_index, "PART", 60)
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(15, 12))
    vectors = {i: centres[rng.integers(15) if i % 3 else 0] + rng.normal(size=12) * 0.4 for i in range(1500)}
    queries = {i: x for i, x in vectors.items() if i % 20 == 0} | {9000: rng.normal(size=12)}
    odd = [(-1, None), (-2, [0.0] * 12), (-3, [float("nan")] * 12), (-4, [1.0, 2.0]), (-5, [1.0, None]), (None, [1.0] * 12)]
    frame = lambda x: vector_index.usable(spark.createDataFrame([(i, v.tolist()) for i, v in x.items()] + odd, "id long, e array<double>"), "id", "e")
    index = vector_index.build(frame(vectors))
    for cutoff in (0.75, -1.0):
        got = {(r.query, r.id) for r in vector_index.search(index, frame(queries), 10, cutoff).collect() if r.query >= 0}
        assert got == all_pairs(vectors, queries, 10, cutoff)
    want = all_pairs(vectors, queries, 10, 0.75)
    found = {(r.query, r.id) for r in vector_index.search(index, frame(queries), 10, 0.75, probes=6).collect()}
    assert len(found & want) >= 0.9 * len(want)
    none = frame({}).where("id > 0")
    assert vector_index.search(vector_index.build(none), frame(queries), 3).collect() == []
