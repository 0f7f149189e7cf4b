"""Hard negatives against all pairs: pruning by coordinates on vectors of many lengths, chunks, odd rows."""


import numpy as np
import pytest

from costweave.llm import hard_negatives


def plain(rows, every=50, positives=5, negatives=3, low=50, high=95):
    width = max(len(v) for _, _, v in rows)
    rows = {i: (label, [*v, *[0] * (width - len(v))]) for i, label, v in sorted(rows, reverse=True)}
    out = []
    for a, (label, v) in rows.items():
        if a % every:
            continue
        score = sorted((-sum(x * y for x, y in zip(v, w, strict=True)), i) for i, (_, w) in rows.items() if i != a)
        for ps, p in [(-s, i) for s, i in score if rows[i][0] == label][:positives]:
            fits = [(i, -s) for s, i in score if rows[i][0] != label and low * ps <= -100 * s <= high * ps][:negatives]
            out += [(a, p, k + 1, n, ps, ns) for k, (n, ns) in enumerate(fits)]
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, label long, v array<long>")


@pytest.mark.parametrize("clustered", [True, False])
def test_equal_to_all_pairs(spark, monkeypatch, clustered):
    for name, value in (("BUCKET", 40), ("CHUNK", 7), ("ROWS", 3)):
        monkeypatch.setattr(hard_negatives, name, value)
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(6, 8))
    rows = []
    for i in range(900):
        v = (centres[rng.integers(6)] * 3 + rng.normal(size=8) * 0.3 if clustered else rng.normal(size=8)) * rng.choice([0.2, 1, 1, 40]) * 10
        rows.append((i, int(rng.integers(3)), [int(x) for x in np.floor(v)]))
    rows += [(1000 + i, 1, rows[3][2]) for i in range(30)] + [(1050, 2, [0] * 8), (1100, 2, [5, 1]), (1150, 7, [])]
    got = hard_negatives.mine(frame(spark, rows).repartition(5))
    assert sorted(map(tuple, got.collect())) == plain(rows)


def test_pruning_takes_rows_out_and_loses_none():
    rng = np.random.default_rng(1)
    v = np.floor(rng.normal(size=(500, 12)) * 100 + (rng.integers(0, 5, 500)[:, None] == np.arange(12)) * 900).astype(np.int64)
    unit = (v / np.linalg.norm(v, axis=1)[:, None]).T
    row = {"ids": np.arange(500).tobytes(), "labels": np.zeros(500, np.int64).tobytes(), "vectors": v.tobytes(), "lists": np.argsort(unit, axis=1).astype(np.int32).tobytes(), "longest": float(np.linalg.norm(v, axis=1).max())}
    bucket = hard_negatives.Bucket(row, 12)
    for cosine in (-1.0, 0.2, 0.7, 0.95, 1.0):
        for a, rows in zip(range(20), bucket.feasible(unit.T[:20], np.full(20, cosine)), strict=True):
            near = set(np.flatnonzero(unit.T @ unit[:, a] >= cosine).tolist())
            assert rows is None or near <= set(rows.tolist())
            if cosine >= 0.95:
                assert len(rows) < 250


def test_odd_rows(spark):
    good = [(0, 1, [3, 4]), (1, 1, [3, 3]), (2, 2, [2, 3]), (3, 2, [1, 2])]
    odd = [(None, 1, [9, 9]), (4, None, [9, 9]), (5, 1, None), (6, 1, [9, None])]
    assert sorted(map(tuple, hard_negatives.mine(frame(spark, good + odd + good[:2] + [(2, 3, [9, 9])])).collect())) == plain(good)
    assert hard_negatives.mine(frame(spark, [])).collect() == []
    clashing = frame(spark, good).selectExpr("*", "1 as chunk", "'x' as band", "2 as score")
    assert sorted(map(tuple, hard_negatives.mine(clashing).collect())) == plain(good)
