"""Sketches of sets of any size, and buckets of the same groups that are one."""

import random

import numpy as np
import pyarrow as pa

from costweave.llm import ngram_jaccard
from costweave.session import Scratch
from tests.llm.test_operators import components_of, linked


def test_large_sets_that_share_little_are_told_by_their_sketches(spark):
    rng = random.Random(5)
    passage = [f"p{i}" for i in range(400)]
    texts = {k: " ".join(passage + [f"w{rng.random()}" for _ in range(6000)]) for k in (1, 2)}
    words = texts[1].split()
    for at in rng.sample(range(400, 6400), 30):
        words[at] = f"new{at}"
    texts[3] = " ".join(words)
    scratch = Scratch(spark, "test")
    base = ngram_jaccard._base(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), 80, scratch)
    pairs = spark.createDataFrame([(1, 2), (1, 3), (2, 3)], "a long, b long")
    assert [tuple(x) for x in ngram_jaccard.plausible(base, pairs, 80, scratch, "found").collect()] == [(1, 3)]


def test_sketches_of_different_widths():
    rng = np.random.default_rng(1)
    sets, rows = [rng.integers(0, 2**63, n, np.uint64) for n in (3, 60, 70, 1000, 1100, 5000)], []
    for x in sets:
        width = ngram_jaccard.sketch_bits(len(x))
        rows.append(np.packbits((np.bincount((x & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1).astype(np.uint8)).tobytes())
    a, b = (x.ravel() for x in np.meshgrid(np.arange(6), np.arange(6)))
    want = []
    for i, j in zip(a, b, strict=True):
        width = min(len(rows[i]), len(rows[j])) * 8
        parity = [np.bincount((sets[k] & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1 for k in (i, j)]
        want.append(int((parity[0] != parity[1]).sum()))
    for column in (pa.array(rows, pa.binary()), pa.array([b"", *rows], pa.binary())[1:], pa.chunked_array([pa.array(rows[:2], pa.binary()), pa.array(rows[2:], pa.binary())])):
        assert ngram_jaccard.Sketches(column).apart(a, b).tolist() == want
    assert not len(ngram_jaccard.Sketches(pa.array([], pa.binary())).apart(a[:0], b[:0]))


def test_shared_passage_is_one_bucket(spark, monkeypatch):
    rng, texts = random.Random(7), {}
    passage = " ".join(f"p{i}" for i in range(60))
    for k in range(12):
        texts[k] = passage + " " + " ".join(f"w{rng.random()}" for _ in range(60))
    texts[100] = texts[5] + " end"
    rows, within = [], ngram_jaccard._within
    monkeypatch.setattr(ngram_jaccard, "_within", lambda base, wide, *rest: rows.append(wide.groupBy("tok").count().collect()) or within(base, wide, *rest))
    assert components_of(spark, texts) == linked(texts)
    sizes = [x["count"] for x in rows[0]]
    # the passage's shingles in the prefixes are over ten, with nearly the same sets
    assert max(sizes) >= 12 and sum(sizes) <= 60
