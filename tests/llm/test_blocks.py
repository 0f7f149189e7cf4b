"""What is left of a bucket, compared in blocks of its chunks: equal to all pairs."""

import random

import pytest

from costweave.llm import ngram_jaccard
from tests.llm.test_operators import components_of, linked


@pytest.mark.parametrize("chunk", [5, 1024])
def test_near_copies_of_one_source_in_blocks(spark, monkeypatch, chunk):
    monkeypatch.setattr(ngram_jaccard, "CHUNK", chunk)
    monkeypatch.setattr(ngram_jaccard, "FEW", 10**9)  # no rounds: all that the first partners leave apart meets in blocks
    rng, texts = random.Random(3), {}
    for source in range(3):
        words = [f"s{source}w{i}" for i in range(100)]
        for k in range(40):
            own = list(words)
            for at in rng.sample(range(4, 96, 8), 2 + k % 3):
                own[at] = f"new{rng.random()}"
            texts[1000 * source + k] = " ".join(own)
    want = linked(texts)
    assert 3 < len(set(want.values())) < len(texts)
    assert components_of(spark, texts) == want
