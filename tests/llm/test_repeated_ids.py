"""Rows that share a doc_id and not their text lose no link."""

import random

from costweave.llm import ngram_jaccard


def test_one_id_and_several_texts(spark):
    rng = random.Random(7)
    line = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    a, b, c = line(60), line(30), line(40)
    near = lambda w: " ".join([*w[:-1], "other"])
    rows = [(1, " ".join(a)), (1, " ".join(b)), (2, near(a)), (3, near(b)), (5, near(a[:-1] + ["x"])), (5, " ".join(c)), (6, near(c)), (7, ""), (7, " ".join(line(9))), (8, None), (None, " ".join(a)), (1, " ".join(a))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((str(r.doc_id), r.component_id) for r in ngram_jaccard.similar_classes(docs).collect())
    want = {1: [1, 1, 1], 2: [1], 3: [1], 5: [1, 5], 6: [5], 7: [7, 7], 8: [8], None: [1]}
    assert got == sorted((str(i), c) for i, own in want.items() for c in own)
    kept = sorted(((r.doc_id, r.text or "") for r in ngram_jaccard.deduplicate(docs).collect()), key=repr)
    assert {i for i, _ in kept} == {1, 5, 7, 8, None}
