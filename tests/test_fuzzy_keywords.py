"""Fuzzy keywords against all runs and keywords."""

import random

import pytest

from costweave.functions.similarity import common_subsequences
from costweave.functions.text import fold_word
from costweave.operators import fuzzy_keywords
from costweave.operators.fuzzy import common_length


def plain(texts, keywords, threshold):
    clean = lambda x: " ".join(fold_word(x or "").split())
    keys, out = {clean(k) for k in keywords} - {""}, {}
    for i, t in texts:
        words = clean(t).split()
        for k in keys if i is not None else ():
            size = len(k.split())
            for at in range(len(words) - size + 1):
                run = " ".join(words[at : at + size])
                common = common_length(run, k)
                if 200 * common >= threshold * (len(run) + len(k)):
                    n, best = out.get((i, k), (0, 0.0))
                    out[i, k] = n + 1, max(best, round(200 * common / (len(run) + len(k)), 6))
    return out


def altered(r, x, alphabet):
    x = list(x)
    for _ in range(r.randrange(1, max(2, len(x) // 5 + 1))):
        at = r.randrange(len(x) + 1)
        if r.random() < 0.5:
            x.insert(at, r.choice(alphabet))
        elif x and at < len(x):
            del x[at]
    return "".join(x)


def run(spark, texts, keywords, threshold):
    found = fuzzy_keywords.find(spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame([(k,) for k in keywords], "keyword string"), threshold)
    return {(x.id, x.keyword): (x.n_windows, x.score) for x in found.collect()}, found


@pytest.mark.parametrize(("alphabet", "longest", "threshold"), [("ab", 9, 85), ("abcdefgh", 16, 85), ("abcdefghijkl", 34, 85), ("abcd", 14, 70), ("abc", 8, 100)])
def test_equals_all_runs(spark, alphabet, longest, threshold):
    r = random.Random(longest)
    word = lambda: "".join(r.choice(alphabet) for _ in range(r.randrange(1, longest)))
    keywords = [" ".join(word() for _ in range(r.choice((1, 1, 2, 3)))) for _ in range(60)] + ["", "  ", None, "Tường Xây"]
    texts = [(i, " ".join(altered(r, r.choice(keywords[:60]), alphabet) if r.random() < 0.6 else word() for _ in range(r.randrange(25)))) for i in range(80)]
    texts += [(90, None), (91, ""), (92, "  tuong\n\txay  "), (None, keywords[0]), (1, keywords[1] or "x")]
    got, _ = run(spark, texts, keywords, threshold)
    want = plain(texts, keywords, threshold)
    assert len(want) > 40
    assert got == want


def test_best_and_ties(spark):
    _, found = run(spark, [(1, "concret wall"), (2, "abcdefghij"), (3, "nothing here")], ["concrete", "wall", "abcdefghix", "abcdefghiy"], 85)
    assert {(x.id, x.keyword) for x in fuzzy_keywords.best(found).collect()} == {(1, "wall"), (2, "abcdefghix")}


def test_empty_sides(spark):
    assert run(spark, [], ["a"], 85)[0] == run(spark, [(1, "a")], [], 85)[0] == {}


def test_common_subsequences():
    r = random.Random(4)
    texts = ["".join(r.choice("abé😀 ") for _ in range(r.randrange(40))) for _ in range(300)] + ["", "x"]
    other = r.sample(texts, len(texts))
    assert common_subsequences(texts, other).tolist() == [common_length(x, y) for x, y in zip(texts, other, strict=True)]
