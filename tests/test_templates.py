"""Templates against all pairs of profiles."""

import random

import pytest

from costweave.operators import profiles

SCHEMA = "id long, names array<string>, kinds array<string>, match string"


def formed(row):
    text = lambda c: [(x or "").strip().lower() for x in c or []]
    return text(row[1]), text(row[2])


def similarity(x, y):
    (a, s), (b, t) = x, y
    both = len({*a} | {*b})
    words = 100 * len({*a} & {*b}) / both if both else 100
    counts = 100 - abs(len(a) - len(b)) / max(len(a), len(b), 1) * 100
    held = min(len(s), len(t))
    kinds = 100 * sum(u == v for u, v in zip(s, t, strict=False)) / held if held else 50
    return round(0.5 * words + 0.25 * counts + 15 * (a == b) + 0.1 * kinds, 6)


def plain(tables, templates, least, k):
    out = set()
    known = sorted((r[0], formed(r)) for r in templates if r[0] is not None)
    for r in tables:
        if r[0] is None:
            continue
        own = formed(r)
        same = [i for i, t in known if t == own]
        if same:
            out.add((r[0], same[0], 100.0, "exact", 1))
        elif own[0]:
            best = sorted((-v, i) for i, t in known if t[0] and (v := similarity(own, t)) >= least)[:k]
            out |= {(r[0], i, -v, "fuzzy", n + 1) for n, (v, i) in enumerate(best)}
    return out


@pytest.mark.parametrize(("least", "k"), [(75.0, 6), (55.0, 2), (92.0, 6)])
def test_equals_all_pairs(spark, least, k):
    r = random.Random(3)
    words = ["Description", "unit", " Unit", "qty", "price", "amount", "note", "code"]

    def table(i):
        names = [r.choice(words) for _ in range(r.randrange(1, 7))]
        return i, names, [r.choice(["text", "number"]) for _ in names][: r.randrange(8)], "a column of that name"

    templates = [table(i) for i in range(70)] + [(None, ["unit"], ["text"], ""), (71, [], [], ""), (72, None, None, ""), (73, ["x", None], None, "")]
    shuffled = [(i + 100, r.sample(n, len(n)), s, m) for i, n, s, m in templates[:70]]
    tables = [table(i) for i in range(200, 260)] + shuffled + [(300, *templates[5][1:]), (301, [], None, ""), (302, None, ["text"], ""), (303, ["x", ""], ["text", "text"], ""), (None, ["unit"], ["text"], "")]
    got = profiles.match(spark.createDataFrame(tables, SCHEMA), spark.createDataFrame(templates, SCHEMA), least, k)
    want = plain(tables, templates, least, k)
    assert len(want) > 30
    assert {(x.id, x.template_id, x.similarity, x.match, x.place) for x in got.collect()} == want


def test_empty_sides(spark):
    none, one = spark.createDataFrame([], SCHEMA), spark.createDataFrame([(1, ["a"], ["text"], "")], SCHEMA)
    assert profiles.match(none, one).collect() == profiles.match(one, none).collect() == []


def test_profiles_without_enough_shared_names_do_not_meet():
    mine, others, *_ = profiles._ways([(4, 4), (7, 7)], [(5, 5), (7, 6), (7, 7)], 75.0)
    pairs = {(x[:2], y[:2]) for x in mine for y in others if x[2] == y[2]}
    assert pairs == {((7, 7), (7, 6)), ((7, 7), (7, 7))}
    few, _, parts, others = profiles._ways([(40, 40)], [(40, 40)], 75.0)
    assert not few and len(parts) == len(others) == 9


@pytest.mark.parametrize("most", [0, 256])
def test_subsets_and_parts_find_the_same(spark, monkeypatch, most):
    monkeypatch.setattr(profiles, "SUBSETS", most)
    test_equals_all_pairs(spark, 75.0, 6)
