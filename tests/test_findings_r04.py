"""Faults found in the fourth review, each on a small input."""

from itertools import permutations, product

import pytest
from pyspark.sql import functions as F

from costweave.operators import catalogue, profiles
from costweave.session import stage


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_quantiles_are_worked_out_once(spark):
    """A cluster merges sketches in the order in which they arrive, so that a plan that holds them twice cuts buckets in two ways."""
    rows = spark.range(3000).select((F.col("id") % 3).cast("string").alias("code"), "id")
    found = catalogue.next_codes(rows, "code", "id")
    assert "percentile_approx" not in plan(found)
    assert {(r.id, r.work_code) for r in found.collect()} == {(i, f"{i % 3}-{i // 3 + 1:04d}") for i in range(3000)}


@pytest.mark.parametrize(("most", "few"), [(256, 1_000_000), (3, -1)])
def test_profiles_of_the_same_names_make_no_rows_of_pairs(spark, monkeypatch, most, few):
    """Every table is similar to every template here; a row for each pair would grow with their product."""
    staged = {}
    monkeypatch.setattr(profiles, "stage", lambda df, name: staged.setdefault(name, stage(df, name)))
    monkeypatch.setattr(profiles, "LIST", most, raising=False)
    monkeypatch.setattr(profiles, "FEW", few, raising=False)
    sheets = [(i, list(n), list(k)) for i, (n, k) in enumerate(product(permutations("abc"), product(["text", "date"], repeat=3)))]
    tables, templates = [r for r in sheets if r[0] % 3], [r for r in sheets if r[0] % 3 == 0]
    wide = ["v", "w", "x", "y"], ["text"] * 5
    tables.append((900, [*wide[0], "z"], wide[1]))
    templates += [(901, [*wide[0], "y"], wide[1]), (902, [*wide[0], "y"], ["date", *wide[1][1:]])]  # 75 and 73 percent
    like = lambda x, y: round(75 + 15 * (x[1] == y[1]) + 10 * sum(a == b for a, b in zip(x[2], y[2], strict=True)) / 3, 6)
    want = {(900, 901, 75.0, "fuzzy", 1)}
    for x in tables[:-1]:
        want |= {(x[0], i, -v, "fuzzy", n + 1) for n, (v, i) in enumerate(sorted((-like(x, y), y[0]) for y in templates[:-2])[:6])}
    schema = "id long, names array<string>, kinds array<string>"
    found = profiles.match(spark.createDataFrame(tables, schema), spark.createDataFrame(templates, schema))
    assert {(r.id, r.template_id, r.similarity, r.match, r.place) for r in found.collect()} == want
    assert staged["pairs"].count() == 1
