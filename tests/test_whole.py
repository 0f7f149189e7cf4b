"""Small inputs on which a part of the job would give other rows."""

from costweave import queries
from costweave.operators import analytics, catalogue, hierarchy


def test_every_version_meets_the_one_before(spark):
    files = spark.createDataFrame([(10 + v, 1, v) for v in range(1, 5)] + [(20, 2, 1)], "file_id long, project_id long, uploaded_at long")
    lines = [(11, "pipe", 1.0), (12, "pipe", 1.0), (13, "pipe", 3.0), (13, "valve", 1.0), (20, "pump", 1.0)]  # version 4 is empty
    lines += [(11, "bolt", None), (12, "bolt", None), (13, "bolt", 4.0)]
    items = spark.createDataFrame([(f, 1, 1, d, q, 2.0, q) for f, d, q in lines], "file_id long, line_number long, master_id long, description string, quantity double, unit_price double, amount double")
    got = {(r.project_id, r.version, r["item"], r.status) for r in catalogue.version_diffs(items, files).collect()}
    assert got == {(1, 2, "pipe", "unchanged"), (1, 3, "pipe", "modified"), (1, 3, "valve", "added"), (1, 4, "pipe", "removed"), (1, 4, "valve", "removed"), (1, 2, "bolt", "unchanged"), (1, 3, "bolt", "unchanged"), (1, 4, "bolt", "removed")}


def test_nearest_vectors_of_other_labels_and_none(spark, monkeypatch):
    monkeypatch.setattr(hierarchy, "VECTOR_BLOCK", 2)
    vectors = spark.createDataFrame([(1, [1.0, 0.0], 0), (2, [1.0, 0.1], 1), (3, [0.0, 1.0], 0), (4, [0.1, 1.0], None), (5, [-1.0, 0.0], 1)], "vec_id long, embedding array<float>, label int")
    got = {(r.vec_id, r.label, r.n_id) for r in hierarchy.vector_topk(vectors, 1, in_label=False).collect()}
    assert got == {(1, 0, 2), (2, 1, 1), (3, 0, 4), (4, None, 3), (5, 1, 3)}


def test_items_meet_the_whole_catalogue(spark):
    data = "/root/testdata/sf0.001"
    items, masters = queries.views.line_items(spark, data), queries.views.catalogue(spark, data)
    known = {r.description.lower() for r in masters.collect()}
    stages = {(r.file_id, r.line_number, r.stage) for r in queries.tier_cascade(spark, data).collect()}
    assert {s for _, line, s in stages if line % 3 == 0} == {"exact"}
    assert {s for _, line, s in stages if line == 7} == {"new"}
    assert {s for _, line, s in stages if line in (1, 4)} == {"synonym"}
    assert all(r.description.lower() not in known for r in queries.unmatched_items(spark, data).collect())
    assert queries.unmatched_items(spark, data).where("line_number = 7").count() == items.where("line_number = 7").count()


def test_ranks_hold_no_group_in_one_task(spark):
    values = [(k, float(x)) for k, n in (("a", 301), ("b", 4), (None, 7)) for x in [*[5] * (n // 3), *((i * 37) % 101 + 1 for i in range(n - n // 3))]]
    rows = spark.createDataFrame([(k, v, "1998-01-01") for k, v in values], "sec_code string, unit_price double, recorded_at string").selectExpr("sec_code", "unit_price", "cast(recorded_at as timestamp) recorded_at")
    own = {k: sorted(v for key, v in values if key == k) for k in ("a", "b", None)}
    spread = analytics.price_distribution(rows)
    assert {(r.sec_code, r.n_prices, r.p25, r.p75) for r in spread.collect()} == {(k, len(v), v[len(v) // 4], v[3 * len(v) // 4]) for k, v in own.items()}
    middle = analytics.prices_by(rows, ["sec_code"], "1997-01-01", "1999-01-01")
    assert {(r.sec_code, r.n_prices, r.median_price) for r in middle.collect()} == {(k, len(v), (v[(len(v) - 1) // 2] + v[len(v) // 2]) / 2) for k, v in own.items()}
    plan = middle._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile(" not in plan and "before" in spread._jdf.queryExecution().optimizedPlan().toString()


def test_deep_code_trees_and_loops(spark):
    chain = [("c0", None), *((f"c{i}", f"c{i - 1}") for i in range(1, 25)), ("c20", "c24")]
    rows = hierarchy.tree(spark.createDataFrame(chain, "code string, parent string")).collect()
    assert sorted((r.level, r.code) for r in rows) == [(i + 1, f"c{i}") for i in range(25)]
    assert max(rows, key=lambda r: r.level).path == " > ".join(f"c{i}" for i in range(25))


def test_pareto_ties_over_many_ranges(spark):
    data = [(f"item {i:04d}", u, f) for i in range(400) for u, f in (("m", 1), ("kg", 1 + i % 3))]
    rows = spark.createDataFrame(data, "description string, unit string, frequency long")
    got = {(r.description, r.unit): r.is_top for r in catalogue.pareto(rows.repartition(7)).collect()}
    whole, before, want = sum(f for _, _, f in data), 0, {}
    for d, u, f in sorted(data, key=lambda x: (-x[2], x[0], x[1])):
        want[d, u] = before * 100 < whole * 80
        before += f
    assert got == want
