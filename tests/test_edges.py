"""Odd rows of operators: nulls, equal prices, ragged vectors, many classes, keywords of any length, builds that run again."""

import random
import tempfile

from costweave.operators import analytics, build, cascade, catalogue, codes, gate, hierarchy, profiles, rules


def test_no_null_or_empty_word_speaks_for_its_cluster(spark):
    rows = [("a", None, 99), ("a", "pump", 1), ("b", "Pump pump", 50), ("b", "pump dn50", 2), ("c", "misc", 9), ("c", "red valve", 1), ("d", None, 3), (None, "x y", 1), (None, "xx yy", 1)]
    got = {r.cluster: (r.description, r.total_frequency) for r in cascade.elect_canonical(spark.createDataFrame(rows, "cluster string, description string, frequency long"), ["cluster"]).collect()}
    assert got == {"a": ("pump", 100), "b": ("pump dn50", 52), "c": ("red valve", 10), "d": (None, 3), None: ("xx yy", 2)}


def test_equal_prices_are_one_bucket(spark):
    same = spark.createDataFrame([(5.0,)] * 4 + [(None,), (-1.0,)], "unit_price double")
    assert [(r.bucket, r.bucket_from, r.bucket_to, r.n_prices) for r in analytics.price_histogram(same, 3).collect()] == [(0, 5.0, 5.0, 4)]
    assert [r.n_prices for r in analytics.price_histogram(spark.createDataFrame([(1.0,), (2.0,), (4.0,)], "unit_price double"), 3).orderBy("bucket").collect()] == [1, 1, 1]


def test_codes_of_rows_without_a_prefix(spark):
    rows = spark.createDataFrame([("P", 3), ("P", 1), (None, 7)], "p string, v long")
    assert {(r.p, r.v, r.work_code) for r in catalogue.next_codes(rows, "p", "v").collect()} == {("P", 1, "P-0001"), ("P", 3, "P-0002"), (None, 7, None)}


def test_vectors_of_any_kind(spark):
    nan = float("nan")
    rows = [(1, [1.0, 0.0], 0), (2, [1.0, 0.1], 0), (3, [1.0, 0.0, 0.0], 0), (4, [1.0, 0.2, 0.0], 0), (5, None, 0), (6, [nan, 1.0], 0), (7, [None, 1.0], 0), (8, [], 0)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    assert {(r.vec_id, r.n_id) for r in hierarchy.vector_topk(vectors, 2).collect()} == {(1, 2), (2, 1), (3, 4), (4, 3)}


def test_more_classes_than_a_model_holds(spark, monkeypatch):
    rng = random.Random(1)
    vectors = spark.createDataFrame([(i, [rng.gauss(0, 1) for _ in range(4)], i % 9) for i in range(60)] + [(99, [], 1), (98, None, 1)], "vec_id long, embedding array<double>, label int")
    rows = lambda: sorted((r.vec_id, r.code, r.similarity, r.place) for r in rules.by_class_mean(vectors, 3).collect())
    want = rows()
    monkeypatch.setattr(rules, "MOST_CLASSES", 5)
    assert rows() == want and len(want) == 180


def test_keywords_of_any_length(spark):
    rng = random.Random(2)
    texts = ["".join(rng.choices("abC é", k=rng.randrange(0, 60))) for _ in range(200)] + ["a", "", None, "long " * 5000 + "needle"]
    words = ["a", "AB", "abc", "c é", "bca b", "needle", "", None, "zzz", "aé" * 3, "b", "long long"]
    got = {(r.id, r.keyword) for r in rules.containing(spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(None, "abc")], "id long, text string"), spark.createDataFrame([(w,) for w in words], "keyword string")).collect()}
    assert got == {(i, w.lower()) for i, t in enumerate(texts) for w in words if t and w and w.lower() in t.lower()}


def test_builds_that_run_again(spark):
    own = gate.Rules(r"^[A-Z]{2}-\d+$", {"misc": "misc"}, {"tee": r"\btee\b"}, {"a": "a", "b": "b", "c": "c"}, {})
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(["a b c", "abc tee", "misc", "XY-1", None, "zzzzzzz", "a b"])], "id long, description string").selectExpr("*", "cast(null as string) as category")
    path = tempfile.mkdtemp(prefix="spark-", dir="/tmp") + "/built"
    for _ in range(2):
        back, counts = build.run(rows, own, path)
        found = {r.id: r.destination for r in back.collect()}
        assert len(found) == 7 == counts["rows"]
        assert {d: list(found.values()).count(d) for d in build.DESTINATIONS} == {d: counts[d] for d in build.DESTINATIONS}
    back, counts = build.run(rows.limit(0), own, path)
    assert back.count() == 0 == counts["rows"]


def test_kinds_of_columns(spark):
    rows = [("1", "1.5", "2024-01-01", None, " "), ("2", "x", "2024-01-02 00:00", None, ""), ("y", "2", "no", None, "z")]
    got = {r.name: (r.kind, r.n_kind, r.n_values) for r in profiles.kinds(spark.createDataFrame(rows, "a string, b string, c string, d string, e string")).collect()}
    assert got == {"a": ("integer", 2, 3), "b": ("integer", 1, 3), "c": ("date", 2, 3), "d": (None, 0, 0), "e": ("empty", 2, 3)}


def test_scored_codes_count_names_words_and_keywords(spark):
    texts = spark.createDataFrame([(1, "Red Steel pipe DN50"), (2, "red steel pipe dn50"), (2, "red steel pipe dn50"), (3, "pipe"), (4, None), (5, ""), (None, "red"), (6, "steelwork")], "id long, text string")
    codes = spark.createDataFrame([("A", "steel pipe", ["DN50", "dn50"]), ("B", "pipe pipe red tee", None), ("C", "wire", [None, "red"]), ("D", None, ["red"]), (None, "red", []), ("E", "steel", [""])], "code string, name string, keywords array<string>")
    run = lambda k, excluded=None: {(r.id, r.place): (r.code, r.score) for r in rules.scored_codes(texts, codes, k, excluded).collect()}
    full = {(1, 1): ("A", 0.9), (1, 2): ("E", 0.5), (1, 3): ("B", 0.2), (1, 4): ("C", 0.2)}
    full |= {(2, place): v for (_, place), v in full.items()} | {(3, 1): ("A", 0.15), (3, 2): ("B", 0.1), (6, 1): ("E", 0.5)}
    assert run(9) == full
    assert run(1) == {k: v for k, v in full.items() if k[1] == 1}
    context = spark.createDataFrame([("red", "Red Steel"), ("dn50", None), ("dn50", "")], "keyword string, context string")
    assert run(9, context) == {k: v for k, v in full.items() if v[0] != "C"}
    assert run(9, context.where("false")) == full
    assert rules.scored_codes(texts.where("false"), codes, 3).isEmpty() and rules.scored_codes(texts, codes.where("false"), 3).isEmpty()


def test_price_statistics_of_few_prices_and_changes_without_a_base(spark):
    items = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 2.0), ("a", 7.0), ("b", 3.0), ("b", 4.0), ("b", 0.0), (None, 5.0), ("c", None)], "sec_code string, unit_price double")
    got = {r.sec_code: (r.n_prices, r.mean_price, r.median_price, r.p25, r.p75) for r in analytics.price_statistics(items).collect()}
    assert got == {"a": (4, 3.0, 2.0, 2.0, 7.0), "b": (2, 3.5, 3.5, None, None), None: (1, 5.0, 5.0, None, None)}
    rows = [("x", 10.0, 1.0, 10.0, 1.1), ("y", 10.0, 1.0, 11.0, 1.04), ("z", 0.0, None, 5.0, 3.0), ("w", 10.0, 1.0, None, 1.0), ("same", 1.0, 1.0, 1.0, 1.0)]
    diffs = spark.createDataFrame([(1, 2, *r, "modified") for r in rows] + [(1, 2, "new", None, None, 1.0, 1.0, "added")], "project_id long, version int, item string, quantity_old double, price_old double, quantity_new double, price_new double, status string")
    found = {r.item: (r.change, r.price_diff and round(r.price_diff, 6), r.quantity_diff) for r in catalogue.version_changes(diffs).collect()}
    assert found == {"x": ("price_changed", 10.0, None), "y": ("quantity_changed", 4.0, 10.0), "z": ("unchanged", None, None), "w": ("quantity_changed", None, -100.0), "same": ("unchanged", None, None)}


def test_work_codes_and_categories_of_odd_texts(spark):
    rows = spark.createDataFrame([("S01-CONC-M250-0007",), ("S01-CONC-SUB-0007",), ("S12-X-9999",), ("S1-X-0001",), ("S01-X-00001",), ("S01-X-M2-0001",), ("",), (None,)], "c string")
    parts = {r.c: r.p and tuple(r.p) for r in rows.select("c", codes.work_code_parts("c").alias("p")).collect()}
    good = {"S01-CONC-M250-0007": ("S01", "CONC", None, "M250", 7), "S01-CONC-SUB-0007": ("S01", "CONC", "SUB", None, 7), "S12-X-9999": ("S12", "X", None, None, 9999)}
    assert parts == {c: good.get(c) for c in parts}
    texts = spark.createDataFrame([("Paint tree",), ("paint and PLASTER a wall",), ("wall beam",), ("other",), ("",), (None,)], "t string")
    of = lambda *rules: [r.c for r in texts.select(codes.work_category("t", *rules).alias("c")).collect()]
    assert of({"green": ["tree"], "none": []}, {"structure": ["beam", "slab"], "finish": ["paint", "plaster", "wall"]}) == ["green", "finish", "structure", "GENERAL", "GENERAL", "GENERAL"]
    assert of({}, {}, "any") == ["any"] * 6


def test_means_totals_and_rates_of_few_rows(spark):
    log = spark.createDataFrame([("a", 0.5, None), ("a", None, 3), ("a", 0.25, 4), (None, None, None)], "action string, confidence double, distance int")
    assert {tuple(r) for r in analytics.log_means(log).collect()} == {("a", 3, 0.375, 3.5), (None, 1, None, None)}
    kinds = spark.createDataFrame([("x",), ("x",), (None,)], "kind string")
    assert {tuple(r) for r in analytics.counts_by_type(kinds, "kind").collect()} == {("x", False, 2), (None, False, 1), (None, True, 3)}
    items = spark.createDataFrame([("A",), ("R",), ("N",), (None,), ("A",), ("N",)], "method string")
    assert [tuple(r) for r in analytics.coded_rate(items).collect()] == [(6, 2, 1, 50.0)]
    assert [tuple(r) for r in analytics.coded_rate(items.where("false")).collect()] == [(0, 0, 0, 0.0)]
