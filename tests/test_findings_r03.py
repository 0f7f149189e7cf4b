"""Faults found in the third review, each on a small input."""

import duckdb
import pandas as pd

from costweave import queries
from costweave.operators import catalogue, fuzzy_keywords, rules, specs
from costweave.session import spread


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_work_codes_beyond_four_digits(spark, tmp_path):
    n = 10_020
    part = pd.DataFrame({"p_partkey": range(n), "p_name": "red bolt", "p_brand": "Brand#1", "p_type": "PROMO", "p_size": 1, "p_retailprice": 1.0})
    part.to_parquet(tmp_path / "part.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet'")
    for t in ("customer", "nation", "region", "orders", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.001/{t}.parquet'")
    want = con.execute(queries.ORACLES["next_work_code"]).fetchall()
    got = [tuple(r) for r in queries.next_work_code(spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(want)
    assert (n - 1, "Brand#1-10020") in got


def test_words_are_looked_up_in_one_reading(spark):
    names = {"pipe": ["ong", "pipe"], "fitting": ["co ong", "elbow"], "steel pipe": ["ong thep"], "other": ["ong"]}
    texts = {" co ong ": "fitting", " ong thep ong ": "steel pipe", " ong co ": "other", " xong pipes ": None, " xong elbow pipe ": "fitting", "  ": None, None: None}
    rows = spark.createDataFrame([(t, n) for t, n in texts.items()], "t string, name string")
    assert all(r.got == r.name for r in rows.withColumn("got", specs.first_named(rows.t, names)).collect())
    found = specs.with_key(specs.extract(spark.createDataFrame([("pipe",)], "description string"))).where("completeness < 0.75D")
    assert plan(found).count("translate(") < 20


def test_scores_are_worked_out_once(spark):
    found = queries.rule_classify(spark, "/root/testdata/sf0.001")
    assert "rlike" not in "".join(line.lower() for line in plan(found).splitlines() if "Filter" in line)
    rows = spark.createDataFrame([(1, "old ring, cold ring"), (2, "nothing"), (3, None)], "id long, description string")
    got = {r.id: [(c.code, c.score) for c in r.classes] for r in rules.by_terms(rows, {"A": ["ring", "gear"], "B": ["old", "ring"]}, 2).collect()}
    assert got == {1: [("A", round(400 / 19 + 20, 6)), ("B", round((300 / 19 + 20 + 400 / 19 + 20) / 2, 6))], 2: [], 3: []}


def test_versions_are_read_once(spark):
    files = spark.createDataFrame([(1, 1, 1), (2, 1, 2), (3, 1, 3), (7, None, 1), (8, None, 2)], "file_id long, project_id long, uploaded_at long")
    lines = [(1, 1, "Pipe", 1.0), (1, 2, " pipe", 2.0), (2, 1, "pipe", 2.0), (1, 3, "valve", 5.0), (3, 1, "valve", 5.0), (7, 1, "pump", 1.0), (8, 1, "pump", 1.0), (3, 2, None, 1.0)]
    items = spark.createDataFrame([(f, n, 1, d, q, 2.0, q) for f, n, d, q in lines], "file_id long, line_number long, master_id long, description string, quantity double, unit_price double, amount double")
    found = catalogue.version_diffs(items, files)
    want = {(1, 2, "pipe", 2.0, 2.0, "unchanged"), (1, 2, "valve", 5.0, None, "removed"), (1, 3, "pipe", 2.0, None, "removed"), (1, 3, "valve", None, 5.0, "added"), (None, 2, "pump", None, 1.0, "added")}
    assert {(r.project_id, r.version, r["item"], r.quantity_old, r.quantity_new, r.status) for r in found.collect()} == want
    assert plan(found).count("LogicalRDD") + plan(found).count("LocalRelation") == 2


def test_grams_in_tasks_and_by_join_find_the_same(spark, monkeypatch):
    texts = spark.createDataFrame([(1, "Red bolt 😀x"), (2, "bolted\nred"), (3, "re"), (4, None), (None, "red"), (5, ""), (2, "cold")], "id long, text string")
    words = spark.createDataFrame([(w,) for w in ("RED", "bolt", "d", "😀x", "t 😀x", "lted\nre", "cold", "", None)], "keyword string")
    want = {(1, "red"), (1, "bolt"), (1, "d"), (1, "😀x"), (1, "t 😀x"), (2, "bolt"), (2, "red"), (2, "d"), (2, "lted\nre"), (2, "cold")}
    for most, held in ((100_000, 200_000), (0, 1)):
        monkeypatch.setattr(rules, "MOST_GRAMS", most)
        monkeypatch.setattr(rules, "HELD", held)
        assert {tuple(r) for r in rules.containing(texts, words).collect()} == want


def test_runs_are_made_over_all_cores(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(fuzzy_keywords, "spread", lambda df: seen.append(spread(df)) or seen[-1])
    texts = spark.createDataFrame([(1, "a red bold here"), (2, None), (3, " ")], "id long, text string").coalesce(1)
    words = spark.createDataFrame([("red bolt",), ("here",)], "keyword string")
    assert {(r.id, r.keyword, r.n_windows) for r in fuzzy_keywords.find(texts, words).collect()} == {(1, "red bolt", 1), (1, "here", 1)}
    assert seen[0].rdd.getNumPartitions() == 4 * spark.sparkContext.defaultParallelism
