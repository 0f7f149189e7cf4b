"""Edges of codes, reviews, contexts, write-backs, exports and the stream of prices."""

import tempfile

from pyspark.sql import functions as F

from costweave import streaming
from costweave.functions import text
from costweave.operators import codes, context, review, updates
from costweave.sources import sinks


def test_codes_prefer_longer_words_and_letters_as_written(spark):
    rules = codes.Rules({"van": "VALV", "ván khuôn": "FWRK"}, {"thép": "BAR"}, {"FWRK": "STL"}, {"cột": "COL"}, {"A": "X", "AB": "Y"})
    rows = spark.createDataFrame([(1, "Ván khuôn cột", "AB-1"), (2, "van khuon", "A-2"), (3, "van thep", "C"), (4, None, None), (5, "", "")], "id long, description string, sec_code string")
    got = {r.id: (r.ref_code, r.discipline, r.location) for r in codes.reference_codes(rows, rules).collect()}
    # 2 holds 'van' as written, which comes before any match without diacritics
    assert got == {1: ("A.FWRK.STL", "Y", "COL"), 2: ("A.VALV.GEN", "X", None), 3: ("A.VALV.BAR", None, None), 4: ("A.GENR.GEN", None, None), 5: ("A.GENR.GEN", None, None)}


def test_code_parts(spark):
    rows = spark.createDataFrame([("A.CONC.STR", "aa.1111B", "Pr_21_31_13"), ("A.C.STR", "AA.11", "Pr"), (None, None, None), ("", "", "")], "a string, b string, c string")
    got = rows.select(codes.reference_parts("a").alias("a"), codes.legal_parts("b").alias("b"), codes.class_parts("c").alias("c")).collect()
    assert tuple(got[0].a) == ("A", "CONC", "STR") and tuple(got[0].b) == ("AA", "1111", "b") and got[0].c.path == "Pr > Pr_21 > Pr_21_31 > Pr_21_31_13"
    assert all(x is None for r in got[1:] for x in r)


def test_text_rules(spark):
    rows = spark.createDataFrame([("[a] (b) - c - d - e;;f--g", "2,5", "M"), ("a - b", "x", "mm"), (None, None, None)], "t string, v string, u string")
    got = rows.select(text.without_brackets("t").alias("t"), "v", "u").select(text.three_components("t"), text.millimetres("v", "u")).collect()
    assert [tuple(r) for r in got] == [("a b - c d - e,f-g", "2500mm"), ("a - b", "xmm"), (None, None)]


def test_verdicts(spark):
    cases = [
        (1, "wall M300 D16", "wall - M300 - D16", 90, "GOOD"), (2, "wall M300 D16", "wall - M300", 90, "FIXABLE"), (3, "wall M300 D16", "wall - x", 90, "BAD"), (4, "wall", None, 90, "BAD"),
        (5, "wall", "wall - x", 40, "BAD"), (6, "wall", "wall", 60, "FIXABLE"), (7, "wall", "a wall without any parts", 90, "BAD"), (8, None, "a - b - c - d", 90, "FIXABLE"), (9, "wall", "wall", None, "GOOD"),
    ]
    rows = spark.createDataFrame([c[:4] for c in cases], "id long, original string, normalised string, confidence int")
    got = {r.id: r.verdict for r in review.verdicts(rows, r"[MD]\d+", "PVC").collect()}
    assert got == {c[0]: c[4] for c in cases}


def test_project_types(spark):
    types = {"a": context.Indicators(["x"], [], 1), "b": context.Indicators(["y"], ["z"], 1)}
    lines = spark.createDataFrame([(1, "x"), (1, "X x"), (1, "z"), (2, "x"), (2, "y"), (3, None), (3, "")], "file_id long, description string")
    got = {r.file_id: (r.project_type, round(r.share, 3)) for r in context.project_types(lines, "file_id", types).collect()}
    assert got == {1: ("a", 0.8), 2: ("mixed", 0.5), 3: ("mixed", 0.0)}
    assert context.top_terms(lines, ["file_id"], ["x", "y"], 1).orderBy("file_id").select("file_id", "term", "n").collect() == [(1, "x", 2), (2, "x", 1)]


def test_write_backs(spark):
    items = spark.createDataFrame([(1, "A ", None), (1, "b", 7), (2, "a", None), (None, None, None)], "file_id long, description string, matched_id long")
    variants = spark.createDataFrame([(3, 1, "a"), (4, 1, " A"), (5, 1, "b")], "master_id long, file_id long, variant string")
    got = updates.back_links(items, variants).select("file_id", "description", "matched_id").collect()
    assert sorted(map(tuple, got), key=repr) == sorted([(1, "A ", 4), (1, "b", 7), (2, "a", None), (None, None, None)], key=repr)


def test_export_keeps_quotes_nulls_and_order(spark):
    rows = spark.createDataFrame([("b", "say \"x\", y"), ("a", None), ("c", "")], "k string, t string")
    assert sinks.csv_round_trip(rows, ["k"]).collect() == rows.orderBy("k").collect()


def test_stream_goes_on_where_it_stopped(spark):
    place, folder = (tempfile.mkdtemp(prefix="spark-", dir="/tmp") for _ in range(2))
    assert streaming.current(spark, f"{folder}/none").count() == 0
    for price in (5.0, 2.0):
        spark.createDataFrame([(1, price, price), (int(price), 9.0, 9.0)], "master_id long, unit_price double, amount double").write.mode("append").parquet(place)
        streaming.running_prices(spark.readStream.schema("master_id long, unit_price double, amount double").parquet(place), folder)
    got = streaming.current(spark, folder).withColumn("total_amount", F.col("total_amount").cast("double")).orderBy("master_id").collect()
    assert [tuple(r) for r in got] == [(1, 2, 2.0, 5.0, 7.0), (2, 1, 9.0, 9.0, 9.0), (5, 1, 9.0, 9.0, 9.0)]
