"""Fuzzy matching, clusters, gate, sections, codes and classes on small inputs, against plain Python."""

import random
from difflib import SequenceMatcher

from costweave.functions import text
from costweave.operators import catalogue, fuzzy, gate, rules, sections, specs, units


def plain_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        row = [0] + [0] * len(b) if not b else _next(row, x, b)
    return row[-1]


def _next(row, x, b):
    out = [0]
    for j, y in enumerate(b):
        out.append(row[j] + 1 if x == y else max(out[-1], row[j + 1]))
    return out


def plain_ratio(a, b):
    return 2 * plain_lcs(a, b) / (len(a) + len(b)) if a or b else 1.0


def near_texts(n, seed):
    r = random.Random(seed)
    base = ["".join(r.choice("abcd ef") for _ in range(r.choice([3, 5, 8, 9, 10, 12, 13, 14, 20, 70, 90]))).strip() or "x" for _ in range(n)]
    out = list(base)
    for t in base:
        for edits in (1, 2, 3):
            u = list(t)
            for _ in range(edits):
                at = r.randrange(len(u) + 1)
                if r.random() < 0.5 or not u:
                    u.insert(at, r.choice("abcdef"))
                else:
                    u.pop(min(at, len(u) - 1))
            out.append(" ".join("".join(u).split()) or "y")
    return sorted(set(out))


def test_indel_ratio_against_the_table():
    r = random.Random(1)
    for _ in range(300):
        a, b = ("".join(r.choice("abc é😀") for _ in range(r.randrange(0, 90))) for _ in "ab")
        assert fuzzy.common_length(a, b) == plain_lcs(a, b)


def test_near_pairs_lose_none(spark):
    texts = near_texts(40, 7)
    got = {(p.a, p.b) for p in fuzzy.near_pairs(spark.createDataFrame([(t, "m") for t in texts], "text string, unit string"), "unit").collect()}
    want = {(a, b) for i, a in enumerate(texts) for b in texts[i + 1 :] if plain_ratio(a, b) >= 0.85}
    assert len(want) > 50
    assert got == want


def test_clusters_of_units_nulls_and_repeats(spark):
    rows = [("Concrete wall", "m"), ("concrete  walls", "m"), ("concrete wall", "m"), ("concrete walls", "kg"), ("pipe", None), ("pipes", None), (None, "m"), ("  ", "m")]
    got = fuzzy.clusters(spark.createDataFrame(rows, "description string, unit string")).collect()
    assert len(got) == len(rows)
    found = {(r.description, r.unit): r.cluster for r in got}
    assert found[("concrete  walls", "m")] == found[("Concrete wall", "m")] == "concrete wall"
    assert found[("concrete walls", "kg")] == "concrete walls"
    assert found[("pipes", None)] == "pipe"
    assert found[(None, "m")] is None and found[("  ", "m")] is None
    assert fuzzy.clusters(spark.createDataFrame([], "description string, unit string")).count() == 0


def test_block_matches_against_all_pairs(spark):
    r = random.Random(3)
    word = lambda: r.choice(["pour", "concrete", "wall", "beam", "steel", "m250", "deep", "slab"])
    masters = [(i, r.choice("AB"), " ".join(word() for _ in range(r.randrange(1, 6))), r.choice(["m", "kg", None])) for i in range(80)]
    items = [(r.choice("AB"), " ".join(word() for _ in range(r.randrange(1, 6))), r.choice(["m", "kg", None])) for _ in range(60)] + [("A", None, "m"), ("B", " ", "m")]
    got = fuzzy.block_matches(spark.createDataFrame(items, "code string, description string, unit string"), spark.createDataFrame(masters, "master_id long, code string, description string, unit string"), "code")
    want = {}
    for code, d, unit in items:
        for i, other_code, other, other_unit in masters:
            if code != other_code or not (d or "").strip():
                continue
            x, y = set(d.split()), set(other.split())
            s = 1.0 if d == other else 0.6 * SequenceMatcher(None, d, other).ratio() + 0.4 * len(x & y) / max(len(x), len(y))
            s = round(min(1.0, s + (0.05 if unit and unit == other_unit else 0)), 9)
            if s >= 0.8:
                key = (code, d, unit, other, other_unit)
                want[key] = (min(i, want.get(key, (i, s))[0]), s)
    assert len(want) > 20
    assert sorted((r.code, r.text, r.unit or "", r.master_id, r.score) for r in got.collect()) == sorted((c, d, u or "", i, s) for (c, d, u, _, _), (i, s) in want.items())


def test_gate_cases(spark):
    own = gate.Rules(r"^[A-Z]{2}-\d+$", {"misc": "(?i)misc"}, {"tee": r"\btee\b"}, {"has_verb": "pour", "has_material": "concrete", "has_location": "wall", "has_specs": r"M\d+"}, {"concrete": gate.Category(2, 0, "M250"), "earth": gate.Category(1, 25, "K95")})
    rows = [("AB-12", None), ("misc works", None), ("tee 90", None), ("abc", None), (None, "concrete"), ("pour concrete wall M300", "concrete"), ("pour concrete wall", "concrete"), ("pour it all", "earth"), ("nothing here", "unknown")]
    got = {r.description: (r.status, r.score, r.reason, r.default_grade, r.destination) for r in gate.destination(gate.score(spark.createDataFrame(rows, "description string, category string"), own)).collect()}
    assert got == {
        "AB-12": ("SKIPPED", 0, "device code", None, "skipped"),
        "misc works": ("REJECTED", 0, "forbidden: misc", None, "quarantine"),
        "tee 90": ("APPROVED", 75, "accepted: tee", None, "master"),
        "abc": ("REJECTED", 10, "too short", None, "quarantine"),
        None: ("REJECTED", 10, "too short", None, "quarantine"),
        "pour concrete wall M300": ("APPROVED", 100, None, None, "master"),
        "pour concrete wall": ("APPROVED", 100, None, "M250", "master"),
        "pour it all": ("PENDING_REVIEW", 75, None, "K95", "pending"),
        "nothing here": ("REJECTED", 0, "few indicators", None, "red work item"),
    }


def test_paths_against_a_stack(spark):
    r = random.Random(5)
    rows = [(f, i, r.randrange(1, 5)) for f in range(20) for i in range(r.randrange(1, 30))]
    want = {}
    for f in range(20):
        stack = []
        for _, i, level in (x for x in rows if x[0] == f):
            while stack and stack[-1][1] >= level:
                stack.pop()
            want[f, i + 1] = [p for p, _ in stack]
            stack.append((i + 1, level))
    found = sections.enclosing(spark.createDataFrame(rows, "file_id long, line long, level int"), "file_id", ["line"], 4)
    assert {(r.file_id, r.position): r.path for r in found.collect()} == want


def test_rows_before_the_first_header(spark):
    rows = spark.createDataFrame([(1, 1, None), (1, 2, True), (1, 3, False), (1, 4, True)], "file_id long, line long, head boolean")
    got = sorted((r.section, r.first_row, r.last_row, r.n_items) for r in sections.segments(rows, "file_id", ["line"], rows["head"]).collect())
    assert got == [(0, 1, 1, 1), (1, 2, 3, 1), (2, 4, 4, 0)]


def test_codes_go_on_after_the_largest_number(spark):
    rows = spark.createDataFrame([("A", 3), ("A", 1), ("B", 2), (None, 5)], "code string, id long")
    used = spark.createDataFrame([("A-0002",), ("A-10000",), ("C-0009",)], "work_code string")
    assert {(r.id, r.work_code) for r in catalogue.next_codes(rows, "code", "id", used).where("code is not null").collect()} == {(1, "A-10001"), (3, "A-10002"), (2, "B-0001")}


def test_units_and_defaults(spark):
    rows = spark.createDataFrame([(" M² ", "SEC-1-2"), (None, "SEC-1-3"), ("a very long unit", "SEC-2-1"), ("", None)], "unit string, code string")
    assert [r.u for r in rows.select(units.standard("unit").alias("u")).collect()] == ["m2", "pcs", "a very lon", ""]
    defaults = spark.createDataFrame([("SEC-1-2", "kg"), ("SEC-1", "m")], "code string, unit string")
    assert {(r.code, r.default_unit, r.default_from) for r in units.with_default(rows, defaults).collect()} == {("SEC-1-2", "kg", "own"), ("SEC-1-3", "m", "parent"), ("SEC-2-1", "", "none"), (None, "", "none")}


def test_folding_of_vietnamese_letters(spark):
    import unicodedata

    plain = "Đổ bê tông móng, ống thép Ø60 cửa gỗ"
    rows = spark.createDataFrame([(plain,), (unicodedata.normalize("NFD", plain),), (None,)], "t string")
    assert [r.f for r in rows.select(text.fold("t").alias("f")).collect()] == ["do be tong mong, ong thep ø60 cua go"] * 2 + [None]
    assert rows.where(text.has_word("t", ["mong"])).count() == 2 and rows.where(text.has_word("t", ["ton"])).count() == 0


def test_classes_by_terms_and_means(spark):
    rows = spark.createDataFrame([("steel beam",), ("x",), (None,), ("a+b",)], "description string")
    got = [r.classes for r in rules.by_terms(rows, {"S": ["steel", "eam"], "P": ["a+b"]}, 2).collect()]
    assert [[(c.code, c.score) for c in x] if x else [] for x in got] == [[("S", round((5 * 10 + 20 + 3 * 10) / 2, 6))], [], [], [("P", 95.0)]]
    vectors = spark.createDataFrame([(1, [1.0, 0.0], 7), (2, [0.0, 2.0], 3), (3, [1.0, 0.1], None), (4, None, 7)], "vec_id long, embedding array<float>, label int")
    assert {(r.vec_id, r.code) for r in rules.by_class_mean(vectors, 1).collect()} == {(1, 7), (2, 3), (3, 7)}
    assert rules.by_class_mean(vectors.where("label is null"), 1).count() == 0


def test_specifications(spark):
    want = {
        "Bê tông cốt thép dầm M300": ("be tong cot thep", None, "M300", None),
        "BT B22.5": ("be tong", None, "B22.5", None),
        "be tong C20/25": ("be tong", None, "C20/25", None),
        "thép cột CB400": ("cot thep", None, "CB400", None),
        "ong HDPE D110 PN10": ("ong", "HDPE", "PN10", "D110"),
        "cap dong 240mm2": ("cap", "Cu", None, "240mm2"),
        "cap dien Cu/XLPE 4x16mm2": ("cap dien", "Cu/XLPE", None, "4x16mm2"),
        "gach lat 600 X 600": ("gach lat", None, None, "600x600"),
        "xay tuong gach": ("xay", None, None, None),
        "van khuon go": ("van khuon", "go", None, None),
        "excavation 2m deep": ("dao dat", None, None, "2m"),
        "dap dat nen K95": ("dap dat", None, "K95", None),
        "son nuoc 15 mm": ("son", None, None, "15mm"),
        "": (None, None, None, None),
        None: (None, None, None, None),
    }
    rows = specs.with_key(specs.extract(spark.createDataFrame([(t,) for t in want], "description string"))).collect()
    assert {r.description: (r.category, r.material, r.grade, r.dimension) for r in rows} == want
    found = {r.description: (r.matching_key, r.completeness) for r in rows}
    assert found["ong HDPE D110 PN10"] == ("ong|hdpe|pn10|d110", 1.0)
    assert found["be tong C20/25"] == ("be tong|x|c20/25|x", 0.55)
    assert found[None] == ("x|x|x|x", 0.0)
