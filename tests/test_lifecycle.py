"""Specification life, spans and abbreviations against plain Python, with odd rows."""

import random
from datetime import datetime, timedelta

from costweave.operators import abbreviations, lifecycle, specs

WEIGHT = {"category": 25, "material": 25, "grade": 30, "dimension": 20}


def plain(commands):
    state, out = {}, []
    for item, at, seq, action, field, value in sorted((c for c in commands if c[0] is not None), key=lambda c: c[:3]):
        s = state.setdefault(item, {"status": 0, "verified": False, "held": {}})
        old, reason, names = s["status"], None, ["draft", "detailed", "final"]
        if action == "set":
            if field in WEIGHT:
                s["held"][field] = value or ""
            else:
                reason = "unknown field"
        elif action == "verify":
            s["verified"] = True
        complete = sum(w for f, w in WEIGHT.items() if s["held"].get(f))
        if action == "promote":
            if value not in names:
                reason = "unknown status"
            elif names.index(value) <= old:
                reason = "not higher"
            elif complete < {"detailed": 50, "final": 75}[value]:
                reason = "incomplete"
            elif value == "final" and not s["verified"]:
                reason = "not verified"
            else:
                s["status"] = names.index(value)
        elif action not in ("set", "verify"):
            reason = "unknown action"
        out.append((item, seq, complete, names[old], names[s["status"]], reason))
    return sorted(out)


def test_history_equals_a_plain_loop(spark):
    rng = random.Random(4)
    day = datetime(2024, 1, 1)
    rows = []
    for seq in range(3000):
        item = rng.choice([1, 1, 1, *range(2, 40), None])
        action = rng.choice(["set", "set", "set", "verify", "promote", "promote", "drop", None])
        field = rng.choice([*WEIGHT, *WEIGHT, "colour", None]) if action == "set" else None
        value = rng.choice(["x", "x", "y", "", None]) if action == "set" else rng.choice(["detailed", "final", "draft", "gone"])
        rows.append((item, day + timedelta(hours=rng.randrange(400)), seq, action, field, value))
    frame = spark.createDataFrame(rows, "item long, at timestamp, seq long, action string, field string, value string").repartition(5)
    log = lifecycle.history(frame)
    got = sorted((r.item, r.seq, r.completeness, r.old_status, r.new_status, r.reason) for r in log.collect())
    want = plain(rows)
    assert got == want
    assert {r.status for r in lifecycle.states(log).collect()} <= {"draft", "detailed", "final"}
    assert lifecycle.history(frame.limit(0)).collect() == []


def test_spans_never_overlap(spark):
    rules = {"long": r"[a-z]+[0-9]+", "short": r"[a-z][0-9]", "number": "[0-9]+"}
    rows = spark.createDataFrame([("ab12 c3, 45 x",), ("",), (None,), ("ab 1",)], "description string")
    got = {r.description: ([(x.rule, x.value) for x in r.specs], r.rest) for r in specs.claim_spans(rows, rules).collect()}
    assert got["ab12 c3, 45 x"] == ([("long", "ab12"), ("long", "c3"), ("number", "45")], ", x")
    assert got[""] == ([], "") and got["ab 1"] == ([("number", "1")], "ab")
    assert got[None] == ([], None)


def test_abbreviations(spark):
    table = {"bt": "be tong", "bt ct": "be tong cot thep", "st": "steel", "d": "diameter"}
    want = {"BT ct dam": "BE TONG COT THEP dam", "bt, ct": "be tong, ct", "St. pipe  st": "Steel. pipe steel", "D110 st2 d": "D110 st2 diameter", "bt bt ct": "be tong be tong cot thep", "D bt": "Diameter be tong", "": "", "best": "best", None: None}
    rows = spark.createDataFrame([(t,) for t in want], "description string")
    assert {r.description: r.e for r in rows.select("description", abbreviations.expand("description", table).alias("e")).collect()} == want
