"""Specifications in descriptions: what a text names, in which grade and size, its key, and the spans that rules claim."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from costweave.functions import text as texts

# Names, each with the folded words that stand for it. A word counts between blanks only.
CATEGORIES = {
    "bich": ["bich", "flange", "flanges"],
    "bom": ["bom", "pump", "pumps"],
    "aptomat": ["aptomat", "mcb", "mccb", "breaker"],
    "be tong": ["be tong", "bt", "concrete", "beton"],
    "be tong cot thep": ["be tong cot thep", "btct"],
    "cap": ["cap", "cable", "cables"],
    "cap dien": ["cap dien", "day dien"],
    "chong tham": ["chong tham", "waterproofing"],
    "co ong": ["co ong", "cut", "elbow", "elbows"],
    "con thu": ["con thu", "reducer", "reducers"],
    "contactor": ["contactor", "khoi dong tu"],
    "cot thep": ["cot thep", "thep cot", "ct", "rebar", "rebars"],
    "dao dat": ["dao dat", "excavate", "excavation"],
    "dap dat": ["dap dat", "backfill", "backfilling"],
    "dong ho": ["dong ho", "meter"],
    "gach": ["gach", "brick", "bricks"],
    "gach lat": ["gach lat", "tile", "tiles"],
    "khop noi": ["khop noi", "coupling", "joint"],
    "ong": ["ong", "pipe", "pipes", "tube"],
    "son": ["son", "paint", "painted", "painting"],
    "thep": ["thep", "steel"],
    "thep hinh": ["thep hinh", "thep h", "thep i", "thep u"],
    "trat": ["trat", "plaster", "plastering"],
    "tu dien": ["tu dien", "switchboard", "panel board"],
    "van": ["van cong", "van buom", "van bi", "valve", "valves"],
    "van khuon": ["van khuon", "vk", "formwork"],
    "xay": ["xay", "masonry"],
}
MATERIALS = {
    "Al": ["al", "nhom", "aluminium"],
    "Cu": ["cu", "dong", "copper"],
    "Cu/XLPE": ["cu xlpe", "xlpe cu"],
    "HDPE": ["hdpe"],
    "PE": ["pe"],
    "PPR": ["ppr"],
    "PVC": ["pvc", "upvc"],
    "XLPE": ["xlpe"],
    "ceramic": ["ceramic", "gach men", "su"],
    "gach dac": ["gach dac"],
    "gach rong": ["gach rong", "hollow"],
    "gang": ["gang", "cast iron"],
    "go": ["go", "wood", "timber"],
    "granite": ["granite"],
    "inox": ["inox", "stainless"],
    "thep ma kem": ["thep ma kem", "galvanized"],
}
#: Letters in front of a grade and how many digits follow them, at least and at most.
GRADES = {"B": (1, 2), "C": (1, 2), "CB": (3, 3), "CT": (1, 1), "K": (2, 2), "M": (2, 3), "PN": (1, 2), "SDR": (1, 2)}
WEIGHTS = {"category": 25, "material": 25, "grade": 30, "dimension": 20}  # percent

NUMBER, UNIT = r"[0-9]+(?:[.,][0-9]+)?", "(?:mm2|mm|cm|m)"
#: A grade is a word; more digits may follow a point or a slash.
GRADE = "(?i)(?:^|[^a-z0-9.,/])((?:" + "|".join(f"{p}[0-9]{{{low},{high}}}" for p, (low, high) in sorted(GRADES.items(), reverse=True)) + r")(?:[./][0-9]{1,2})?)(?:$|[^a-z0-9])"
#: A diameter, numbers with x between them, or a number with a unit; not inside another word or number.
SIZE = rf"(?i)(?:^|[^a-z0-9.,/])((?:dn|d|ø)[0-9]{{1,4}}|{NUMBER}(?: *[x×] *{NUMBER}){{1,2}}(?: *{UNIT})?|{NUMBER} *{UNIT})(?:$|[^a-z0-9])"


def words_of(column: str) -> Column:
    """The folded text's runs of letters and digits between single blanks, with one at both ends."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(texts.fold(column), "[^a-z0-9]+", " ")), F.lit(" "))


def first_named(words: Column, names: dict[str, list[str]]) -> Column:
    """The name whose word comes first in ``words_of`` a text; of words that begin together the longest; null without any.

    One pattern finds it, longer words before those that they begin with, so that a text is read once, not once a word.
    """
    named = {w: name for name in sorted(names, reverse=True) for w in names[name]}
    if not named:
        return F.lit(None).cast("string")
    # a word ends before a blank, which may begin the next one
    pattern = " (" + "|".join(map(re.escape, sorted(named, key=len, reverse=True))) + ")(?= )"
    table = F.create_map(*(F.lit(x) for pair in named.items() for x in pair))
    return F.try_element_at(table, F.regexp_extract(words, pattern, 1))


def extract(rows: DataFrame, text: str = "description") -> DataFrame:
    """``rows`` with category, material, grade and dimension, each null where the text names none; null texts name none.

    What a text names first counts, whatever the order of the tables. Grades are upper-cased, sizes lose their blanks and,
    where they begin with a number, capitals.
    """
    found = lambda p: F.nullif(F.regexp_extract(text, p, 1), F.lit(""))
    size = F.translate(found(SIZE), "X× ", "xx")
    rows = rows.withColumn("_words", words_of(text))
    named = {"category": first_named(F.col("_words"), CATEGORIES), "material": first_named(F.col("_words"), MATERIALS)}
    return rows.withColumns(named | {"grade": F.upper(found(GRADE)), "dimension": F.when(size.rlike("^[0-9]"), F.lower(size)).otherwise(size)}).drop("_words")


def with_key(specs: DataFrame) -> DataFrame:
    """``specs`` with ``matching_key`` (the four parts in lower case, x where one is missing) and ``completeness`` from 0 to 1."""
    part = lambda c: F.lower(F.trim(F.coalesce(F.col(c), F.lit("x"))))
    done = sum((F.when(F.coalesce(F.col(c), F.lit("")) != "", w).otherwise(0) for c, w in WEIGHTS.items()), F.lit(0))
    return specs.withColumns({"matching_key": F.concat_ws("|", *map(part, WEIGHTS)), "completeness": done / 100})


#: Stands where a rule has cut out its span: no rule matches it, so spans never overlap.
CUT = "\ue000"


def claim_spans(rows: DataFrame, rules: dict[str, str], text: str = "description") -> DataFrame:
    """``rows`` with ``specs``, an array of (rule, value), and ``rest``, the text without them.

    Rules claim in their order, each all its matches from left to right; what one has claimed is no longer there for the
    next, and no match reaches over it. Null texts have no specs and a null rest. Rules must not match the empty text.
    """
    left, found = F.col(text), F.array().cast("array<struct<rule: string, value: string>>")
    rows = rows.withColumns({"_left": left, "_specs": found})
    for name, pattern in rules.items():
        # a column of its own: every rule works on what the one before has left, computed once
        values = F.coalesce(F.regexp_extract_all("_left", F.lit(pattern), F.lit(0)), F.array().cast("array<string>"))
        rule = F.lit(name).alias("rule")
        claimed = F.transform(values, lambda v: F.struct(rule, v.alias("value")))  # noqa: B023
        rows = rows.withColumns({"_specs": F.concat("_specs", claimed), "_left": F.regexp_replace("_left", pattern, CUT)})
    rest = F.trim(F.regexp_replace("_left", f"[{CUT}\\s]+", " "))
    return rows.withColumns({"specs": F.col("_specs"), "rest": rest}).drop("_left", "_specs")
