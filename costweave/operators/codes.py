"""Reference codes from keywords, and the parts of coded identifiers."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from costweave.functions import text

REFERENCE = r"^[AMLE]\.[A-Z]{2,5}\.[A-Z]{2,4}$"
# Fixed value: section, category, then a part of letters or a grade, and four digits.
WORK_CODE = r"^(S\d{2})-([A-Z]+)-(?:([A-Z]+|M\d{2,3})-)?([0-9]{4})$"
LEGAL = r"^([A-Za-z]{2,3})\.(\d{3,4})([A-Za-z+\-]?)$"


@dataclass(frozen=True)
class Rules:
    """Keyword -> code for groups, types and locations; a type by default of each group; disciplines by section prefix."""

    groups: dict[str, str]
    types: dict[str, str]
    defaults: dict[str, str]
    locations: dict[str, str]
    disciplines: dict[str, str]


def longest_first(words: dict[str, str]) -> list[str]:
    """Longer words before shorter ones, equal lengths as given: a longer word decides over one inside it."""
    return sorted(words, key=len, reverse=True)


def _named(found: Column, words: dict[str, str]) -> Column:
    return F.coalesce(*(F.when(F.contains(found, F.lit(w)), F.lit(words[w])) for w in longest_first(words)))


def by_keyword(column: str, words: dict[str, str]) -> Column:
    """What the longest contained keyword stands for, letters as written before letters without diacritics; else null."""
    plain = {text.fold_word(w): code for w, code in reversed(words.items())}
    return F.coalesce(_named(F.lower(column), words), _named(text.fold(column), {w: plain[w] for w in map(text.fold_word, words)}))


def reference_codes(rows: DataFrame, rules: Rules, kind: str = "A") -> DataFrame:
    """``rows`` with ``ref_code`` KIND.GROUP.TYPE, ``discipline`` and ``location``; unknown parts are GENR, GEN and null.

    Null descriptions and sections name nothing.
    """
    rows = rows.withColumn("_group", F.coalesce(by_keyword("description", rules.groups), F.lit("GENR")))
    default = F.coalesce(*(F.when(F.col("_group") == group, F.lit(code)) for group, code in rules.defaults.items()), F.lit("GEN"))
    part = F.coalesce(by_keyword("description", rules.types), default)
    discipline = F.coalesce(*(F.when(F.startswith("sec_code", F.lit(p)), F.lit(rules.disciplines[p])) for p in longest_first(rules.disciplines)))
    named = rows.withColumns({"ref_code": F.concat_ws(".", F.lit(kind), "_group", part), "discipline": discipline, "location": by_keyword("description", rules.locations)})
    return named.drop("_group")


def reference_parts(code: str) -> Column:
    """(table_type, group, type) of a reference code, null for anything else."""
    parts = F.split(code, r"\.")
    return F.when(F.col(code).rlike(REFERENCE), F.struct(parts[0].alias("table_type"), parts[1].alias("group"), parts[2].alias("type")))


def legal_parts(code: str) -> Column:
    """(prefix, number, suffix) of AA.1111, AA.1111a or AA.1111+ in either case, null for anything else; suffix may be null."""
    part = lambda k: F.regexp_extract(code, LEGAL, k)
    return F.when(F.col(code).rlike(LEGAL), F.struct(F.upper(part(1)).alias("prefix"), part(2).alias("number"), F.nullif(F.lower(part(3)), F.lit("")).alias("suffix")))


def work_code_parts(code: str) -> Column:
    """(section, category, part, grade, sequence) of S01-CAT-0001, S01-CAT-SUB-0001 or S01-CAT-M250-0001, null for anything else.

    ``part`` is null for a grade, ``grade`` for a part; both are where a code has neither.
    """
    at = lambda k: F.nullif(F.regexp_extract(code, WORK_CODE, k), F.lit(""))
    graded = at(3).rlike(r"\d")
    parts = F.struct(at(1).alias("section"), at(2).alias("category"), F.when(~graded, at(3)).alias("part"), F.when(graded, at(3)).alias("grade"), at(4).cast("int").alias("sequence"))
    return F.when(F.col(code).rlike(WORK_CODE), parts)


def work_category(column: str, indicators: dict[str, list[str]], keywords: dict[str, list[str]], otherwise: str = "GENERAL") -> Column:
    """The first category of ``indicators`` that a text contains one of; else the one of ``keywords`` with the most contained words.

    Ties go by the order given; a text without any, and a null one, is ``otherwise``. Both tables are configuration of a
    few words, so they become one expression.
    """
    holds = lambda w: F.contains(F.lower(column), F.lit(w))
    sure = [F.when(reduce(or_, map(holds, words)), F.lit(name)) for name, words in indicators.items() if words]
    counts = {name: sum((holds(w).cast("int") for w in words), F.lit(0)) for name, words in keywords.items()}
    ranked = F.array(*(F.struct(n.alias("n"), F.lit(-i).alias("order"), F.lit(name).alias("name")) for i, (name, n) in enumerate(counts.items())))
    most = F.when(F.array_max(ranked)["n"] > 0, F.array_max(ranked)["name"]) if counts else F.lit(None).cast("string")
    return F.coalesce(*sure, most, F.lit(otherwise))


def class_parts(code: str) -> Column:
    """(entity, system, element, product, level, path) of a code of two to four parts joined by _, null for anything else."""
    parts = F.split(code, "_")
    at = lambda k: F.try_element_at(parts, F.lit(k))
    path = F.array_join(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "_")), " > ")
    return F.when(F.size(parts).between(2, 4), F.struct(at(1).alias("entity"), at(2).alias("system"), at(3).alias("element"), at(4).alias("product"), F.size(parts).alias("level"), path.alias("path")))


def undominated(words: Column) -> Column:
    """Of an array of keywords those that aren't whole words inside another one of the array."""
    inside = lambda w, o: (w != o) & F.contains(F.concat(F.lit(" "), o, F.lit(" ")), F.concat(F.lit(" "), w, F.lit(" ")))
    return F.filter(words, lambda w: ~F.exists(words, lambda o: inside(w, o)))


def contained(column: str, words: list[str]) -> Column:
    """The keywords that a text contains, in the order given."""
    return F.array_compact(F.array(*(F.when(F.contains(F.lower(column), F.lit(w)), F.lit(w)) for w in words)))


def strip_leading(column: str, words: list[str]) -> Column:
    """(lead, rest): the longest of the words that a text starts with, lower case and null without one, and what follows it."""
    pattern = r"(?i)^\s*(" + "|".join(map(re.escape, sorted(words, key=len, reverse=True))) + r")\s+"
    lead = F.nullif(F.lower(F.regexp_extract(column, pattern, 1)), F.lit(""))
    return F.struct(lead.alias("lead"), F.regexp_replace(column, pattern, "").alias("rest"))


def first_kind(column: str, kinds: dict[str, str], otherwise: str) -> Column:
    """The first kind whose pattern the lower-cased text holds."""
    return F.coalesce(*(F.when(F.lower(column).rlike(p), F.lit(k)) for k, p in kinds.items()), F.lit(otherwise))


def confidence(*signs: Column) -> Column:
    """Of a code that is made by rule: 75, 10 more for each sign that holds, 95 at most (fixed values)."""
    return F.least(F.lit(95), F.lit(75) + sum(F.when(s, 10).otherwise(0) for s in signs)).cast("int")
