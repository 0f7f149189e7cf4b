"""Abbreviations in descriptions written out, with what carries numbers left alone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _cased(word: Column, full: Column) -> Column:
    """``full`` with the case of ``word``: all capitals (two letters at least), a capital first, or as it is."""
    capital = F.concat(F.upper(F.substring(full, 1, 1)), F.substr(full, F.lit(2)))
    first = F.substring(word, 1, 1)
    return F.when((F.upper(word) == word) & (F.length(word) > 1), F.upper(full)).when(F.upper(first) != F.lower(first), F.when(F.upper(first) == first, capital).otherwise(full)).otherwise(full)


def expand(column: str, table: dict[str, str]) -> Column:
    """The text with the table's abbreviations (lower case; one or two words) replaced, words joined by one blank.

    Words are what blanks separate; commas, colons and full stops behind a word stay. At each word the longer entry is
    tried first: it and the next word, then it alone. A word with a digit is a specification and never part of one.
    What is written out takes the abbreviation's case, of two words the first one's. Null stays null.
    """
    words = F.filter(F.split(F.trim(column), r"\s+"), lambda w: w != "")
    known = F.create_map(*(F.lit(x) for pair in table.items() for x in pair))
    body, tail = (lambda w: F.regexp_extract(w, r"^(.*?)([,:.]*)$", 1)), (lambda w: F.regexp_extract(w, r"^(.*?)([,:.]*)$", 2))
    plain = lambda w: ~w.rlike("[0-9]")
    spelt = lambda w: F.struct(w.alias("w"), F.lower(body(w)).alias("key"), body(w).alias("body"), tail(w).alias("tail"), plain(w).alias("plain"))

    def step(state: Column, x: Column) -> Column:
        """out: words so far; last: the word before, as it may begin an entry of two words; bare: it can."""
        both = F.when(state["bare"] & x["plain"] & (state["before"]["tail"] == ""), known[F.concat(state["before"]["key"], F.lit(" "), x["key"])])
        one = F.when(x["plain"], known[x["key"]])
        single = F.coalesce(F.concat(_cased(x["body"], one), x["tail"]), x["w"])
        joined = F.concat(F.slice(state["out"], F.lit(1), F.size(state["out"]) - 1), F.array(F.concat(_cased(state["before"]["body"], both), x["tail"])))
        out = F.when(both.isNotNull(), joined).otherwise(F.concat(state["out"], F.array(single)))
        return F.struct(out.alias("out"), x.alias("before"), (both.isNull() & x["plain"]).alias("bare"))

    none = F.struct(*(F.lit("").alias(c) for c in ("w", "key", "body", "tail")), F.lit(False).alias("plain"))
    start = F.struct(F.array().cast("array<string>").alias("out"), none.alias("before"), F.lit(False).alias("bare"))
    return F.aggregate(F.transform(words, spelt), start, step, lambda s: F.array_join(s["out"], " "))
