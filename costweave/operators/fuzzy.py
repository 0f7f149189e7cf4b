"""Fuzzy matching of descriptions: blocked best match and top-k, and clusters of near-equal texts.

Texts are compared once per distinct form. Pairs come from equi joins that lose nothing: words for scores that need a
shared word, prefixes of rare q-grams for edit-like ratios. Scores are computed by Arrow functions on those pairs only.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from costweave.functions.similarity import sequence_ratios
from costweave.operators.graph import components

# Thresholds and weights of the matcher.
EXACT, FUZZY, CLUSTER = 0.95, 0.80, 0.85
SEQUENCE_WEIGHT, TOKEN_WEIGHT, UNIT_BONUS = 0.6, 0.4, 0.05

#: Texts up to SHORT characters are paired by their characters, from LONG on by their pairs of characters. At a ratio of
#: CLUSTER a text of LONG or more has a partner of more than SHORT only if both are LONG or more, so no pair falls between.
SHORT, LONG = 12, 9


def common_length(a: str, b: str) -> int:
    """Length of the longest common subsequence; a row of its table is the bits of one integer."""
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    full = row = (1 << len(a)) - 1
    for c in b:
        kept = row & places.get(c, 0)
        row = ((row + kept) | (row - kept)) & full
    return len(a) - row.bit_count()


def indel(a: str, b: str) -> float:
    """2 x common subsequence / (both lengths); two empty texts are equal."""
    return 2 * common_length(a, b) / (len(a) + len(b)) if a or b else 1.0


def _indels(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([indel(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


def _sequences(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series(sequence_ratios(a.tolist(), b.tolist()))


def _scores(function):
    return F.pandas_udf(function, "double")


def normal(column: str) -> F.Column:
    """Lower case, trimmed, runs of white space as one blank."""
    return F.lower(F.trim(F.regexp_replace(column, r"(?U)\s+", " ")))


def _words(column: str) -> F.Column:
    return F.array_distinct(F.split(column, " "))


def block_matches(items: DataFrame, catalogue: DataFrame, block: str) -> DataFrame:
    """(block, text, unit, master_id, score) of all pairs of a block that share a word and reach FUZZY.

    ``items`` and ``catalogue`` have the block's column, description and unit. The score is 0.6 x sequence ratio + 0.4 x
    shared words over the larger number of words, 1 for equal texts, and 0.05 more for an equal unit (1 at most). A pair
    without a shared word stays below FUZZY, so joining on words loses nothing; pairs that share too few words to reach
    it are dropped before they are scored. Equal texts of a block and unit are scored once, the smallest id stands for
    them; null and blank descriptions match nothing.
    """
    form = lambda df: df.withColumn("text", normal("description")).where("text <> ''").withColumn("words", _words("text"))
    left = form(items).select(block, "text", "unit", "words").distinct()
    right = form(catalogue).groupBy(F.col(block).alias("b_block"), F.col("text").alias("other"), F.col("unit").alias("b_unit")).agg(F.min("master_id").alias("master_id"), F.first("words").alias("b_words"))
    a = left.select("*", F.explode("words").alias("word"))
    b = right.select("*", F.explode("b_words").alias("b_word"))
    # a pair meets once: under the first word of the left text that both hold
    shared = F.array_intersect("words", "b_words")
    pairs = a.join(b, (F.col(block) == F.col("b_block")) & (F.col("word") == F.col("b_word"))).where(F.col("word") == shared[0])
    tokens = F.size(shared) / F.greatest(F.size("words"), F.size("b_words"))
    bonus = F.when(F.col("unit") == F.col("b_unit"), UNIT_BONUS).otherwise(0.0)
    pairs = pairs.where(SEQUENCE_WEIGHT + TOKEN_WEIGHT * tokens + bonus >= FUZZY - 1e-9)
    blend = F.when(F.col("text") == F.col("other"), 1.0).otherwise(SEQUENCE_WEIGHT * _scores(_sequences)("text", "other") + TOKEN_WEIGHT * tokens)
    scored = pairs.select(block, "text", "unit", "master_id", "other", F.round(F.least(F.lit(1.0), blend + bonus), 9).alias("score"))
    return scored.where(F.col("score") >= FUZZY)


def top_matches(items: DataFrame, catalogue: DataFrame, block: str, k: int) -> DataFrame:
    """The k best of ``block_matches`` for every text and unit of a block, ties by id, with their ``place`` and tier."""
    best = Window.partitionBy(block, "text", "unit").orderBy(F.desc("score"), "master_id")
    rows = block_matches(items, catalogue, block).withColumn("place", F.row_number().over(best)).where(F.col("place") <= k)
    return rows.withColumn("tier", F.when(F.col("score") >= EXACT, "exact").otherwise("fuzzy"))


def _grams(texts: DataFrame, within: str, q: int) -> DataFrame:
    """A row per q-gram of a text, with the number of its occurrence, so that repeated ones stay apart."""
    each = F.transform(F.sequence(F.lit(1), F.length("text") - (q - 1)), lambda i: F.substr("text", i, F.lit(q)))
    rows = texts.withColumn("gram", F.explode(each))
    turn = F.row_number().over(Window.partitionBy(within, "text", "gram").orderBy(F.lit(0)))
    return rows.select(within, "text", F.lit(q).alias("q"), F.concat("gram", F.lit("\x1f"), turn.cast("string")).alias("gram"))


def near_pairs(texts: DataFrame, within: str, threshold: float = CLUSTER) -> DataFrame:
    """(within, a, b, ratio) of all pairs of distinct ``text`` with the same ``within``, a < b, whose InDel ratio reaches ``threshold``.

    A ratio of t allows a text of n characters (1 - t) x 2n / t edits at most, and an edit spoils q of its q-grams at most:
    of partners, the prefixes of q x edits + 1 rarest grams share one. Thresholds below 0.85 need other bounds.
    """
    if threshold < CLUSTER:
        raise ValueError(f"a threshold of {CLUSTER} or more is needed")
    slack = 2 * (1 - threshold) / threshold
    n = F.length("text")
    texts = texts.where("text <> ''").select(within, "text").distinct()
    grams = _grams(texts.where(n <= SHORT), within, 1).union(_grams(texts.where(n >= LONG), within, 2))
    counts = grams.groupBy(F.col(within).alias("c_within"), F.col("q").alias("c_q"), F.col("gram").alias("c_gram")).agg(F.count("*").alias("n"))
    grams = grams.join(counts, F.col(within).eqNullSafe(F.col("c_within")) & (F.col("q") == F.col("c_q")) & (F.col("gram") == F.col("c_gram")))
    rare = F.row_number().over(Window.partitionBy(within, "q", "text").orderBy("n", "gram"))
    prefix = grams.withColumn("_place", rare).where(F.col("_place") <= F.col("q") * F.floor(n * slack + 1e-9) + 1).select(within, "q", "gram", "text")
    other = prefix.select(F.col(within).alias("b_within"), F.col("q").alias("b_q"), F.col("gram").alias("b_gram"), F.col("text").alias("b"))
    least = threshold / (2 - threshold) - 1e-9
    fits = (F.col("text") < F.col("b")) & (F.least(n, F.length("b")) >= F.greatest(n, F.length("b")) * least)
    pairs = prefix.join(other, F.col(within).eqNullSafe(F.col("b_within")) & (F.col("q") == F.col("b_q")) & (F.col("gram") == F.col("b_gram"))).where(fits)
    pairs = pairs.select(within, F.col("text").alias("a"), "b").distinct()
    return pairs.withColumn("ratio", _scores(_indels)("a", "b")).where(F.col("ratio") >= threshold - 1e-9)


def clusters(variants: DataFrame, within: str = "unit") -> DataFrame:
    """``variants`` with ``cluster``: the smallest normalised text of those that links of CLUSTER or more reach in the same unit.

    Null and blank descriptions have a null cluster; null units are one unit. The same method at every size.
    """
    rows = variants.withColumn("text", normal("description"))
    key = lambda c: F.concat_ws("\x1f", F.coalesce(F.col(within).cast("string"), F.lit("\x1e")), c)
    pairs = near_pairs(rows, within)
    labels = components(pairs.select(key("a").alias("a"), key("b").alias("b")))
    found = rows.withColumn("_key", key("text")).join(labels, F.col("_key") == F.col("node"), "left")
    smallest = F.substring_index("component", "\x1f", -1)
    return found.withColumn("cluster", F.when(F.col("text") != "", F.coalesce(smallest, "text"))).drop("_key", "node", "component", "text")
