"""The k best fuzzy partners of every text in a whole catalogue, without comparing all pairs.

The score is the reference matcher's: 0.6 x sequence ratio (twice the characters in matching blocks over both lengths) +
0.4 x shared words over the larger number of words; equal texts score 1; only scores above FLOOR count.

Distinct texts are compared only. Seeds (texts with the same two or three rarest words) give each text a k-th best
score that its true one can't be below. From then on a partner has to reach it: the words it must share at least follow
from it, so texts meet on the rarest of their words only; lengths and the characters two texts have in common bound the
sequence ratio before it is computed. A text whose bound is so low that a partner might share no word with it meets such
partners on its rarest characters, as many as the bound requires.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from costweave.functions.similarity import common_characters, sequence_ratios
from costweave.operators.fuzzy import SEQUENCE_WEIGHT, TOKEN_WEIGHT, normal
from costweave.session import Scratch, stage

FLOOR = 0.3  # fixed value: what a score has to exceed
SLACK = 1e-9
COUPLED = 24  # words of a text whose couples of words are keys, at most; this changes the work only


def _bounded_score(a: pd.Series, b: pd.Series, share: pd.Series, least: pd.Series) -> pd.Series:
    """The score where it may reach ``least``, else null."""
    x, y, t, s = a.tolist(), b.tolist(), share.to_numpy(), least.to_numpy()
    out = np.full(len(x), np.nan)
    for low in range(0, len(x), 1 << 16):
        part = slice(low, low + (1 << 16))
        total = np.array([len(u) + len(v) for u, v in zip(x[part], y[part], strict=True)])
        most = SEQUENCE_WEIGHT * 2 * common_characters(x[part], y[part]) / np.maximum(total, 1) + TOKEN_WEIGHT * t[part]
        at = low + np.flatnonzero(most >= s[part] - SLACK)
        out[at] = SEQUENCE_WEIGHT * sequence_ratios([x[i] for i in at], [y[i] for i in at]) + TOKEN_WEIGHT * t[at]
    same = np.array([u == v for u, v in zip(x, y, strict=True)], bool)
    out[same] = 1.0
    return pd.Series(np.round(out, 9)).where(~np.isnan(out), None)


def _least_shared(n: Column, s: Column) -> Column:
    """Words that a partner with score s or more shares at least with a text of n words, whatever their characters."""
    return F.greatest(F.lit(0), F.ceil((s - SEQUENCE_WEIGHT) / TOKEN_WEIGHT * n - 1e-6)).cast("int")


def _couple(x: Column, y: Column) -> Column:
    return F.xxhash64(F.least(x, y), F.greatest(x, y))


def _couples(words: Column) -> Column:
    """A key for every two of the words."""
    return F.flatten(F.transform(words, lambda x, i: F.transform(F.slice(words, i + 2, F.size(words)), lambda y: _couple(x, y))))


def _scored(pairs: DataFrame) -> DataFrame:
    """Pairs (text, n, words, least, other, other_id, m, other_words) with their score, where it reaches ``least`` and exceeds FLOOR."""
    share = F.size(F.array_intersect("words", "other_words")) / F.greatest("n", "m")
    shorter, longer = F.least(F.length("text"), F.length("other")), F.greatest(F.length("text"), F.length("other"))
    # evaluated once: a deterministic function would be pushed into the filter behind it as well
    pairs = pairs.withColumn("share", share).where(SEQUENCE_WEIGHT * 2 * shorter / (shorter + longer) + TOKEN_WEIGHT * F.col("share") >= F.col("least") - SLACK)
    scored = pairs.select("text", "other", "other_id", F.pandas_udf(_bounded_score, "double").asNondeterministic()("text", "other", "share", "least").alias("score"), "least")
    return scored.where((F.col("score") > FLOOR) & (F.col("score") >= F.col("least") - SLACK)).drop("least")


def top_matches(items: DataFrame, catalogue: DataFrame, k: int = 5) -> DataFrame:
    """(text, master_id, other, score, place): the k best catalogue texts above FLOOR of each distinct item text, ties by id.

    ``items`` has a description, ``catalogue`` a description and master_id. Texts are normalised; equal catalogue texts
    are one, under their smallest id; null and blank texts match nothing; an empty side gives no rows.
    """
    scratch = Scratch(items.sparkSession, "fuzzy")
    text = lambda df: df.withColumn("text", normal("description")).where("text <> ''")
    left = text(items).select("text").distinct()
    right = text(catalogue).groupBy("text").agg(F.min("master_id").alias("other_id"))
    split = lambda df: df.withColumn("word", F.explode(F.array_distinct(F.split("text", " "))))
    counts = scratch.stage(split(right).groupBy("word").agg(F.count("*").alias("held")), "words")
    # rare words first; words that no catalogue text has can't be shared and are only counted
    rare = F.sort_array(F.collect_list(F.when(F.col("held").isNotNull(), F.struct("held", F.xxhash64("word").alias("id")))))
    form = lambda df, keys: split(df).join(counts, "word", "left").groupBy(*keys).agg(F.count("*").cast("int").alias("n"), F.transform(rare, lambda x: x["id"]).alias("words"))
    left = scratch.stage(form(left, ["text"]), "left")
    right = scratch.stage(form(right, ["text", "other_id"]).select(F.col("text").alias("other"), "other_id", F.col("n").alias("m"), F.col("words").alias("other_words")), "right")

    # seeds only raise bounds, so any pairs will do: those that share their rarest words, the most promising of them
    def keys(words: str) -> Column:
        first = lambda n: F.when(F.size(words) >= n, F.xxhash64(F.array_sort(F.slice(words, 1, n))))
        return F.array_compact(F.array(first(2), first(3)))

    seeds = left.withColumn("key", F.explode(keys("words"))).join(right.withColumn("key", F.explode(keys("other_words"))), "key").drop("key").distinct()
    hope = F.size(F.array_intersect("words", "other_words")) / F.greatest("n", "m") - F.abs(F.length("text") - F.length("other")) / F.greatest(F.length("text"), F.length("other"))
    seeds = seeds.withColumn("r", F.row_number().over(Window.partitionBy("text").orderBy(hope.desc(), "other_id"))).where(F.col("r") <= 2 * k).drop("r")
    seeded = _scored(seeds.withColumn("least", F.lit(FLOOR)))
    kth = seeded.withColumn("r", F.row_number().over(Window.partitionBy("text").orderBy(F.desc("score")))).where(F.col("r") == k).select("text", F.col("score").alias("least"))
    left = scratch.stage(left.join(kth, "text", "left").withColumn("least", F.coalesce("least", F.lit(FLOOR))), "bounded")

    # pairs that share a word meet at the first of the text's rarest words that both hold; where two have to be shared and
    # texts are short enough for all their couples of words, they meet at the first two
    need = F.greatest(F.lit(1), _least_shared(F.col("n"), F.col("least")))
    asked = left.withColumn("need", need)
    head = lambda k: F.slice("words", 1, F.greatest(F.lit(0), F.col("n") - F.col("need") + k))  # noqa: E731  # words are at most n
    coupled, short = (F.col("need") > 1) & (F.col("n") <= COUPLED), F.col("m") <= COUPLED
    alone, beside = asked.withColumn("key", F.explode(head(1))), right.withColumn("key", F.explode("other_words"))
    shared = F.array_intersect("words", "other_words")
    met = alone.join(beside, "key").where(~(coupled & short)).withColumn("shared", shared).where(F.get("shared", F.lit(0)) == F.col("key"))
    twice = asked.where(coupled).withColumn("key", F.explode(_couples(head(2)))).join(right.where(short).withColumn("key", F.explode(_couples(F.col("other_words")))), "key")
    twice = twice.withColumn("shared", shared).where(_couple(F.get("shared", F.lit(0)), F.get("shared", F.lit(1))) == F.col("key"))
    met = met.union(twice).where(F.size("shared") >= F.col("need")).drop("shared", "key", "need")
    found = _scored(met)

    # pairs that share none: their sequence ratio alone has to reach the bound
    ratio = F.greatest(F.col("least"), F.lit(FLOOR)) / SEQUENCE_WEIGHT
    open_ = left.where(_least_shared(F.col("n"), F.col("least")) == 0).withColumn("ratio", ratio - SLACK)
    if not open_.isEmpty():
        # of the characters of both, numbered when they repeat, so many are shared at least; the rest may come first
        each = lambda c: F.posexplode(F.filter(F.split(c, ""), lambda x: x != "")).alias("at", "char")
        numbered = lambda df, c: df.select("*", each(c)).withColumn("nth", F.row_number().over(Window.partitionBy(c, "char").orderBy("at"))).drop("at")
        a = numbered(open_, "text")
        b = numbered(right, "other")
        known = scratch.stage(b.groupBy("char", "nth").agg(F.count("*").alias("times")), "characters")
        order = F.row_number().over(Window.partitionBy("text").orderBy(F.coalesce("times", F.lit(0)), "char", "nth"))
        least_held = F.ceil(F.col("ratio") * F.length("text") / (2 - F.col("ratio")) - 1e-6)
        a = a.join(known, ["char", "nth"], "left").withColumn("r", order).where(F.col("r") <= F.length("text") - least_held + 1).drop("times")
        sizes = 2 * F.least(F.length("text"), F.length("other")) >= F.col("ratio") * (F.length("text") + F.length("other"))
        apart = a.join(b, ["char", "nth"]).where(sizes & ~F.arrays_overlap("words", "other_words")).dropDuplicates(["text", "other"])
        found = found.union(_scored(apart.drop("char", "nth", "r", "ratio").select(*met.columns)))

    place = F.row_number().over(Window.partitionBy("text").orderBy(F.desc("score"), "other_id"))
    out = stage(found.withColumn("place", place).where(F.col("place") <= k).select("text", F.col("other_id").alias("master_id"), "other", "score", "place"), "fuzzy")
    scratch.close()
    return out
