"""Profiles of columns: what their values look like, and a fingerprint of a table's columns in order."""

from __future__ import annotations

import math
from functools import reduce
from itertools import combinations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from costweave.session import stage

#: Kinds of values, in the order in which a value is tried and in which ties are decided; anything else is text.
KINDS = {"integer": r"^[+-]?[0-9]+$", "number": r"^[+-]?[0-9]+(\.[0-9]+)?([eE][+-]?[0-9]+)?$", "date": r"^[0-9]{4}-[0-9]{2}-[0-9]{2}", "empty": r"^\s*$"}
NAMES = (*KINDS, "text")
#: What shared names, the number of columns, their order and their kinds weigh, and the least similarity.
WORDS, COUNT, ORDER, SIGNATURE, LEAST = 0.5, 0.25, 0.15, 0.1, 75.0
SUBSETS = 256  # of a profile's names for one pair of shapes, beyond that pairs meet on parts: work only
LIST = 256  # templates that a profile of the same names is compared with at a time: memory only
FEW = 1_000_000  # pairs whose hashes are broadcast to pick their profiles, more are joined with all: work only


def kinds(table: DataFrame) -> DataFrame:
    """(position, name, kind, n_kind, n_values): the most frequent kind of every column's values; null where it has none.

    One scan: every column's kinds are counted side by side, then the one row of counts is turned into a row a column.
    """
    columns = table.columns

    def counts(c: str) -> F.Column:
        value = F.col(f"`{c}`").cast("string")
        kind = F.coalesce(*(F.when(value.rlike(p), k) for k, p in KINDS.items()), F.when(value.isNotNull(), "text"))
        return F.struct(*(F.count_if(kind == k).alias(k) for k in NAMES))

    row = table.agg(*(counts(c).alias(f"c{i}") for i, c in enumerate(columns)))
    each = F.array(*(F.struct(F.lit(i).alias("position"), F.lit(c).alias("name"), F.col(f"c{i}").alias("n")) for i, c in enumerate(columns)))
    rows = row.select(F.explode(each).alias("c")).select("c.position", "c.name", "c.n")
    best = F.array_max(F.array(*(F.struct(F.col(f"n.{k}").alias("n"), F.lit(-i).alias("order"), F.lit(k).alias("kind")) for i, k in enumerate(NAMES))))
    total = reduce(F.Column.__add__, (F.col(f"n.{k}") for k in NAMES))
    return rows.select("position", "name", F.when(total > 0, best["kind"]).alias("kind"), F.when(total > 0, best["n"]).otherwise(0).alias("n_kind"), total.alias("n_values"))


def fingerprint(columns: DataFrame) -> DataFrame:
    """(table_name, fingerprint, n_columns) of ``kinds`` rows with their table: a digest of names and kinds in order."""
    line = F.concat_ws(":", F.lower("name"), F.coalesce("kind", F.lit("none")))
    parts = F.array_sort(F.collect_list(F.struct("position", line.alias("line"))))
    return columns.groupBy("table_name").agg(parts.alias("p")).select("table_name", F.sha2(F.array_join("p.line", ","), 256).alias("fingerprint"), F.size("p").alias("n_columns"))


def _hash(*parts: F.Column) -> F.Column:
    """Sixteen bytes of a SHA-256: they stand for whole arrays in joins, at a quarter of the hex digits' size."""
    return F.unhex(F.left(F.sha2(F.to_json(F.struct(*parts)), 256), F.lit(32)))


def _formed(rows: DataFrame) -> DataFrame:
    """(id, profile, names, kinds) with names trimmed and in lower case, null names and kinds as empty texts."""
    text = lambda c: F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.lower(F.trim(F.coalesce(x, F.lit("")))))
    rows = rows.where("id is not null").select("id", text("names").alias("names"), text("kinds").alias("kinds"))
    return rows.select("id", _hash("names", "kinds").alias("profile"), "names", "kinds")


def _words(names="names") -> F.Column:
    return F.array_sort(F.array_distinct(names))


def _similarity(a, b, alike: bool = False) -> F.Column:
    """Weighted similarity in percent of two profiles (names, kinds, words); kinds that one side lacks count half.

    ``alike`` leaves out to count shared names, for profiles of the same ones.
    """
    size = lambda x, c: F.size(x[c])
    shared = F.size(F.array_intersect(a["words"], b["words"]))
    words = F.lit(100.0) if alike else shared / (size(a, "words") + size(b, "words") - shared) * 100
    counts = 100 - F.abs(size(a, "names") - size(b, "names")) / F.greatest(size(a, "names"), size(b, "names"), F.lit(1)) * 100
    order = F.when(a["names"] == b["names"], 100.0).otherwise(0.0)
    held = F.least(size(a, "kinds"), size(b, "kinds"))
    agree = F.size(F.filter(F.zip_with(a["kinds"], b["kinds"], lambda x, y: x == y), lambda e: e))
    kinds_ = F.when(held > 0, agree / held * 100).otherwise(50.0)
    return F.round(words * WORDS + counts * COUNT + order * ORDER + kinds_ * SIGNATURE, 6)


def _ways(mine: list, others: list, least: float, alike: bool = True) -> tuple[list, list, list, list]:
    """How profiles of these shapes, (names, distinct names) and maybe kinds, meet where a pair can reach ``least``: (subsets
    of mine, of others, parts of mine, of others), each with the shape in front and the number of the pair of shapes.

    A pair whose names differ or stand in another order has ORDER for nothing, so its number of names says how many
    distinct ones it shares at least. It meets on every subset of so many names, with all pairs that share it and no
    other, if a profile has at most SUBSETS of them; else on one of the parts, one more than names that may differ.
    Without ``alike`` pairs of the same distinct names need not meet. Shapes with kinds get one number more: that of the
    first kinds that have to be the same, since with one that differs no such pair reaches ``least``; else 0.
    """
    found: tuple[list, list, list, list] = [], [], [], []
    for way, (mine_, other) in enumerate((x, y) for x in mine for y in others):
        (n, s, *z), (m, t, *w) = mine_, other
        counts = 1 - abs(n - m) / max(n, m)
        share = (least - 100 * (COUNT * counts + SIGNATURE)) / (100 * WORDS)
        held = max(1, math.ceil((s + t) * share / (1 + share) - 1e-6))
        most = min(s, t) if alike or s != t else s - 1
        if held > most:
            continue
        spare = 100 * (WORDS * most / (s + t - most) + COUNT * counts + SIGNATURE) - least
        same = [min(z + w) if min(z + w) * (spare + 1e-5) < 100 * SIGNATURE else 0] if z else []
        small = max(math.comb(s, held), math.comb(t, held)) <= SUBSETS
        for k, (shape, words) in enumerate(((mine_, s), (other, t))):
            if small:
                found[k].extend((*shape, way, *same, list(at)) for at in combinations(range(words), held))
            else:
                found[2 + k].extend((*shape, way, *same, s + t - 2 * held + 1, part) for part in range(s + t - 2 * held + 1))
    return found


def _sharing(loose: DataFrame, known: DataFrame, least: float) -> DataFrame:
    """(a, b): hashes of profiles of different distinct names that meet by ``_ways``."""
    spark = loose.sparkSession
    # one row for every number of names and kinds that profiles have
    shapes = [[tuple(r) for r in rows.select(F.size("names"), F.size("words"), F.size("kinds")).distinct().collect()] for rows in (loose, known)]
    ways = _ways(*shapes, least, alike=False)

    def keys(rows: DataFrame, name: str, subsets: list, parts: list) -> DataFrame:
        sized = rows.select(F.xxhash64("profile").alias(name), F.size("names").alias("n"), F.size("words").alias("s"), F.size("kinds").alias("z"), "words", "kinds")
        subsets = spark.createDataFrame(subsets, "n int, s int, z int, way long, same int, at array<int>")
        parts = spark.createDataFrame(parts, "n int, s int, z int, way long, same int, parts int, part int")
        same = F.slice("kinds", F.lit(1), F.col("same"))
        some = sized.join(F.broadcast(subsets), ["n", "s", "z"]).select(name, F.xxhash64("way", same, F.transform("at", lambda i: F.get("words", i))).alias("key"))
        held = F.filter("words", lambda w: F.pmod(F.xxhash64(w), F.col("parts")) == F.col("part"))
        return some.union(sized.join(F.broadcast(parts), ["n", "s", "z"]).select(name, F.xxhash64("way", "part", same, held).alias("key")))

    return keys(loose, "a", ways[0], ways[2]).join(keys(known, "b", ways[1], ways[3]), "key").select("a", "b").distinct()


def match(tables: DataFrame, templates: DataFrame, least: float = LEAST, k: int = 6) -> DataFrame:
    """(id, template_id, similarity, match, place): the k templates most like each table, from ``least`` on (above 50).

    Both are (id, names, kinds), arrays in the order of the columns, with ids of their own. A table with the profile of a
    template matches it exactly, the smallest id of them alone; others rank by similarity, ties by id. Tables without
    columns match such templates only; null ids take no part.

    Only different profiles are compared. Those of the same distinct names, most of what is similar, meet a list of
    templates at a time and keep its k best, so that no pair of them is written; others meet by ``_ways``.
    """
    if not 100 * (1 - WORDS) < least <= 100:
        raise ValueError("least must be above 50, at most 100")
    tables, templates = stage(_formed(tables), "tables"), _formed(templates)
    # no more than k ids of a profile can be among the k best
    nth = lambda *order: F.row_number().over(Window.partitionBy(order[0]).orderBy(order[1]))
    ids = F.array_sort(F.collect_list("id")).alias("ids")
    known = templates.withColumn("nth", nth("profile", "id")).where(F.col("nth") <= k).groupBy("profile").agg(ids, *(F.first(c).alias(c) for c in ("names", "kinds")))
    known = stage(known, "templates")
    loose = tables.select("profile", "names", "kinds").dropDuplicates(["profile"]).join(known.select("profile"), "profile", "left_anti")
    loose = stage(loose.where("size(names) > 0"), "loose")
    known_ = known.where("size(names) > 0")
    # sorted words are made anew where they are looked at: they are as long as the names they come from
    mine, others = (rows.withColumn("words", _words()) for rows in (loose, known_))
    by_set = lambda rows: rows.withColumn("set", F.xxhash64(_words()))

    def best(similar: F.Column) -> F.Column:
        """The k best (less, id) of an array of (similarity, ids)."""
        near = F.filter(similar, lambda e: e["similarity"] >= least)
        return F.slice(F.array_sort(F.flatten(F.transform(near, lambda e: F.transform(e["ids"], lambda i: F.struct((-e["similarity"]).alias("less"), i.alias("id")))))), F.lit(1), F.lit(k))

    column = {c: F.col(c) for c in ("names", "kinds", "words")}
    # a set of more templates than a list holds is cut into several, which meet its profiles in tasks of their own
    crowded = by_set(known_).groupBy("set").agg(F.ceil(F.count("*") / LIST).alias("lists")).where("lists > 1")
    crowded = F.broadcast(stage(crowded, "crowded"))  # a row for LIST templates at most
    many = F.coalesce("lists", F.lit(1))
    lists = by_set(known_).join(crowded, "set", "left").withColumn("list", F.pmod(F.xxhash64("profile"), many))
    lists = lists.groupBy("set", "list").agg(F.collect_list(F.struct("names", "kinds", "ids")).alias("held"))
    lists = lists.select("set", "list", F.transform("held", lambda t: F.struct(t["names"].alias("names"), t["kinds"].alias("kinds"), t["ids"].alias("ids"), _words(t["names"]).alias("words"))).alias("held"))
    similar = F.transform("held", lambda t: F.struct(F.when(t["words"] == F.col("words"), _similarity(column, t, alike=True)).alias("similarity"), t["ids"].alias("ids")))
    alike = by_set(loose).join(crowded, "set", "left").withColumn("list", F.explode(F.sequence(F.lit(0).cast("long"), many - 1))).drop("lists")
    alike = alike.join(lists, ["set", "list"]).withColumn("words", _words()).select("profile", best(similar).alias("best"))

    worded = lambda x: F.struct(x["names"].alias("names"), x["kinds"].alias("kinds"), _words(x["names"]).alias("words"))
    pairs = stage(_sharing(mine, others, least), "pairs")
    few = pairs.count() <= FEW

    def met(rows: DataFrame, c: str, x: str, *more: str) -> DataFrame:
        """Profiles by their hash, those of ``pairs`` if they are few; where it stands for two, both are compared."""
        rows = rows.select(F.xxhash64("profile").alias(c), F.struct("profile", "names", "kinds").alias(x), *more)
        return rows.join(F.broadcast(pairs.select(c)), c, "left_semi") if few else rows

    near = pairs.join(met(known_, "b", "y", "ids"), "b").join(met(loose, "a", "x"), "a")
    near = near.select("x.profile", "ids", worded(F.col("x")).alias("x"), worded(F.col("y")).alias("y")).select("profile", "ids", _similarity(F.col("x"), F.col("y")).alias("similarity"))
    first = Window.partitionBy("profile").orderBy(F.desc("similarity"), F.col("ids")[0])
    near = near.where(F.col("similarity") >= least).withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= k)
    shared = near.select("profile", best(F.array(F.struct("similarity", "ids"))).alias("best"))

    found = alike.where("size(best) > 0").union(shared).groupBy("profile").agg(F.flatten(F.collect_list("best")).alias("best"))
    fuzzy = found.select("profile", F.slice(F.array_sort(F.array_distinct("best")), F.lit(1), F.lit(k)).alias("best"), F.lit("fuzzy").alias("match"))
    exact = known.select("profile", F.array(F.struct(F.lit(-100.0).alias("less"), F.col("ids")[0].alias("id"))).alias("best"), F.lit("exact").alias("match"))
    rows = tables.select("id", "profile").join(fuzzy.union(exact), "profile").select("id", "match", F.posexplode("best").alias("at", "b"))
    return rows.select("id", F.col("b.id").alias("template_id"), (-F.col("b.less")).alias("similarity"), "match", (F.col("at") + 1).alias("place"))
