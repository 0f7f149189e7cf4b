"""Classification of texts by terms, and of vectors by class means."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from costweave.operators import vector_index
from costweave.session import spread, stage

BOUNDARY_BONUS, MOST = 20, 95  # fixed values: points for a whole word, the highest score
MOST_CLASSES = 10_000
#: Up to so many grams of keywords are held in tasks and drop a text's others there, more by a join; grams handed on at once.
MOST_GRAMS, HELD = 100_000, 200_000
NAME, OVERLAP, KEYWORD = 0.5, 0.3, 0.2  # fixed values: points for a contained name, for all of its words, for a contained keyword


def by_terms(rows: DataFrame, terms: dict[str, list[str]], k: int, text: str = "description") -> DataFrame:
    """``rows`` with ``classes``: the k best (score, code) by contained terms, best first, ties in the order of the rules.

    A contained term scores its share of the text in percent and BOUNDARY_BONUS more as a whole word; a code's score is
    the mean over its contained terms, MOST at most. Rules are configuration, so they become expressions, not a join.
    """
    t = F.col("_t")
    rows = rows.withColumn("_t", F.lower(F.col(text)))
    points, means = {}, {}
    for i, words in enumerate(terms.values()):
        for j, w in enumerate(words):
            whole = F.when(t.rlike(rf"(?<!\w)\Q{w}\E(?!\w)"), BOUNDARY_BONUS).otherwise(0)
            points[f"_p{i}_{j}"] = F.when(F.contains(t, F.lit(w)), len(w) * 100.0 / F.greatest(F.length(t), F.lit(1)) + whole)
        own = [f"_p{i}_{j}" for j in range(len(words))]
        n = sum((F.col(p).isNotNull().cast("int") for p in own), F.lit(0))
        means[f"_m{i}"] = sum((F.coalesce(p, F.lit(0.0)) for p in own), F.lit(0.0)) / F.when(n > 0, n)
    # in columns of their own, so that each point and mean is computed once
    rows = rows.withColumns(points).withColumns(means)
    each = (F.when(F.col(f"_m{i}").isNotNull(), F.struct(F.round(F.least(f"_m{i}", F.lit(float(MOST))), 6).alias("score"), F.lit(-i).alias("order"), F.lit(code).alias("code"))) for i, code in enumerate(terms))
    ranked = F.slice(F.sort_array(F.array_compact(F.array(*each)), asc=False), 1, k)
    rows = rows.withColumn("_ranked", ranked).withColumn("classes", F.transform("_ranked", lambda c: F.struct(c["score"].alias("score"), c["code"].alias("code"))))
    return rows.drop("_t", "_ranked", *points, *means)


def by_class_mean(vectors: DataFrame, k: int) -> DataFrame:
    """(vec_id, code, similarity, place): the k classes whose mean embedding is nearest by cosine, ties by label.

    Null components count in no mean; embeddings that are null, empty, or hold null or non-finite components get no class.
    The means of up to MOST_CLASSES classes are broadcast; more of them are searched through a vector index, exactly.
    """
    vectors = vectors.where("embedding is not null and size(embedding) > 0 and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('inf'))")
    parts = vectors.where("label is not null").select("label", F.posexplode("embedding").alias("i", "x"))
    means = parts.groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("x")).groupBy("label").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("m"))
    model = means.select("label", "m.x").orderBy("label").limit(MOST_CLASSES + 1).collect()
    if len(model) > MOST_CLASSES:
        index = vector_index.build(vector_index.usable(means.select("label", "m.x"), "label", "x"))
        near = vector_index.search(index, vector_index.usable(vectors, "vec_id", "embedding"), k, -1.0)
        return near.select(F.col("query").cast("long").alias("vec_id"), F.col("id").cast("long").alias("code"), "similarity", "place")
    labels, centres = np.array([r.label for r in model], np.int64), np.array([r.x for r in model], np.float64)
    if len(model):
        centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)

    def nearest(frames):
        for f in frames:
            if not len(f) or not len(labels):
                continue
            x = np.stack(f["embedding"].to_numpy()).astype(np.float64)
            scores = np.round(x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12) @ centres.T, 9)
            best = np.argsort(-scores, axis=1, kind="stable")[:, :k]
            yield pd.DataFrame({"vec_id": np.repeat(f["vec_id"].to_numpy(), best.shape[1]), "code": labels[best].ravel(), "similarity": np.take_along_axis(scores, best, 1).ravel(), "place": np.tile(np.arange(1, best.shape[1] + 1), len(f))})

    return vectors.where("embedding is not null").select("vec_id", "embedding").mapInPandas(nearest, "vec_id long, code long, similarity double, place int")


def containing(texts: DataFrame, keywords: DataFrame, q: int = 3) -> DataFrame:
    """(id, keyword) where a text of ``texts`` (id, text) contains a keyword of ``keywords`` (keyword), whatever their case.

    Rules as a table: every keyword is anchored on the one of its q-grams that the fewest texts have, texts meet keywords
    on grams that they share, and what meets is verified. One equi join however many keywords there are; a keyword
    shorter than q is its own gram. Null ids, null and empty texts and keywords take no part; rows that share an id are one.
    """
    texts = texts.select("id", F.lower("text").alias("text")).where("id is not null and text <> ''")
    keys = stage(keywords.select(F.lower("keyword").alias("keyword")).where("keyword <> ''").distinct(), "keywords")

    def cut(rows: DataFrame, key: str, sizes: Callable[[str], list[int]], wanted: set[str] | None = None) -> DataFrame:
        """(key, gram): the distinct grams of every ``text`` in the sizes for it."""

        def grams(frames):
            for f in frames:
                names, found, held = [], [], 0
                for i, (name, x) in enumerate(zip(f[key], f["text"], strict=True)):
                    own = {x[k : k + n] for n in sizes(x) for k in range(len(x) - n + 1)}
                    own = own if wanted is None else own & wanted
                    names.append(pd.Series([name] * len(own), dtype=f[key].dtype))
                    found.extend(own)
                    held += len(own)
                    if held >= HELD or i == len(f) - 1:
                        yield pd.DataFrame({key: pd.concat(names, ignore_index=True), "gram": pd.Series(found, dtype=object)})
                        names, found, held = [], [], 0

        return rows.select(key, "text").mapInPandas(grams, StructType([rows.schema[key], StructField("gram", StringType())]))

    own = stage(cut(keys.withColumn("text", F.col("keyword")), "keyword", lambda x: [min(q, len(x))]), "own")
    # the few lengths of grams that there are: q, and those of shorter keywords
    sizes = sorted(r[0] for r in own.select(F.length("gram")).distinct().collect())
    some = own.select("gram").distinct().limit(MOST_GRAMS + 1).collect()
    wanted = {r.gram for r in some} if len(some) <= MOST_GRAMS else None
    grams = cut(spread(texts), "id", lambda x: sizes, wanted)
    grams = stage(grams.join(own.select("gram").distinct(), "gram", "left_semi"), "grams")
    rare = own.join(grams.groupBy("gram").agg(F.count("*").alias("n")), "gram", "left")
    anchors = rare.groupBy("keyword").agg(F.min_by("gram", F.struct(F.coalesce("n", F.lit(0)), "gram")).alias("gram"))
    return grams.join(anchors, "gram").select("id", "keyword").join(texts, "id").where(F.contains("text", F.col("keyword"))).select("id", "keyword").distinct()


def scored_codes(texts: DataFrame, codes: DataFrame, k: int, excluded: DataFrame | None = None) -> DataFrame:
    """(id, code, score, place): the k codes of ``codes`` (code, name, keywords) that fit a text of ``texts`` (id, text) best.

    A contained name counts NAME, else the share of its distinct words that the text has counts OVERLAP; every contained
    keyword adds KEYWORD, one listed twice counts twice. ``excluded`` (keyword, context) takes a keyword back where the
    text contains the context too. Codes without a point are left out, ties go by code; scores have three decimals.

    Names, keywords and contexts are looked up as tables by ``containing``, once for equal texts. A text's words meet a
    name's on equal words, with equal names held once; pairs are summed before texts are expanded to their ids. Null
    ids, texts, codes and names take no part, keywords may be null; rows that share an id and a text are one.
    """
    texts = stage(texts.select("id", F.lower("text").alias("text")).where("id is not null and text <> ''").distinct(), "texts")
    codes = stage(codes.where("code is not null and name is not null").select("code", F.lower("name").alias("name"), F.transform("keywords", F.lower).alias("keywords")), "codes")
    each = stage(texts.select("text").distinct().withColumn("t", F.monotonically_increasing_id()), "each")
    asked = each.select(F.col("t").alias("id"), "text")
    words = lambda c: F.array_distinct(F.filter(F.split(c, r"\s+"), lambda w: w != ""))
    listed = codes.select("code", F.explode("keywords").alias("keyword"))
    sought = codes.select(F.col("name").alias("keyword")).union(listed.select("keyword"))
    if excluded is not None:
        excluded = stage(excluded.select(F.lower("keyword").alias("keyword"), F.lower("context").alias("context")).where("context <> ''").distinct(), "excluded")
        sought = sought.union(excluded.select("context"))
    hits = stage(containing(asked, sought.distinct()).withColumnRenamed("id", "t"), "hits")
    named = hits.join(codes.select(F.col("name").alias("keyword"), "code"), "keyword").select("t", "code", F.lit(NAME).alias("by_name"), F.lit(0).alias("n"))
    counted = hits
    if excluded is not None:
        around = hits.withColumnRenamed("keyword", "context").join(excluded, "context").select("t", "keyword").distinct()
        counted = hits.join(around, ["t", "keyword"], "left_anti")
    keyed = counted.join(listed, "keyword").select("t", "code", F.lit(0.0).alias("by_name"), F.lit(1).alias("n"))
    name_words = codes.select("name").distinct().select("name", F.size(words("name")).alias("of"), F.explode(words("name")).alias("word"))
    shared = each.select("t", F.explode(words("text")).alias("word")).join(name_words, "word").groupBy("t", "name").agg((F.lit(OVERLAP) * F.count("*") / F.max("of")).alias("by_name"))
    overlapped = shared.join(codes.select("name", "code"), "name").select("t", "code", "by_name", F.lit(0).alias("n"))
    # a contained name is worth more than all of its words, so the larger of the two counts
    points = named.union(keyed).union(overlapped).groupBy("t", "code").agg(F.round(F.max("by_name") + KEYWORD * F.sum("n"), 3).alias("score"))
    ranked = points.where("score > 0").withColumn("place", F.row_number().over(Window.partitionBy("t").orderBy(F.desc("score"), "code")))
    best = ranked.where(F.col("place") <= k)
    return texts.join(each, "text").join(best, "t").select("id", "code", "score", "place")
