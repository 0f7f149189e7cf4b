"""Tiered matching, routing and their metrics: exact, synonym and token-overlap tiers, then what is left."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from costweave.operators import analytics, matching, vector_index
from costweave.session import stage

TIERS = ("exact", "synonym", "token")


def synonym_lookup(synonyms: DataFrame) -> DataFrame:
    """One master per normalised synonym: the largest id wins."""
    return synonyms.groupBy(F.lower(F.trim("synonym")).alias("synonym_key")).agg(F.max("master_id").alias("synonym_id"))


def cascade(items: DataFrame, catalogue: DataFrame, synonyms: DataFrame) -> DataFrame:
    """``items`` with ``stage`` and ``matched_id``: every row takes the first tier that knows its description.

    The token tier compares the order-free set of words. All three tiers are equi joins on one key each; AQE broadcasts
    the lookups when they are small, so that items aren't moved, and shuffles them when they are not.
    """
    words = lambda c: F.array_join(F.array_sort(F.array_distinct(F.split(F.lower(F.trim(c)), " +"))), " ")
    by_token = catalogue.groupBy(words("description").alias("token_key")).agg(F.max("master_id").alias("token_id"))
    rows = items.withColumns({"synonym_key": F.lower(F.trim("description")), "token_key": words("description")})
    rows = matching.exact(rows, catalogue).withColumnRenamed("matched_id", "exact_id")
    rows = rows.join(synonym_lookup(synonyms), "synonym_key", "left").join(by_token, "token_key", "left")
    tier = F.when(F.col("exact_id").isNotNull(), TIERS[0]).when(F.col("synonym_id").isNotNull(), TIERS[1]).when(F.col("token_id").isNotNull(), TIERS[2]).otherwise("new")
    rows = rows.withColumns({"stage": tier, "matched_id": F.coalesce("exact_id", "synonym_id", "token_id")})
    return rows.drop("key", "synonym_key", "token_key", "exact_id", "synonym_id", "token_id")


def with_vectors(items: DataFrame, catalogue: DataFrame, synonyms: DataFrame, embed, rescore, k: int = 20, cutoff: float = 0.75, least: float = 0.6) -> DataFrame:
    """``cascade`` with a fourth tier, ``vector``, and its ``score``: what no other tier knows meets the k nearest catalogue texts.

    ``embed`` makes a vector of a text column, ``rescore`` a score of two. Candidates are of ``cutoff`` or more by cosine
    (exact, from an index of the catalogue's texts); the best score, ties by the smaller master, matches from ``least``
    on. Distinct texts are matched, and joined back to their items. Null descriptions match nothing.
    """
    texts = stage(cascade(items.select("description").distinct(), catalogue, synonyms), "texts")
    known = stage(matching.lookup(catalogue).where("key is not null"), "known")
    index = vector_index.build(vector_index.usable(known.withColumn("_v", embed(F.col("key"))), "matched_id", "_v"))
    asked = texts.where("stage = 'new' and description is not null").select("description", F.lower(F.trim("description")).alias("asked"))
    near = vector_index.search(index, vector_index.usable(asked.withColumn("_v", embed(F.col("asked"))), "description", "_v"), k, cutoff)
    scored = near.join(known, F.col("id") == F.col("matched_id")).withColumn("score", rescore(F.lower(F.trim("query")), F.col("key"))).where(F.col("score") >= least)
    best = scored.groupBy(F.col("query").alias("_text")).agg(F.max_by(F.struct("id", "score"), F.struct("score", -F.col("id"))).alias("_b"))
    found = texts.join(best, texts.description == F.col("_text"), "left")
    vector = (F.col("stage") == "new") & F.col("_b").isNotNull()
    found = found.select(F.col("description").alias("_text"), F.when(vector, "vector").otherwise(F.col("stage")).alias("stage"), F.when(vector, F.col("_b.id")).otherwise(F.col("matched_id")).alias("matched_id"), F.when(vector, F.col("_b.score")).alias("score"))
    return items.join(found, F.col("description").eqNullSafe(F.col("_text"))).drop("_text")


def stage_metrics(cascaded: DataFrame) -> DataFrame:
    """Items that enter and leave each tier, in tier order; tiers that resolve nothing are listed too."""
    spark = cascaded.sparkSession
    tiers = spark.createDataFrame(list(enumerate(TIERS)), "ord int, stage string")
    counts = stage(cascaded.groupBy("stage").agg(F.count("*").alias("resolved")), "tiers")  # one row a tier
    total = counts.agg(F.coalesce(F.sum("resolved"), F.lit(0)).alias("total"))
    before = Window.orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    rows = tiers.join(counts, "stage", "left").crossJoin(total).withColumn("resolved", F.coalesce("resolved", F.lit(0)))
    rows = rows.withColumn("items_in", F.col("total") - F.coalesce(F.sum("resolved").over(before), F.lit(0)))
    return rows.select("stage", "items_in", "resolved", F.when(F.col("items_in") > 0, F.col("resolved") / F.col("items_in")).otherwise(0.0).alias("hit_rate"))


def temp_codes(rows: DataFrame, project: str, file: str, order: list[str]) -> DataFrame:
    """PRJ.<project>-TEMP-001, ... numbered within the project by file, then ``order``, so no two rows share a code.

    Rows without a project have no code. Files are ranked by their counts in buckets and lines inside their file, so that no project is sorted in one task.
    """
    starts = analytics.placed(rows.select(project, file), [project], file).select(F.col(project).alias("_project"), F.col(file).alias("_file"), "before")
    numbered = rows.join(starts, F.col(project).eqNullSafe(F.col("_project")) & F.col(file).eqNullSafe(F.col("_file")))
    number = (F.col("before") + F.row_number().over(Window.partitionBy(project, file).orderBy(*order))).cast("string")
    padded = F.when(F.length(number) < 3, F.lpad(number, 3, "0")).otherwise(number)
    return numbered.withColumn("temp_code", F.concat(F.lit("PRJ."), F.col(project).cast("string"), F.lit("-TEMP-"), padded)).drop("_project", "_file", "before")


GENERIC = ("item", "other", "various", "misc", "work", "n/a")


def degenerate(column: str, generic: tuple[str, ...] = GENERIC) -> F.Column:
    """Whether a text says nothing: null, under three characters, one word said again and again, or a generic word."""
    t = F.lower(F.trim(column))
    words = F.split(t, r"\s+")
    return F.coalesce((F.length(t) < 3) | (F.size(words) > 1) & (F.size(F.array_distinct(words)) == 1) | t.isin(*generic), F.lit(True))


def elect_canonical(variants: DataFrame, cluster: list[str]) -> DataFrame:
    """The variant that speaks for its cluster, with the cluster's ``total_frequency``: not degenerate, most frequent, longest, then alphabetical.

    Aggregated, so a large cluster is combined before it is shuffled. Null frequencies come last.
    """
    size = F.coalesce(F.length("description"), F.lit(0))
    order = F.struct(degenerate("description"), -F.coalesce("frequency", F.lit(-1)), -size, F.coalesce("description", F.lit("")))
    best = variants.groupBy(*cluster).agg(F.min_by(F.struct("*"), order).alias("_best"), F.sum("frequency").alias("total_frequency"))
    return best.select("_best.*", "total_frequency")


def route(items: DataFrame) -> DataFrame:
    """``items`` with ``route``: the first reason to reject a row, or the gate that its confidence passes (green from 90)."""
    text, c = F.trim("description"), F.col("confidence")
    reason = F.when(F.length(text) < 3, "too short").when((F.col("unit_price") <= 0) | (F.col("quantity") <= 0), "no price").when(c < 60, "low confidence")
    return items.withColumn("route", F.coalesce(reason, F.when(c >= 90, "green").otherwise("yellow")))
