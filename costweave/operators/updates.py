"""Results written back to lines: matches, back links from new masters, synonyms learnt from approved ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from costweave.operators import matching


def with_matches(items: DataFrame, matches: DataFrame, keys: list[str]) -> DataFrame:
    """``items`` with ``matched_id`` of the matches where one is given, their own otherwise; repeated matches: the largest id."""
    one = matches.groupBy(*keys).agg(F.max("matched_id").alias("_new"))
    return items.join(one, keys, "left").withColumn("matched_id", F.coalesce("_new", "matched_id")).drop("_new")


def back_links(items: DataFrame, variants: DataFrame) -> DataFrame:
    """``items`` without a match take the master whose variant has their file and their description, if there is one.

    ``variants``: (master_id, file_id, variant); of several masters the largest id.
    """
    own = variants.groupBy("file_id", F.lower(F.trim("variant")).alias("_variant")).agg(F.max("master_id").alias("_master"))
    rows = items.withColumn("_variant", F.lower(F.trim("description"))).join(own, ["file_id", "_variant"], "left")
    return rows.withColumn("matched_id", F.coalesce("matched_id", "_master")).drop("_variant", "_master")


def learnt_synonyms(approved: DataFrame, catalogue: DataFrame) -> DataFrame:
    """(synonym, master_id, n): what approved items (description, matched_id) call a master, unless the catalogue has that text.

    One master a synonym: the one with most approvals, then the largest id.
    """
    counts = approved.where("matched_id is not null").groupBy(F.lower(F.trim("description")).alias("synonym"), "matched_id").agg(F.count("*").alias("n"))
    best = counts.groupBy("synonym").agg(F.max(F.struct("n", F.col("matched_id").alias("master_id"))).alias("b"))
    known = matching.lookup(catalogue).select(F.col("key").alias("synonym"))
    return best.join(known, "synonym", "left_anti").select("synonym", "b.master_id", "b.n")
