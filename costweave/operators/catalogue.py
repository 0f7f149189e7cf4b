"""Catalogue building and versions: frequency aggregation, Pareto selection, dedup, numbering and version diffs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from costweave.operators import analytics
from costweave.session import stage

PARETO = 80  # percent of all rows
QUANTITY_CHANGE, PRICE_CHANGE = 0.01, 0.05


def aggregate(items: DataFrame, least: int = 1) -> DataFrame:
    """Frequency and number of files of every (description, unit)."""
    return items.groupBy("description", "unit").agg(F.count("*").alias("frequency"), F.count_distinct("file_id").alias("n_files")).where(F.col("frequency") >= least)


def pareto(frequencies: DataFrame) -> DataFrame:
    """``is_top`` for rows in frequency order, ties by text, up to and including the one that crosses PARETO.

    Rows are cut into ranges of that order and summed inside each from where it starts, so that no task holds more than a
    range: the tail of rare texts is as long as the table.
    """
    order = [F.desc("frequency"), "description", "unit"]
    rows = stage(frequencies.repartitionByRange(*order).withColumn("piece", F.spark_partition_id()), "pareto")
    sums = rows.groupBy("piece").agg(F.sum("frequency").alias("held"))
    starts = sums.select("piece", (F.sum("held").over(Window.orderBy("piece")) - F.col("held")).alias("start"), F.sum("held").over(Window.partitionBy()).alias("all"))  # one row a range
    inside = Window.partitionBy("piece").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("so_far", F.sum("frequency").over(inside)).join(starts, "piece")
    before = F.col("start") + F.col("so_far") - F.col("frequency")
    return rows.select("description", "unit", "frequency", (before * 100 < F.col("all") * PARETO).alias("is_top"))


def first_of(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row by ``order`` of every key."""
    return rows.withColumn("_place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_place = 1").drop("_place")


def versions(files: DataFrame) -> DataFrame:
    return files.withColumn("version", F.row_number().over(Window.partitionBy("project_id").orderBy("uploaded_at", "file_id")))


def _last_lines(items: DataFrame, numbered: DataFrame) -> DataFrame:
    """The last line of every item, by lower-cased trimmed description, in a version.

    A version is one file, so lines that have met their file are ranked where they are.
    """
    rows = items.select("file_id", "line_number", "master_id", "description", "quantity", "unit_price", "amount").join(numbered, "file_id")
    rows = rows.withColumn("item", F.lower(F.trim("description"))).drop("description").where("item <> ''")
    return first_of(rows, ["file_id", "project_id", "version", "item"], [F.desc("line_number"), F.desc("master_id"), F.desc("amount")])


def _with_status(pairs: DataFrame) -> DataFrame:
    """Added and removed go by presence, not by a quantity that may be null; unknown changes count as none."""
    far = lambda a, b, most: F.abs(F.col(b) - F.col(a)) > F.abs(F.col(a)) * most
    changed = far("quantity_old", "quantity_new", QUANTITY_CHANGE) | far("price_old", "price_new", PRICE_CHANGE)
    status = F.when(F.col("here_old").isNull(), "added").when(F.col("here_new").isNull(), "removed").when(changed, "modified").otherwise("unchanged")
    return pairs.withColumn("status", status).drop("here_old", "here_new")


def version_diffs(items: DataFrame, files: DataFrame) -> DataFrame:
    """Items of every version from a project's second one on against the version before it; last line wins.

    A version without any line has all items of the one before it removed; nothing follows a project's newest version.
    An item's versions in a project stand in order once: each is compared with the one before it, and is removed from
    the next version where that lacks it. Files without a project have no version before or after.
    """
    numbered = versions(files).select("file_id", "project_id", "version", F.count("*").over(Window.partitionBy("project_id")).alias("newest"))
    order = Window.partitionBy("project_id", "item").orderBy("version")
    before, after = F.lag(F.struct("version", "quantity", "unit_price")).over(order), F.lead("version").over(order)
    last = _last_lines(items, numbered).select("project_id", "item", "version", "newest", "quantity", "unit_price").withColumns({"before": before, "after": after})
    known = F.col("project_id").isNotNull()
    old = F.when(known & (F.col("before.version") == F.col("version") - 1), F.col("before"))
    none = F.lit(None)

    def row(version: Column, old: tuple, new: tuple) -> Column:
        values = dict(zip(("quantity_old", "price_old", "here_old", "quantity_new", "price_new", "here_new"), (*old, *new), strict=True))
        return F.struct(version.alias("version"), *(v.cast("boolean" if k.startswith("here") else "double").alias(k) for k, v in values.items()))

    own = (F.col("quantity"), F.col("unit_price"), F.lit(True))
    here = row(F.col("version"), (old["quantity"], old["unit_price"], F.when(old.isNotNull(), True)), own)
    gone = row(F.col("version") + 1, own, (none, none, none))
    left = known & (F.col("version") < F.col("newest")) & ~F.col("after").eqNullSafe(F.col("version") + 1)
    rows = F.array_compact(F.array(F.when(F.col("version") > 1, here), F.when(left, gone)))
    pairs = last.select("project_id", "item", F.explode(rows).alias("r"))
    return _with_status(pairs.select("project_id", "r.version", "item", *(f"r.{c}_{n}" for n in ("old", "new") for c in ("quantity", "price", "here"))))


def version_changes(diffs: DataFrame) -> DataFrame:
    """Rows of ``version_diffs`` that both versions have, with ``change``, ``price_diff`` and ``quantity_diff`` in percent.

    A price that moved by more than PRICE_CHANGE decides, a quantity only after it. Without a positive value before there
    is no difference, and one of zero is null; a null value after counts as zero.
    """
    def percent(name):
        old, new = F.col(f"{name}_old"), F.coalesce(F.col(f"{name}_new"), F.lit(0.0))
        return F.when(old > 0, (new - old) / old * 100)

    price, quantity = percent("price"), percent("quantity")
    change = F.when(F.abs(price) > PRICE_CHANGE * 100, "price_changed").when(F.abs(quantity) > QUANTITY_CHANGE * 100, "quantity_changed").otherwise("unchanged")
    both = diffs.where(~F.col("status").isin("added", "removed"))
    return both.select("project_id", "version", "item", change.alias("change"), F.nullif(price, F.lit(0.0)).alias("price_diff"), F.nullif(quantity, F.lit(0.0)).alias("quantity_diff"))


def next_codes(rows: DataFrame, prefix: str, value: str, existing: DataFrame | None = None, width: int = 4) -> DataFrame:
    """(prefix, value, work_code): PREFIX-0001, ... in order of the distinct numeric ``value``; ``width`` digits or more.

    Rows without a prefix have no code. With ``existing`` codes (column ``work_code``) a prefix goes on after its largest number, compared as a number. Rows
    are ranked in buckets, so that no prefix is sorted in one task.
    """
    ranked = analytics.placed(rows.select(prefix, value).distinct(), [prefix], value)
    start = F.lit(0)
    if existing is not None:
        number = F.try_to_number(F.regexp_extract("work_code", r"-(\d{1,18})$", 1), F.lit("9" * 18))
        last = existing.groupBy(F.regexp_replace("work_code", r"-\d+$", "").alias("_used")).agg(F.max(number).cast("long").alias("_last"))
        ranked = ranked.join(last, F.col(prefix) == F.col("_used"), "left")
        start = F.coalesce("_last", F.lit(0))
    number = (F.col("before") + 1 + start).cast("string")
    return ranked.select(prefix, value, F.concat(prefix, F.lit("-"), F.when(F.length(number) < width, F.lpad(number, width, "0")).otherwise(number)).alias("work_code"))


def price_ranges(items: DataFrame) -> DataFrame:
    """Occurrences, least, largest and mean price, and the sorted distinct files of every (description, unit)."""
    price = F.col("unit_price")
    return items.groupBy("description", "unit").agg(F.count("*").alias("occurrences"), F.min(price).alias("min_price"), F.max(price).alias("max_price"), F.round(F.avg(price), 4).alias("avg_price"), F.array_sort(F.collect_set("file_id")).alias("file_ids"))


def same_content(files: DataFrame, key: str, content: str) -> DataFrame:
    """Every file with the SHA-256 of its bytes and the smallest key that has the same; files without content are left out."""
    rows = files.where(F.col(content).isNotNull()).select(key, F.sha2(content, 256).alias("digest"))
    return rows.join(rows.groupBy("digest").agg(F.min(key).alias("first_id")), "digest")


def version_totals(items: DataFrame, files: DataFrame) -> DataFrame:
    """Lines and amount of every version over all its rows, with the change against the version before, also in percent."""
    per_file = items.groupBy("file_id").agg(F.count("*").alias("n_lines"), F.sum(F.col("amount").cast("decimal(18,2)")).alias("total"))
    rows = versions(files).join(per_file, "file_id", "left").withColumns({"n_lines": F.coalesce("n_lines", F.lit(0)), "total_amount": F.coalesce(F.col("total").cast("double"), F.lit(0.0))})
    before = F.lag("total_amount").over(Window.partitionBy("project_id").orderBy("version"))
    change = F.col("total_amount") - before
    return rows.select("project_id", "version", "n_lines", "total_amount", F.round(change, 2).alias("change"), F.round(F.when(before != 0, change / before * 100), 4).alias("change_pct"))
