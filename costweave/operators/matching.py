"""Matching against the catalogue: exact joins, what is left, token overlap, and cleaning with its flags."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def lookup(catalogue: DataFrame) -> DataFrame:
    """One catalogue row per lower-cased trimmed description: the largest id wins."""
    return catalogue.groupBy(F.lower(F.trim("description")).alias("key")).agg(F.max("master_id").alias("matched_id"))


def exact(items: DataFrame, catalogue: DataFrame) -> DataFrame:
    """``items`` with ``matched_id``, null where nothing matches."""
    return items.withColumn("key", F.lower(F.trim("description"))).join(lookup(catalogue), "key", "left")


def overlap(a: str, b: str) -> F.Column:
    """Shared distinct words over the larger number of distinct words."""
    x, y = (F.array_distinct(F.split(F.lower(F.trim(c)), " +")) for c in (a, b))
    return F.size(F.array_intersect(x, y)) / F.greatest(F.size(x), F.size(y))


def jaccard(a: str, b: str) -> F.Column:
    """Shared distinct words over all distinct words."""
    x, y = (F.array_distinct(F.split(F.lower(F.trim(c)), " +")) for c in (a, b))
    return F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y))


def select_items(items: DataFrame, equal: dict, low: float | None = None, high: float | None = None, search: str | None = None) -> DataFrame:
    """Line items that meet all given conditions: equal columns, a closed range of confidence, words in the description; None asks nothing."""
    for column, value in equal.items():
        items = items if value is None else items.where(F.col(column) == value)
    items = items if low is None else items.where(F.col("confidence") >= low)
    items = items if high is None else items.where(F.col("confidence") <= high)
    return items if search is None else items.where(F.contains(F.lower("description"), F.lit(search.lower())))


def clean(items: DataFrame) -> DataFrame:
    """Rows with a description; amounts that aren't numbers count as 0; issues joined by '; '; amount recomputed."""
    text = F.trim("description")
    number = lambda c: F.coalesce(F.col(c).try_cast("double"), F.lit(0.0))
    quantity, price = number("quantity"), number("unit_price")
    rows = items.where(text.isNotNull() & ~F.lower(text).isin("", "nan")).withColumns({"description": text, "quantity": quantity, "unit_price": price})
    q, p, given = F.col("quantity"), F.col("unit_price"), number("amount")
    issues = F.concat_ws("; ", F.when(q < 0, "Negative quantity"), F.when(q == 0, "Zero quantity"), F.when(p < 0, "Negative price"), F.when((given != 0) & (F.abs(given - q * p) > 0.01 * F.abs(given)), "Amount mismatch"))
    return rows.withColumn("issues", issues).withColumn("amount", q * p)
