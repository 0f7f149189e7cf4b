"""Units of measure: spellings to standard units, and defaults by section code."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Standard units and the spellings that stand for them.
SPELLINGS = {
    "m": ["m", "met", "meter", "mét"],
    "m2": ["m2", "m²", "sqm", "sq.m", "square meter"],
    "m3": ["m3", "m³", "cbm", "cubic meter", "khối"],
    "kg": ["kg", "kilo", "kilogram"],
    "ton": ["ton", "tấn", "t", "tonne"],
    "pcs": ["pcs", "pc", "cái", "chiếc", "ea", "each", "piece"],
    "set": ["set", "bộ"],
    "lot": ["lot", "lô"],
    "ls": ["ls", "lump sum", "trọn gói"],
    "ml": ["ml", "liter", "lít", "l"],
    "day": ["day", "ngày", "d"],
    "hour": ["hour", "giờ", "hr", "h"],
}
NO_UNIT, LONGEST = "pcs", 10


def standard(unit) -> F.Column:
    """The standard unit of a spelling; null is 'pcs', unknown ones are lower-cased, trimmed and cut to 10 characters."""
    text = F.lower(F.trim(F.col(unit) if isinstance(unit, str) else unit))
    known = F.create_map(*(F.lit(x) for unit, spellings in SPELLINGS.items() for s in spellings for x in (s, unit)))
    return F.when(text.isNull(), NO_UNIT).otherwise(F.coalesce(F.element_at(known, text), F.substring(text, 1, LONGEST)))


def with_default(rows: DataFrame, defaults: DataFrame, code: str = "code") -> DataFrame:
    """``rows`` with ``default_unit`` and where it is from: the code's own (own), its first two parts' (parent), or '' (none).

    ``defaults`` has one (code, unit) per code; rows whose code is null get none.
    """
    own = defaults.select(F.col("code").alias("own_code"), F.col("unit").alias("own_unit"))
    parent = defaults.select(F.col("code").alias("parent_code"), F.col("unit").alias("parent_unit"))
    found = rows.join(own, F.col(code) == F.col("own_code"), "left").join(parent, F.substring_index(code, "-", 2) == F.col("parent_code"), "left")
    source = F.when(F.col("own_unit").isNotNull(), "own").when(F.col("parent_unit").isNotNull(), "parent").otherwise("none")
    return found.withColumns({"default_unit": F.coalesce("own_unit", "parent_unit", F.lit("")), "default_from": source}).drop("own_code", "own_unit", "parent_code", "parent_unit")
