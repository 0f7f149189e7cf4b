"""Sections of a file: segments below header rows, and the nearest enclosing rows as a path."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def segments(rows: DataFrame, group: str, order: list[str], header) -> DataFrame:
    """A row per section of every group: number, first and last position (from 1), items without the header.

    A section starts at a header row; rows before the first header are section 0.
    """
    along = Window.partitionBy(group).orderBy(*order)
    placed = rows.withColumns({"position": F.row_number().over(along), "_header": F.coalesce(header, F.lit(False)).cast("int")})
    so_far = F.sum("_header").over(along.rowsBetween(Window.unboundedPreceding, 0))
    return placed.withColumn("section", so_far).groupBy(group, "section").agg(F.min("position").alias("first_row"), F.max("position").alias("last_row"), (F.count("*") - F.sum("_header")).alias("n_items"))


def enclosing(rows: DataFrame, group: str, order: list[str], levels: int) -> DataFrame:
    """``rows`` with ``position`` (from 1) and ``path``: the positions of the rows that enclose each, outermost first.

    ``level`` runs from 1 to ``levels``; a row is enclosed by the nearest row before it of a smaller level, and by what
    encloses that. A level's last row counts if no row of a smaller level came after it.
    """
    along = Window.partitionBy(group).orderBy(*order)
    rows = rows.withColumn("position", F.row_number().over(along))
    before = Window.partitionBy(group).orderBy("position").rowsBetween(Window.unboundedPreceding, -1)
    names = [f"_last_{k}" for k in range(1, levels)]
    rows = rows.withColumns({name: F.max(F.when(F.col("level") == k, F.col("position"))).over(before) for k, name in enumerate(names, 1)})
    steps = []
    for k, name in enumerate(names, 1):
        above = [F.coalesce(F.col(x), F.lit(0)) for x in names[: k - 1]]
        open_ = (F.col("level") > k) & (F.lit(True) if not above else F.col(name) > (F.greatest(*above) if len(above) > 1 else above[0]))
        steps.append(F.when(open_, F.col(name)))
    return rows.withColumn("path", F.array_compact(F.array(*steps))).drop(*names)


#: Level and pattern of headings, in the order they are tried.
HEADINGS = [(1, r"^\s*(?:PHẦN|Phần|CHƯƠNG|Chương|HẠNG MỤC|Hạng mục)\s"), (2, r"^\s*[IVX]+[.)]\s"), (3, r"^\s*[A-Z][.)]\s"), (4, r"^\s*\d+(?:\.\d+)*[.)]\s")]


def heading_level(column: str) -> F.Column:
    """Level of a heading by how it starts; other texts of several words in capitals are level 2, the rest null."""
    t = F.col(column)
    capitals = (t == F.upper(t)) & F.contains(t, F.lit(" ")) & (t != F.lower(t))
    return F.coalesce(*(F.when(t.rlike(p), k) for k, p in HEADINGS), F.when(capitals, 2))
