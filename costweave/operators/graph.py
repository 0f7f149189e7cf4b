"""Connected components of an edge table, without collecting it anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from costweave.session import Scratch


def _roots(parent: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root): follow (node, parent) links, which never go up, to their ends by pointer jumping."""
    while True:
        step = parent.join(parent.select(F.col("node").alias("parent"), F.col("parent").alias("next")), "parent", "left")
        new = scratch.stage(step.select("node", F.coalesce("next", "parent").alias("parent"), (F.col("next") != F.col("parent")).alias("moved")), "roots")
        if new.where("moved").isEmpty():
            return new.select("node", F.col("parent").alias("root"))
        parent = new.drop("moved")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node reachable, for every node that has an edge; ids of any type that has an order.

    Every node hooks onto its smallest neighbour, the trees are contracted to their roots, and what edges are left
    between roots goes on; each round at least halves the nodes. Loops, nulls and repeated edges do no harm. The
    result is read from the scratch folder of its own, whose other tables are dropped.
    """
    scratch = Scratch(edges.sparkSession, "components")
    x, y = F.col(a), F.col(b)
    edges = scratch.stage(edges.select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v")).where("u <> v").distinct(), "edges")
    label = None
    while label is None or not edges.isEmpty():
        low = edges.groupBy("u").agg(F.min("v").alias("v"))
        parent = scratch.stage(low.union(edges.select(F.col("v").alias("u"), "v").distinct()).groupBy(F.col("u").alias("node")).agg(F.min("v").alias("parent")), "parents")
        roots = _roots(parent, scratch)
        hop = roots.select(F.col("node").alias("u"), F.col("root").alias("ru"))
        edges = edges.join(hop, "u").join(roots.select(F.col("node").alias("v"), F.col("root").alias("rv")), "v")
        edges = scratch.stage(edges.where("ru <> rv").select(F.greatest("ru", "rv").alias("u"), F.least("ru", "rv").alias("v")).distinct(), "edges")
        if label is None:
            label = roots
        else:
            label = label.join(hop, label.root == hop.u, "left").select("node", F.coalesce("ru", "root").alias("root"))
        label = scratch.stage(label, "labels")
    scratch.drop("edges", "parents", "roots")
    return label.withColumnRenamed("root", "component")
