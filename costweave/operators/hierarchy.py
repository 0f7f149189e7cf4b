"""Code hierarchies, neighbouring rows and vector neighbours."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from costweave.session import stage

#: Reference vectors that meet a task's batch at once.
VECTOR_BLOCK = 4096
#: Queries whose scores against a block are held at once.
QUERY_ROWS = 512


def tree(links: DataFrame) -> DataFrame:
    """(code, parent, level, path) of every code that a root (null parent) reaches; one join a level.

    A level that is empty ends it. A code that its own path holds already is left out, so loops end too.
    """
    level = stage(links.where("parent is null").select("code", "parent", F.lit(1).alias("level"), F.col("code").alias("path"), F.array("code").alias("codes")), "level")
    out = level
    while not level.isEmpty():
        above = level.select(F.col("code").alias("parent"), F.col("level").alias("k"), F.col("path").alias("above"), F.col("codes").alias("held"))
        rows = links.join(above, "parent").where(~F.array_contains("held", F.col("code")))
        level = stage(rows.select("code", "parent", (F.col("k") + 1).alias("level"), F.concat_ws(" > ", "above", "code").alias("path"), F.array_append("held", F.col("code")).alias("codes")), "level")
        out = out.union(level)
    return out.drop("codes")


def neighbours(rows: DataFrame, group: str, order: list[str], reach: int = 2) -> DataFrame:
    """``rows`` with the lines up to ``reach`` before and after each, as sorted 'line:description'."""
    own = F.concat_ws(":", F.col("line_number").cast("string"), "description")
    frame = Window.partitionBy(group).orderBy(*order)
    others = [f(own, k).over(frame) for k in range(1, reach + 1) for f in (F.lag, F.lead)]
    return rows.withColumn("neighbours", F.array_sort(F.array_compact(F.array(*others)))).where(F.size("neighbours") > 0)


def numbered(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """``rows`` with ``row_number`` from 1 in a group's order; ties in any order."""
    return rows.withColumn("row_number", F.row_number().over(Window.partitionBy(group).orderBy(*order)))


def _unit(column: pa.ChunkedArray) -> np.ndarray:
    """Vectors of one length as the rows of a matrix, scaled to length 1."""
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    rows = flat.reshape(len(column), -1)
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)


def vector_topk(vectors: DataFrame, k: int, in_label: bool = True) -> DataFrame:
    """(vec_id, label, n_id, similarity): each vector's k nearest by cosine, ties by id; of its label or of all vectors.

    Vectors of a label, or all, are dealt into blocks; a query's block meets each block in a task of its own, gives its
    k best there, and the best of those are ranked. No label meets in one task, and no task holds more than a block.
    Null embeddings, and those with null or non-finite components, have no neighbours and are none; vectors of different
    lengths never meet.
    """
    vectors = vectors.where("embedding is not null and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('inf'))")
    vectors = vectors.withColumn("part", F.struct((F.col("label") if in_label else F.lit(0)).alias("label"), F.size("embedding").alias("size")))
    sizes = vectors.groupBy(F.col("part").alias("sized")).agg(F.ceil(F.count("*") / VECTOR_BLOCK).cast("int").alias("blocks"))
    rows = vectors.join(sizes, F.col("part").eqNullSafe(F.col("sized"))).drop("sized").withColumn("own", F.pmod(F.xxhash64("vec_id"), "blocks").cast("int"))
    each = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    asked = rows.select("part", "label", "vec_id", "embedding", F.col("own").alias("q"), each.alias("r"))
    held = rows.select(*(F.col(c).alias(f"held_{c}") for c in ("part", "vec_id", "embedding")), F.col("own").alias("held_r"), each.alias("held_q"))

    def best(queries: pa.Table, held: pa.Table) -> pa.Table:
        names = ["vec_id", "label", "n_id", "similarity"]
        if not queries.num_rows or not held.num_rows:
            return pa.table([pa.array([], t) for t in (pa.int64(), pa.int32(), pa.int64(), pa.float64())], names)
        held = held.sort_by("held_vec_id")
        ids, others, reference = queries.column("vec_id").to_numpy(), held.column("held_vec_id").to_numpy(), _unit(held.column("held_embedding"))
        asked, out = _unit(queries.column("embedding")), []
        for start in range(0, len(ids), QUERY_ROWS):
            own = ids[start : start + QUERY_ROWS]
            score = np.round(asked[start : start + QUERY_ROWS] @ reference.T, 9)
            score[own[:, None] == others] = -np.inf
            least = -np.partition(-score, min(k, len(others)) - 1, axis=1)[:, min(k, len(others)) - 1]
            at, to = np.nonzero((score >= least[:, None]) & (score > -np.inf))
            order = np.lexsort((to, -score[at, to], at))
            at, to = at[order], to[order]
            first = np.searchsorted(at, at)  # where a query's rows start
            keep = np.arange(len(at)) - first < k
            at, to = at[keep], to[keep]
            out.append((start + at, others[to], score[at, to]))
        at, b, s = (np.concatenate(x) for x in zip(*out, strict=True))
        return pa.table([pa.array(ids[at]), queries.column("label").cast("int32").take(pa.array(at)), pa.array(b), pa.array(s)], names)

    found = asked.groupBy("part", "q", "r").cogroup(held.groupBy("held_part", "held_q", "held_r")).applyInArrow(best, "vec_id long, label int, n_id long, similarity double")
    place = F.row_number().over(Window.partitionBy("vec_id").orderBy(F.desc("similarity"), "n_id"))
    return found.withColumn("_place", place).where(F.col("_place") <= k).drop("_place")
