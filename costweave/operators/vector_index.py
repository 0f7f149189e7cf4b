"""Inverted-file index over vectors: coarse centroids, every vector in the list of its nearest, lists probed by bound or by number.

Centroids are fitted on a bounded sample and broadcast (LISTS x dimension numbers at most). A query goes only to lists
that may hold a vector as close as asked for: by the triangle inequality of angles no vector of a list is nearer than the
query's angle to the centroid less the list's widest angle. Probing all those lists is exact; ``probes`` asks the nearest
lists only, which is faster and may miss some. A list of many rows is dealt into parts, so no list meets in one task.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from costweave.session import stage

#: Rows that fit the centroids, and centroids, at most. They change the work, and the recall when ``probes`` is given.
SAMPLE, LISTS = 20_000, 4_096
PART = 4096  # rows of a part of a list, about
SLACK = 1e-9


def usable(vectors: DataFrame, id: str, vector: str) -> DataFrame:
    """(id, v): vectors as doubles; rows with a null id or vector, a null or non-finite component, or length 0 are left out."""
    v = F.transform(vector, lambda x: x.cast("double"))
    rows = vectors.select(F.col(id).alias("id"), v.alias("v")).where("id is not null and v is not null and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('inf'))")
    return rows.where("exists(v, x -> x <> 0)")


def _unit(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    rows = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def centroids(sample: np.ndarray, lists: int, rounds: int = 12) -> np.ndarray:
    """Unit centres of ``lists`` groups of unit rows at most; the first rows are where it starts."""
    centre = sample[:lists].copy()
    for _ in range(rounds):
        own = (sample @ centre.T).argmax(axis=1)
        sums = np.zeros_like(centre)
        np.add.at(sums, own, sample)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        centre = np.where(size > 1e-12, sums / np.maximum(size, 1e-12), centre)
    return centre


class Index:
    """``rows`` (list, part, id, v) on disk, the centroids, and per list its widest angle and number of parts."""

    def __init__(self, rows: DataFrame, centre: np.ndarray, angle: np.ndarray, parts: np.ndarray):
        self.rows, self.centre, self.angle, self.parts = rows, centre, angle, parts

    @property
    def size(self) -> int:
        return self.centre.shape[1]


def build(vectors: DataFrame, lists: int | None = None) -> Index:
    """An index of (id, v) rows as ``usable`` gives them, all of the length that most have; rows of other lengths are left out."""
    spark = vectors.sparkSession
    most = vectors.groupBy(F.size("v").alias("n")).agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), "n").first()
    if most is None:
        return Index(vectors.selectExpr("0L as list", "0L as part", "id", "v").limit(0), np.zeros((0, 1)), np.zeros(0), np.zeros(0, np.int64))
    vectors = vectors.where(F.size("v") == most["n"])
    sample = vectors.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("v").toArrow()  # bounded by SAMPLE
    unit = _unit(sample.column("v"))
    centre = centroids(unit, min(lists or max(1, math.isqrt(most["rows"])), LISTS, len(unit)))
    sent = spark.sparkContext.broadcast(centre)

    def assign(batches):
        for batch in batches:
            if len(batch):
                near = _unit(batch.column("v")) @ sent.value.T
                own = near.argmax(axis=1)
                yield pa.record_batch([pa.array(own), batch.column("id"), batch.column("v"), pa.array(np.arccos(np.clip(near[np.arange(len(own)), own], -1, 1)))], ["list", "id", "v", "angle"])

    id_type = dict(vectors.dtypes)["id"]
    rows = stage(vectors.select("id", "v").mapInArrow(assign, f"list long, id {id_type}, v array<double>, angle double"), "lists")
    held = rows.groupBy("list").agg(F.max("angle").alias("angle"), F.count("*").alias("n")).toPandas()  # a row a centroid
    angle, parts = np.full(len(centre), -np.inf), np.zeros(len(centre), np.int64)
    angle[held["list"]], parts[held["list"]] = held["angle"], -(-held["n"] // PART)
    in_list = F.array(*(F.lit(int(x)) for x in parts)) if len(parts) < 512 else None
    sizes = rows.groupBy("list").agg(F.ceil(F.count("*") / PART).alias("parts"))
    dealt = rows.join(sizes, "list") if in_list is None else rows.withColumn("parts", in_list[F.col("list").cast("int")].cast("long"))
    return Index(dealt.select("list", F.pmod(F.xxhash64("id"), "parts").alias("part"), "id", "v"), centre, angle, parts)


def search(index: Index, queries: DataFrame, k: int, cutoff: float = 0.75, probes: int | None = None) -> DataFrame:
    """(query, id, similarity, place): each query's k nearest by cosine of ``cutoff`` or more, ties by id; queries of another length find none.

    Exact without ``probes``; with it, each query looks into so many lists only. Similarities are rounded to 9 places.
    """
    spark, size = queries.sparkSession, index.size
    sent = spark.sparkContext.broadcast((index.centre, index.angle, index.parts))
    types = dict(queries.dtypes)["id"], dict(index.rows.dtypes)["id"]

    def route(batches):
        centre, widest, parts = sent.value
        for batch in batches:
            if not len(batch) or not len(centre):
                continue
            near = np.clip(_unit(batch.column("v")) @ centre.T, -1, 1)
            bound = np.cos(np.maximum(np.arccos(near) - widest, 0))
            wanted = (bound >= cutoff - SLACK) & (parts > 0)
            if probes is not None and probes < len(centre):
                rank = np.argsort(np.argsort(np.where(parts > 0, -near, np.inf), axis=1, kind="stable"), axis=1)
                wanted &= rank < probes
            at, to = np.nonzero(wanted)
            each = parts[to]
            at, to = np.repeat(at, each), np.repeat(to, each)
            part = np.arange(len(at)) - np.repeat(np.cumsum(each) - each, each)
            yield pa.record_batch([pa.array(to), pa.array(part), batch.column("id").take(pa.array(at)), batch.column("v").take(pa.array(at))], ["list", "part", "query", "q"])

    def best(asked: pa.Table, held: pa.Table) -> pa.Table:
        names = ["query", "id", "similarity"]
        if not asked.num_rows or not held.num_rows:
            return pa.table([asked.column("query").slice(0, 0), held.column("id").slice(0, 0), pa.array([], pa.float64())], names)
        held = held.sort_by("id")
        vectors, out = _unit(held.column("v")), []
        for low in range(0, asked.num_rows, 512):
            near = np.round(_unit(asked.column("q").slice(low, 512)) @ vectors.T, 9)
            n = min(k, near.shape[1])
            least = np.maximum(-np.partition(-near, n - 1, axis=1)[:, n - 1], cutoff)
            at, to = np.nonzero(near >= least[:, None])
            order = np.lexsort((to, -near[at, to], at))
            at, to = at[order], to[order]
            keep = np.arange(len(at)) - np.searchsorted(at, at) < k
            out.append((low + at[keep], to[keep], near[at[keep], to[keep]]))
        at, to, near = (np.concatenate(x) for x in zip(*out, strict=True))
        return pa.table([asked.column("query").take(pa.array(at)), held.column("id").take(pa.array(to)), pa.array(near)], names)

    routed = queries.where(F.size("v") == size).select("id", "v").mapInArrow(route, f"list long, part long, query {types[0]}, q array<double>")
    found = routed.groupBy("list", "part").cogroup(index.rows.groupBy("list", "part")).applyInArrow(best, f"query {types[0]}, id {types[1]}, similarity double")
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("similarity"), "id"))
    return found.withColumn("place", place).where(F.col("place") <= k)
