"""Hard-negative mining by coordinate pruning over length buckets.

Vectors of like length form buckets of about BUCKET rows; a bucket keeps its vectors, and for every coordinate the list of
its unit vectors' values in order. Anchors go through all buckets in chunks, longest vectors first. For an anchor and a
least score, a bucket asks for a least cosine (the score over both lengths, the bucket's longest), or nothing at all if
that is over 1. From the cosine follows, for each of the anchor's FOCUS largest coordinates, the range in which a
vector's own coordinate must lie; the ranges are cut out of the sorted lists, the sets of rows they hold intersected, and
what is left is verified by exact integer products. The least score rises as rows are found.

First the nearest rows of the anchor's label are searched, then, with their scores as bounds, the rows of other labels
that are nearly as close. A chunk of anchors (CHUNK rows at most) is broadcast and the index read once per chunk and
search, so no vector is shuffled but into its bucket, and no label or vector meets in one task.

Rows with a null id, label or vector take no part, nor do rows with null components. Of rows that share a vec_id the one
with the smallest (label, vector) counts. Shorter vectors are filled with zeros; a zero vector scores 0 with all. Ties go
to the smaller id. Other columns are not looked at; an empty table gives an empty result. Products must stay below 2**63.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from costweave.session import Scratch, stage

BUCKET = 4096  # rows of a bucket, about
CHUNK = 16_384  # anchors that are broadcast at once
FOCUS = 4
ROWS = 256  # anchors whose scores against a bucket are held at once
GROWTH = 1.1  # lengths in a bucket differ by this factor at most
SLACK = 1e-9
#: From this share of a bucket on, candidates are verified by one matrix product instead of row by row.
DENSE = 0.25


class Bucket:
    """Rows of like length with one sorted list a coordinate."""

    def __init__(self, row: dict, size: int):
        self.ids, self.labels = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["labels"], np.int64)
        self.vectors = np.frombuffer(row["vectors"], np.int64).reshape(-1, size)
        self.lists = np.frombuffer(row["lists"], np.int32).reshape(size, -1)
        self.longest = row["longest"]
        lengths = np.linalg.norm(self.vectors.astype(float), axis=1)
        self.unit = np.ascontiguousarray((self.vectors / np.maximum(lengths, 1e-300)[:, None]).T)
        self.sorted = np.take_along_axis(self.unit, self.lists, axis=1)

    def feasible(self, unit: np.ndarray, cosine: np.ndarray) -> list[np.ndarray | None]:
        """Per anchor the rows whose focus coordinates all allow this cosine; None stands for all rows."""
        n = len(self.ids)
        out: list[np.ndarray | None] = [None] * len(unit)
        bound = np.flatnonzero(cosine > -1)
        if not len(bound):
            return out
        focus = np.argsort(-np.abs(unit[bound]), axis=1)[:, :FOCUS]
        own = np.arccos(np.clip(np.take_along_axis(unit[bound], focus, axis=1), -1, 1))
        reach = np.arccos(np.clip(cosine[bound], -1, 1))[:, None]
        low = np.where(own + reach >= math.pi, -1.0, np.cos(np.minimum(own + reach, math.pi))) - SLACK
        high = np.cos(np.maximum(own - reach, 0)) + SLACK
        first, last = np.empty_like(focus), np.empty_like(focus)
        for f in np.unique(focus):
            at = focus == f
            first[at], last[at] = np.searchsorted(self.sorted[f], low[at], "left"), np.searchsorted(self.sorted[f], high[at], "right")
        sizes = last - first
        for k in np.flatnonzero((sizes < n).any(axis=1)).tolist():
            j = int(sizes[k].argmin())
            rows = self.lists[focus[k, j], first[k, j] : last[k, j]]
            for i in range(focus.shape[1]):
                if i != j and sizes[k, i] < n:
                    value = self.unit[focus[k, i], rows]
                    rows = rows[(value >= low[k, i]) & (value <= high[k, i])]
            out[bound[k]] = np.sort(rows)
        return out


class Anchors:
    """A chunk of anchors: ids, labels, vectors, and the score bounds of what is looked for, one column per search."""

    def __init__(self, ids, labels, vectors, low, high, k: int, same: bool):
        self.ids, self.labels, self.vectors, self.low, self.high, self.k, self.same = ids, labels, vectors, low, high, k, same
        self.lengths = np.linalg.norm(vectors.astype(float), axis=1)
        self.unit = vectors / np.maximum(self.lengths, 1e-300)[:, None]


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T of integers, exactly."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    return np.rint(a.astype(float) @ b.T.astype(float)).astype(np.int64) if most < 2**53 else a @ b.T


def hits(bucket: Bucket, anchors: Anchors, at: np.ndarray, least: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, row, score) of the bucket's rows with a score in [least, most] for the anchors ``at``; of their label or of others."""
    room = anchors.lengths[at] * bucket.longest
    with np.errstate(over="ignore", divide="ignore", invalid="ignore"):
        cosine = np.where(least > 0, np.where(room > 0, least / room, np.inf), -1.0)
    inside = cosine <= 1 + SLACK
    at, least, most, cosine = at[inside], least[inside], most[inside], cosine[inside]
    found = []
    for start in range(0, len(at), ROWS):
        here = at[start : start + ROWS]
        rows = bucket.feasible(anchors.unit[here], cosine[start : start + ROWS])
        allowed, wide = np.ones((len(here), len(bucket.ids)), bool), []
        for i, own in enumerate(rows):
            if own is None or len(own) > DENSE * len(bucket.ids):
                wide.append(i)
                if own is not None:
                    allowed[i] = False
                    allowed[i, own] = True
            elif len(own):
                score = products(anchors.vectors[here[i]][None], bucket.vectors[own])[0]
                found.append((np.full(len(own), start + i), own, score))
        if wide:
            score = products(anchors.vectors[here[wide]], bucket.vectors)
            low, high = least[start : start + ROWS][wide], most[start : start + ROWS][wide]
            i, r = np.nonzero(allowed[wide] & (score >= low[:, None]) & (score <= high[:, None]))
            found.append((start + np.array(wide)[i], r, score[i, r]))
    if not found:
        return (np.zeros(0, np.int64),) * 3
    i, r, score = (np.concatenate(x) for x in zip(*found, strict=True))
    who = at[i]
    keep = (score >= least[i]) & (score <= most[i]) & ((bucket.labels[r] == anchors.labels[who]) == anchors.same) & (bucket.ids[r] != anchors.ids[who])
    return who[keep], r[keep], score[keep]


def search(index: DataFrame, anchors: Anchors, size: int) -> DataFrame:
    """(anchor, search, row_id, score): for each anchor and pair of bounds the k best rows of every task."""
    sent = index.sparkSession.sparkContext.broadcast(anchors)
    searches = anchors.low.shape[1]

    def best(batches):
        own = sent.value
        low = own.low.copy()
        held = [np.zeros(0, np.int64)] * 3  # place (anchor x searches + search), row id, score
        for batch in batches:
            for row in batch.to_pylist():
                bucket = Bucket(row, size)
                wanted = np.flatnonzero((own.low <= own.high).any(axis=1))
                open_low = np.where(own.low <= own.high, low, np.iinfo(np.int64).max)[wanted].min(axis=1)
                who, r, score = hits(bucket, own, wanted, open_low, own.high[wanted].max(axis=1))
                new = [held]
                for j in range(searches):
                    fits = (score >= low[who, j]) & (score <= own.high[who, j])
                    new.append([who[fits] * searches + j, bucket.ids[r[fits]], score[fits]])
                place, ids, score = (np.concatenate(x) for x in zip(*new, strict=True))
                order = np.lexsort((ids, -score, place))
                place, ids, score = place[order], ids[order], score[order]
                rank = np.arange(len(place)) - np.searchsorted(place, place)
                last = np.flatnonzero(rank == own.k - 1)
                low[place[last] // searches, place[last] % searches] = score[last]  # ties still come in, for their ids
                held = [x[rank < own.k] for x in (place, ids, score)]
        place, ids, score = held
        yield pa.record_batch([pa.array(own.ids[place // searches]), pa.array(place % searches), pa.array(ids), pa.array(score)], ["anchor", "search", "row_id", "score"])

    return index.mapInArrow(best, "anchor long, search long, row_id long, score long")


def build_index(rows: DataFrame, size: int) -> DataFrame:
    """A row per bucket of (vec_id, label, v): ids, labels, vectors and the order of each coordinate, as bytes; longest first."""
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x))
    banded = rows.withColumn("band", F.when(length > 0, F.floor(F.log(length) / math.log(GROWTH))).otherwise(-1))
    bands = banded.groupBy("band").agg(F.ceil(F.count("*") / BUCKET).alias("parts"))
    dealt = banded.join(bands, "band").withColumn("part", F.pmod(F.xxhash64("vec_id"), "parts"))

    def build(table: pa.Table) -> pa.Table:
        ids, labels = table.column("vec_id").to_numpy(), table.column("label").to_numpy()
        vectors = table.column("v").combine_chunks().flatten().to_numpy().astype(np.int64).reshape(-1, size)
        lengths = np.linalg.norm(vectors.astype(float), axis=1)
        lists = np.argsort((vectors / np.maximum(lengths, 1e-300)[:, None]).T, axis=1, kind="stable").astype(np.int32)
        return pa.table({"longest": [float(lengths.max())], "ids": [ids.tobytes()], "labels": [labels.tobytes()], "vectors": [vectors.tobytes()], "lists": [lists.tobytes()]})

    out = dealt.select("band", "part", "vec_id", "label", "v").groupBy("band", "part").applyInArrow(build, "longest double, ids binary, labels binary, vectors binary, lists binary")
    return out.sortWithinPartitions(F.desc("longest"))


def mine(vectors: DataFrame, every: int = 50, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for rows of (vec_id, label, v), v an array of long.

    Anchors are the rows whose vec_id ``every`` divides. A positive is one of the anchor's ``positives`` best other rows of
    its label; its negatives are the best rows of other labels that score ``low`` to ``high`` percent of it.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "negatives")
    rows = vectors.where("vec_id is not null and label is not null and v is not null and not exists(v, x -> x is null)").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "v")
    total, distinct, size, shortest = rows.agg(F.count("*"), F.count_distinct("vec_id"), F.max(F.size("v")), F.min(F.size("v"))).first()
    if distinct < total:
        rows = rows.groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("r")).select("vec_id", "r.label", "r.v")
    if shortest != size or size == 0:
        size = max(size or 1, 1)
        rows = rows.withColumn("v", F.concat("v", F.array_repeat(F.lit(0).cast("long"), F.lit(size) - F.size("v"))))
    index = scratch.stage(build_index(rows, size), "index")
    asked = rows.where(F.col("vec_id") % every == 0)
    chunks = math.ceil(asked.count() / CHUNK)
    asked = scratch.stage(asked.withColumn("chunk", F.pmod(F.xxhash64("vec_id"), F.lit(max(chunks, 1)))), "anchors")

    def chunk(df: DataFrame, i: int) -> pa.Table:
        return df.where(F.col("chunk") == i).drop("chunk").toArrow().sort_by("vec_id")

    def numbers(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        v = table.column("v").combine_chunks().flatten().to_numpy().astype(np.int64)
        return table.column("vec_id").to_numpy(), table.column("label").to_numpy(), v.reshape(-1, size)

    def ranked(found: DataFrame, k: int) -> DataFrame:
        by = Window.partitionBy("anchor", "search").orderBy(F.desc("score"), "row_id")
        return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)

    out, lowest, highest = None, np.iinfo(np.int64).min, np.iinfo(np.int64).max
    for i in range(chunks):
        held = chunk(asked, i)
        if not held.num_rows:
            continue
        ids, labels, v = numbers(held)
        open_ = np.full((len(ids), 1), lowest), np.full((len(ids), 1), highest)
        near = scratch.stage(ranked(search(index, Anchors(ids, labels, v, *open_, positives, True), size), positives), f"positives{i}")
        found = near.toArrow().sort_by([("anchor", "ascending"), ("rank", "ascending")])
        at, place, score = np.searchsorted(ids, found.column("anchor").to_numpy()), found.column("rank").to_numpy() - 1, found.column("score").to_numpy()
        floor, roof = np.full((len(ids), positives), highest), np.full((len(ids), positives), lowest)
        floor[at, place], roof[at, place] = [-(-low * s // 100) for s in score.tolist()], [high * s // 100 for s in score.tolist()]
        hard = ranked(search(index, Anchors(ids, labels, v, floor, roof, negatives, False), size), negatives).withColumn("search", F.col("search") + 1)
        pairs = near.select("anchor", F.col("rank").cast("long").alias("search"), F.col("row_id").alias("positive_id"), F.col("score").alias("positive_score"))
        part = hard.join(pairs, ["anchor", "search"]).select(F.col("anchor").alias("anchor_id"), "positive_id", F.col("rank").cast("int").alias("rank"), F.col("row_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
        part = stage(part, "negatives")
        out = part if out is None else out.union(part)
    scratch.close()
    empty = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    return spark.createDataFrame([], empty) if out is None else out
