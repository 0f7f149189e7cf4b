"""N-gram Jaccard join: grouped prefix join over distinct 5-word shingles, and its connected classes.

Documents with the same set are one class; classes with the same size and the same prefix (the rarest shingles, as many
as the threshold requires) are one group. Groups meet on prefix shingles under size and position filters, are expanded
to their classes and verified on whole sets; the classes of a group also meet in a bucket of their own.

Two linked sets share a shingle at a place in both prefixes behind which enough is left of either for the overlap that
their sizes require. So a bucket (a shingle and a run of sizes that the size filter can't cut) is dropped unless one of
its sets has the shingle that early, and a pair is only made where the shingle is early enough in both: a passage that
many documents share makes no pairs of those it can't link. A bucket of m classes gives 2 m candidates first (each with
its neighbour by size and with the hub of its size), then rounds of one random partner of another component each, as long as
they merge. What is left of a bucket is compared by sizes, places and sketches in blocks of its chunks, and only pairs in
different components that these leave in reach become rows and are verified, so a group of near copies never becomes
all its pairs.

Rows with null or wordless text have an empty set and stand alone. Repeated rows give repeated result rows; of rows
with one doc_id and several texts each text is linked by itself, and component ids are the smallest doc_ids all the same. A null
doc_id gets the component of its class's smallest id, or null. Very long texts are hashed in blocks. Other columns are
not looked at, whatever their names. Empty tables give empty results.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from costweave.llm.words import batch_shingles, blocks, mix
from costweave.operators.graph import components
from costweave.session import Scratch, stage

THRESHOLD = 80  # percent
#: Shingles whose counts decide the order inside prefixes. The order changes no result, only the work.
ORDERED = 200_000
LOCAL_LEAST, TOTAL_LEAST = 2, 16
#: Partners that meet one hub in a task.
SALT = 512
#: Least bits per shingle of the parity sketch of a set: every shingle flips one, so two sketches differ in at most as many
#: bits as the sets differ in shingles, and a pair whose sketches differ too much can't reach the threshold. A sketch of
#: fixed size fills up: at 2,048 bits it says nothing of sets of over 4,600 shingles, which are the largest texts.
SKETCH = 1
#: Rounds of random partners go on while buckets hold over FEW pairs a row and a round merges over one in GAIN of the
#: components that meet in buckets; whatever they leave apart then meets in blocks. This changes the work only.
FEW, GAIN = 4, 20
#: Classes of a bucket that are one side of a block, and words of 64 bits of sketches that are compared at once.
CHUNK, SLICE = 1024, 1 << 17
#: Up to so many requests of 24 bytes are broadcast to the texts; more are joined by a shuffle.
BROADCAST_ROWS = 500_000


def _frequent(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent shingles of all documents (at most ORDERED) with their rank by count."""

    def count(batches):
        for batch in blocks(batches):
            hashes, at = batch_shingles(batch.column("text"))
            parts = [np.unique(hashes[i:j]) for i, j in zip(at[:-1], at[1:], strict=True)]
            value, n = np.unique(np.concatenate(parts) if parts else hashes, return_counts=True)
            keep = n >= LOCAL_LEAST
            yield pa.record_batch([pa.array(value[keep].view(np.int64)), pa.array(n[keep])], ["tok", "n"])

    top = docs.select("text").mapInArrow(count, "tok long, n long").groupBy("tok").agg(F.sum("n").alias("n")).where(F.col("n") >= TOTAL_LEAST)
    rows = top.orderBy(F.desc("n"), "tok").limit(ORDERED).toPandas()
    value = rows["tok"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(value)
    return value[order], (len(value) - order).astype(np.int64)


def required(n: int, threshold: int = THRESHOLD) -> int:
    """Least shared shingles with any partner of a set of n."""
    return -(-threshold * n // 100)


def sketch_bits(n: int) -> int:
    """Bits of the sketch of a set of n: a power of two, SKETCH times n or more."""
    return max(64, 1 << (SKETCH * n - 1).bit_length())


class Sketches:
    """The sketches of a column's rows; of two the wider one is folded onto the other's bits, as parities add up."""

    def __init__(self, column: pa.Array | pa.ChunkedArray):
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        column = column.cast(pa.large_binary())
        _, offsets, data = column.buffers()
        at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
        words = np.frombuffer(data, np.uint8)[at[0] : at[-1]].view(np.uint64) if at[-1] > at[0] else np.zeros(0, np.uint64)
        self.words, first = np.diff(at) // 8, (at[:-1] - at[0]) // 8
        self.table: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        width, wider = int(self.words.max(initial=0)), None
        while width:
            rows = np.flatnonzero(self.words >= width)
            place = np.zeros(len(self.words), np.int64)
            place[rows] = np.arange(len(rows))
            table, own = np.empty((len(rows), width), np.uint64), self.words[rows] == width
            table[own] = words[first[rows[own]][:, None] + np.arange(width)]
            if wider is not None:
                table[~own] = wider[:, :width] ^ wider[:, width:]
            self.table[width], wider, width = (table, place), table, width // 2

    def apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Bits in which the sketches of the rows a and b differ."""
        out, common = np.empty(len(a), np.int64), np.minimum(self.words[a], self.words[b])
        for width in np.unique(common).tolist():
            (table, place), pairs = self.table[width], np.flatnonzero(common == width)
            step = max(1, SLICE // width)
            for x in (pairs[i : i + step] for i in range(0, len(pairs), step)):
                out[x] = np.bitwise_count(table[place[a[x]]] ^ table[place[b[x]]]).sum(axis=1, dtype=np.int64)
        return out


def _base(docs: DataFrame, threshold: int, scratch: Scratch) -> DataFrame:
    """A row per document: size and signature of its set, its prefix and the prefix's signature."""
    frequent = docs.sparkSession.sparkContext.broadcast(_frequent(docs))

    def build(batches):
        value, rank = frequent.value
        for batch in blocks(batches):
            hashes, at = batch_shingles(batch.column("text"))
            n, s1, s2, p, prefix, sketch = [], [], [], [], [], []
            for i, j in zip(at[:-1], at[1:], strict=True):
                own = np.unique(hashes[i:j])
                if len(value) and len(own):
                    where = np.minimum(np.searchsorted(value, own), len(value) - 1)
                    seen = value[where] == own
                    if seen.any():
                        own = own[np.lexsort((own, np.where(seen, rank[where] + 1, 0)))]
                head = own[: len(own) - required(len(own), threshold) + 1] if len(own) else own
                width = sketch_bits(len(own))
                bits = np.bincount((own & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
                sketch.append(np.packbits(bits.astype(np.uint8)).tobytes())
                n.append(len(own))
                s1.append(mix(own, 1).sum(dtype=np.uint64))
                s2.append(mix(own, 2).sum(dtype=np.uint64))
                p.append(mix(head, 3).sum(dtype=np.uint64))
                prefix.append(head.view(np.int64))
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(x) for x in prefix])]).astype(np.int32)), pa.array(np.concatenate(prefix) if prefix else np.zeros(0, np.int64)))
            longs = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (s1, s2, p)]
            yield pa.record_batch([batch.column("doc_id"), pa.array(n, pa.int64()), *longs, lists, pa.array(sketch, pa.binary())], ["doc_id", "n", "s1", "s2", "p", "prefix", "sketch"])

    return scratch.stage(docs.mapInArrow(build, "doc_id long, n long, s1 long, s2 long, p long, prefix array<long>, sketch binary"), "sets")


def _bounded(df: DataFrame) -> DataFrame:
    """Broadcast if it has at most BROADCAST_ROWS rows, as counted."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def plausible(base: DataFrame, pairs: DataFrame, threshold: int, scratch: Scratch, name: str) -> DataFrame:
    """The pairs (a, b) whose sketches leave the threshold within reach; only the sketches of their ids are moved."""
    pairs = scratch.stage(pairs, "met")
    nodes = scratch.stage(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "nodes")
    sketches = base.select("doc_id", "n", "sketch").join(_bounded(nodes), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    both = pairs
    for c in ("a", "b"):
        both = both.join(sketches.select(F.col("doc_id").alias(c), F.col("n").alias(f"n_{c}"), F.col("sketch").alias(f"s_{c}")), c)

    def test(batches):
        for batch in batches:
            na, nb = (batch.column(c).to_numpy() for c in ("n_a", "n_b"))
            row = np.arange(batch.num_rows)
            apart = Sketches(pa.chunked_array([batch.column("s_a"), batch.column("s_b")])).apart(row, row + batch.num_rows)
            # 100 i >= t u with i = (na + nb - d) / 2 and u = (na + nb + d) / 2
            yield batch.select(["a", "b"]).filter(pa.array((100 + threshold) * apart <= (100 - threshold) * (na + nb)))

    found = scratch.stage(both.select("a", "b", "n_a", "n_b", "s_a", "s_b").mapInArrow(test, "a long, b long"), name)
    scratch.drop("met", "nodes")
    return found


def verify(docs: DataFrame, pairs: DataFrame, threshold: int, scratch: Scratch, name: str) -> DataFrame:
    """Those of the pairs (a, b) of doc ids whose whole shingle sets reach the threshold.

    The partners of a travel once each to where a's own text is; more than SALT partners are dealt over several tasks.
    """
    heads = pairs.groupBy("a").agg(F.ceil(F.count("*") / SALT).alias("salts"))
    dealt = pairs.join(heads, "a").select("a", "b", F.pmod(F.xxhash64("b"), "salts").cast("int").alias("salt"))
    need = dealt.union(heads.select("a", F.col("a").alias("b"), F.explode(F.sequence(F.lit(0), F.col("salts").cast("int") - 1)).alias("salt")))
    need = scratch.stage(need, "requests")
    sent = docs.withColumnRenamed("doc_id", "b").join(_bounded(need), "b").select("a", "salt", "b", "text")
    sent = sent.repartition("a", "salt").sortWithinPartitions("a", "salt", (F.col("a") != F.col("b")))

    def compare(batches):
        key, own = None, None
        for batch in blocks(batches):
            hashes, at = batch_shingles(batch.column("text"))
            a, b, salt = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("a", "b", "salt"))
            keep = []
            for x in range(len(a)):
                new = np.unique(hashes[at[x] : at[x + 1]])
                if a[x] == b[x]:
                    key, own = (a[x], salt[x]), new
                elif key == (a[x], salt[x]):
                    common = len(np.intersect1d(own, new, assume_unique=True))
                    if 100 * common >= threshold * (len(own) + len(new) - common) and common:
                        keep.append(x)
            yield pa.record_batch([pa.array(a[keep], pa.int64()), pa.array(b[keep], pa.int64())], ["a", "b"])

    found = scratch.stage(sent.mapInArrow(compare, "a long, b long"), name)
    scratch.drop("requests")
    return found


def _within(base: DataFrame, wide: DataFrame, threshold: int, scratch: Scratch) -> DataFrame:
    """The distinct pairs (a, b) of a bucket's classes in different components that sizes, places and sketches leave in reach.

    A bucket of ``wide`` (tok, gid, rep, n, pos, c) is dealt into chunks of about CHUNK classes by hash, and every two of
    its chunks meet in a block. A class travels once a chunk, not once a partner, and only pairs that its block leaves
    become rows. The comparisons inside the blocks are still as many as the bucket's pairs in different components, so
    their number, and a CHUNK-th of it in rows sent, grows with the square of a bucket that the rounds leave apart.
    """
    chunks = wide.groupBy("tok").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks"))
    nodes = scratch.stage(wide.select(F.col("rep").alias("doc_id")).distinct(), "nodes")
    sketches = base.select("doc_id", "sketch").join(_bounded(nodes), "doc_id", "left_semi").dropDuplicates(["doc_id"]).withColumnRenamed("doc_id", "rep")
    own = F.pmod(F.xxhash64("rep", "tok"), "chunks").cast("int")
    dealt = wide.join(chunks, "tok").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    sent = dealt.select("tok", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "gid", "rep", "n", "pos", "c").join(sketches, "rep")
    block = ["tok", "i", "j"]

    def meet(batches):
        held = None
        for batch in batches:
            held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])]).combine_chunks()
            new = _starts(held, block)
            if new[-1]:
                yield _meet(held.slice(0, new[-1]), block, threshold)
                held = held.slice(new[-1])
        if held is not None:
            yield _meet(held, block, threshold)

    sorted_blocks = sent.select(*block, "own", "gid", "rep", "n", "pos", "c", "sketch").repartition(*block).sortWithinPartitions(*block)
    found = scratch.stage(sorted_blocks.mapInArrow(meet, "a long, b long").distinct(), "within")
    scratch.drop("nodes")
    return found


def _starts(rows: pa.Table, keys: list[str]) -> np.ndarray:
    """Where the blocks of sorted rows begin."""
    key = np.stack([rows.column(c).to_numpy().astype(np.int64) for c in keys])
    return np.concatenate([[0], np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1])


def _meet(rows: pa.Table, keys: list[str], threshold: int) -> pa.RecordBatch:
    """Pairs of whole blocks: every row with the one s places behind it, for each s that a block still has."""
    at = _starts(rows, keys)
    i, j, own, gid, rep, n, pos, c = (rows.column(x).to_numpy() for x in ("i", "j", "own", "gid", "rep", "n", "pos", "c"))
    sketch = Sketches(rows.column("sketch"))
    behind = np.repeat(np.append(at[1:], len(rep)), np.diff(np.append(at, len(rep)))) - np.arange(len(rep)) - 1
    x, s, pairs = np.arange(len(rep)), 0, []
    while True:
        s += 1
        x = x[behind[x] >= s]
        if not len(x):
            break
        # of two chunks only classes of different ones meet; pairs of one group come from its own bucket alone
        a = x[((i[x] == j[x]) | (own[x] != own[x + s])) & (c[x] != c[x + s]) & ((gid[x] == gid[x + s]) == (pos[x] < 0))]
        b = a + s
        a, b = (y[100 * np.minimum(n[a], n[b]) >= threshold * np.maximum(n[a], n[b])] for y in (a, b))
        both = n[a] + n[b]
        early = (100 + threshold) * np.minimum(n[a] - pos[a], n[b] - pos[b]) >= threshold * both
        a, b, both = a[early], b[early], both[early]
        near = (100 + threshold) * sketch.apart(a, b) <= (100 - threshold) * both
        pairs.append(np.stack([rep[a[near]], rep[b[near]]]))
    low_first = np.sort(np.concatenate(pairs, axis=1), axis=0) if pairs else np.zeros((2, 0), np.int64)
    return pa.record_batch([pa.array(y.astype(np.int64)) for y in low_first], ["a", "b"])


def similar_classes(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of (doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    digest = [F.xxhash64(F.coalesce("text", F.lit("")), F.lit(seed)) for seed in (1, 2)]
    apart = docs.where("doc_id is not null").groupBy("doc_id").agg(F.min(digest[0]).alias("low"), F.max(digest[0]).alias("high")).where("low <> high")
    apart = stage(apart.select("doc_id"), "repeated")
    if apart.isEmpty():
        return _classes(docs, threshold)
    # every text of an id that has several becomes a node of its own, with a number far below all ids
    keyed = docs.select("*", *(d.alias(f"d{i}") for i, d in enumerate(digest)))
    nodes = keyed.join(_bounded(apart), "doc_id").select("doc_id", "d0", "d1").distinct()
    nodes = stage(nodes.withColumn("node", F.monotonically_increasing_id() - F.lit(2**63 - 1)), "nodes")
    asked = keyed.join(_bounded(nodes), ["doc_id", "d0", "d1"], "left").select(F.coalesce("node", "doc_id").alias("doc_id"), "text")
    found = _classes(asked, threshold)
    real = nodes.select("node", F.col("doc_id").alias("of"))
    found = found.join(_bounded(real), F.col("doc_id") == F.col("node"), "left").select(F.coalesce("of", "doc_id").alias("doc_id"), "n_shingles", F.col("component_id").alias("c"))
    least = found.groupBy("c").agg(F.min("doc_id").alias("component_id"))
    return found.join(least, "c", "left").select("doc_id", "n_shingles", "component_id")


def _classes(docs: DataFrame, threshold: int) -> DataFrame:
    """``similar_classes`` of rows whose ids have one text each."""
    scratch = Scratch(docs.sparkSession, "jaccard")
    base = _base(docs, threshold, scratch)
    slim = base.drop("prefix", "sketch")
    same = ["n", "p", "s1", "s2"]
    classes = scratch.stage(slim.where("n > 0").groupBy(*same).agg(F.min("doc_id").alias("rep")), "classes")
    groups = classes.groupBy("n", "p").agg(F.min("rep").alias("gid"), F.count("*").alias("size"))
    members = scratch.stage(classes.join(groups, ["n", "p"]).where("rep is not null").select("gid", "rep", "n", "size"), "members")

    def overlap(n1: Column, n2: Column) -> Column:
        """Least shared shingles of linked sets of these sizes."""
        return F.ceil((n1 + n2) * threshold / (100 + threshold) - 1e-9)

    def fits(n1: str, p1: str, n2: str, p2: str) -> Column:
        """Size filter, and whether what the two sets can still share from these places on is enough."""
        n1, p1, n2, p2 = map(F.col, (n1, p1, n2, p2))
        return (100 * F.least(n1, n2) >= threshold * F.greatest(n1, n2)) & (F.least(n1 - p1, n2 - p2) >= overlap(n1, n2))

    heads = base.drop("sketch").join(groups.select("gid"), base.doc_id == F.col("gid"), "left_semi").dropDuplicates(["doc_id"])
    tokens = heads.select(F.col("doc_id").alias("gid"), "n", F.posexplode("prefix").alias("pos", "tok"))
    # the hub of a run's band of alike sizes is the set that has the shingle earliest, so with least that is its own
    band = F.floor(F.log("n") / math.log(100 / threshold) * 2) if threshold < 100 else F.col("n")
    # a bucket is a shingle and a run of sizes: no two sets in different runs are alike enough in size
    by_size = Window.partitionBy("tok").orderBy("n", "gid")
    beside = lambda a, b: F.coalesce(100 * F.col(a) >= threshold * F.col(b), F.lit(False))
    runs = tokens.select("*", F.lag("n").over(by_size).alias("before"), F.lead("n").over(by_size).alias("after"))
    runs = runs.withColumn("run", F.sum(F.when(beside("before", "n"), 0).otherwise(1)).over(by_size)).where(beside("before", "n") | beside("n", "after")).withColumn("band", band)
    in_run, in_band = Window.partitionBy("tok", "run").orderBy("n", "gid"), Window.partitionBy("tok", "run", "band").orderBy("pos", "n", "gid")
    # the smaller set of a linked pair has a shared shingle at least this early
    early = F.col("n") - F.col("pos") >= overlap(F.col("n"), F.col("n"))
    whole = Window.partitionBy("tok", "run")
    some = F.max(early).over(whole)
    # buckets of the same groups, as the shingles of a shared passage make, are one bucket from here on; if two different
    # ones had the same hash, the groups of both would meet
    same_groups = F.xxhash64(F.bit_xor(F.xxhash64("gid")).over(whole), F.count("*").over(whole))
    shared = runs.select(same_groups.alias("bucket"), "gid", "n", "pos", some.alias("some"), *(f(c).over(w).alias(f"{x}_{c}") for x, f, w in (("prev", F.lag, in_run), ("hub", F.first, in_band)) for c in ("gid", "n", "pos"))).where("some")
    shared = scratch.stage(shared.withColumnRenamed("bucket", "tok").drop("some"), "shared")

    near = [shared.where(F.col(f"{x}_gid").isNotNull() & (F.col(f"{x}_gid") != F.col("gid")) & fits(f"{x}_n", f"{x}_pos", "n", "pos")).select(F.col(f"{x}_gid").alias("a"), F.col("gid").alias("b")) for x in ("prev", "hub")]
    inside = members.where("size > 1 and gid <> rep").select(F.col("gid").alias("a"), F.col("rep").alias("b"))
    tried = plausible(base, near[0].union(near[1]).union(inside).distinct(), threshold, scratch, "tried")
    links = verify(docs, tried, threshold, scratch, "links")
    found = components(links)

    # what is left: classes of one bucket in different components; rounds of few pairs merge most of them first
    met = shared.groupBy("tok", "gid", "n").agg(F.min("pos").alias("pos"))
    met = met.join(members.select("gid", "rep"), "gid").select("tok", "gid", "rep", "n", "pos")
    # classes of one group share their whole prefix, whether or not another group has any of it: a bucket of their own
    own = members.where("size > 1").select(F.xxhash64("gid", F.lit("group")).alias("tok"), "gid", "rep", "n", F.lit(-1).alias("pos"))
    slots = scratch.stage(met.union(own), "slots")
    scratch.drop("shared", "members")

    def mixed(found: DataFrame) -> DataFrame:
        wide = slots.join(found, slots.rep == found.node, "left").select("tok", "gid", "rep", "n", "pos", F.coalesce("component", "rep").alias("c"))
        apart = wide.groupBy("tok").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low <> high").select("tok")
        return scratch.stage(wide.join(apart, "tok", "left_semi"), "mixed")

    wide, seed, parts = mixed(found), 0, None
    while True:
        held = wide.groupBy("tok", "c").agg(F.count("*").alias("m")).groupBy("tok").agg(F.sum("m").alias("m"), F.sum(F.col("m") * F.col("m")).alias("own"))
        rows, pairs = held.agg(F.sum("m"), F.sum(F.col("m") * F.col("m") - F.col("own")) / 2).first()
        before, parts = parts, wide.select("c").distinct().count()
        if not rows or pairs <= FEW * rows or (before is not None and GAIN * (before - parts) < before):
            break
        shuffled = Window.partitionBy("tok").orderBy(F.xxhash64("rep", F.lit(seed)), "rep")
        partners = wide.select("rep", "n", "pos", "c", *(F.lag(x).over(shuffled).alias(f"prev_{x}") for x in ("rep", "n", "pos", "c"))).where((F.col("c") != F.col("prev_c")) & fits("prev_n", "prev_pos", "n", "pos"))
        partners = partners.select(F.least("rep", "prev_rep").alias("a"), F.greatest("rep", "prev_rep").alias("b")).distinct()
        more = verify(docs, plausible(base, partners, threshold, scratch, "some"), threshold, scratch, f"links{seed}")
        if more.isEmpty():
            break
        links = links.union(more)
        found = components(links)
        wide, seed = mixed(found), seed + 1
    done = tried.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    rest = scratch.stage(_within(base, wide, threshold, scratch).join(done, ["a", "b"], "left_anti"), "rest")
    if not rest.isEmpty():
        more = verify(docs, rest, threshold, scratch, "last")
        if not more.isEmpty():
            found = components(links.union(more))

    final = classes.join(found, classes.rep == found.node, "left").select(*same, F.coalesce("component", "rep").alias("class_id"))
    joined = slim.join(final, same, "left")
    out = joined.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("class_id")).otherwise(F.col("doc_id")).alias("component_id"))
    out = stage(out, "similar")
    scratch.close()
    return out


def deduplicate(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` but those linked to a smaller doc_id; rows with null doc_id stay, repeated rows too.

    Rows that share a doc_id and not their text stay together if one of them does.
    """
    ids = similar_classes(docs, threshold).where("doc_id is not null").groupBy(F.col("doc_id").alias("gone_id")).agg(F.max(F.col("doc_id") == F.col("component_id")).alias("stays"))
    gone = _bounded(stage(ids.where("not stays").select("gone_id"), "gone"))
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("id"))
    return rows.join(gone, F.col("id") == F.col("gone_id"), "left_anti").select("row.*")
