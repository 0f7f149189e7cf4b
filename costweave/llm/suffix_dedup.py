"""Suffix-array dedup: removes every byte that a repeated LENGTH-byte string covers, over all documents.

Suffixes are sampled so that no repeat is missed: the anchor of a window of LENGTH bytes is its smallest GRAM-byte hash
(leftmost of equals), which depends on the window's bytes alone, so equal windows meet at equal anchors. A record is an
anchor with the run of windows that share it. Records with the same bytes are one class; a class of two or more is
repeated as a whole and needs no sorting. Classes of one anchor value with different bytes are compared by their
suffixes from the anchor on (and their reversed prefixes), which deep-shallow sorting orders: multikey quicksort by
8-byte words to SHALLOW bytes, then a blind trie for each group whose common prefix is longer. Common prefixes of
neighbours then tell, window place by window place, which windows are equal.

An anchor value with more than GROUP classes is split before it is sorted: windows whose place is in a narrow range
share bytes around the anchor, so the classes are dealt by those bytes, range by range (WIDTHS). Where that range is
one place the bytes are the whole window, and a group is one class of equal windows.

Strings are UTF-8 bytes; null is empty. Matches never cross documents, and repeated rows are copies of each other.
Rows with a null doc_id are documents too. Very long texts are read in chunks. Documents are told apart by 128-bit
hashes. An empty table gives an empty result; other columns are kept as they are, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from costweave.llm.words import mix, text_buffers
from costweave.session import Scratch, stage

LENGTH, GRAM = 400, 100
SPAN = LENGTH - GRAM + 1  # anchors to choose from in a window
CHUNK = 1 << 19  # window starts handled at once
SHALLOW = 32
SMALL = 12  # strings that multikey quicksort leaves to an insertion sort
GROUP = 20_000
#: Widths of the ranges of window places that a group too large is split into, one after the other.
WIDTHS = (40, 5, 1)
PIECE = 500  # rows of a batch of remaining texts
BATCH = 10_000  # records sorted together, whole groups
#: Tables of arrays are broadcast up to so many bytes, as counted.
BROADCAST_BYTES = 64 << 20
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _pow(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    if which not in _powers or len(_powers[which][0]) < n:
        m = max(n, CHUNK + 2 * LENGTH)
        b = _BASES[which]
        _powers[which] = tuple(np.concatenate([[np.uint64(1)], np.full(m - 1, v, np.uint64)]).cumprod(dtype=np.uint64) for v in (b, pow(b, -1, 2**64)))
    a, b = _powers[which]
    return a[:n], b[:n]


def _sums(raw: np.ndarray, which: int) -> np.ndarray:
    """Prefix sums of the polynomial hash."""
    out = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * _pow(which, len(raw))[0], out=out[1:])
    return out


def _hash(sums: np.ndarray, lo, hi, which: int) -> np.ndarray:
    """Hashes of raw[lo:hi]; equal bytes have equal hashes wherever they are."""
    return mix((sums[hi] - sums[lo]) * _pow(which, len(sums))[1][lo], which)


def _least(keys: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours, from running minima of blocks in both directions."""
    n = len(keys) - width + 1
    padded = np.concatenate([keys, np.full(-len(keys) % width, np.uint64(2**64 - 1))]).reshape(-1, width)
    ahead = np.minimum.accumulate(padded, axis=1).ravel()
    back = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def anchors(raw: np.ndarray):
    """(lo, hi, d, h, r1, r2) of a text's records: window starts lo..hi, the anchor d bytes behind lo, the anchor's hash, the hashes of raw[lo : hi + LENGTH]."""
    for c in range(0, max(0, len(raw) - LENGTH + 1), CHUNK):
        part = raw[c : c + CHUNK + LENGTH - 1]
        sums = _sums(part, 0)
        at = np.arange(len(part) - GRAM + 1)
        grams = _hash(sums, at, at + GRAM, 0)
        low = np.uint64((1 << 20) - 1)
        best = (_least((grams & ~low) | at.astype(np.uint64), SPAN) & low).astype(np.int64)
        first = np.concatenate([[0], np.flatnonzero(np.diff(best)) + 1])
        last = np.concatenate([first[1:] - 1, [len(best) - 1]])
        other = _sums(part, 1)
        yield c + first, c + last, best[first] - first, grams[best[first]], _hash(sums, first, last + LENGTH, 0), _hash(other, first, last + LENGTH, 1)


_RECORD = "k long, k2 long, lo long, hi long, d int, h long, r1 long, r2 long"


def _records(docs: DataFrame) -> DataFrame:
    def build(batches):
        for batch in batches:
            raw, offsets = text_buffers(batch.column("text"))
            keys, others = batch.column("k").to_numpy(), batch.column("k2").to_numpy()
            held, size = [], 0
            for i in np.flatnonzero(np.diff(offsets) >= LENGTH):
                for found in anchors(raw[offsets[i] : offsets[i + 1]]):
                    held.append((np.full(len(found[0]), keys[i]), np.full(len(found[0]), others[i]), *found))
                    size += len(found[0])
                    if size > 100_000:
                        yield pack(held)
                        held, size = [], 0
            if held:
                yield pack(held)

    def pack(held):
        k, k2, lo, hi, d, *hashes = map(np.concatenate, zip(*held, strict=True))
        return pa.record_batch([pa.array(x) for x in (k, k2, lo, hi, d.astype(np.int32), *(x.view(np.int64) for x in hashes))], [x.split()[0] for x in _RECORD.split(", ")])

    return docs.select("k", "k2", "text").mapInArrow(build, _RECORD)


class BlindTrie:
    """Orders strings that share a long prefix: inner nodes keep only the depth of a branch and its next bytes."""

    def __init__(self, strings: list[bytes]):
        self.strings, self.root = strings, 0

    def common(self, a: int, b: int) -> int:
        x, y = self.strings[a], self.strings[b]
        n = min(len(x), len(y))
        if x[:n] == y[:n]:
            return n
        lo, hi = 0, n  # longest equal prefix by halving
        while lo + 1 < hi:
            m = (lo + hi) // 2
            lo, hi = (m, hi) if x[lo:m] == y[lo:m] else (lo, m)
        return lo

    def insert(self, i: int) -> None:
        s, node = self.strings[i], self.root
        while isinstance(node, list):  # blindly: bytes between branches are not looked at
            node = node[1].get(s[node[0]] if node[0] < len(s) else -1) or node[2]
            if isinstance(node, tuple):
                break
        leaf = node if isinstance(node, tuple) else (node,)
        shared = self.common(i, leaf[0])
        byte = s[shared] if shared < len(s) else -1
        node, up = self.root, None
        while isinstance(node, list) and node[0] < shared:
            up, node = node, node[1][s[node[0]] if node[0] < len(s) else -1]
        if isinstance(node, list) and node[0] == shared:
            if byte in node[1]:  # equal strings share a leaf
                node[1][byte] = (*node[1][byte], i)
            else:
                node[1][byte] = (i,)
            return
        if isinstance(node, tuple) and shared == len(s) == len(self.strings[node[0]]):
            new = (*node, i)
        else:
            other = self.strings[leaf[0]]
            new = [shared, {(other[shared] if shared < len(other) else -1): node, byte: (i,)}, leaf]
        if up is None:
            self.root = new
        else:
            up[1][s[up[0]] if up[0] < len(s) else -1] = new

    def order(self) -> tuple[list[int], list[int]]:
        """Strings in order, and each one's common prefix with the one before."""
        self.root = (0,)
        for i in range(1, len(self.strings)):
            self.insert(i)
        out, lcp, todo = [], [], [(self.root, -1)]
        while todo:
            node, shared = todo.pop()
            if isinstance(node, tuple):
                for j, i in enumerate(node):
                    out.append(i)
                    lcp.append(shared if j == 0 else len(self.strings[i]))
            else:
                below = sorted(node[1])
                todo += [(node[1][b], node[0] if j else shared) for j, b in reversed(list(enumerate(below)))]
        return out, lcp


def multikey_quicksort(keys: np.ndarray) -> np.ndarray:
    """Order of the rows of ``keys``, word by word: a pivot of the current word parts them in three, and only those
    equal to it go on to the next word."""
    out, todo = [], [(np.arange(len(keys)), 0)]
    while todo:
        rows, word = todo.pop()
        if word == keys.shape[1] or len(rows) < 2:
            out.append(rows)
        elif len(rows) <= SMALL:
            out.append(np.array(sorted(rows.tolist(), key=lambda i: (*keys[i, word:].tolist(), i))))
        else:
            own = keys[rows, word]
            pivot = np.sort(own[[0, len(own) // 2, -1]])[1]
            less, more = own < pivot, own > pivot
            todo += [(rows[more], word), (rows[~less & ~more], word + 1), (rows[less], word)]
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def deep_shallow(group: np.ndarray, strings: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Order by (group, string), and each one's common prefix with the one before (-1 where a group begins)."""
    n = len(strings)
    words = np.frombuffer(b"".join(s[:SHALLOW].ljust(SHALLOW, b"\0") for s in strings), ">u8").reshape(n, -1).astype(np.uint64)
    length = np.minimum(np.array([len(s) for s in strings]), SHALLOW)
    order = multikey_quicksort(np.column_stack([group.astype(np.uint64), words, length.astype(np.uint64)]))
    lcp = np.full(n, -1)
    a, b = order[1:], order[:-1]
    same = group[a] == group[b]
    apart = words[a] ^ words[b]
    first = np.where((apart != 0).any(axis=1), (apart != 0).argmax(axis=1), words.shape[1])
    word = apart[np.arange(n - 1), np.minimum(first, words.shape[1] - 1)]
    shared = np.minimum(8 * first + np.where(word > 0, (64 - np.frexp(word.astype(float))[1]).clip(0) // 8, 0), np.minimum(length[a], length[b]))
    lcp[1:] = np.where(same, shared, -1)
    deep = np.concatenate([[False], (lcp[1:] >= SHALLOW) & same])
    start = np.flatnonzero(deep & ~np.concatenate([[False], deep[:-1]])) - 1
    for i in start.tolist():
        j = i + 1
        while j < n and deep[j]:
            j += 1
        own = order[i:j]
        sub, common = BlindTrie([strings[x] for x in own]).order()
        order[i:j] = own[sub]
        lcp[i + 1 : j] = common[1:]
    return order, lcp


def repeated_windows(group: np.ndarray, regions: list[bytes], d: np.ndarray, places: np.ndarray) -> np.ndarray:
    """(region, place) of windows that another region of the group has too: covered[i, s] for the window at s of region i.

    ``places``: the first and last number of bytes from a window's start to its anchor that a region's group is about.
    """
    n = len(regions)
    runs = np.array([len(r) - LENGTH for r in regions])
    covered = np.zeros((n, int(runs.max()) + 1), bool)
    classes = []
    for strings in ([r[x:] for r, x in zip(regions, d.tolist(), strict=True)], [r[:x][::-1] for r, x in zip(regions, d.tolist(), strict=True)]):
        order, lcp = deep_shallow(group, strings)
        classes.append((order, lcp))
    left, right = np.empty(n, np.int64), np.empty(n, np.int64)
    for ahead in range(max(0, int((d - runs).min())), int(d.max()) + 1):  # bytes from a window's start to its anchor
        inside = np.flatnonzero((d - runs <= ahead) & (ahead <= d) & (places[:, 0] <= ahead) & (ahead <= places[:, 1]))
        if len(inside) < 2:
            continue
        for (order, lcp), least, out in ((classes[0], LENGTH - ahead, right), (classes[1], ahead, left)):
            out[order] = np.cumsum((lcp < least) | (lcp < 0))
        key = (right * (n + 1) + left)[inside]
        # the reversed prefixes' classes may join groups when nothing is asked of them
        _, back, count = np.unique(key, return_inverse=True, return_counts=True)
        twice = inside[count[back] > 1]
        covered[twice, d[twice] - ahead] = True
    return covered


def _runs(flags: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


_SPANS = "k long, k2 long, a long, b long"


def _spans(rows: list[tuple[int, int, int, int]]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else ((), (), (), ())
    return pa.record_batch([pa.array(x, pa.int64()) for x in columns], ["k", "k2", "a", "b"])


def _resolve(batches):
    """Spans of the single records whose windows other classes of their group share; rows come sorted by g."""

    def solve(rows):
        g, first, last, k, k2, lo, d, single, regions = (list(x) for x in zip(*rows, strict=True))
        group = np.unique(np.array(g), return_inverse=True)[1]
        covered = repeated_windows(group, regions, np.array(d), np.array([first, last]).T)
        return _spans([(k[i], k2[i], lo[i] + x, lo[i] + y - 1 + LENGTH) for i in np.flatnonzero(np.array(single) & covered.any(axis=1)).tolist() for x, y in _runs(covered[i])])

    held: list[tuple] = []
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("g", "first", "last", "k", "k2", "lo", "d", "single", "region")), strict=True):
            if len(held) >= BATCH and row[0] != held[-1][0]:
                yield solve(held)
                held = []
            held.append(row)
    if held:
        yield solve(held)


_GROUPED = "g long, g2 long, first int, last int, k long, k2 long, lo long, d int, single boolean, region binary"


def _split(width: int):
    """Deal regions into groups by the bytes that all their windows of a range of places share."""

    def deal(batches):
        for batch in batches:
            out = []
            for row in zip(*(batch.column(c).to_pylist() for c in ("first", "last", "k", "k2", "lo", "d", "single", "region")), strict=True):
                first, last, k, k2, lo, d, single, region = row
                raw = np.frombuffer(region, np.uint8)
                sums = _sums(raw, 0), _sums(raw, 1)
                for x in range(first, last + 1, width):
                    y = min(x + width - 1, last)
                    if max(x, d - (len(raw) - LENGTH)) > min(y, d):
                        continue  # the region has no window with its anchor at such a place
                    # windows of these places all have x bytes before the anchor, and LENGTH - y from it on
                    g, g2 = (int(_hash(sums[i], np.array([d - x]), np.array([d + LENGTH - y]), i).view(np.int64)[0]) for i in (0, 1))
                    out.append((g ^ x, g2, x, y, k, k2, lo, d, single, region))
                if len(out) >= 10_000:
                    yield _grouped(out)
                    out = []
            yield _grouped(out)

    return deal


def _grouped(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.binary())
    columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
    return pa.record_batch([pa.array(x, t) for x, t in zip(columns, kinds, strict=True)], [x.split()[0] for x in _GROUPED.split(", ")])


def _bounded(df: DataFrame, array: str, width: int) -> DataFrame:
    """Broadcast a written table if its rows, with arrays of elements of ``width`` bytes, take at most BROADCAST_BYTES."""
    rows, elements = df.agg(F.count("*"), F.coalesce(F.sum(F.size(array)), F.lit(0))).first()
    return F.broadcast(df) if 48 * rows + width * elements <= BROADCAST_BYTES else df


def repeated_spans(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """(k, k2, spans): the covered byte ranges [a, b) of each document (k, k2) of (k, k2, text), if any; sorted and apart."""
    records = scratch.stage(_records(docs), "anchors")
    same = ["h", "r1", "r2", "d"]
    classes = records.groupBy(*same).agg(F.count("*").alias("n"), F.min(F.struct("k", "k2", "lo", "hi")).alias("rep"))
    classes = scratch.stage(classes.where("n > 1").union(classes.where("n = 1").join(records.groupBy("h").agg(F.count("*").alias("c")).where("c > 1").select("h"), "h", "left_semi").select(*classes.columns)), "classes")
    whole = records.join(classes.where("n > 1").select(*same), same, "left_semi").select("k", "k2", F.col("lo").alias("a"), (F.col("hi") + LENGTH).alias("b"))

    mixed = classes.groupBy("h").agg(F.count("*").alias("classes"), F.min("n").alias("least")).where("classes > 1 and least = 1").select("h")
    asked = classes.join(mixed, "h").select("rep.*", "h", "d", (F.col("n") == 1).alias("single"))
    asked = scratch.stage(asked.groupBy("k", "k2").agg(F.collect_list(F.struct("lo", "hi", "h", "d", "single")).alias("asked")), "asked")

    def fetch(batches):
        for batch in batches:
            texts = batch.column("text")
            for i, (k, k2, asked) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("k", "k2", "asked")), strict=True)):
                raw = texts[i].as_py().encode()
                for j in range(0, len(asked), 10_000):
                    yield _grouped([(x["h"], 0, 0, SPAN - 1, k, k2, x["lo"], x["d"], x["single"], raw[x["lo"] : x["hi"] + LENGTH]) for x in asked[j : j + 10_000]])

    once = docs.join(_bounded(asked, "asked", 64), ["k", "k2"]).select("k", "k2", "text", "asked").dropDuplicates(["k", "k2"])
    todo, spans = scratch.stage(once.mapInArrow(fetch, _GROUPED), "regions"), whole
    for level, width in enumerate(WIDTHS):
        hot = todo.groupBy("g", "g2").agg(F.count("*").alias("n")).where(F.col("n") > GROUP).select("g", "g2")
        hot = F.broadcast(scratch.stage(hot, f"hot{level}"))  # fewer than one row in GROUP of the regions
        ready = todo.join(hot, ["g", "g2"], "left_anti")
        spans = spans.union(ready.repartition("g", "g2").sortWithinPartitions("g", "g2", "k", "k2", "lo").mapInArrow(_resolve, _SPANS))
        if hot.isEmpty():
            break
        todo = scratch.stage(todo.join(hot, ["g", "g2"]).select(*(x.split()[0] for x in _GROUPED.split(", "))).mapInArrow(_split(width), _GROUPED), f"split{level}")
    else:  # groups of one window each
        twice = todo.groupBy("g", "g2", "first").agg(F.count("*").alias("n")).where("n > 1").drop("n")
        at = F.col("lo") + F.col("d") - F.col("first")
        spans = spans.union(todo.where("single").join(twice, ["g", "g2", "first"], "left_semi").select("k", "k2", at.alias("a"), (at + LENGTH).alias("b")))

    # overlapping and touching ranges become one
    key = Window.partitionBy("k", "k2").orderBy("a", "b")
    apart = F.coalesce(F.max("b").over(key.rowsBetween(Window.unboundedPreceding, -1)) < F.col("a"), F.lit(True))
    pieces = spans.withColumn("new", apart).withColumn("piece", F.sum(F.col("new").cast("int")).over(key.rowsBetween(Window.unboundedPreceding, 0)))
    merged = pieces.groupBy("k", "k2", "piece").agg(F.min("a").alias("a"), F.max("b").alias("b"))
    return merged.groupBy("k", "k2").agg(F.array_sort(F.collect_list(F.struct("a", "b"))).alias("spans"))


def remove_repeats(docs: DataFrame) -> DataFrame:
    """Every row: ``row`` (a struct of its columns but the text), ``text`` (what is left; characters that a removal cuts
    through are dropped), ``spans`` (the removed byte ranges [a, b)), and ``n_bytes``, ``n_removed`` and ``kept_sha256``
    of the text before, of what went, and of the exact bytes left."""
    scratch = Scratch(docs.sparkSession, "repeats")
    others = F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text"))
    rows = docs.select(others.alias("row"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumns({"k": F.xxhash64("row.doc_id", "text"), "k2": F.xxhash64("text", "row.doc_id", F.lit(9))})
    spans = stage(repeated_spans(rows.select("k", "k2", "text"), scratch), "spans")
    scratch.close()

    def cut(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, PIECE):
                yield piece(batch.slice(at, PIECE))

    def piece(batch):
        n, removed, sha, left = [], [], [], []
        for text, spans in zip(batch.column("text"), batch.column("spans").to_pylist(), strict=True):
            raw, at, parts = memoryview(text.as_buffer() or b""), 0, []
            for x in spans or ():
                parts.append(raw[at : x["a"]])
                at = x["b"]
            kept = b"".join([*parts, raw[at:]])
            n.append(len(raw))
            removed.append(len(raw) - len(kept))
            sha.append(hashlib.sha256(kept).hexdigest())
            left.append(kept.decode("utf-8", "ignore"))
        return pa.record_batch([batch.column("row"), pa.array(left, pa.string()), batch.column("spans"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(sha, pa.string())], ["row", "text", "spans", "n_bytes", "n_removed", "kept_sha256"])

    joined = rows.join(_bounded(spans, "spans", 32), ["k", "k2"], "left").select("row", "text", "spans")
    schema = StructType([*joined.schema, StructField("n_bytes", LongType()), StructField("n_removed", LongType()), StructField("kept_sha256", StringType())])
    return joined.mapInArrow(cut, schema)


def digests(removed: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, repeated, kept_text) of the rows of ``remove_repeats``."""
    n_spans = F.coalesce(F.size("spans"), F.lit(0)).cast("long")
    return removed.select(F.col("row.doc_id").cast("long").alias("doc_id"), "n_bytes", "n_removed", F.greatest(n_spans, F.lit(0)).alias("n_spans"), "kept_sha256", (F.col("n_removed") > 0).alias("repeated"), F.col("text").alias("kept_text"))
