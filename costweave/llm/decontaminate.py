"""Benchmark decontamination by SimHash over item-sized windows.

Each item has a SimHash of BITS bits of its weighted 5-word shingles (weight: how often the shingle occurs in it). A
text's windows of an item's size get one too, from running sums of bits. Fingerprints are cut into BLOCKS blocks: two
that differ in at most RADIUS bits differ in at most NEAR of some block. Every block's index holds the items' values
and all that differ from them in one bit, and is asked for all values that differ from a window's in NEAR - 1 bits at
most, so none within the radius is missed, while few others are met. Candidates are then verified exactly: sum of
minimum weights over sum of maximum weights, 80 % or more.

RADIUS is where SimHash itself decides: a window with similarity of 0.8 differs in 15 % of the bits on average, and
RADIUS is about two standard deviations more (tests/llm measures the recall of edited items, 0.9 at least, and the rate
of random pairs that become candidates).

A window that shares too few shingles with the items to reach the threshold is not fingerprinted (it could not be
verified). Items are indexed in blocks of at most ITEMS, each broadcast and run over all documents. Windows are
fingerprinted in pieces of PIECE, so memory follows the item's length, not the text's.

Items and texts without words match nothing; an item of fewer than five words matches its exact word sequence. Of
windows that are equally similar to an item the first is given. Null texts are empty. Repeated items or documents give
repeated rows; columns but the id and the text are not looked at, whatever their names. Empty tables give empty results.
"""

from __future__ import annotations

from collections import defaultdict
from fractions import Fraction
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from costweave.llm.words import K, batch_words, mix, shingle_hashes

THRESHOLD = 80  # percent
BITS = 256
RADIUS, BLOCKS = 51, 13
NEAR = RADIUS // BLOCKS  # bits in which one of the blocks differs at most
PIECE = 4096
ITEMS = 20_000
_TABLE_BITS = 22
MATCH = "item_id long, start_word long, n_words long, similarity double"
_WIDTHS = [len(x) for x in np.array_split(np.arange(BITS), BLOCKS)]


def _within(width: int, near: int) -> np.ndarray:
    """All words of ``width`` bits with at most ``near`` bits set."""
    out = [sum(1 << i for i in bits) for k in range(near + 1) for bits in combinations(range(width), k)]
    return np.array(out, np.int64)


def _bits(hashes: np.ndarray) -> np.ndarray:
    """(n, BITS) of +1 and -1, from as many 64-bit hashes of each shingle as that takes."""
    words = np.column_stack([mix(hashes, 40 + i) for i in range(BITS // 64)]) if len(hashes) else np.zeros((0, BITS // 64), np.uint64)
    return (np.unpackbits(words.view(np.uint8), axis=1).astype(np.int32) << 1) - 1


def _pack(sums: np.ndarray) -> np.ndarray:
    """(n, BITS / 64) words of the signs."""
    return np.packbits(sums > 0, axis=1).view(np.uint64) if len(sums) else np.zeros((0, BITS // 64), np.uint64)


def _values(prints: np.ndarray) -> list[np.ndarray]:
    """Each block's value of every fingerprint."""
    bits, out, at = np.unpackbits(prints.view(np.uint8), axis=1), [], 0
    for width in _WIDTHS:
        out.append(bits[:, at : at + width].astype(np.int64) @ (1 << np.arange(width)))
        at += width
    return out


class Index:
    """The items of one block: shingle weights, fingerprints and their Hamming blocks, by width and size."""

    def __init__(self, ids: list, texts: list[str]):
        words, at = batch_words(pa.array(texts, pa.string()))
        self.ids, self.size, self.weight = [], [], []
        prints = []
        posting = defaultdict(set)
        for i, x in enumerate(ids):
            own = words[at[i] : at[i + 1]]
            if not len(own):
                continue
            sh = shingle_hashes(own)
            self.ids.append(x)
            self.size.append(len(own))
            self.weight.append(dict(zip(*(y.tolist() for y in np.unique(sh, return_counts=True)), strict=True)))
            prints.append(_pack(sum(_bits(sh[j : j + PIECE]).sum(axis=0, keepdims=True) for j in range(0, len(sh), PIECE)))[0])
            for h in self.weight[-1]:
                posting[min(K, len(own)), h].add(len(own))
        self.prints = np.array(prints, np.uint64).reshape(-1, BITS // 64)
        self.by_size = {n: np.flatnonzero(np.array(self.size) == n) for n in set(self.size)}
        self.widths = {}
        for width in {k for k, _ in posting}:
            keys = np.array(sorted(h for k, h in posting if k == width), np.uint64)
            table = np.zeros(1 << _TABLE_BITS, bool)
            table[keys & np.uint64((1 << _TABLE_BITS) - 1)] = True
            self.widths[width] = keys, table, [np.array(sorted(posting[width, h])) for h in keys.tolist()]
        #: by size, for each block: the values of the items and their neighbours in one bit, sorted, and whose they are
        self.blocks = {}
        for n, items in self.by_size.items():
            self.blocks[n] = []
            for width, value in zip(_WIDTHS, _values(self.prints[items]), strict=True):
                around = (value[:, None] ^ _within(width, 1)).ravel()
                order = np.argsort(around, kind="stable")
                self.blocks[n].append((around[order], np.repeat(items, width + 1)[order]))

    def candidates(self, prints: np.ndarray, n: int) -> tuple[np.ndarray, int]:
        """(window, item) pairs within RADIUS, and how many pairs the blocks gave."""
        found = [np.zeros(0, np.int64)]
        for (value, items), width, own in zip(self.blocks[n], _WIDTHS, _values(prints), strict=True):
            asked = (own[:, None] ^ _within(width, NEAR - 1)).ravel()
            lo, hi = np.searchsorted(value, asked, "left"), np.searchsorted(value, asked, "right")
            w = np.repeat(np.repeat(np.arange(len(own)), len(asked) // max(1, len(own))), hi - lo)
            found.append(w * len(self.ids) + items[np.arange(len(w)) + np.repeat(lo - np.cumsum(hi - lo) + (hi - lo), hi - lo)])
        pair = np.unique(np.concatenate(found))
        pair = np.stack([pair // max(1, len(self.ids)), pair % max(1, len(self.ids))], axis=1)
        near = np.bitwise_count(prints[pair[:, 0]] ^ self.prints[pair[:, 1]]).sum(axis=1, dtype=np.int64) <= RADIUS
        return pair[near], len(pair)

    def matches(self, words: np.ndarray, hit: np.ndarray, width: int) -> dict:
        """item -> (similarity, start, words) of the best window; hit: where a shingle is one of an item's."""
        keys, _, sizes = self.widths[width]
        sh = shingle_hashes(words, width)
        place = np.searchsorted(keys, sh[hit])
        counts = np.zeros(len(sh) + 1, np.int64)
        counts[hit + 1] = 1
        counts = counts.cumsum()
        best: dict = {}
        for n in np.unique(np.concatenate([sizes[p] for p in np.unique(place)])).tolist():
            if min(K, n) != width:
                continue
            m = n - width + 1
            own = min(m, len(sh))  # shingles in a window
            least = -(-THRESHOLD * (m + own) // (100 + THRESHOLD))
            starts = np.flatnonzero(counts[own:] - counts[: len(counts) - own] >= least)
            if not len(starts):
                continue
            i = 0
            while i < len(starts):
                j = int(np.searchsorted(starts, starts[i] + PIECE))
                first, at = int(starts[i]), starts[i:j] - starts[i]
                sums = np.concatenate([np.zeros((1, BITS), np.int32), _bits(sh[first : int(starts[j - 1]) + own]).cumsum(axis=0, dtype=np.int32)])
                last = None
                for w, item in self.candidates(_pack(sums[at + own] - sums[at]), n)[0].tolist():
                    if w != last:
                        have, last = dict(zip(*(y.tolist() for y in np.unique(sh[first + at[w] : first + at[w] + own], return_counts=True)), strict=True)), w
                    want = self.weight[item]
                    low = sum(min(c, want.get(h, 0)) for h, c in have.items())
                    high = m + own - low
                    if 100 * low >= THRESHOLD * high and (item not in best or best[item][0] < Fraction(low, high)):
                        best[item] = Fraction(low, high), int(first + at[w]), min(n, len(words))
                i = j
        return best

    def search(self, column) -> list[tuple]:
        """(row, item_id, start_word, n_words, similarity) over all texts of the column."""
        words, at = batch_words(column)
        out = []
        for width, (keys, table, _) in self.widths.items():
            if len(words) < width:
                continue
            sh = shingle_hashes(words, width)
            near = np.flatnonzero(table[sh & np.uint64((1 << _TABLE_BITS) - 1)])
            where = np.minimum(np.searchsorted(keys, sh[near]), len(keys) - 1)
            near = near[keys[where] == sh[near]]
            row = np.searchsorted(at, near, "right") - 1
            inside = near + width <= at[row + 1]
            near, row = near[inside], row[inside]
            for r in np.unique(row).tolist():
                hit = near[row == r] if len(near) < 64 else near[np.searchsorted(row, r) : np.searchsorted(row, r, "right")]
                for item, (sim, start, n) in self.matches(words[at[r] : at[r + 1]], hit - at[r], width).items():
                    out.append((r, self.ids[item], start, n, float(sim)))
        return sorted(out, key=lambda x: (x[0], x[2], x[1]))


def _indexes(benchmark: DataFrame):
    """An Index of every block of items; the number of blocks follows the number of items."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    parts = -(-items.count() // (ITEMS // 2)) or 1
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(parts))
    for p in range(parts):
        rows = items.where(block == p).orderBy("item_id", "text").toPandas()
        yield items.sparkSession.sparkContext.broadcast(Index(rows["item_id"].astype(object).where(rows["item_id"].notna(), None).tolist(), rows["text"].tolist()))


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, start_word, n_words, similarity): the best window of every document for each item that it leaks."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = None
    for index in _indexes(benchmark):

        def find(batches, index=index):
            for batch in batches:
                rows = index.value.search(batch.column("text"))
                row, *rest = zip(*rows, strict=True) if rows else ((), (), (), (), ())
                yield pa.record_batch([batch.column("doc_id").take(pa.array(row, pa.int64())), *(pa.array(x, t) for x, t in zip(rest, (pa.int64(), pa.int64(), pa.int64(), pa.float64()), strict=True))], ["doc_id", "item_id", "start_word", "n_words", "similarity"])

        found = docs.mapInArrow(find, f"doc_id long, {MATCH}")
        out = found if out is None else out.union(found)
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that leak no item, unchanged."""
    for index in _indexes(benchmark):

        def keep(batches, index=index):
            for batch in batches:
                clean = np.ones(batch.num_rows, bool)
                clean[[x[0] for x in index.value.search(batch.column("text"))]] = False
                yield batch.filter(pa.array(clean))

        docs = docs.mapInArrow(keep, docs.schema)
    return docs
