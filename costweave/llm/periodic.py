"""Periodic runs of words inside texts, found by internal pattern matching.

A run is a stretch of words with smallest period q and at least ``least(q)`` words that can't be extended. For every
m = 2, 4, 8, ... a text is cut into blocks of m words. A run of four periods or more holds a block whose length is
between q and 2q and, on one side of it, another period; so the nearest occurrence of that block in the windows of m
words beside it lies exactly q away. Occurrences of a block inside such a window form one arithmetic progression through
the block itself, so its nearest occurrence is all that is asked for: the successor and the predecessor of the block's
place among the places of its suffix-array interval. A wavelet tree over the suffix array answers that; its levels are
built one after the other and all blocks of a batch descend together, so memory is linear in the batch.
Distances found are candidate periods; they are checked and extended word by word.

Texts are worked on in batches of about BATCH bytes; a longer text is a batch of its own, whole. Texts never meet each
other. Null and blank texts have no words and no runs; a null doc_id is an id like any other; repeated rows give
repeated rows; other columns are not looked at; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from costweave.llm.words import text_buffers, word_hashes, word_spans

SHORTEST, PERIODS = 6, 4  # words and periods in a run, at least
BATCH = 1 << 22  # bytes of text


def suffix_array(ids: np.ndarray, doc: np.ndarray, ends: np.ndarray, at_depth: Callable[[int, np.ndarray, np.ndarray], None]) -> np.ndarray:
    """Suffixes of all texts, text by text in order of their words, by prefix doubling of the groups that are still tied.

    ``ids`` name words, ``doc`` is the text of each and ``ends`` where that text ends. After each doubling
    ``at_depth(words, first, size)`` is given, per suffix, the first place and the size of its group: the interval of
    those that share so many words.
    """
    total = len(ids)
    key = (doc << 32) | ids
    order = np.argsort(key, kind="stable")
    place = np.arange(total)

    def regroup(places: np.ndarray, keys: np.ndarray) -> None:
        new = np.ones(len(places), bool)
        new[1:] = keys[1:] != keys[:-1]
        heads = np.flatnonzero(new)
        sizes = np.diff(np.append(heads, len(places)))
        group[order[places]], size[order[places]] = np.repeat(places[heads], sizes), np.repeat(sizes, sizes)

    group, size = np.empty(total, np.int64), np.empty(total, np.int64)
    regroup(place, key[order])
    depth = 1
    while True:
        open_places = np.flatnonzero(size[order] > 1)
        if not len(open_places):
            return order
        pos = order[open_places]
        after = pos + depth
        inside = after < ends[pos]
        key = group[pos] * (total + 1) + np.where(inside, group[np.minimum(after, total - 1)] + 1, 0)
        by = np.argsort(key, kind="stable")
        order[open_places] = pos[by]
        regroup(open_places, key[by])
        depth *= 2
        at_depth(depth, group, size)


class WaveletTree:
    """Order statistics of ranges of a sequence; levels are made when they are asked for and not kept."""

    def __init__(self, values: np.ndarray):
        self.values, self.bits = values, max(1, int(values.max(initial=0)).bit_length())

    def _levels(self):
        """(bit, ones before each place, number of zeros) from the highest bit down."""
        values = self.values
        for bit in range(self.bits - 1, -1, -1):
            ones = (values >> bit & 1).astype(bool)
            before = np.zeros(len(values) + 1, np.int32 if len(values) < 1 << 31 else np.int64)
            np.cumsum(ones, out=before[1:])
            yield bit, before, len(values) - int(before[-1])
            values = np.concatenate([values[~ones], values[ones]])

    def below(self, first: np.ndarray, last: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """How many values of [first, last) are smaller than ``bound``."""
        lo, hi, count = first.copy(), last.copy(), np.zeros(len(first), np.int64)
        for bit, before, zeros in self._levels():
            lo1, hi1, right = before[lo], before[hi], (bound >> bit & 1).astype(bool)
            count += np.where(right, (hi - lo) - (hi1 - lo1), 0)
            lo, hi = np.where(right, zeros + lo1, lo - lo1), np.where(right, zeros + hi1, hi - hi1)
        return count + np.where(bound >> self.bits > 0, hi - lo, 0)

    def kth(self, first: np.ndarray, last: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The k-th smallest value (from 0) of [first, last)."""
        lo, hi, k, value = first.copy(), last.copy(), k.copy(), np.zeros(len(first), np.int64)
        for bit, before, zeros in self._levels():
            lo1, hi1 = before[lo], before[hi]
            left = (hi - lo) - (hi1 - lo1)
            right = k >= left
            value |= right.astype(np.int64) << bit
            k = np.where(right, k - left, k)
            lo, hi = np.where(right, zeros + lo1, lo - lo1), np.where(right, zeros + hi1, hi - hi1)
        return value

    def beside(self, first: np.ndarray, last: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Range predecessor and successor: the nearest values of [first, last) below and above ``value``, which is there once; -1 if none."""
        rank = self.below(first, last, value)
        has_before, has_after = rank > 0, rank + 1 < last - first
        before, after = np.full(len(value), -1, np.int64), np.full(len(value), -1, np.int64)
        before[has_before] = self.kth(first[has_before], last[has_before], rank[has_before] - 1)
        after[has_after] = self.kth(first[has_after], last[has_after], rank[has_after] + 1)
        return before, after


def candidates(ids: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(at, until, period): stretches of places whose word is the word a candidate period on, joined where they touch.

    ``ids`` are the words of all texts and ``starts`` where each text begins, with the end of the last.
    """
    sizes = np.diff(starts)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    ends, local = np.repeat(starts[1:], sizes), np.arange(len(ids)) - np.repeat(starts[:-1], sizes)
    asked = []

    def blocks(m: int, group: np.ndarray, size: np.ndarray) -> None:
        here = np.flatnonzero((local % m == 0) & (size > 1))
        here = here[here + m <= ends[here]]
        asked.append((np.full(len(here), m), here, group[here], group[here] + size[here]))

    order = suffix_array(ids, doc, ends, blocks)
    if not asked:
        return (np.zeros(0, np.int64),) * 3
    m, here, first, last = (np.concatenate(x) for x in zip(*asked, strict=True))
    before, after = WaveletTree(local[order]).beside(first, last, local[here])
    back, ahead = local[here] - before, after - local[here]
    left, right = (before >= 0) & (back <= m), (after >= 0) & (ahead <= m)
    at = np.concatenate([here[left] - back[left], here[right]])
    until = at + np.concatenate([m[left], m[right]])
    period = np.concatenate([back[left], ahead[right]])
    # stretches of one text and period that touch are one
    by = np.lexsort((until, at, period, doc[at]))
    at, until, period, doc = at[by], until[by], period[by], doc[at[by]]
    series = np.ones(len(at), bool)
    series[1:] = (doc[1:] != doc[:-1]) | (period[1:] != period[:-1])
    shift = np.cumsum(series) * (int(starts[-1]) + 1)  # keeps series apart in the running maximum
    reach = np.maximum.accumulate(until + shift) if len(at) else until
    new = series.copy()
    new[1:] |= at[1:] + shift[1:] > reach[:-1]
    heads = np.flatnonzero(new)
    return at[heads], (reach - shift)[np.append(heads[1:], len(at)) - 1] if len(at) else until, period[heads]


def extend(ids: np.ndarray, at: int, until: int, period: int, start: int, end: int) -> tuple[int, int]:
    """The longest stretch around [at, until) of the text [start, end) whose words equal those ``period`` on, in doubling steps."""
    step = 16
    while until + period < end:
        stop = min(until + step, end - period)
        apart = np.flatnonzero(ids[until:stop] != ids[until + period : stop + period])
        if len(apart):
            until += int(apart[0])
            break
        until, step = stop, step * 2
    step = 16
    while at > start:
        stop = max(at - step, start)
        apart = np.flatnonzero(ids[stop:at] != ids[stop + period : at + period])
        if len(apart):
            at = stop + int(apart[-1]) + 1
            break
        at, step = stop, step * 2
    return at, until


def runs_of(ids: np.ndarray, starts: np.ndarray, shortest: int = SHORTEST, periods: int = PERIODS) -> list[list[tuple[int, int, int]]]:
    """Per text the runs (start, length, period) of at least ``shortest`` words and ``periods`` periods (4 or more), in order."""
    if periods < 4:
        raise ValueError("blocks of a run are certain from four periods on")
    out: list[list[tuple[int, int, int]]] = [[] for _ in range(len(starts) - 1)]
    at, until, period = candidates(ids, starts)
    docs = np.searchsorted(starts, at, "right") - 1
    done = (-1, 0, 0)  # text, period and end of the stretch before, which may have grown over the next one
    for d, a, u, q in zip(docs.tolist(), at.tolist(), until.tolist(), period.tolist(), strict=True):
        if done[:2] == (d, q) and a < done[2]:
            continue
        a, u = extend(ids, a, u, q, int(starts[d]), int(starts[d + 1]))
        done = (d, q, u)
        if u - a + q >= max(shortest, periods * q):
            out[d].append((a - int(starts[d]), u - a + q, q))
    return [sorted(set(x), key=lambda r: (r[0], r[2])) for x in out]


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words without those that a run holds after its first period, joined by one space."""
    if not runs:
        return b" ".join(words)
    edge = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    kept = np.flatnonzero(np.cumsum(edge[:-1]) == 0)
    return b" ".join([words[i] for i in kept.tolist()])


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def periodic_runs(docs: DataFrame, shortest: int = SHORTEST, periods: int = PERIODS) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) of every row of (doc_id, text); words are told apart by 64-bit hashes of whole words, case kept."""

    def find(batches):
        for whole in batches:
            sizes = np.diff(text_buffers(whole.column("text"))[1])
            block = np.cumsum(sizes) // BATCH
            edges = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(sizes)]
            for low, high in zip(edges[:-1], edges[1:], strict=True):
                batch = whole.slice(low, high - low)
                raw, offsets = text_buffers(batch.column("text"))
                first, last = word_spans(raw, offsets)
                starts = np.searchsorted(first, offsets)
                ids = np.unique(word_hashes(raw, first, last, lower=False), return_inverse=True)[1]
                found = runs_of(ids, starts, shortest, periods)
                data = raw.tobytes()
                kept = [collapse(data[a:b].split(), r) for a, b, r in zip(offsets[:-1].tolist(), offsets[1:].tolist(), found, strict=True)]
                flat = np.array([x for r in found for x in r], np.int64).reshape(-1, 3)
                lists = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum([len(r) for r in found])]).astype(np.int32), pa.StructArray.from_arrays([pa.array(flat[:, i]) for i in range(3)], fields=list(_RUN)))
                yield pa.record_batch([batch.column("doc_id"), pa.array(np.diff(starts)), lists, pa.array(kept, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "runs", "collapsed"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(find, "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")


def digests(found: DataFrame) -> DataFrame:
    """Of ``periodic_runs``: number of runs, the longest one (ties: smallest start, then period), and digests of all runs and of the kept words."""
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"], -r["start"], -r["period"])))
    best = found.withColumn("_best", longest)
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")
    length, start, period = F.col("_best.length"), -F.col("_best.col2"), -F.col("_best.col3")
    exponent = F.floor(1000 * length / period)  # exact: below 2**53
    return best.select("doc_id", F.size("runs").cast("long").alias("n_runs"), start.alias("start"), length.alias("length"), period.alias("period"), exponent.alias("exponent_milli"), F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))


_WORDS = r"[^\x20\x09-\x0D]+"


def planted(docs: DataFrame, one_in: int = 10) -> DataFrame:
    """``docs`` with a repeating stretch of words in the texts whose crc32 of doc_id is divisible by ``one_in``, for measuring what is found.

    With h that checksum, g = h div 10 and n words: from word a = g mod n on, words repeat the first
    1 + (n - a) div (3 + g mod 8) of them. Null ids and texts without words stay as they are.
    """
    h = F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary"))
    chosen = F.when(F.pmod(h, F.lit(one_in)) == 0, F.regexp_extract_all("text", F.lit(f"({_WORDS})")))  # a column: looked up, not split again, for each word
    n, g = F.size("_words"), F.floor(h / 10)
    a = F.pmod(g, n)
    p = 1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8))))
    rows = docs.withColumn("_words", chosen).withColumns({"_from": a, "_every": p})
    at = lambda i: F.when(i < F.col("_from"), i).otherwise(F.col("_from") + F.pmod(i - F.col("_from"), "_every"))
    repeated = F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get("_words", at(i).cast("int"))), " ")
    return rows.withColumn("text", F.when(n > 0, repeated).otherwise(F.col("text"))).drop("_words", "_from", "_every")
