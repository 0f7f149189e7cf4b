"""Best-fit packing of token sequences by patterns and non-negative least squares.

Texts are tokenised once; what remains is slim (a row per piece of at most CAPACITY tokens). The histogram of piece
lengths (at most CAPACITY numbers, however large the corpus) is all that the driver sees: few-document patterns are
enumerated over it, their repeat counts fitted by non-negative least squares and rounded down to what is there, and
what they leave is packed best fit, largest first, again by repeated patterns. Pieces then find their place by their
rank among the pieces of their length. Ranks are dealt in buckets with offsets, so no length meets in one task.

Null texts are empty: one end token. Repeated rows are packed like any others. An empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from costweave.llm.words import BLOCK, text_buffers
from costweave.session import stage

CAPACITY = 2048
END = b"\0\0\0\0"
CACHED = 300_000  # encoded words that a Python worker keeps, about
_parts: dict[str | None, dict[str, bytes]] = {}  # of each tokenizer file; tasks of one worker share them
RANKED = 200_000  # pieces of one length that one task ranks, about
# printable ASCII and the letters of Latin-1, upper case and lower case
_PLAIN = re.compile("[!-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")
# fixed by the vocabulary's pre-tokenizer, over the characters of _PLAIN in lower case
_PARTS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00df-\u00f6\u00f8-\u00ff]+|[0-9]|[^a-z0-9\u00df-\u00f6\u00f8-\u00ff]+")
_BLANK = re.compile(r"[\t\n\x0b\x0c\r]")


def _tokenizer(path: str | None):
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path or public_tokenizers.path("word_bpe_49k.json"))


def _byte_level() -> dict[int, str]:
    """Code point below 256 -> how a byte-level vocabulary writes its UTF-8 bytes."""
    shown = [b for b in range(256) if chr(b).isprintable() and not chr(b).isspace() and b != 0xAD]
    letter = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(x for x in range(256) if x not in shown)}
    return {c: "".join(letter[b] for b in chr(c).encode()) for c in range(128, 256)}


def encoder(path: str | None = None):
    """text -> its ids as little-endian 32-bit bytes, END included.

    The tokenizer drops white space and never joins across it, so each run of other characters is encoded once and
    remembered. Runs of printable ASCII and plain Latin letters are lower-cased and split as its pre-tokenizer does, and
    the parts go to its BPE model directly; every other run goes through the whole tokenizer.
    """
    tokenizer, shown = _tokenizer(path), _byte_level()
    model = tokenizer.model
    known: dict[str, bytes] = {"": b""}
    parts = _parts.setdefault(path, {})

    def part(x: str) -> bytes:
        ids = array("I", [t.id for t in model.tokenize(x if x.isascii() else x.translate(shown))]).tobytes()
        parts[x] = ids
        return ids

    def encode(texts: list[str]) -> list[bytes]:
        for cache in (known, parts):
            if len(cache) > CACHED:
                cache.clear()
                known[""] = b""
        split = [_BLANK.sub(" ", x).split(" ") for x in texts]
        other = []
        for w in {w for words in split for w in words}.difference(known):
            if _PLAIN.fullmatch(w) and "<|" not in w:
                known[w] = b"".join([parts[x] if x in parts else part(x) for x in _PARTS.findall(w.lower())])
            else:
                other.append(w)
        for w, e in zip(other, tokenizer.encode_batch_fast(other, add_special_tokens=False), strict=True):
            known[w] = array("I", e.ids).tobytes()
        return [b"".join([known[w] for w in words]) + END for words in split]

    return encode


def pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): every document's ids cut into pieces of at most ``capacity``."""

    def cut(batches):
        encode = encoder(path)
        for whole in batches:
            sizes = np.diff(text_buffers(whole.column("text"))[1])
            block = np.cumsum(sizes) // BLOCK  # texts encoded at once
            edges = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(sizes)]
            for at, end in zip(edges[:-1], edges[1:], strict=True):
                batch = whole.slice(at, end - at)
                ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").fill_null("").to_pylist()
                rows = [(d, k, k * capacity, len(b) // 4, zlib.crc32(b)) for d, x in zip(ids, encode(texts), strict=True) for k in range(-(-len(x) // (4 * capacity))) for b in (x[4 * k * capacity : 4 * (k + 1) * capacity],)]
                columns = list(zip(*rows, strict=True)) or [()] * 5
                yield pa.record_batch([pa.array(x, t) for x, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


def patterns(counts: np.ndarray, capacity: int) -> list[tuple[int, ...]]:
    """Patterns of one to four lengths that fill a sequence as well as the lengths present allow."""
    present = np.flatnonzero(counts)
    best = np.zeros(capacity + 1, np.int64)  # largest present length up to each bound
    best[present] = present
    best = np.maximum.accumulate(best)
    grid = np.unique(np.quantile(present, np.linspace(0, 1, 12), method="lower")).tolist()
    found = set()
    for a in present.tolist():
        for inner in [(), *((b,) for b in grid), *((b, c) for b in grid[:6] for c in grid[:6] if b >= c)]:
            room = capacity - a - sum(inner)
            if room >= 0:
                found.add(tuple(sorted((a, *inner, *((int(best[room]),) if best[room] else ())), reverse=True)))
    return sorted(found)


def nnls(use: np.ndarray, counts: np.ndarray, steps: int = 300) -> np.ndarray:
    """min |A x - counts|^2 over x >= 0 by accelerated projected gradients; column j of A counts the lengths in use[j] (0: none)."""
    scale = max(float(counts.max()), 1.0)
    want = counts / scale
    x = y = np.zeros(len(use))
    t = 1.0

    def forward(v):
        out = np.zeros(len(counts))
        for k in range(use.shape[1]):
            out += np.bincount(use[:, k], v, len(counts))
        out[0] = 0
        return out

    v = np.ones(len(use))
    for _ in range(12):  # largest eigenvalue of A'A
        u = forward(v)
        v = u[use].sum(axis=1)
        top = np.linalg.norm(v)
        v /= top
    for _ in range(steps):
        r = forward(y) - want
        r[0] = 0
        new = np.maximum(0, y - r[use].sum(axis=1) / (1.05 * top))
        s = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y, x, t = new + (t - 1) / s * (new - x), new, s
    return x * scale


def plan(counts: np.ndarray, capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """[(repeats, [(length, copies), ...])] that packs exactly ``counts[length]`` pieces of each length."""
    left, out = counts.copy(), []

    def take(lengths, repeats):
        own = sorted(((int(x), lengths.count(x)) for x in set(lengths)), reverse=True)
        for x, c in own:
            left[x] -= c * repeats
        out.append((repeats, own))

    if not left.any():
        return out
    found = patterns(left, capacity)
    use = np.array([p + (0,) * (4 - len(p)) for p in found])
    fit = nnls(use, left.astype(float))
    waste = capacity - use.sum(axis=1)
    for j in np.lexsort((-fit, waste > capacity // 100)).tolist():
        if waste[j] > capacity // 100:
            break
        p = found[j]
        repeats = min([int(fit[j] + 1e-6), *(int(left[x]) // p.count(x) for x in set(p))])
        if repeats > 0:
            take(p, repeats)
    while left.any():
        present = np.flatnonzero(left)
        own, room = [], capacity
        while True:
            k = int(np.searchsorted(present, room, "right")) - 1
            while k >= 0 and left[present[k]] <= own.count(int(present[k])):
                k -= 1
            if k < 0:
                break
            x = int(present[k])
            n = min(room // x, int(left[x]) - own.count(x))
            own += [x] * n
            room -= n * x
        take(own, min(int(left[x]) // own.count(x) for x in set(own)))
    return out


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` with sequence_id and offset."""
    rows = stage(cut, "pieces")
    sizes = rows.groupBy("length").agg(F.count("*").alias("n")).toPandas()
    counts = np.zeros(capacity + 1, np.int64)
    counts[sizes["length"].to_numpy(int)] = sizes["n"].to_numpy(int)
    key, first, offset, copies, sequence = [], [], [], [], []
    used, done = np.zeros(capacity + 1, np.int64), 0
    for repeats, own in plan(counts, capacity):
        at = 0
        for x, c in own:
            for column, value in zip((key, first, offset, copies, sequence), ((x << 44) + int(used[x]), int(used[x]), at, c, done), strict=True):
                column.append(value)
            used[x] += c * repeats
            at += x * c
        done += repeats
    order = np.argsort(np.array(key, np.int64), kind="stable")
    sent = cut.sparkSession.sparkContext.broadcast([np.array(x, np.int64)[order] for x in (key, first, offset, copies, sequence)])

    buckets = int(counts.max(initial=0)) // RANKED + 1
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)))
    by_bucket = rows.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = by_bucket.select("length", "bucket", (F.sum("n").over(Window.partitionBy("length").orderBy("bucket")) - F.col("n")).alias("before"))
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")) - 1)
    ranked = ranked.join(before, ["length", "bucket"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("before")).alias("rank"))

    def place(batches):
        key, first, offset, copies, sequence = sent.value
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            i = np.searchsorted(key, (length << 44) + rank, "right") - 1
            q = rank - first[i]
            yield pa.record_batch([*batch.columns[:5], pa.array(sequence[i] + q // copies[i]), pa.array(offset[i] + q % copies[i] * length)], [*batch.schema.names[:5], "sequence_id", "offset"])

    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
