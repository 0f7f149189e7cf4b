"""Keywords that texts nearly contain: runs of words against a table of keywords, by deletion neighbourhoods."""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from costweave.functions.similarity import common_subsequences
from costweave.functions.text import fold
from costweave.session import spread, stage

THRESHOLD = 85  # fixed value: least InDel ratio in percent
#: Pairs that differ by up to WHOLE letters meet on shared subsequences of the whole, others on those of a piece.
WHOLE = 3
#: A bitmap of 2^BITS places over the keywords' neighbourhoods drops most of a text's before they are shuffled.
BITS, CELLS = 22, 1 << 20


def _partners(length: int, threshold: int) -> range:
    """Lengths that a partner can have."""
    return range(-(-length * threshold // (200 - threshold)), length * (200 - threshold) // threshold + 1)


def _ways(n: int, m: int, threshold: int):
    """(mode, c, places in the run, places in the keyword) such that a pair of these lengths that reaches the threshold
    shares a subsequence of c letters in one of the ways. Places are (first from, first to, span, end).

    A pair may lose d = (100 - threshold) % of both lengths. Cut the keyword into d // 3 + 1 pieces: one of them loses at
    most e = d // pieces (2 or fewer) against its part of the run, which begins at most d letters off.
    """
    d = (100 - threshold) * (n + m) // 100
    if d < abs(n - m):
        return
    if d <= WHOLE:
        c = (n + m - d + 1) // 2
        if c <= min(n, m):
            yield 0, c, (0, n - c, n, n), (0, m - c, m, m)
        return
    pieces = d // 3 + 1
    e, cuts = d // pieces, [k * m // pieces for k in range(pieces + 1)]
    for s, t in zip(cuts, cuts[1:], strict=False):
        y = t - s
        for x in range(max(1, y - e), min(n, y + e) + 1):
            c = max(1, (x + y - e + 1) // 2)
            if c <= min(x, y):
                low, high = (0, x - c) if s == 0 else (s - d, s + d + x - c)
                yield 1, c, (max(0, low), min(n - c, high), x, n), (s, t - c, y, t)


@lru_cache(maxsize=4096)
def _subsequences(length: int, partners: tuple[int, ...], keyword: bool, threshold: int) -> list[tuple[int, np.ndarray]]:
    """(mode, places of letters) of the subsequences that a run or keyword of this length offers its partners."""
    wanted: dict[tuple[int, int], set] = {}
    for p in partners:
        for mode, c, run, key in _ways(*((p, length) if keyword else (length, p)), threshold):
            wanted.setdefault((mode, c), set()).add(key if keyword else run)
    out = []
    for (mode, c), specs in wanted.items():
        places = {(u, *rest) for low, high, span, end in specs for u in range(low, high + 1) for rest in combinations(range(u + 1, min(u + span, end)), c - 1)}
        if places:
            out.append((mode, np.array(sorted(places), np.int64)))
    return out


def _signatures(texts: list[str], partners: dict[int, tuple[int, ...]], keyword: bool, threshold: int, bitmap: np.ndarray | None = None):
    """Pairs of arrays (place of the text, signature): hashes of the texts' subsequences; equal ones are the same hash."""
    shapes: dict[tuple[int, int], list[int]] = {}
    for i, x in enumerate(texts):
        shapes.setdefault((x.count(" ") + 1, len(x)), []).append(i)
    for (words, length), own in shapes.items():
        for mode, places in _subsequences(length, partners.get(words, ()), keyword, threshold):
            step = max(1, CELLS // len(places))
            for start in range(0, len(own), step):
                some = own[start : start + step]
                letters = np.frombuffer("".join(texts[i] for i in some).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(some), length).astype(np.uint64)
                h = np.full((len(some), len(places)), (2 * words + mode) << 32, np.uint64)
                for column in places.T:
                    h = (h + letters[:, column] + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
                    h ^= h >> np.uint64(31)
                rows = np.repeat(np.array(some, np.int64), len(places))
                h = h.ravel()
                if bitmap is not None:
                    at = (h >> np.uint64(64 - BITS)).astype(np.int64)
                    kept = (bitmap[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
                    rows, h = rows[kept], h[kept]
                yield rows, h.view(np.int64)


def normal(column: str) -> F.Column:
    """Folded, trimmed, white space as one blank."""
    return F.trim(F.regexp_replace(fold(column), r"(?U)\s+", " "))


def find(texts: DataFrame, keywords: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """(id, keyword, n_windows, score): how many runs of words of a text come near a keyword, and the best of them.

    ``texts`` is (id, text), ``keywords`` (keyword); both are folded. A run has as many words as the keyword; it is near
    where 2 x common subsequence / (both lengths) reaches ``threshold`` percent (70 or more); ``score`` is in percent.
    Equal texts count once: distinct runs of letters and keywords meet on subsequences that a pair of their lengths must
    share, whatever the pair, and are verified. No pair is lost and no run meets all keywords. Null ids, null or empty
    texts and keywords take no part, rows that share an id add up.
    """
    if not 70 <= threshold <= 100:
        raise ValueError("threshold must be 70 to 100")
    keys = stage(keywords.select(normal("keyword").alias("keyword")).where("keyword <> ''").distinct(), "keywords")
    # one row for every number of words and length that keywords have
    lengths: dict[int, set[int]] = {}
    for r in keys.select(F.size(F.split("keyword", " ")).alias("words"), F.length("keyword").alias("length")).distinct().collect():
        lengths.setdefault(r.words, set()).add(r.length)
    offered = {w: tuple(sorted(own)) for w, own in lengths.items()}
    asked = {w: tuple(sorted({n for m in own for n in _partners(m, threshold)})) for w, own in lengths.items()}

    words = spread(texts.where("id is not null").select("id", "text")).select("id", F.split(normal("text"), " ").alias("w"))
    none = F.array().cast("array<string>")
    runs = lambda n: F.when(F.size("w") >= n, F.transform(F.sequence(F.lit(0), F.size("w") - n), lambda i: F.concat_ws(" ", *(F.get("w", i + j) for j in range(n))))).otherwise(none)
    fitting = lambda low, high: lambda x: F.length(x).between(low, high)
    each = [F.filter(runs(n), fitting(own[0], own[-1])) for n, own in asked.items()]
    # an outer generator: for a plain one Spark makes all runs a second time, before texts are spread, to filter
    exploded = words.select("id", F.explode_outer(F.concat(*each) if each else none).alias("run")).where("run is not null")
    found = stage(exploded.groupBy("id", "run").agg(F.count("*").alias("n")), "runs")

    def of_keywords(frames):
        for f in frames:
            names = f["keyword"].to_numpy()
            for rows, sig in _signatures(f["keyword"].tolist(), asked, True, threshold):
                yield pd.DataFrame({"keyword": names[rows], "sig": sig})

    own = stage(keys.mapInPandas(of_keywords, "keyword string, sig long").distinct(), "neighbourhoods")
    bitmap = np.zeros(1 << BITS, bool)
    # at most 2^BITS numbers, however many keywords there are
    bitmap[own.select(F.shiftrightunsigned("sig", 64 - BITS).cast("int").alias("at")).distinct().toPandas()["at"].to_numpy(np.int64)] = True
    bitmap = np.packbits(bitmap, bitorder="little")

    def of_runs(frames):
        for f in frames:
            names = f["run"].to_numpy()
            kept = [x for x in _signatures(f["run"].tolist(), offered, False, threshold, bitmap) if len(x[0])]
            if kept:
                rows, sig = (np.concatenate(x) for x in zip(*kept, strict=True))
                yield pd.DataFrame({"run": names[rows], "sig": sig})

    @F.pandas_udf("double")
    def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        x, y = a.tolist(), b.tolist()
        return pd.Series(200.0 * common_subsequences(x, y) / np.array([len(u) + len(v) for u, v in zip(x, y, strict=True)], float))

    pairs = found.select("run").distinct().mapInPandas(of_runs, "run string, sig long").join(own, "sig").select("run", "keyword").distinct()
    blanks = lambda c: F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit("")))
    pairs = pairs.where(blanks(F.col("run")) == blanks(F.col("keyword")))  # equal hashes may differ
    near = stage(pairs.withColumn("score", ratio("run", "keyword")).where(F.col("score") >= threshold), "near")
    return found.join(near, "run").groupBy("id", "keyword").agg(F.sum("n").alias("n_windows"), F.round(F.max("score"), 6).alias("score"))


def best(found: DataFrame) -> DataFrame:
    """(id, keyword, score): the keyword that a text of ``find`` comes nearest to; ties by the longer, then the first in order."""
    order = Window.partitionBy("id").orderBy(F.desc("score"), F.desc(F.length("keyword")), "keyword")
    return found.withColumn("place", F.row_number().over(order)).where("place = 1").select("id", "keyword", "score")
