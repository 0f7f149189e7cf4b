"""Toxicity scores by non-negative positive-unlabelled (nnPU) learning on word presence.

Confirmed toxic rows are the positives; everything else is unlabelled text. The class-prior-corrected risk
    pi E_p[l(+1)] + max(0, E_u[l(-1)] - pi E_p[l(-1)])
is minimised by full-batch gradient steps in numpy, on a bounded sample (POSITIVES and UNLABELLED rows, drawn by hash)
whose size does not grow with the corpus; the prior is counted over all training labels. Every text is then scored whole, in one scan without
a shuffle: the model (FEATURES word hashes and weights) is all that is broadcast.

Null or wordless texts get the score of a text without any listed word. Rows with a null doc_id are held out from
learning and scored like others; a doc_id that is labelled twice is toxic if any label says so. Without a positive row
all scores are the prior (0.5 without labels at all). Empty tables give empty results.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from costweave.llm.words import LETTERS, batch_words

POSITIVES, UNLABELLED = 4_000, 10_000
FEATURES = 512
LEAST_DF = 8
#: A word is a feature if its rates among positives and unlabelled texts differ by so many standard errors, and in this ratio.
LEAST_Z, LEAST_RATIO = 3.0, 4.0
BITS = 22
STEPS, RATE, DECAY = 400, 0.3, 1e-4
CUT = 0.3


@dataclass
class Model:
    """Sorted hashed words with weights, bias."""

    words: np.ndarray
    weights: np.ndarray
    bias: float

    def score(self, column) -> np.ndarray:
        hashes, at = batch_words(column, LETTERS)
        margin = np.full(len(at) - 1, self.bias)
        if len(self.words) and len(hashes):
            short = (hashes >> np.uint64(64 - BITS)).astype(np.int64)
            known = np.zeros(1 << BITS, bool)
            known[self.words] = True
            hit = np.flatnonzero(known[short])
            row = np.searchsorted(at, hit, "right") - 1
            pair = np.unique(row * len(self.words) + np.searchsorted(self.words, short[hit]))
            np.add.at(margin, pair // len(self.words), self.weights[pair % len(self.words)])
        return 1 / (1 + np.exp(-np.clip(margin, -40, 40)))


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit_nnpu(positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> tuple[np.ndarray, float]:
    """Weights and bias of the logistic nnPU minimiser on 0/1 features."""
    w, b = np.zeros(positive.shape[1]), float(np.log(prior / (1 - prior)))
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for t in range(1, STEPS + 1):
        sp = 1 / (1 + np.exp(-(positive @ w + b)))  # chance of +1
        su = 1 / (1 + np.exp(-(unlabelled @ w + b)))
        negative = -np.log1p(-su + 1e-12).mean() + prior * np.log1p(-sp + 1e-12).mean()
        gp, gu = np.zeros(len(sp)), np.zeros(len(su))
        if negative >= 0:
            gp = prior * ((sp - 1) - sp) / len(sp)
            gu = su / len(su)
        else:  # the corrected negative risk is below zero: step back on it alone
            gp, gu = prior * sp / len(sp), -su / len(su)
        g, gb = positive.T @ gp + unlabelled.T @ gu + DECAY * w, gp.sum() + gu.sum()
        m, v, mb, vb = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g, 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        step = RATE / (1 + 4 * t / STEPS)
        w = w - step * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        b = b - step * (mb / (1 - 0.9**t)) / (np.sqrt(vb / (1 - 0.999**t)) + 1e-8)
    return w, b


def _features(batches):
    for batch in batches:
        hashes, at = batch_words(batch.column("text"), LETTERS)
        short = (hashes >> np.uint64(64 - BITS)).astype(np.int32)
        rows = [np.unique(short[i:j]) for i, j in zip(at[:-1], at[1:], strict=True)]
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(x) for x in rows])]).astype(np.int32)), pa.array(np.concatenate(rows) if rows else np.zeros(0, np.int32)))
        yield pa.record_batch([batch.column("positive"), lists], ["positive", "words"])


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Learn from the rows that are not held out; labels count only as confirmed positives and for the prior."""
    ids = docs.where(F.col("doc_id").isNotNull() & ~held_out("doc_id")).select(F.col("doc_id").cast("long").alias("doc_id"))
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out("doc_id")).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.max("toxic") == 1).alias("positive"))
    n, toxic = known.agg(F.count("*"), F.sum(F.col("positive").cast("long"))).first()
    prior = min(max((toxic or 0) / n, 1e-3), 0.5) if n else 0.5
    empty = Model(np.zeros(0, np.int64), np.zeros(0), float(np.log(prior / (1 - prior))))
    if not toxic:
        return empty
    draw = F.xxhash64("doc_id", F.lit(6))
    sample = known.where("positive").orderBy(draw, "doc_id").limit(POSITIVES).select("doc_id", F.lit(True).alias("positive"))
    sample = sample.union(ids.orderBy(draw, "doc_id").limit(UNLABELLED).select("doc_id", F.lit(False).alias("positive")))
    # at most POSITIVES + UNLABELLED ids are broadcast
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(sample), "doc_id").select("positive", "text")
    data = rows.mapInArrow(_features, "positive boolean, words array<int>").toArrow()
    lists, mark = data.column("words").combine_chunks(), data.column("positive").to_numpy().astype(bool)
    if not mark.any() or mark.all():
        return empty
    flat, sizes = lists.flatten().to_numpy(), np.diff(lists.offsets.to_numpy())
    row = np.repeat(np.arange(len(mark)), sizes)
    p, u = (np.bincount(flat[mark[row] == x], minlength=1 << BITS) for x in (True, False))
    rate_p, rate_u = p / mark.sum(), u / (~mark).sum()
    z = (rate_p - rate_u) / np.sqrt((rate_p + rate_u + 1e-9) / 2 * (1 / mark.sum() + 1 / (~mark).sum()))
    z[p + u < min(LEAST_DF, 2 + len(mark) // 50)] = 0
    chosen = np.argsort(-np.abs(z), kind="stable")[:FEATURES]
    chosen = np.sort(chosen[(z[chosen] >= LEAST_Z) & (rate_p[chosen] >= LEAST_RATIO * rate_u[chosen])])
    column = np.full(1 << BITS, -1, np.int32)
    column[chosen] = np.arange(len(chosen))
    x = np.zeros((len(mark), len(chosen)), np.float32)
    keep = column[flat] >= 0
    x[row[keep], column[flat[keep]]] = 1
    w, b = fit_nnpu(x[mark], x[~mark], prior)
    return Model(chosen, w, b)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def apply(batches):
        for batch in batches:
            yield pa.record_batch([batch.column("doc_id"), batch.column("held_out"), pa.array(np.round(sent.value.score(batch.column("text")), 9))], ["doc_id", "held_out", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out("doc_id").alias("held_out"), "text")
    return rows.mapInArrow(apply, "doc_id long, held_out boolean, score double").withColumn("predicted", (F.col("score") >= CUT).cast("int"))
