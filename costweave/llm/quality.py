"""Quality classifier with hierarchical empirical Bayes over hosts and paths.

A logistic classifier on text statistics gives each document's own evidence (a log-likelihood ratio). Hosts (source,
or a URL's host) and paths below them (language, or a URL's first path segment) have posteriors of their own: counts
of labelled rows, shrunk from path to host to the global rate with strengths fitted by moments over the groups, so
sparse sites fall back to the global prior. A document is kept if the posterior of its evidence and its path's prior
reaches CUT.

The statistics are built-in expressions of one scan; group counts are partial aggregates over all labelled rows, so a
hot host is no hot task. The classifier is fitted on SAMPLE labelled rows at most, drawn by hash. The table of path
posteriors is broadcast only up to BROADCAST_ROWS rows, beyond that it is joined by a shuffle.

Null and empty texts have statistics of zero; null hosts or paths are groups of their own; a doc_id that is labelled
twice with both values counts as good. Texts are taken whole, however long, and other columns kept, whatever their
names. Without labels of both kinds everything is kept. Repeated rows give repeated rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SAMPLE = 20_000
CUT = 0.5
BROADCAST_ROWS = 100_000
STEPS, DECAY = 60, 1e-3


def statistics(text) -> dict[str, F.Column]:
    """Text statistics that separate prose from tables, symbol noise, shouting and repetition."""
    text = F.coalesce(F.col(text), F.lit(""))
    n = F.length(text)
    rate = lambda c: F.coalesce(c / F.when(n > 0, n), F.lit(0.0))
    letters = F.length(F.regexp_replace(text, r"[^\p{L}]+", ""))
    upper = F.length(F.regexp_replace(text, r"[^\p{Lu}]+", ""))
    words = F.split(text, r"[\s]+")
    lines = F.split(text, "[.\n]")
    count = lambda chars: n - F.length(F.translate(text, chars, ""))
    return {
        "size": F.log1p(n.cast("double")),
        "letters": rate(letters),
        "upper": F.coalesce(upper / F.when(letters > 0, letters), F.lit(0.0)),
        "symbols": rate(count("#$%&*@^~")),
        "bars": rate(count("|<>{}[]\\")),
        "shouts": rate(count("!?")),
        "digits": rate(count("0123456789")),
        "stops": rate(count(".,;:")),
        "spaces": rate(count(" \n\t")),
        "word_variety": F.coalesce(F.size(F.array_distinct(words)) / F.size(words), F.lit(0.0)),
        "line_variety": F.coalesce(F.size(F.array_distinct(lines)) / F.size(lines), F.lit(0.0)),
    }


def fit_logistic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float, np.ndarray, np.ndarray]:
    """Ridge logistic regression by Newton steps: weights, bias, and the means and scales of the columns."""
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    w = np.zeros(z.shape[1])
    ridge = np.diag([*[DECAY * len(x)] * x.shape[1], 1e-9])
    for _ in range(STEPS):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        g = z.T @ (p - y) + ridge @ w
        step = np.linalg.solve(z.T @ (z * (p * (1 - p) + 1e-9)[:, None]) + ridge + 1e-9 * np.eye(len(w)), g)
        w = w - step * min(1.0, 5 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-8:
            break
    return w[:-1], float(w[-1]), mean, scale


def strength(groups: DataFrame, mean: float) -> float:
    """Prior strength of groups (n, good) around ``mean`` by moments: within-group noise over between-group variance."""
    apart = F.col("n") * F.pow(F.col("good") / F.col("n") - mean, 2)
    k, n, squares, dev = groups.agg(F.count("*"), F.sum("n"), F.sum(F.col("n") * F.col("n")), F.sum(apart)).first()
    if not k or k < 2 or not 0 < mean < 1:
        return 100.0
    between = (dev - (k - 1) * mean * (1 - mean)) / (n - squares / n + 1e-9)
    return float(np.clip(mean * (1 - mean) / max(between, 1e-9) - 1, 1.0, 1000.0))


def classify(docs: DataFrame, labels: DataFrame, host="source", path="lang") -> DataFrame:
    """``docs`` with evidence, prior and posterior of good quality, and ``keep``; columns of these names are replaced."""
    good = labels.where("quality is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("label_id")).agg(F.max("quality").cast("int").alias("good"))
    total, positive = good.agg(F.count("*"), F.sum("good")).first()
    extra = {"evidence": F.lit(0.0), "prior": F.lit(1.0), "posterior": F.lit(1.0), "keep": F.lit(True)}
    if not total or positive in (0, total):
        return docs.withColumns(extra)
    mean = positive / total

    # evidence: a bounded sample of labelled rows
    sample = F.broadcast(good.orderBy(F.xxhash64("label_id", F.lit(4)), "label_id").limit(SAMPLE))
    columns = statistics("text")
    data = docs.select("doc_id", "text").join(sample, F.col("doc_id") == F.col("label_id")).select(*(c.alias(k) for k, c in columns.items()), "good").toPandas()
    x, y = data[list(columns)].to_numpy(float), data["good"].to_numpy(float)
    if len(set(y)) < 2:
        return docs.withColumns(extra)
    w, bias, centre, scale = fit_logistic(x, y)
    base = np.log(y.mean() / (1 - y.mean()))
    evidence = F.lit(float(bias - base))
    for k, c in enumerate(columns.values()):
        evidence = evidence + (c - float(centre[k])) * float(w[k] / scale[k])

    # priors: counts by host and path over all labelled rows, shrunk towards the level above
    known = docs.select(F.col("doc_id").cast("long").alias("label_id"), F.col(host).alias("host"), F.col(path).alias("path")).join(good, "label_id")
    paths = known.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("good").alias("good"))
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    m_host, m_path = strength(hosts, mean), strength(paths, mean)
    hosts = hosts.select(F.col("host").alias("h"), ((F.col("good") + m_host * mean) / (F.col("n") + m_host)).alias("p_host"))
    priors = paths.join(hosts, F.col("host").eqNullSafe(F.col("h"))).select("host", "path", ((F.col("good") + m_path * F.col("p_host")) / (F.col("n") + m_path)).alias("p"))
    hosts, priors = (F.broadcast(t) if t.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else t for t in (hosts, priors))
    # the rows travel as one struct, so no column of theirs can clash
    rows = docs.select(F.struct("*").alias("row"), F.col(host).alias("own_host"), F.col(path).alias("own_path"), "text")
    joined = rows.join(priors, F.col("own_host").eqNullSafe(F.col("host")) & F.col("own_path").eqNullSafe(F.col("path")), "left").join(hosts, F.col("own_host").eqNullSafe(F.col("h")), "left")
    names = [c for c in docs.columns if c not in extra]
    out = joined.select(*(F.col("row").getField(c).alias(c) for c in names), evidence.alias("evidence"), F.coalesce("p", "p_host", F.lit(mean)).alias("prior"))
    out = out.withColumn("posterior", 1 / (1 + F.exp(-(F.col("evidence") + F.log(F.col("prior") / (1 - F.col("prior")))))))
    return out.withColumn("keep", F.col("posterior") >= CUT)


def keep_good(docs: DataFrame, labels: DataFrame, host="source", path="lang") -> DataFrame:
    """The rows of ``docs`` that ``classify`` keeps, with their own columns, whatever their names."""
    rows = docs.select(F.struct("*").alias("row"), "doc_id", "text", F.col(host).alias("host"), F.col(path).alias("path"))
    return classify(rows, labels, "host", "path").where("keep").select("row.*")
