"""Analytic reads: dashboards, confidence bands, price distributions and frequency statistics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from costweave.session import stage
from costweave.sources.views import money

#: Parts of a group's values that are ranked in tasks of their own.
BUCKETS = 64
REVIEW_BELOW, HIGH_FROM = 80, 95


def total(column: str) -> F.Column:
    return F.sum(money(column)).cast("double")


def by_code(items: DataFrame) -> DataFrame:
    return items.groupBy("sec_code").agg(F.count("*").alias("item_count"), total("amount").alias("total_amount"))


def needs_review(items: DataFrame) -> DataFrame:
    """Low confidence or no code; an unknown confidence with a code isn't selected."""
    return items.where((F.col("confidence") < REVIEW_BELOW) | F.col("sec_code").isNull())


def confidence_bands(items: DataFrame) -> DataFrame:
    band = F.when(F.col("confidence") < REVIEW_BELOW, "low").when(F.col("confidence") < HIGH_FROM, "medium").when(F.col("confidence").isNotNull(), "high")
    return items.groupBy(band.alias("band")).agg(F.count("*").alias("item_count"), F.min("confidence").alias("lowest"), F.max("confidence").alias("highest"))


def by_method(items: DataFrame) -> DataFrame:
    return items.groupBy("method").agg(F.count("*").alias("item_count"), (F.sum("confidence") / F.count("confidence")).alias("avg_confidence"))


def confidence_histogram(items: DataFrame) -> DataFrame:
    """Half-open ranges of ten from 50 on; the last one is closed, so full confidence counts."""
    low = F.least(F.floor(F.col("confidence") / 10) * 10, F.lit(90))
    return items.groupBy(low.cast("int").alias("range_from")).agg(F.count("*").alias("item_count"))


def project_summary(projects: DataFrame, files: DataFrame, items: DataFrame) -> DataFrame:
    """Files, items and amount of every project; each side is aggregated before it is joined, so nothing fans out."""
    per_file = items.groupBy("file_id").agg(F.count("*").alias("items"), F.sum(money("amount")).alias("amount"))
    per_project = files.join(per_file, "file_id", "left").groupBy("project_id").agg(F.count("*").alias("file_count"), F.sum("items").alias("items"), F.sum("amount").alias("amount"))
    return projects.join(per_project, "project_id", "left").select(
        "project_id", "project_name", "region", F.coalesce("file_count", F.lit(0)).alias("file_count"), F.coalesce("items", F.lit(0)).alias("item_count"), F.coalesce(F.col("amount").cast("double"), F.lit(0.0)).alias("total_amount")
    )


def placed(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """A row per distinct value of every group: its count ``n``, the rows ``before`` it in order and the group's ``total``.

    Values are counted first, then cut into buckets at approximate quantiles and ranked in their bucket from where it
    starts, so that no group is held or sorted in one task. Any quantiles do, but only if starts and ranks see the same:
    they differ with the order in which a cluster merges its sketches, so they are worked out once.
    """
    counts = stage(rows.groupBy(*keys, value).agg(F.count("*").alias("n")), "counts")
    same = lambda c: F.lit(True) if not keys else reduce(lambda x, y: x & y, (F.col(k).eqNullSafe(F.col(f"{c}_{k}")) for k in keys))
    renamed = lambda c: [F.col(k).alias(f"{c}_{k}") for k in keys]
    quantiles = F.percentile_approx(value, [i / BUCKETS for i in range(1, BUCKETS)], 1000)
    edges = stage(counts.groupBy(*keys).agg(F.array_distinct(quantiles).alias("edges")).select(*renamed("e"), "edges"), "edges")
    dealt = counts.join(edges, same("e")).select(*keys, value, "n", F.size(F.filter("edges", lambda e: e < F.col(value))).alias("bucket"))
    sums = dealt.groupBy(*keys, "bucket").agg(F.sum("n").alias("held"))
    group = Window.partitionBy(*keys)
    starts = sums.select(*renamed("s"), F.col("bucket").alias("s_bucket"), (F.sum("held").over(group.orderBy("bucket")) - F.col("held")).alias("start"), F.sum("held").over(group).alias("total"))
    inside = Window.partitionBy(*keys, "bucket").orderBy(value)
    found = dealt.withColumn("_inside", F.sum("n").over(inside) - F.col("n")).join(starts, same("s") & (F.col("bucket") == F.col("s_bucket")))
    return found.select(*keys, value, "n", (F.col("start") + F.col("_inside")).alias("before"), "total")


def _at(rank: F.Column, value: str) -> F.Column:
    """The value at a rank (from 0) of a group of ``placed`` rows."""
    return F.max(F.when((F.col("before") <= rank) & (rank < F.col("before") + F.col("n")), F.col(value)))


def price_distribution(items: DataFrame) -> DataFrame:
    """Price statistics by code; quartiles are the values at n/4 and 3n/4 of the sorted prices, null below four."""
    rows = placed(items.where("unit_price > 0"), ["sec_code"], "unit_price")
    at = lambda q: _at(F.when(F.col("total") >= 4, F.floor(F.col("total") * q / 4)), "unit_price")
    return rows.groupBy("sec_code").agg(F.sum("n").alias("n_prices"), F.min("unit_price").alias("min_price"), F.max("unit_price").alias("max_price"), at(1).alias("p25"), at(3).alias("p75"))


def price_statistics(items: DataFrame) -> DataFrame:
    """``price_distribution`` with mean and median, both with two decimals; the mean's sum is exact in eight decimals."""
    rows = placed(items.where("unit_price > 0"), ["sec_code"], "unit_price")
    at = lambda q: _at(F.when(F.col("total") >= 4, F.floor(F.col("total") * q / 4)), "unit_price")
    low, high = (_at(F.floor((F.col("total") - k) / 2), "unit_price") for k in (1, 0))
    mean = F.sum(F.col("unit_price").cast("decimal(20,8)") * F.col("n")).cast("double") / F.sum("n")
    return rows.groupBy("sec_code").agg(
        F.sum("n").alias("n_prices"), F.min("unit_price").alias("min_price"), F.max("unit_price").alias("max_price"), F.round(mean, 2).alias("mean_price"), F.round((low + high) / 2, 2).alias("median_price"),
        F.round(at(1), 2).alias("p25"), F.round(at(3), 2).alias("p75"),
    )


def regions(projects: DataFrame) -> DataFrame:
    return projects.select("region").distinct()


def log_stats(events: DataFrame) -> DataFrame:
    return events.groupBy(F.col("event_type").alias("action")).agg(F.count("*").alias("n"), F.count_if(F.get_json_object("props", "$.k").cast("int") > 50).alias("n_large"), F.max("value").alias("max_value"))


def log_means(log: DataFrame) -> DataFrame:
    """Rows of a training log (action, confidence, distance) by action, with means of what is not null; sums are exact in eight decimals."""
    mean = lambda c, d: F.round(F.sum(F.col(c).cast("decimal(20,8)")).cast("double") / F.count(c), d)
    return log.groupBy("action").agg(F.count("*").alias("n"), mean("confidence", 3).alias("mean_confidence"), mean("distance", 1).alias("mean_distance"))


def counts_by_type(rows: DataFrame, kind: str) -> DataFrame:
    """Rows of each type, rows without one too, and of all types together (``is_total``), from one pass."""
    return rows.select(F.col(kind).alias("type")).rollup("type").agg((F.grouping("type") == 1).alias("is_total"), F.count("*").alias("n"))


def coded_rate(items: DataFrame) -> DataFrame:
    """One row: items, those coded automatically (method A) and by hand (R), and both in percent of all; 0 without items."""
    of = lambda m: F.count_if(F.col("method") == m)
    rows = items.agg(F.count("*").alias("n_items"), of("A").alias("n_auto"), of("R").alias("n_manual"))
    return rows.withColumn("rate", F.when(F.col("n_items") > 0, F.round(100.0 * (F.col("n_auto") + F.col("n_manual")) / F.col("n_items"), 2)).otherwise(0.0))


def frequency_buckets(frequencies: DataFrame) -> DataFrame:
    f = F.col("frequency")
    bucket = F.when(f <= 1, "1").when(f <= 5, "2-5").when(f <= 10, "6-10").when(f <= 50, "11-50").otherwise("50+")
    return frequencies.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n_items"), F.sum("frequency").alias("n_rows"))


def price_histogram(items: DataFrame, buckets: int) -> DataFrame:
    """Equal-width buckets from the least to the largest price, empty ones too; the last one is open above, so no price is lost.

    If all prices are equal there is one bucket.
    """
    prices = items.where("unit_price > 0").select("unit_price")
    span = prices.agg(F.min("unit_price").alias("low"), F.max("unit_price").alias("high")).withColumn("bucket", F.explode(F.sequence(F.lit(0), F.when(F.col("low") < F.col("high"), buckets - 1).otherwise(0))))
    edge = lambda i: F.col("low") + i * ((F.col("high") - F.col("low")) / buckets)
    edges = span.select("bucket", edge(F.col("bucket")).alias("bucket_from"), edge(F.col("bucket") + 1).alias("bucket_to"))
    inside = (F.col("unit_price") >= F.col("bucket_from")) & ((F.col("unit_price") < F.col("bucket_to")) | (F.col("bucket") == buckets - 1) | (F.col("bucket_from") == F.col("bucket_to")))
    counts = prices.join(F.broadcast(edges), inside).groupBy("bucket").agg(F.count("*").alias("n"))  # one row a bucket is broadcast
    return edges.join(counts, "bucket", "left").select("bucket", "bucket_from", "bucket_to", F.coalesce("n", F.lit(0)).alias("n_prices"))


def prices_by(prices: DataFrame, keys: list[str], since: str, until: str) -> DataFrame:
    """Count, range and median of the positive prices of a period."""
    at = F.col("recorded_at")
    rows = prices.where((F.col("unit_price") > 0) & (at >= F.lit(since).cast("timestamp")) & (at <= F.lit(until).cast("timestamp")))
    low, high = (_at(F.floor((F.col("total") - k) / 2), "unit_price") for k in (1, 0))
    return placed(rows, keys, "unit_price").groupBy(*keys).agg(F.sum("n").alias("n_prices"), F.min("unit_price").alias("min_price"), F.max("unit_price").alias("max_price"), ((low + high) / 2).alias("median_price"))


def gate_counts(items: DataFrame, key: str) -> DataFrame:
    """Items by quality gate: green from 90, yellow from 60, red below."""
    c = F.col("confidence")
    return items.groupBy(key).agg(F.count("*").alias("n_items"), F.count_if(c >= 90).alias("green"), F.count_if((c >= 60) & (c < 90)).alias("yellow"), F.count_if(c < 60).alias("red"))


def dashboard(projects: DataFrame, files: DataFrame, items: DataFrame) -> DataFrame:
    """One row of totals; the cross joins are of one-row frames."""
    review = F.count_if((F.col("confidence") < REVIEW_BELOW) | F.col("sec_code").isNull())
    rows = items.agg(F.count("*").alias("n_items"), review.alias("n_review"), F.count_distinct("sec_code").alias("n_codes"), total("amount").alias("total_amount"))
    sizes = projects.agg(F.count("*").alias("n_projects")).crossJoin(files.agg(F.count("*").alias("n_files")))
    return sizes.crossJoin(rows)


def project_stats(items: DataFrame) -> DataFrame:
    mean = F.sum("confidence") / F.count("confidence")
    method = lambda m: F.count_if(F.col("method") == m)
    return items.groupBy("project_id").agg(F.count("*").alias("n_items"), total("amount").alias("total_amount"), mean.alias("avg_confidence"), method("A").alias("n_auto"), method("R").alias("n_manual"))


def master_stats(catalogue: DataFrame) -> DataFrame:
    return catalogue.groupBy("sec_code").agg(F.count("*").alias("n_masters"), F.count_distinct("description").alias("n_descriptions"), F.min("ref_price").alias("lowest"), F.max("ref_price").alias("highest"))


def file_totals(items: DataFrame) -> DataFrame:
    return items.groupBy("file_id").agg(F.count("*").alias("n_rows"), total("amount").alias("total_amount"))


def most_used(items: DataFrame, k: int) -> DataFrame:
    """The k catalogue rows that most line items refer to; ties by id."""
    return items.groupBy("master_id").agg(F.count("*").alias("occurrences")).orderBy(F.desc("occurrences"), "master_id").limit(k)


def by_grade(codes: DataFrame) -> DataFrame:
    """Rows by material grade: the third part of work codes that have one."""
    rows = codes.where(F.col("work_code").like("%-M%-%"))
    return rows.groupBy(F.split_part("work_code", F.lit("-"), F.lit(3)).alias("grade")).agg(F.count("*").alias("n"))
