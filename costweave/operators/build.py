"""The catalogue build as one job: rows are scored once, written by destination, and counted on the way."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from costweave.operators import gate

DESTINATIONS = ("master", "pending", "quarantine", "red work item", "skipped")


def run(rows: DataFrame, rules: gate.Rules, path: str) -> tuple[DataFrame, dict[str, int]]:
    """The scored rows, read back from ``path`` in a folder a destination, and how many went where.

    One scan and no shuffle: counters are observed by the job that writes. Files appear when the write commits, and a run
    for the same path replaces what an earlier one left, so a retry neither doubles nor loses rows.
    """
    seen = Observation()
    scored = gate.destination(gate.score(rows, rules))
    counts = [F.count_if(F.col("destination") == d).cast("long").alias(d) for d in DESTINATIONS]
    counted = scored.observe(seen, F.count(F.lit(1)).alias("rows"), F.count_if(F.col("default_grade").isNotNull()).cast("long").alias("graded"), *counts)
    counted.write.mode("overwrite").partitionBy("destination").parquet(path)
    spark = rows.sparkSession
    # no row, no file: the schema is known all the same
    return spark.read.schema(scored.schema).option("basePath", path).parquet(path), dict(seen.get)


def steps(spark, counts: dict[str, int]) -> DataFrame:
    """(step, n_rows) of the counters, one row a step."""
    return spark.createDataFrame(sorted(counts.items()), "step string, n_rows long")
