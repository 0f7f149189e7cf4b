"""Structured Streaming: figures of catalogue rows kept up to date as line items arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEPT = "master_id long, occurrences long, min_price double, max_price double, total_amount decimal(38,2)"


def running_prices(lines: DataFrame, folder: str) -> None:
    """Read what a stream of (master_id, unit_price, amount) holds now and append the rows that changed to ``folder``.

    Called again it goes on where it stopped: state and progress lie in the shared folder. A batch that is repeated after
    a loss writes over its own rows. Only the counts of masters are kept as state, no line.
    """
    price = F.col("unit_price")
    sums = lines.groupBy("master_id").agg(F.count("*").alias("occurrences"), F.min(price).alias("min_price"), F.max(price).alias("max_price"), F.sum(F.col("amount").cast("decimal(18,2)")).cast("decimal(38,2)").alias("total_amount"))

    def changed(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{folder}/rows/batch={batch}")

    stream = sums.writeStream.outputMode("update").foreachBatch(changed).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True)
    stream.start().awaitTermination()


def current(spark: SparkSession, folder: str) -> DataFrame:
    """The newest figures of every master that ``running_prices`` wrote below ``folder``; none before its first batch."""
    spark.createDataFrame([], KEPT).write.mode("overwrite").parquet(f"{folder}/rows/batch=-1")
    rows = spark.read.schema(KEPT + ", batch long").parquet(f"{folder}/rows")
    names = ("occurrences", "min_price", "max_price", "total_amount")
    newest = rows.groupBy("master_id").agg(F.max_by(F.struct(*names), "batch").alias("r"))
    return newest.select("master_id", *(f"r.{n}" for n in names))
