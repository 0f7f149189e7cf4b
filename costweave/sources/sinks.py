"""Sinks: sorted text exports."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from costweave.session import shared_dir


def write_csv(rows: DataFrame, path: str, order: list[str]) -> None:
    """CSV files with a header below ``path``; read in the order of their names they are sorted by ``order``.

    Ranges are sorted and written by tasks of their own, so that no task holds the whole export.
    """
    rows.orderBy(*order).write.mode("errorifexists").csv(path, header=True, escape='"', nullValue="\\N")


def csv_round_trip(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` written as a CSV export into the shared folder and read again by their own schema."""
    spark = rows.sparkSession
    path = f"{shared_dir(spark)}/exports/{uuid.uuid4().hex}"
    write_csv(rows, path, order)
    return spark.read.schema(rows.schema).csv(path, header=True, escape='"', nullValue="\\N")
