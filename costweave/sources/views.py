"""Cost-domain views of the given tables: projects, files, catalogue and line items, as lazy DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from costweave.session import table


def money(column) -> F.Column:
    """Exact decimals, so that sums don't depend on the order of rows."""
    return F.col(column).cast("decimal(18,2)") if isinstance(column, str) else column.cast("decimal(18,2)")


def projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = table(spark, sf_dir, "customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.select(F.col("c_custkey").alias("project_id"), F.col("c_name").alias("project_name"), F.col("c_mktsegment").alias("project_type"), F.col("r_name").alias("region"))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders")
    return rows.select(F.col("o_orderkey").alias("file_id"), F.col("o_custkey").alias("project_id"), F.col("o_totalprice").alias("total_amount"), F.col("o_orderdate").alias("uploaded_at"), F.col("o_orderstatus").alias("status"))


def catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part")
    return rows.select(F.col("p_partkey").alias("master_id"), F.col("p_name").alias("description"), F.col("p_brand").alias("sec_code"), F.col("p_type").alias("unit"), F.col("p_retailprice").alias("ref_price"))


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with their numbers only, so that what needs no text joins nothing; confidence spans 50 to 100."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("file_id"), F.col("l_linenumber").alias("line_number"), F.col("l_partkey").alias("master_id"),
        F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("amount"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("unit_price"),
        (F.lit(100) - F.round(F.col("l_discount") * 100) * 5).cast("int").alias("confidence"), F.col("l_returnflag").alias("method"), F.col("l_shipdate").alias("recorded_at"),
    )


def line_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``facts`` with their catalogue row's text, unit and code."""
    return facts(spark, sf_dir).join(catalogue(spark, sf_dir).drop("ref_price"), "master_id")


def price_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with the project that paid the price."""
    return facts(spark, sf_dir).join(files(spark, sf_dir).select("file_id", "project_id"), "file_id").join(projects(spark, sf_dir), "project_id")


def code_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(code, parent) of a three-level code system: region, nation, market segment in a nation."""
    regions, nations = table(spark, sf_dir, "region"), table(spark, sf_dir, "nation")
    top = regions.select(F.col("r_name").alias("code"), F.lit(None).cast("string").alias("parent"))
    middle = nations.join(regions, F.col("n_regionkey") == F.col("r_regionkey")).select("n_name", "r_name")
    low = table(spark, sf_dir, "customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey")).select(F.concat_ws("/", "n_name", "c_mktsegment"), "n_name").distinct()
    return top.union(middle).union(low)


#: The same views for SQL engines, as common table expressions.
SQL = """
WITH projects AS (
  SELECT c_custkey AS project_id, c_name AS project_name, c_mktsegment AS project_type, r_name AS region
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
files AS (
  SELECT o_orderkey AS file_id, o_custkey AS project_id, o_totalprice AS total_amount, o_orderdate AS uploaded_at, o_orderstatus AS status FROM orders),
catalogue AS (
  SELECT p_partkey AS master_id, p_name AS description, p_brand AS sec_code, p_type AS unit, p_retailprice AS ref_price FROM part),
facts AS (
  SELECT l_orderkey AS file_id, l_linenumber AS line_number, l_partkey AS master_id, l_quantity AS quantity, l_extendedprice AS amount,
    l_extendedprice / l_quantity AS unit_price, CAST(100 - round(l_discount * 100) * 5 AS INTEGER) AS confidence, l_returnflag AS method, l_shipdate AS recorded_at
  FROM lineitem),
line_items AS (SELECT facts.*, description, unit, sec_code FROM facts JOIN catalogue USING (master_id))
"""
