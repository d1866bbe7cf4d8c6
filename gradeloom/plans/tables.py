"""The driver's tables seen as rollouts, tasks, documents and chats, as DataFrames and as the SQL of the same views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def graded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a rollout, without an order inside tasks: what counts and means need."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("task_id"),
        F.when(F.col("l_returnflag") != "R", 1.0).otherwise(0.0).alias("reward"),
        F.when(F.col("l_linestatus") == "F", "before").otherwise("after").alias("arm"),
        F.pmod(F.year("l_shipdate"), F.lit(3)).cast("int").alias("eval_run"),
        (F.col("l_discount") * 10).alias("score"),
        F.col("l_quantity").cast("int").alias("reply_length"),
        F.when(F.col("l_tax") < 0.04, 1.0).otherwise(0.0).alias("cheap"),
        F.when(F.col("l_quantity") > 25, 1.0).otherwise(0.0).alias("big"),
        F.col("l_returnflag").alias("harness"), F.col("l_linestatus").alias("model"),
        "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice",
    )


ORDER = ("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")


def rollouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``graded`` with each rollout's index inside its task."""
    return graded(spark, sf_dir).withColumn("rollout_index", F.row_number().over(Window.partitionBy("task_id").orderBy(*ORDER)))


GRADED_SQL = """graded AS (
  SELECT l_orderkey AS task_id, CASE WHEN l_returnflag <> 'R' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS reward,
         CASE WHEN l_linestatus = 'F' THEN 'before' ELSE 'after' END AS arm, CAST(year(l_shipdate) % 3 AS INTEGER) AS eval_run,
         l_discount * 10 AS score, CAST(l_quantity AS INTEGER) AS reply_length,
         CASE WHEN l_tax < 0.04 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS cheap, CASE WHEN l_quantity > 25 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS big,
         l_returnflag AS harness, l_linestatus AS model, l_linenumber, l_partkey, l_suppkey, l_extendedprice
  FROM lineitem)"""
ROLLOUTS_SQL = GRADED_SQL + """, rollouts AS (
  SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS rollout_index FROM graded)"""
STATS_SQL = GRADED_SQL + """, stats AS (
  SELECT task_id, count(*) AS n, CAST(sum(reward) AS BIGINT) AS c FROM graded GROUP BY task_id)"""
