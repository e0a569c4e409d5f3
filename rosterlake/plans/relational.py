"""Queries over the star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import query, table


@query("""
SELECT n_name, o_orderpriority AS priority, count(*) AS n_orders,
       sum(CAST(o_totalprice AS DECIMAL(18,2)))::DOUBLE AS revenue
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
GROUP BY n_name, o_orderpriority
""")
def revenue_by_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderpriority", "o_totalprice")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    # Orders are summed by customer's key before the joins, so the joins move sums only.
    by_customer = orders.groupBy("o_custkey", "o_orderpriority").agg(F.count("*").alias("n"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("s"))
    joined = by_customer.join(customer, F.col("o_custkey") == F.col("c_custkey")).join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.groupBy("n_name", F.col("o_orderpriority").alias("priority")).agg(F.sum("n").alias("n_orders"), F.sum("s").cast("double").alias("revenue"))
