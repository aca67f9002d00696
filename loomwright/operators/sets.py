"""Sorts, limits, set operations and reshaping."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomwright.registry import query
from loomwright.session import table, views


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def l1_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(20)


@query("SELECT c_custkey FROM customer ORDER BY c_acctbal, c_custkey LIMIT 10 OFFSET 15")
def l2_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").orderBy("c_acctbal", "c_custkey").offset(15).limit(10).select("c_custkey")


@query("""
SELECT c_custkey, row_number() OVER (ORDER BY seg DESC NULLS LAST, c_custkey) AS n
FROM (SELECT c_custkey, nullif(c_mktsegment, 'BUILDING') AS seg FROM customer ORDER BY seg DESC NULLS LAST, c_custkey LIMIT 100000) ORDER BY n LIMIT 50
""")
def l3_null_placement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers only the rows of a top-k, which one task holds."""
    c = table(spark, sf_dir, "customer").select("c_custkey", F.nullif("c_mktsegment", F.lit("BUILDING")).alias("seg"))
    order = [F.col("seg").desc_nulls_last(), F.col("c_custkey")]
    top = c.orderBy(*order).limit(50)
    return top.select("c_custkey", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(*order)).cast("long").alias("n"))


@query("""
SELECT c_mktsegment, c_custkey FROM (
  SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) AS r FROM customer) WHERE r <= 3
""")
def l4_top_k_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("c_mktsegment").orderBy(F.desc("c_acctbal"), "c_custkey")
    return table(spark, sf_dir, "customer").withColumn("r", F.row_number().over(w)).filter("r <= 3").select("c_mktsegment", "c_custkey")


@query("SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def u1_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k"))
    return a.union(table(spark, sf_dir, "supplier").select("s_nationkey")).distinct()


@query("SELECT c_nationkey AS k FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier")
def u2_intersect_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k"))
    return a.intersectAll(table(spark, sf_dir, "supplier").select("s_nationkey"))


@query("SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier")
def u2_except_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k"))
    return a.exceptAll(table(spark, sf_dir, "supplier").select("s_nationkey"))


@query("""
WITH RECURSIVE chain(n_nationkey, depth) AS (
  SELECT n_nationkey, 0 FROM nation WHERE n_nationkey < 3
  UNION ALL SELECT n.n_nationkey, c.depth + 1 FROM nation n JOIN chain c ON n.n_nationkey = c.n_nationkey + 3)
SELECT n_nationkey, depth FROM chain
""")
def u3_recursive_cte(spark: SparkSession, sf_dir: str) -> DataFrame:
    views(spark, sf_dir, "nation")
    return spark.sql("""
        WITH RECURSIVE chain(n_nationkey, depth) AS (
          SELECT n_nationkey, 0 FROM nation WHERE n_nationkey < 3
          UNION ALL SELECT n.n_nationkey, c.depth + 1 FROM nation n JOIN chain c ON n.n_nationkey = c.n_nationkey + 3)
        SELECT n_nationkey, depth FROM chain""")


@query("SELECT s_suppkey AS key, s_name AS name, CAST(NULL AS VARCHAR) AS segment FROM supplier UNION ALL SELECT c_custkey, c_name, c_mktsegment FROM customer")
def u4_union_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"))
    c = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("segment"), F.col("c_custkey").alias("key"), F.col("c_name").alias("name"))
    return s.unionByName(c, allowMissingColumns=True)


@query("""
SELECT p_partkey, 'p_size' AS name, CAST(p_size AS DOUBLE) AS number FROM part UNION ALL SELECT p_partkey, 'p_retailprice', p_retailprice FROM part
""")
def u4_unpivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("double"), "p_retailprice")
    return part.unpivot("p_partkey", ["p_size", "p_retailprice"], "name", "number")


@query("""
SELECT 'r_regionkey' AS key, max(r_regionkey) FILTER (WHERE r_name = 'ASIA') AS asia, max(r_regionkey) FILTER (WHERE r_name = 'EUROPE') AS europe FROM region
""")
def u4_transpose(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table of five rows; transposing brings all rows to one task."""
    return table(spark, sf_dir, "region").select("r_name", "r_regionkey").transpose("r_name").select("key", F.col("ASIA").alias("asia"), F.col("EUROPE").alias("europe"))


@query("SELECT count(*) AS n, count(DISTINCT (l_orderkey, l_linenumber, l_partkey, l_suppkey)) AS different FROM lineitem")
def distinct_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    different = lines.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").distinct().agg(F.count(F.lit(1)).alias("different"))
    return lines.agg(F.count(F.lit(1)).alias("n")).crossJoin(different)  # one row each
