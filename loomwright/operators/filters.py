"""Projections, filters and predicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwright.registry import query
from loomwright.session import table


@query("""
SELECT o_orderkey, o_totalprice FROM orders
WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1996-04-01' AND o_totalprice BETWEEN 1000 AND 200000
""")
def p1_filter_between(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    return orders.filter(
        "o_orderdate >= timestamp_ntz'1996-01-01' and o_orderdate < timestamp_ntz'1996-04-01'"
    ).filter(F.col("o_totalprice").between(1000, 200000)).select("o_orderkey", "o_totalprice")


@query("""
SELECT l_orderkey, l_linenumber, l_partkey,
       CASE WHEN l_quantity < 10 THEN 'small' WHEN l_quantity < 30 THEN 'medium' ELSE 'large' END AS size_class,
       coalesce(nullif(l_returnflag, 'N'), 'kept') AS flag
FROM lineitem
""")
def p2_case_coalesce(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.when(F.col("l_quantity") < 10, "small").when(F.col("l_quantity") < 30, "medium").otherwise("large")
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", size.alias("size_class"),
        F.coalesce(F.nullif("l_returnflag", F.lit("N")), F.lit("kept")).alias("flag"),
    )


@query("SELECT p_partkey, p_name FROM part WHERE (p_brand LIKE 'Brand#%1%' OR p_type LIKE 'E%_Y') AND p_type NOT LIKE 'P_OMO'")
def p3_like(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    return part.filter((F.col("p_brand").like("Brand#%1%") | F.col("p_type").like("E%_Y")) & ~F.col("p_type").like("P_OMO")).select("p_partkey", "p_name")


@query("""
WITH c AS (SELECT c_custkey, nullif(c_mktsegment, 'BUILDING') AS seg FROM customer)
SELECT a.c_custkey, a.seg IS NOT DISTINCT FROM b.seg AS same_segment
FROM c a JOIN c b ON b.c_custkey = a.c_custkey + 1
""")
def p4_null_safe_equality(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey", F.nullif("c_mktsegment", F.lit("BUILDING")).alias("seg"))
    b = c.select((F.col("c_custkey") - 1).alias("c_custkey"), F.col("seg").alias("next"))
    return c.join(b, "c_custkey").select("c_custkey", F.col("seg").eqNullSafe(F.col("next")).alias("same_segment"))


@query("""
SELECT event_id, greatest(value, nullif(CAST(user_id AS DOUBLE), 3)) AS most, least(value, nullif(CAST(user_id AS DOUBLE), 3)) AS least_
FROM events
""")
def p5_greatest_least(spark: SparkSession, sf_dir: str) -> DataFrame:
    other = F.nullif(F.col("user_id").cast("double"), F.lit(3.0))
    return table(spark, sf_dir, "events").select(
        "event_id", F.greatest("value", other).alias("most"), F.least("value", other).alias("least_")
    )


@query("""
WITH v AS (SELECT CASE WHEN event_id % 7 = 0 THEN CAST('NaN' AS DOUBLE) ELSE value END AS x FROM events)
SELECT count(*) FILTER (WHERE x = CAST('NaN' AS DOUBLE)) AS equal_nan, count(*) FILTER (WHERE x > 1e300) AS above, isnan(max(x)) AS max_is_nan FROM v
""")
def p6_nan(spark: SparkSession, sf_dir: str) -> DataFrame:
    nan = F.lit(float("nan"))
    v = table(spark, sf_dir, "events").select(F.when(F.col("event_id") % 7 == 0, nan).otherwise(F.col("value")).alias("x"))
    return v.agg(F.count_if(F.col("x") == nan).alias("equal_nan"), F.count_if(F.col("x") > 1e300).alias("above"), F.isnan(F.max("x")).alias("max_is_nan"))


@query("SELECT o_orderkey, try_cast(split_part(o_orderpriority, '-', 1) AS INTEGER) AS level, try_cast(o_orderstatus AS INTEGER) AS none FROM orders")
def p7_try_cast(spark: SparkSession, sf_dir: str) -> DataFrame:
    level = F.split_part("o_orderpriority", F.lit("-"), F.lit(1)).try_cast("int")
    return table(spark, sf_dir, "orders").select("o_orderkey", level.alias("level"), F.col("o_orderstatus").try_cast("int").alias("none"))


@query("""
SELECT c_custkey, c_name ILIKE '%CUSTOMER%' AS named, regexp_matches(c_name, '[13]$') AS ends,
       c_mktsegment IS NOT DISTINCT FROM 'MACHINERY' AS machinery, CASE WHEN nullif(c_mktsegment, 'MACHINERY') IS NOT NULL THEN 'a' ELSE 'b' END AS either
FROM customer
""")
def p8_ilike_rlike_nvl2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(
        "c_custkey", F.col("c_name").ilike("%CUSTOMER%").alias("named"), F.col("c_name").rlike("[13]$").alias("ends"),
        F.equal_null("c_mktsegment", F.lit("MACHINERY")).alias("machinery"),
        F.nvl2(F.nullif("c_mktsegment", F.lit("MACHINERY")), F.lit("a"), F.lit("b")).alias("either"),
    )
