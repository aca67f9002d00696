"""Scalar functions, one query for each family."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwright.registry import query
from loomwright.session import table


@query("""
SELECT c_custkey, upper(c_name) AS up, lower(c_name) AS low, CAST(length(c_name) AS INTEGER) AS n, replace(c_name, '#', '-') AS rep, trim('  ' || c_mktsegment || ' ') AS tr,
       lpad(CAST(c_custkey AS VARCHAR), 8, '0') AS pad, reverse(c_mktsegment) AS rev, CAST(instr(c_mktsegment, 'I') AS INTEGER) AS at,
       split_part(c_name, '#', 2) AS part, CAST(levenshtein(c_mktsegment, 'MACHINERY') AS INTEGER) AS lev, substring(c_name, -3) AS tail, concat_ws('/', c_mktsegment, c_name) AS joined
FROM customer
""")
def f1_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(
        "c_custkey", F.upper("c_name").alias("up"), F.lower("c_name").alias("low"), F.length("c_name").alias("n"),
        F.replace("c_name", F.lit("#"), F.lit("-")).alias("rep"), F.trim(F.concat(F.lit("  "), "c_mktsegment", F.lit(" "))).alias("tr"),
        F.lpad(F.col("c_custkey").cast("string"), 8, "0").alias("pad"), F.reverse("c_mktsegment").alias("rev"), F.instr("c_mktsegment", "I").alias("at"),
        F.split_part("c_name", F.lit("#"), F.lit(2)).alias("part"), F.levenshtein("c_mktsegment", F.lit("MACHINERY")).alias("lev"),
        F.substring("c_name", -3, 3).alias("tail"), F.concat_ws("/", "c_mktsegment", "c_name").alias("joined"),
    )


@query("""
SELECT c_custkey, substring(c_name, 1, 2) AS head, c_name || nullif(c_mktsegment, 'BUILDING') AS nulled, lower('ÄÖÜ' || c_name) AS low FROM customer
""")
def f2_string_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Substrings from 1, concatenation with null, and lower case beyond ASCII."""
    return table(spark, sf_dir, "customer").select(
        "c_custkey", F.substring("c_name", 1, 2).alias("head"), F.concat("c_name", F.nullif("c_mktsegment", F.lit("BUILDING"))).alias("nulled"),
        F.lower(F.concat(F.lit("ÄÖÜ"), "c_name")).alias("low"),
    )


@query("""
SELECT event_id, regexp_extract(props, '"(\\w+)": *(\\d+)', 2) AS digits, CAST(len(string_split_regex(props, '[^a-z0-9]+')) AS INTEGER) AS n FROM events
""")
def f3_regex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        "event_id", F.regexp_extract("props", r'"(\w+)": *(\d+)', 2).alias("digits"), F.size(F.split("props", "[^a-z0-9]+")).alias("n")
    )


@query("SELECT p_partkey, regexp_replace(p_name, '[aeiou]', '_', 'g') AS masked FROM part")
def f4_regex_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", F.regexp_replace("p_name", "[aeiou]", "_").alias("masked"))


@query("SELECT doc_id, md5(text) AS m, sha256(text) AS s FROM documents")
def f5_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("m"), F.sha2("text", 256).alias("s"))


@query("""
SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS y, CAST(month(o_orderdate) AS INTEGER) AS m, CAST(quarter(o_orderdate) AS INTEGER) AS q, CAST(week(o_orderdate) AS INTEGER) AS w,
       CAST(date_trunc('month', o_orderdate) AS DATE) AS start, CAST(date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS INTEGER) AS days,
       CAST(CAST(o_orderdate AS DATE) + INTERVAL 1 MONTH AS DATE) AS later, last_day(o_orderdate) AS last_, epoch_us(o_orderdate) AS micros
FROM orders
""")
def f6_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.to_date("o_orderdate")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", F.year(d).alias("y"), F.month(d).alias("m"), F.quarter(d).alias("q"), F.weekofyear(d).alias("w"), F.trunc(d, "month").alias("start"),
        F.datediff(d, F.lit("1995-01-01").cast("date")).alias("days"), F.add_months(d, 1).alias("later"), F.last_day(d).alias("last_"),
        F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("micros"),
    )


@query("SELECT date_trunc('day', ts) AS start, count(*) AS n FROM events GROUP BY 1")
def f6_day_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "events").groupBy(F.window(F.col("ts").cast("timestamp"), "1 day")).agg(F.count(F.lit(1)).alias("n"))
    return found.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "n")


@query("SELECT event_id, CAST(dayofweek(ts) + 1 AS INTEGER) AS d FROM events")
def f7_day_of_week(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sunday is 1."""
    return table(spark, sf_dir, "events").select("event_id", F.dayofweek("ts").alias("d"))


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, round(sqrt(l_quantity), 9) AS sq, round(ln(l_quantity), 9) AS l, round(log10(l_quantity), 9) AS l10, round(power(l_discount, 2), 9) AS p, round(exp(l_tax), 9) AS e,
       CAST(floor(l_extendedprice) AS BIGINT) AS f, CAST(ceil(l_extendedprice) AS BIGINT) AS c, CAST(sign(l_discount - 0.05) AS DOUBLE) AS s, abs(l_discount - 0.05) AS a,
       l_extendedprice / l_quantity AS d, CAST(l_partkey // 7 AS BIGINT) AS i, l_partkey % 7 AS m, round(l_quantity / 4, 0) AS r
FROM lineitem
""")
def f8_math(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, x = F.col("l_quantity"), F.col("l_extendedprice")
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", F.round(F.sqrt(q), 9).alias("sq"), F.round(F.ln(q), 9).alias("l"), F.round(F.log10(q), 9).alias("l10"),
        F.round(F.pow("l_discount", 2), 9).alias("p"), F.round(F.exp("l_tax"), 9).alias("e"), F.floor(x).alias("f"), F.ceil(x).alias("c"),
        F.sign(F.col("l_discount") - 0.05).alias("s"), F.abs(F.col("l_discount") - 0.05).alias("a"), (x / q).alias("d"),
        F.expr("l_partkey div 7").alias("i"), (F.col("l_partkey") % 7).alias("m"), F.round(q / 4, 0).alias("r"),
    )


@query("SELECT p_partkey, round(ln(p_retailprice), 9) AS natural_, p_retailprice / nullif(p_size % 3, 0) AS guarded FROM part")
def f9_log_and_division_by_zero(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One-argument log is natural here; division by zero gives null where it is asked to."""
    return table(spark, sf_dir, "part").select(
        "p_partkey", F.round(F.log("p_retailprice"), 9).alias("natural_"), F.try_divide("p_retailprice", F.col("p_size") % 3).alias("guarded")
    )


@query("""
WITH d AS (SELECT doc_id, string_split(lang || ',' || source || ',' || lang, ',') AS a FROM documents)
SELECT doc_id, CAST(len(a) AS INTEGER) AS n, list_max(a) AS m, a[2] AS second, array_to_string(a[1:2], '-') AS head, CAST(len(list_distinct(a)) AS INTEGER) AS different,
       array_to_string(list_transform(a, lambda x: upper(x)), '-') AS up, CAST(list_sum(list_transform(a, lambda x: length(x))) AS BIGINT) AS total
FROM d
""")
def f10_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.split(F.concat_ws(",", "lang", "source", "lang"), ",").alias("a"))
    return d.select(
        "doc_id", F.size("a").alias("n"), F.array_max("a").alias("m"), F.element_at("a", 2).alias("second"), F.array_join(F.slice("a", 1, 2), "-").alias("head"),
        F.size(F.array_distinct("a")).alias("different"), F.array_join(F.transform("a", F.upper), "-").alias("up"),
        F.aggregate("a", F.lit(0).cast("long"), lambda s, x: s + F.length(x)).alias("total"),
    )


@query("SELECT vec_id, i, CAST(embedding[i + 1] AS DOUBLE) AS x FROM (SELECT vec_id, embedding, unnest(range(0, len(embedding))) AS i FROM embeddings)")
def f10_explode_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.explode(F.sequence(F.lit(0).cast("long"), (F.size("embedding") - 1).cast("long"))).alias("i"))
    return v.select("vec_id", "i", F.get("embedding", F.col("i").cast("int")).cast("double").alias("x"))


@query("""
SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 1 WHEN 'MACHINERY' THEN 2 END AS code, c_name AS name FROM customer
""")
def f11_maps_structs(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = F.create_map(F.lit("BUILDING"), F.lit(1), F.lit("MACHINERY"), F.lit(2))
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", F.struct(F.col("c_name").alias("name")).alias("s"))
    return c.select("c_custkey", F.try_element_at(codes, F.col("c_mktsegment")).alias("code"), "s.name")


@query("SELECT event_id, json_extract_string(props, '$.k') AS text_k, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events")
def f12_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        "event_id", F.get_json_object("props", "$.k").alias("text_k"), F.from_json("props", "k int")["k"].alias("k")
    )


@query("SELECT l_orderkey, l_linenumber, l_partkey, CAST(trunc(l_extendedprice) AS BIGINT) AS whole, CAST(l_quantity AS DECIMAL(10, 2)) AS exact FROM lineitem")
def f13_casts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", F.col("l_extendedprice").cast("long").alias("whole"), F.col("l_quantity").cast("decimal(10,2)").alias("exact")
    )


@query("""
SELECT c_custkey, CAST((c_custkey > 20)::INTEGER + (c_nationkey > 20)::INTEGER AS INTEGER) AS left_, c_custkey * 2 AS doubled, c_custkey AS renamed, c_custkey + c_nationkey AS both_
FROM customer
""")
def f14_map_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """map_filter, transform_values, transform_keys and map_zip_with."""
    m = F.create_map(F.lit("x"), F.col("c_custkey"), F.lit("y"), F.col("c_nationkey").cast("long"))
    crossed = F.create_map(F.lit("x"), F.col("c_nationkey").cast("long"), F.lit("z"), F.lit(1).cast("long"))
    return table(spark, sf_dir, "customer").select(
        "c_custkey", F.size(F.map_filter(m, lambda k, v: v > 20)).alias("left_"), F.transform_values(m, lambda k, v: v * 2)["x"].alias("doubled"),
        F.transform_keys(m, lambda k, v: F.upper(k))["X"].alias("renamed"), F.map_zip_with(m, crossed, lambda k, a, b: a + b)["x"].alias("both_"),
    )


@query("""
SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS variant_k, CAST(len(regexp_extract_all(props, '[0-9]')) AS INTEGER) AS digits,
       array_to_string(regexp_extract_all(props, '[0-9]'), '') AS all_digits, event_type || '.shop.example' AS host, 'user ' || CAST(user_id AS VARCHAR) || '/é' AS decoded, event_type AS csv_second, CAST(event_id AS VARCHAR) AS xml_id,
       event_type = 'click' OR event_type = 'CLICK' AS same_folded
FROM events
""")
def f14_variant_xml_csv_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    csv = F.concat_ws(",", F.col("event_id").cast("string"), "event_type")
    asked = F.url_encode(F.concat(F.lit("user "), F.col("user_id").cast("string"), F.lit("/é")))
    url = F.concat(F.lit("https://"), F.col("event_type"), F.lit(".shop.example/a?u="), asked, F.lit("&b=1"))
    xml = F.concat(F.lit("<e><id>"), F.col("event_id").cast("string"), F.lit("</id></e>"))
    return table(spark, sf_dir, "events").select(
        "event_id", F.variant_get(F.parse_json("props"), "$.k", "int").alias("variant_k"), F.regexp_count("props", F.lit("[0-9]")).alias("digits"),
        F.array_join(F.regexp_extract_all("props", F.lit("[0-9]"), F.lit(0)), "").alias("all_digits"),
        F.parse_url(url, F.lit("HOST")).alias("host"), F.url_decode(F.parse_url(url, F.lit("QUERY"), F.lit("u"))).alias("decoded"),
        F.from_csv(csv, "id long, kind string")["kind"].alias("csv_second"), F.xpath_string(xml, F.lit("e/id")).alias("xml_id"),
        (F.collate("event_type", "UTF8_LCASE") == F.collate(F.lit("CLICK"), "UTF8_LCASE")).alias("same_folded"),
    )


@query("SELECT e.vec_id, round(list_sum(list_transform(list_zip(e.embedding, f.embedding), lambda p: CAST(p[1] AS DOUBLE) * CAST(p[2] AS DOUBLE))), 6) AS dot FROM embeddings e JOIN embeddings f ON f.vec_id = e.vec_id + 1")
def f10_zip_with_dot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dot products of neighbouring vectors, which have unit length."""
    e = table(spark, sf_dir, "embeddings")
    f = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("next"))
    products = F.zip_with("embedding", "next", lambda a, b: a.cast("double") * b.cast("double"))
    return e.join(f, "vec_id").select("vec_id", F.round(F.aggregate(products, F.lit(0.0), lambda s, x: s + x), 6).alias("dot"))


@query("""
SELECT event_id, event_id AS id, event_type AS kind, CASE WHEN event_id % 3 <> 0 THEN value END AS value, CAST(event_id % 4 AS INTEGER) AS tags, event_id % 7 = 0 AS broken FROM events
""")
def f14_from_xml(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as XML with attributes, repeated elements, ones that are missing, and records that don't parse."""
    tags = F.array_join(F.transform(F.when(F.col("event_id") % 4 > 0, F.sequence(F.lit(1), (F.col("event_id") % 4).cast("int"))).otherwise(F.array().cast("array<int>")), lambda i: F.concat(F.lit("<tag>"), i.cast("string"), F.lit("</tag>"))), "")
    value = F.when(F.col("event_id") % 3 != 0, F.concat(F.lit("<value>"), F.col("value").cast("string"), F.lit("</value>"))).otherwise("")
    whole = F.concat(F.lit('<e id="'), F.col("event_id").cast("string"), F.lit('"><kind>'), F.col("event_type"), F.lit("</kind>"), value, tags, F.lit("</e>"))
    torn = F.concat(F.lit("<e><kind>"), F.col("event_type"))
    schema = "_id long, kind string, value double, tag array<int>, bad string"
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "bad"}
    rows = table(spark, sf_dir, "events").select("event_id", F.from_xml(whole, schema, options).alias("x"), F.from_xml(F.when(F.col("event_id") % 7 == 0, torn).otherwise(whole), schema, options).alias("y"))
    return rows.select("event_id", F.col("x._id").alias("id"), "x.kind", "x.value", F.coalesce(F.size("x.tag"), F.lit(0)).alias("tags"), F.col("y.bad").isNotNull().alias("broken"))
