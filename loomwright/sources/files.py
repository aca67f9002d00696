"""Sources and sinks."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from loomwright.registry import query
from loomwright.session import table

#: Formats that need a module or a driver which Spark doesn't bring along.
EXTERNAL = {"avro": "spark-avro", "delta": "delta-spark", "kafka": "spark-sql-kafka-0-10", "iceberg": "iceberg-spark-runtime", "jdbc": "the database's JDBC driver"}


def shared_folder(spark: SparkSession) -> str:
    """A new folder that all executors see; a local one only where the executors are this process."""
    base = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="loomwright-")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
    return f"{base}/files-{uuid.uuid4().hex}"


def settled(df: DataFrame) -> DataFrame:
    """df as it is now, written to the shared folder and read again: it stays the same however often it is used."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_external(spark: SparkSession, kind: str, **options: str) -> DataFrame:
    """Read avro, delta, kafka, iceberg or jdbc where its module is installed; else say what is missing."""
    try:
        return spark.read.format(kind).options(**options).load()
    except Exception as e:
        if "Failed to find data source" in str(e) or "DATA_SOURCE_NOT_FOUND" in str(e) or "No suitable driver" in str(e):
            raise RuntimeError(f"reading {kind} needs {EXTERNAL.get(kind, kind)} on Spark's class path") from e
        raise


def round_trip(spark: SparkSession, df: DataFrame, kind: str, **options: str) -> DataFrame:
    """What comes back of df when it is written and read in a format."""
    path = shared_folder(spark)
    df.write.format(kind).options(**options).save(path)
    return spark.read.format(kind).options(**options).schema(df.schema).load(path)


@query("SELECT l_orderkey, l_quantity FROM lineitem WHERE l_quantity > 45 AND l_shipdate >= TIMESTAMP '1997-01-01'")
def s1_parquet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filter and columns reach the scan."""
    lines = table(spark, sf_dir, "lineitem").filter("l_quantity > 45 and l_shipdate >= timestamp_ntz'1997-01-01'")
    return lines.select("l_orderkey", "l_quantity")


CUSTOMER = "SELECT * FROM customer"


def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer")


@query(CUSTOMER)
def s2_parquet_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(spark, _customers(spark, sf_dir), "parquet")


@query(CUSTOMER)
def s2_orc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(spark, _customers(spark, sf_dir), "orc")


@query(CUSTOMER)
def s2_json_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(spark, _customers(spark, sf_dir), "json")


@query(CUSTOMER)
def s2_csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(spark, _customers(spark, sf_dir), "csv", header="true")


#: Rows in one file of XML, at most, as a task reads a file whole.
XML_ROWS = 100_000


@query(CUSTOMER)
def s3_xml_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(spark, _customers(spark, sf_dir), "xml", rowTag="customer", rootTag="customers", maxRecordsPerFile=str(XML_ROWS))


@query("SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY o_orderstatus")
def s2_partitioned_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written by a partition column, read with the other partitions pruned."""
    path = shared_folder(spark)
    table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus").write.partitionBy("o_orderstatus").parquet(path)
    return spark.read.parquet(path).filter("o_orderstatus = 'F'").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


class Span(InputPartition):
    def __init__(self, first: int, last: int):
        self.first, self.last = first, last


class SquaresReader(DataSourceReader):
    def __init__(self, options: dict):
        self.n, self.parts = int(options.get("n", 100)), int(options.get("parts", 4))

    def partitions(self) -> list[Span]:
        return [Span(self.n * i // self.parts, self.n * (i + 1) // self.parts) for i in range(self.parts)]

    def read(self, partition: Span):
        return ((i, i * i) for i in range(partition.first, partition.last))


class Squares(DataSource):
    """A source written in Python: the numbers below `n` and their squares, in `parts` partitions."""

    @classmethod
    def name(cls) -> str:
        return "loomwright_squares"

    def schema(self) -> str:
        return "i bigint, square bigint"

    def reader(self, schema) -> SquaresReader:
        return SquaresReader(self.options)


@query("SELECT c_custkey, square FROM customer JOIN (SELECT i, i * i AS square FROM (SELECT unnest(range(0, (SELECT max(c_custkey) + 1 FROM customer))) AS i)) ON c_custkey = i")
def s5_python_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many squares as there are keys of customers, a task for each 100,000, joined to them."""
    spark.dataSource.register(Squares)
    customer = table(spark, sf_dir, "customer").select("c_custkey")
    n = (customer.agg(F.max("c_custkey")).first()[0] or 0) + 1
    squares = spark.read.format("loomwright_squares").option("n", n).option("parts", -(-n // 100_000)).load()
    return customer.join(squares, F.col("c_custkey") == F.col("i")).select("c_custkey", "square")
