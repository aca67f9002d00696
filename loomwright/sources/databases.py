"""Tables of databases by JDBC: reads in parts with filters pushed down, writes in batches, tables in parts for clusters without a server."""

from __future__ import annotations

import glob
import os
import re
import shutil
import subprocess
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from functools import partial, reduce

import pyarrow as pa
import pyarrow.csv
import pyspark
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwright.registry import query
from loomwright.session import table
from loomwright.sources.files import shared_folder

#: Rows that a task sends or fetches at once.
BATCH = 10_000

#: Rows of a part, at most, where a table lies in parts.
PART_ROWS = 250_000

DERBY = "org.apache.derby.iapi.jdbc.AutoloadedDriver"


def read_jdbc(spark: SparkSession, url: str, name: str, column: str | None = None, parts: int = 8, quote: str = '"', **options: str) -> DataFrame:
    """A table of a database, read by `parts` tasks at once, each a range of a whole-number or date column.

    The database is asked for the ends of the ranges. Rows with a null there are in the first range.
    Filters and the choice of columns go to the database. Without a column one task reads all. Spark
    quotes the names of columns; `quote` is the mark that the database has for that.
    """

    def source(**more: str) -> DataFrame:
        return spark.read.format("jdbc").options(url=url, fetchsize=str(BATCH), preferTimestampNTZ="true", **options, **more).load()

    if column is None:
        return source(dbtable=name)
    ends = source(query=f"SELECT MIN({quote}{column}{quote}) AS least, MAX({quote}{column}{quote}) AS most FROM {name}").first()
    if ends[0] is None:
        return source(dbtable=name)
    return source(dbtable=name, partitionColumn=column, lowerBound=str(ends[0]), upperBound=str(ends[1]), numPartitions=str(parts))


def write_jdbc(df: DataFrame, url: str, name: str, parts: int = 8, mode: str = "errorifexists", types: str | None = None, **options: str) -> None:
    """Write df as a table, by at most `parts` connections, in batches; a part is one transaction.

    `types` gives columns other types than the database's usual ones ("name VARCHAR(20), ..."). If a
    part fails and runs again its rows were rolled back; if the whole job fails, finished parts stay, as
    databases know no transaction over connections: write to a new name, then rename.
    """
    more = {"createTableColumnTypes": types} if types else {}
    df.write.format("jdbc").options(url=url, dbtable=name, numPartitions=str(parts), batchsize=str(BATCH), **more, **options).mode(mode).save()


def quoted(name: str) -> str:
    return f"`{name.replace('`', '``')}`"


def local(spark: SparkSession) -> bool:
    return spark.sparkContext.master.split("[")[0] == "local"


def derby_folder(spark: SparkSession) -> str:
    """A new name in the shared folder for Derby, which opens files by their path; its log lies beside it."""
    folder = shared_folder(spark)
    if re.match(r"(?!file:)\w+:", folder):
        raise RuntimeError(f"Derby opens files by their path, which {folder} is not; give the url of a server that all executors reach")
    folder = re.sub("^file:/+", "/", folder)
    spark._jvm.java.lang.System.setProperty("derby.stream.error.file", f"{folder}.log")
    return folder


def embedded(spark: SparkSession) -> dict[str, str]:
    """Options for a new database inside this process: Derby, which Spark brings along.

    It is open to one process alone, so only to a local master. A cluster names a server's url, or has
    its tables in parts (`write_parts`).
    """
    if not local(spark):
        raise RuntimeError("an embedded database is open to one process; give the url of a server that all executors reach")
    return {"url": f"jdbc:derby:{derby_folder(spark)};create=true", "driver": DERBY}


def pack(database: str, jar: str) -> None:
    """A closed Derby database as a jar, which any number of processes may open and none may change.

    Scans have no use for a large cache, and a process that has opened a part keeps it open.
    """
    with zipfile.ZipFile(jar, "w") as z:  # not compressed: Derby reads a compressed one anew from its start for every step back
        for path in sorted(glob.glob(f"{database}/**", recursive=True)):
            if os.path.isfile(path) and not path.endswith(("/service.properties", ".lck")):
                z.write(path, f"db/{os.path.relpath(path, database)}")
        with open(f"{database}/service.properties", encoding="latin-1") as settings:
            z.writestr("db/service.properties", (settings.read() + "\nderby.storage.pageCacheSize=40\n").encode("latin-1"))


def ij(statements: str, folder: str) -> str:
    """What Derby's command line says to some statements, in a process of its own that ends with them."""
    java = shutil.which("java", path=f"{os.environ.get('JAVA_HOME', '')}/bin") or "java"
    jars = glob.glob(f"{os.environ.get('SPARK_HOME') or os.path.dirname(pyspark.__file__)}/jars/derby*.jar")
    more = [f"-Dderby.stream.error.file={folder}/derby.log", "-Dderby.system.durability=test", "-Duser.timezone=UTC", "-Dij.maximumDisplayWidth=400"]
    command = [java, "-Xmx192m", "-XX:+UseSerialGC", "-XX:TieredStopAtLevel=1", *more, "-cp", ":".join(jars), "org.apache.derby.tools.ij"]
    return subprocess.run(command, input=statements, stdout=subprocess.PIPE, stderr=subprocess.STDOUT, text=True).stdout


def loader(template: str, folder: str, name: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function that makes a database of a task's rows: a copy of the template, filled by Derby's import of CSV."""

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, writer, at = 0, None, os.path.realpath(tempfile.mkdtemp())
        try:
            for batch in batches:
                writer = writer or pyarrow.csv.CSVWriter(f"{at}/rows.csv", batch.schema, write_options=pyarrow.csv.WriteOptions(include_header=False))
                writer.write_batch(batch)
                rows += batch.num_rows
            if not rows:
                return
            writer.close()
            said = ij(
                f"connect 'jdbc:derby:{at}/db;createFrom={template}';\n"
                f"CALL SYSCS_UTIL.SYSCS_IMPORT_TABLE(NULL, '{name.upper()}', '{at}/rows.csv', ',', '\"', 'UTF-8', 1);\n"
                f"SELECT 'rows ' || CAST(COUNT(*) AS CHAR(20)) FROM {name};\nconnect 'jdbc:derby:{at}/db;shutdown=true';\n",
                at,
            )
            if f"rows {rows} " not in said:
                raise RuntimeError(f"{rows} rows were to be loaded; Derby says: {said[-2000:]}")
            jar = f"{folder}/{uuid.uuid4().hex}.jar"
            pack(f"{at}/db", jar)
        finally:
            shutil.rmtree(at, ignore_errors=True)
        yield pa.RecordBatch.from_pydict({"jar": [jar]})

    return load


def write_parts(df: DataFrame, name: str, parts: int = 4, types: str | None = None) -> list[str]:
    """Write df as a table in parts, each a Derby database of its own in the shared folder; their urls.

    For clusters without a server: a task makes a part of at most about `PART_ROWS` rows, and only the
    parts of tasks that succeeded are named. Nobody has them open afterwards, and they are read-only.
    Columns have the types that `write_jdbc` gives them; an instant is kept as the session's wall clock,
    as `read_jdbc` returns it. There are at least `parts` parts, if there are so many rows. Rows are
    counted first, so df is read twice. The shared folder must have the same path everywhere.
    """
    spark, folder = df.sparkSession, derby_folder(df.sparkSession)
    os.makedirs(folder)
    template = f"jdbc:derby:{folder}/template"
    write_jdbc(df.limit(0), f"{template};create=true", name, types=types, driver=DERBY)
    try:
        spark._jvm.org.apache.derby.iapi.jdbc.AutoloadedDriver().connect(f"{template};shutdown=true", spark._jvm.java.util.Properties())
    except Py4JJavaError as e:
        if e.java_exception.getSQLState() != "08006":  # "database shutdown"
            raise
    as_csv = {"binary": F.hex, "timestamp": lambda c: c.cast("timestamp_ntz")}
    rows = df.select(*(as_csv.get(kind, lambda c: c)(F.col(quoted(c))).alias(f"c{i}") for i, (c, kind) in enumerate(df.dtypes)))
    n = df.count()
    dealt = rows.repartition(max(1, min(parts, n), -(-n // PART_ROWS)))
    jars = [r.jar for r in dealt.mapInArrow(loader(f"{folder}/template", folder, name), "jar string").collect()]
    if not jars:
        jars = [f"{folder}/empty.jar"]
        pack(f"{folder}/template", jars[0])
    return [f"jdbc:derby:jar:({jar})db" for jar in jars]


def read_parts(spark: SparkSession, urls: list[str], name: str) -> DataFrame:
    """A table that lies in parts: a task reads a part, filters and the choice of columns go to its database.

    Timestamps are fetched as text, as JDBC's own would be moved by Java's zone and, before 1582, its
    calendar; so filters on them are Spark's. Derby itself moves only the hour that the executors' zone
    skips each spring, so that zone should be UTC. All parts have the columns of the first.
    """
    source = partial(read_jdbc, spark, name=name, driver=DERBY)
    first = source(urls[0])
    moved = [quoted(c) for c, kind in first.dtypes if kind == "timestamp_ntz"]
    if not moved:
        return reduce(DataFrame.unionAll, map(source, urls[1:]), first)
    found = reduce(DataFrame.unionAll, (source(url, customSchema=", ".join(f"{c} STRING" for c in moved)) for url in urls))
    return found.select(*(F.col(c).cast("timestamp_ntz").alias(x) if (c := quoted(x)) in moved else F.col(c) for x in found.columns))


def _orders(spark: SparkSession, sf_dir: str, compared: tuple[str, ...] = ()) -> DataFrame:
    """The orders table, after it was written to a database: one in this process, or in parts on a cluster.

    Texts are short VARCHARs if all fit and none is null, as CLOBs and Derby's large pages take far more
    memory; else CLOBs, or the longest VARCHAR for those that the database compares.
    """
    orders, short = table(spark, sf_dir, "orders"), {"o_orderstatus": 8, "o_orderpriority": 32}
    others = orders.agg(*(F.count_if(F.coalesce(F.octet_length(c) > n, F.lit(True))).alias(c) for c, n in short.items())).first()
    types = ", ".join(f"{c} VARCHAR({32672 if others[c] else n})" for c, n in short.items() if c in compared or not others[c]) or None
    if not local(spark):
        return read_parts(spark, write_parts(orders, "orders", types=types), "orders")
    to = embedded(spark)
    write_jdbc(orders, name="orders", types=types, **to)
    return read_jdbc(spark, name="orders", column="o_orderkey", parts=4, **to)


@query("SELECT * FROM orders")
def s7_jdbc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orders(spark, sf_dir)


@query("SELECT o_custkey, count(*) AS n, max(o_orderdate) AS latest FROM orders WHERE o_totalprice > 100000 AND o_orderstatus = 'F' GROUP BY o_custkey")
def s7_jdbc_pushed_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The database filters; three columns come back."""
    found = _orders(spark, sf_dir, compared=("o_orderstatus",)).filter("o_totalprice > 100000 and o_orderstatus = 'F'")
    return found.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.max("o_orderdate").alias("latest"))
