"""A data source written in Python: a table of immutable files with a log of commits.

A write puts its files into a folder of its own, which no reader looks at, and then adds one commit to
the log: the names of the files, with the least and greatest value of each column. So a write is there
as a whole or not at all. A read takes over comparisons with constants: files whose values can't match
are left out, and the rest are filtered as they are read. A stream reads commit after commit.
"""

from __future__ import annotations

import datetime as dt
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    DataSourceStreamReader,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    IsNotNull,
    LessThan,
    LessThanOrEqual,
    WriterCommitMessage,
)
from pyspark.sql.types import StructType

from loomwright.registry import query
from loomwright.session import table
from loomwright.sources.files import shared_folder

COMPARED = {EqualTo: pc.equal, GreaterThan: pc.greater, GreaterThanOrEqual: pc.greater_equal, LessThan: pc.less, LessThanOrEqual: pc.less_equal}
#: Rows in one file, about, and rows that a task holds before it writes them to it.
FILE_ROWS, HELD_ROWS = 1 << 20, 1 << 16


class Store:
    """Files and commits below a folder, in any file system that Arrow knows by its URI."""

    def __init__(self, uri: str):
        self.files, self.root = fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)

    def commits(self) -> list[str]:
        found = self.files.get_file_info(fs.FileSelector(f"{self.root}/log", allow_not_found=True))
        return sorted(f.path for f in found if f.path.endswith(".json"))

    def entries(self, first: int = 0, end: int | None = None) -> list[dict]:
        """The files of the commits from number first up to end."""
        out = []
        for path in self.commits()[first:end]:
            with self.files.open_input_stream(path) as f:
                out += json.loads(f.read())
        return out

    def commit(self, entries: list[dict]) -> None:
        """Write the entries under another name, then give them the next number."""
        self.files.create_dir(f"{self.root}/log")
        pending = f"{self.root}/log/{uuid.uuid4().hex}.pending"
        with self.files.open_output_stream(pending) as f:
            f.write(json.dumps(entries).encode())
        self.files.move(pending, f"{self.root}/log/{len(self.commits()):012d}.json")

    def drop(self, folder: str) -> None:
        if self.files.get_file_info(f"{self.root}/{folder}").type == fs.FileType.Directory:
            self.files.delete_dir(f"{self.root}/{folder}")


def plain(value: object) -> object:
    """A value as JSON has it; times as text that sorts like them."""
    return value.isoformat(sep=" ", timespec="microseconds") if isinstance(value, dt.datetime) else value.isoformat() if isinstance(value, dt.date) else value


def ranges(t: pa.Table) -> dict[str, list]:
    """Least and greatest value of each column that has an order which JSON keeps."""
    out = {}
    for name in t.column_names:
        kind = t.schema.field(name).type
        if pa.types.is_integer(kind) or pa.types.is_string(kind) or pa.types.is_timestamp(kind) or pa.types.is_date(kind):
            found = pc.min_max(t[name]).as_py()
            if found["min"] is not None:
                out[name] = [plain(found["min"]), plain(found["max"])]
    return out


@dataclass
class File(InputPartition):
    path: str


@dataclass
class Written(WriterCommitMessage):
    entries: list


def batches_of(store: Store, path: str, names: list[str], tests: list[Filter]) -> Iterator[pa.RecordBatch]:
    """The columns of one file, of the rows that pass."""
    needed = [*names, *[n for n in dict.fromkeys(t.attribute[0] for t in tests) if n not in names]]
    with store.files.open_input_file(f"{store.root}/{path}") as f:
        for batch in pq.ParquetFile(f).iter_batches(columns=needed):
            keep = None
            for t in tests:
                column = batch.column(t.attribute[0])
                if isinstance(t, IsNotNull):
                    ok = pc.is_valid(column)
                elif isinstance(t, In):
                    ok = pc.is_in(column, pa.array(list(t.value), column.type))
                else:
                    ok = COMPARED[type(t)](column, pa.scalar(t.value, column.type))
                keep = ok if keep is None else pc.and_kleene(keep, ok)
            batch = batch.select(names)
            yield batch if keep is None else batch.filter(keep)


def may_hold(entry: dict, test: Filter) -> bool:
    """Whether a file with these ranges can have a row that passes."""
    if isinstance(test, IsNotNull) or test.attribute[0] not in entry["ranges"]:
        return True
    low, high = entry["ranges"][test.attribute[0]]
    if isinstance(test, In):
        return any(low <= plain(v) <= high for v in test.value)
    v = plain(test.value)
    if isinstance(test, EqualTo):
        return low <= v <= high
    if isinstance(test, GreaterThan):
        return high > v
    if isinstance(test, GreaterThanOrEqual):
        return high >= v
    return low < v if isinstance(test, LessThan) else low <= v


class LoggedReader(DataSourceReader):
    def __init__(self, uri: str, schema: StructType):
        self.uri, self.names, self.tests = uri, schema.names, []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, (In, IsNotNull, *COMPARED)) and len(f.attribute) == 1 and not (hasattr(f, "value") and f.value is None):
                self.tests.append(f)
            else:
                yield f

    def partitions(self) -> list[File]:
        return [File(e["path"]) for e in Store(self.uri).entries() if all(may_hold(e, t) for t in self.tests)]

    def read(self, partition: File | None) -> Iterator[pa.RecordBatch]:
        if partition is not None:
            yield from batches_of(Store(self.uri), partition.path, self.names, self.tests)


class LoggedStream(DataSourceStreamReader):
    """Offsets are numbers of commits, so a commit is read whole, once."""

    def __init__(self, uri: str, schema: StructType):
        self.uri, self.names = uri, schema.names

    def initialOffset(self) -> dict:
        return {"commits": 0}

    def latestOffset(self) -> dict:
        return {"commits": len(Store(self.uri).commits())}

    def partitions(self, start: dict, end: dict) -> list[File]:
        return [File(e["path"]) for e in Store(self.uri).entries(start["commits"], end["commits"])]

    def read(self, partition: File) -> Iterator[pa.RecordBatch]:
        return batches_of(Store(self.uri), partition.path, self.names, [])


class LoggedWriter(DataSourceArrowWriter):
    def __init__(self, uri: str, overwrite: bool):
        if overwrite:
            raise ValueError("files are immutable: append to the table, or write another one")
        self.uri, self.folder = uri, f"data/{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, entries = Store(self.uri), []
        store.files.create_dir(f"{store.root}/{self.folder}")
        batches = iter(iterator)
        for batch in batches:
            entries.append(self.put(store, batch, batches))
        return Written([e for e in entries if e["rows"]])

    def put(self, store: Store, first: pa.RecordBatch, more: Iterator[pa.RecordBatch]) -> dict:
        """A file with the first batch and as many more as it takes, of which HELD_ROWS rows are in memory; its entry."""
        path, found, held, n = f"{self.folder}/{uuid.uuid4().hex}.parquet", {}, [first], first.num_rows
        with store.files.open_output_stream(f"{store.root}/{path}") as f, pq.ParquetWriter(f, first.schema) as out:

            def flush() -> None:
                t = pa.Table.from_batches(held, first.schema)
                held.clear()
                out.write_table(t)
                for name, (low, high) in ranges(t).items():
                    least, most = found.get(name, (low, high))
                    found[name] = [min(low, least), max(high, most)]

            waiting = n
            while n < FILE_ROWS and (batch := next(more, None)) is not None:
                held.append(batch)
                n, waiting = n + batch.num_rows, waiting + batch.num_rows
                if waiting >= HELD_ROWS:
                    flush()
                    waiting = 0
            flush()
        return {"path": path, "rows": n, "ranges": found}

    def commit(self, messages: list[Written | None]) -> None:
        """Only files of tasks that were told of here are named, so what a task left that ran twice is no part."""
        Store(self.uri).commit([e for m in messages if m is not None for e in m.entries])

    def abort(self, messages: list[Written | None]) -> None:
        Store(self.uri).drop(self.folder)


class Logged(DataSource):
    """format("loomwright_logged").option("path", uri), with the schema given for reads."""

    @classmethod
    def name(cls) -> str:
        return "loomwright_logged"

    def reader(self, schema: StructType) -> LoggedReader:
        return LoggedReader(self.options["path"], schema)

    def streamReader(self, schema: StructType) -> LoggedStream:
        return LoggedStream(self.options["path"], schema)

    def writer(self, schema: StructType, overwrite: bool) -> LoggedWriter:
        return LoggedWriter(self.options["path"], overwrite)


def registered(spark: SparkSession) -> str:
    """The source's name, after it was made known to the session and its filters were switched on."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Logged)
    return Logged.name()


def _written(spark: SparkSession, sf_dir: str) -> tuple[str, DataFrame]:
    """The folder of a logged table with the events, in two commits, and the events."""
    name, path, events = registered(spark), shared_folder(spark), table(spark, sf_dir, "events")
    for part in (events.filter("ts < timestamp_ntz'2024-01-15'"), events.filter("ts >= timestamp_ntz'2024-01-15'")):
        part.write.format(name).option("path", path).mode("append").save()
    return path, events


@query("SELECT event_id, user_id, ts FROM events WHERE event_type = 'click' AND ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-20'")
def s5_python_source_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written and read by the source; the filters are its own work."""
    path, events = _written(spark, sf_dir)
    found = spark.read.format(Logged.name()).schema(events.schema).option("path", path).load()
    found = found.filter("event_type = 'click' and ts >= timestamp_ntz'2024-01-10' and ts < timestamp_ntz'2024-01-20'")
    return found.select("event_id", "user_id", "ts")


@query("SELECT user_id, count(*) AS n FROM events GROUP BY user_id")
def s5_python_source_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same table as a stream of its commits."""
    from loomwright.streaming.events import finished

    path, events = _written(spark, sf_dir)
    rows = spark.readStream.format(Logged.name()).schema(events.schema).option("path", path).load()
    return finished(rows.groupBy("user_id").agg(F.count(F.lit(1)).alias("n")), "complete")
