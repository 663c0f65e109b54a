"""Spark data source `sqlite_gz`: a table of a (gzip-compressed) SQLite database file.

    spark.dataSource.register(SQLiteGz)
    spark.read.format("sqlite_gz").option("path", "dump.sqlite3.gz").option("table", "tracks").load()

Options: path; table; scratch (a folder that all executors share, for the
decompressed file; the file's own folder if not given); partitions (8).

Gzip can't be split, so the file is decompressed once, streamed, and renamed into
place when whole. After that each task opens it read-only and reads its own range
of row ids, so tasks are independent and can be run again. Text that isn't valid
in the file's encoding is read with replacement characters.
"""

from __future__ import annotations

import gzip
import os
import shutil
import sqlite3
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

BATCH = 4096


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def _plain_file(path: str, scratch: str | None) -> str:
    """The decompressed file; made once, and found again by name, size and time."""
    with open(path, "rb") as f:
        if f.read(2) != b"\x1f\x8b":
            return path
    st = os.stat(path)
    to = os.path.join(scratch or os.path.dirname(os.path.abspath(path)), f".{os.path.basename(path)}.{st.st_size}.{st.st_mtime_ns}.sqlite")
    if not os.path.exists(to):
        part = f"{to}.{uuid.uuid4().hex}"
        with gzip.open(path, "rb") as src, open(part, "wb") as dst:
            shutil.copyfileobj(src, dst, 16 << 20)
        os.replace(part, to)
    return to


def _open(path: str) -> sqlite3.Connection:
    with open(path, "rb") as f:
        if f.read(16) != b"SQLite format 3\0":
            raise ValueError(f"{path} isn't an SQLite database")
    db = sqlite3.connect(f"file:{path}?mode=ro&immutable=1", uri=True)
    db.text_factory = lambda b: b.decode("utf-8", "replace")
    return db


def _type(declared: str) -> T.DataType:
    """Column affinity, by SQLite's own rules, as a Spark type."""
    d = declared.upper()
    if "INT" in d:
        return T.LongType()
    if any(x in d for x in ("CHAR", "CLOB", "TEXT", "DATE", "TIME")):
        return T.StringType()
    if "BLOB" in d:
        return T.BinaryType()
    if any(x in d for x in ("REAL", "FLOA", "DOUB")):
        return T.DoubleType()
    return T.StringType()


def list_tables(path: str, scratch: str | None = None) -> list[str]:
    """Names of a database's own tables, in the order in which they were made."""
    db = _open(_plain_file(path, scratch))
    try:
        return [r[0] for r in db.execute("SELECT name FROM sqlite_master WHERE type = 'table' AND name NOT LIKE 'sqlite\\_%' ESCAPE '\\' ORDER BY rowid")]
    finally:
        db.close()


class SQLiteGz(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sqlite_gz"

    def _file(self) -> str:
        return _plain_file(self.options["path"], self.options.get("scratch"))

    def schema(self) -> T.StructType:
        db = _open(self._file())
        try:
            cols = db.execute(f"PRAGMA table_info({_quoted(self.options['table'])})").fetchall()
        finally:
            db.close()
        if not cols:
            raise ValueError(f"no table {self.options['table']}")
        return T.StructType([T.StructField(c[1], _type(c[2])) for c in cols])

    def reader(self, schema: T.StructType) -> SQLiteReader:
        return SQLiteReader(self._file(), self.options["table"], schema, int(self.options.get("partitions", 8)))


class Rows(InputPartition):
    def __init__(self, low: int, high: int) -> None:
        self.low, self.high = low, high


class SQLiteReader(DataSourceReader):
    def __init__(self, file: str, table: str, schema: T.StructType, partitions: int) -> None:
        self.file, self.table, self.fields, self.n = file, table, schema.fields, partitions

    def partitions(self) -> list[Rows]:
        db = _open(self.file)
        try:
            low, high = db.execute(f"SELECT min(rowid), max(rowid) FROM {_quoted(self.table)}").fetchone()
        finally:
            db.close()
        if low is None:
            return [Rows(0, -1)]
        step = -(-(high - low + 1) // self.n)
        return [Rows(a, min(a + step - 1, high)) for a in range(low, high + 1, step)]

    def read(self, partition: Rows) -> Iterator[pa.RecordBatch]:
        cast = {"bigint": int, "double": float, "string": str, "binary": bytes}
        kinds = {"bigint": pa.int64(), "double": pa.float64(), "string": pa.string(), "binary": pa.binary()}
        types = [f.dataType.simpleString() for f in self.fields]

        def value(v, t: str):
            if v is None or isinstance(v, cast[t]):
                return v
            if t == "binary":
                return str(v).encode()
            if isinstance(v, bytes):
                v = v.decode("utf-8", "replace")
            try:
                return cast[t](v)
            except ValueError:
                return None

        schema = pa.schema([(f.name, kinds[t]) for f, t in zip(self.fields, types, strict=True)])
        db = _open(self.file)
        try:
            cur = db.execute(f"SELECT {', '.join(_quoted(f.name) for f in self.fields)} FROM {_quoted(self.table)} WHERE rowid BETWEEN ? AND ?", (partition.low, partition.high))
            while rows := cur.fetchmany(BATCH):
                cols = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array([value(v, t) for v in c], kinds[t]) for c, t in zip(cols, types, strict=True)], schema=schema)
        finally:
            db.close()
