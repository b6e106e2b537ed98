"""SQLite files as a Spark data source: a table of one file or of all files of a folder, in partitions by ranges of row numbers.

Files on a mounted path are opened where they lie, so their size does not matter and a task reads its range only; files elsewhere are
copied to a local file for as long as a task reads them, and are one partition each. Only the schema's columns are read, comparisons can be
part of the reading query, and a column or table that a file lacks is null or has no rows.
"""

from __future__ import annotations

import json
import os
import shutil
import sqlite3
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import closing, contextmanager
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

ROWS = 100_000
DEFINITIONS = "select m.name as name, p.name as col from sqlite_master m join pragma_table_info(m.name) p where m.type = 'table'"
SIGNS = ("=", ">", ">=", "<", "<=", "<>", "is null", "is not null")


def files_at(path: str) -> list[str]:
    """The file, or the files of the folder in order."""
    system, name = arrow_fs.FileSystem.from_uri(path)
    kind = system.get_file_info(name).type
    if kind == arrow_fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if kind != arrow_fs.FileType.Directory:
        return [path]
    found = [i.path for i in system.get_file_info(arrow_fs.FileSelector(name)) if i.type == arrow_fs.FileType.File and not i.base_name.startswith((".", "_"))]
    return sorted(f if isinstance(system, arrow_fs.LocalFileSystem) else f"{path.rstrip('/')}/{os.path.basename(f)}" for f in found)


def _is_local(path: str) -> bool:
    return isinstance(arrow_fs.FileSystem.from_uri(path)[0], arrow_fs.LocalFileSystem)


@contextmanager
def opened(path: str) -> Iterator[sqlite3.Connection]:
    system, name = arrow_fs.FileSystem.from_uri(path)
    if isinstance(system, arrow_fs.LocalFileSystem):
        with closing(sqlite3.connect(f"file:{quote(name)}?mode=ro&immutable=1", uri=True)) as db:
            yield db
        return
    with tempfile.NamedTemporaryFile(suffix=".sqlite") as local:
        with system.open_input_stream(name) as source:
            shutil.copyfileobj(source, local)
        local.flush()
        with closing(sqlite3.connect(f"file:{local.name}?mode=ro&immutable=1", uri=True)) as db:
            yield db


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


@dataclass
class Range(ds.InputPartition):
    path: str
    first: int | None = None
    last: int | None = None


class SqliteReader(ds.DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.schema, self.path, self.table = schema, options["path"], options.get("table")
        self.query, self.rows = options.get("query"), int(options.get("rows", ROWS))
        self.where = [tuple(c) for c in json.loads(options.get("where", "[]"))]
        if bad := [c for c in self.where if c[1] not in SIGNS or c[0] not in schema.names]:
            raise ValueError(f"not a condition on a column that is read: {bad[0]}")

    def partitions(self) -> list[Range]:
        out = []
        for path in files_at(self.path):
            if self.query or not _is_local(path):
                out.append(Range(path))
                continue
            with opened(path) as db:
                if not db.execute("select 1 from sqlite_master where type = 'table' and name = ?", (self.table,)).fetchone():
                    continue
                first, last = db.execute(f"select min(rowid), max(rowid) from {_quoted(self.table)}").fetchone()
            if first is not None:
                out += [Range(path, a, min(a + self.rows - 1, last)) for a in range(first, last + 1, self.rows)]
        return out or [Range("")]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        target = to_arrow_schema(self.schema)
        if not partition.path:
            return
        with opened(partition.path) as db:
            values: list = []
            if self.query:
                sql = self.query
            else:
                have = {r[1] for r in db.execute(f"pragma table_info({_quoted(self.table)})")}
                if not have:
                    return
                place = lambda c: _quoted(c) if c in have else "null"
                where = ["1"]
                if partition.first is not None:
                    where.append("rowid between ? and ?")
                    values += [partition.first, partition.last]
                for column, sign, value in self.where:
                    where.append(f"{place(column)} {sign}" + (" ?" if not sign.startswith("is") else ""))
                    values += [value] * (not sign.startswith("is"))
                sql = f"select {', '.join(place(c) for c in self.schema.names) or '1'} from {_quoted(self.table)} where {' and '.join(where)}"
            cursor = db.execute(sql, values)
            while rows := cursor.fetchmany(10_000):
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), target, strict=True)], schema=target)


class SqliteSource(ds.DataSource):
    """spark.read.format("sqlite_table").schema(..).option("path", ..).option("table", ..): options rows (of a partition), query (instead of a table), where."""

    @classmethod
    def name(cls) -> str:
        return "sqlite_table"

    def schema(self) -> str:
        raise ValueError("give the columns to read as the schema")

    def reader(self, schema: StructType) -> SqliteReader:
        return SqliteReader(schema, dict(self.options))


def read_table(spark: SparkSession, path: str, table: str, schema: str, rows: int = ROWS, where: list[tuple[str, str, object]] | None = None) -> DataFrame:
    """The columns of `schema` of one table of a file or of all files of a folder. where: (column, sign, value) that the reading query checks, all of them.

    They are told here, as Spark keeps what it pushed into a Python source for one query and applies it to the next query of the same DataFrame.
    """
    spark.dataSource.register(SqliteSource)
    return spark.read.format("sqlite_table").schema(schema).option("path", path).option("table", table).option("rows", str(rows)).option("where", json.dumps(where or [])).load()


def definitions(spark: SparkSession, path: str) -> DataFrame:
    """(name, col): the tables of a file, or of all files of a folder, with their columns."""
    spark.dataSource.register(SqliteSource)
    return spark.read.format("sqlite_table").schema("name string, col string").option("path", path).option("query", DEFINITIONS).load().distinct()


def write_tables(df: DataFrame, path: str, table: str) -> None:
    """df as a table of SQLite files in a folder, one file a task; a task that runs again replaces nothing and leaves its first file unnamed."""
    names = df.columns
    system, folder = arrow_fs.FileSystem.from_uri(path)
    system.create_dir(folder, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with tempfile.NamedTemporaryFile(suffix=".sqlite") as local:
            n = 0
            with closing(sqlite3.connect(local.name)) as db:
                db.execute(f"create table {_quoted(table)} ({', '.join(map(_quoted, names))})")
                for b in batches:
                    db.executemany(f"insert into {_quoted(table)} values ({', '.join('?' * len(names))})", zip(*(c.to_pylist() for c in b.columns), strict=True))
                    n += b.num_rows
                db.commit()
            from pyspark import TaskContext

            system, folder = arrow_fs.FileSystem.from_uri(path)
            own, name = f"{folder}/.{uuid.uuid4().hex}", f"{folder}/{table}-{TaskContext.get().partitionId():06d}.sqlite"
            with open(local.name, "rb") as source, system.open_output_stream(own) as out:
                shutil.copyfileobj(source, out)
            system.move(own, name)
        yield pa.RecordBatch.from_arrays([pa.array([n])], ["n"])

    df.mapInArrow(run, "n long").agg({"n": "sum"}).collect()
