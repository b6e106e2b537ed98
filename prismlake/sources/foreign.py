"""Foreign sources: a photo library's SQLite copy, folders of files, and per-item work that may fail."""

from __future__ import annotations

import re
import sqlite3
import uuid
from collections.abc import Callable, Iterator
from contextlib import closing
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from ..plans.durable import shared_dir, write_file
from . import sqlite

#: Seconds from the Unix epoch to 2001-01-01, the epoch of these libraries.
EPOCH_2001 = 978307200


def _each_database(spark: SparkSession, path: str, schema: str, read: Callable[[sqlite3.Connection], Iterator[tuple]]) -> DataFrame:
    """The rows that `read` finds in the SQLite file at `path`, on any file system: its bytes come through Spark and open in memory."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column(0):
                with closing(sqlite3.connect(":memory:")) as db:
                    db.deserialize(content.as_py())
                    rows = read(db)
                    while part := list(islice(rows, 10_000)):
                        yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in part], schema=target)

    target = to_arrow_schema(_parse_datatype_string(schema))
    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, schema)


def _mounted(path: str) -> bool:
    """Whether the path is one that Python opens on every machine: a mount of a shared folder."""
    return path.startswith(("/", "file:"))


def columns(spark: SparkSession, path: str) -> dict[str, list[str]]:
    """table -> columns of an SQLite file, or of all files of a folder."""

    def read(db: sqlite3.Connection) -> Iterator[tuple]:
        yield from db.execute(sqlite.DEFINITIONS)

    found = sqlite.definitions(spark, path) if _mounted(path) else _each_database(spark, path, "name string, col string", read)
    out: dict[str, list[str]] = {}
    for name, column in found.distinct().collect():  # table definitions
        out.setdefault(name, []).append(column)
    return out


def sqlite_table(spark: SparkSession, path: str, table: str, schema: str) -> DataFrame:
    """One table of an SQLite file or of a folder of them; a column that a file lacks is null. Files that only Spark can read come through it whole, at most 2 GB each."""
    if not re.fullmatch(r"\w+", table):
        raise ValueError("table names are words")
    if _mounted(path):
        return sqlite.read_table(spark, path, table, schema)
    names = [c.split()[0] for c in schema.split(", ")]

    def read(db: sqlite3.Connection) -> Iterator[tuple]:
        have = {r[1] for r in db.execute(f"pragma table_info({table})")}
        if have:
            yield from db.execute(f"select {', '.join(n if n in have else 'null' for n in names)} from {table}")

    return _each_database(spark, path, schema, read)


def scan_library(spark: SparkSession, path: str) -> DataFrame:
    """Assets of a photo library's database copy, in either generation of its schema; trashed and unknown kinds are left out."""
    table = next((t for t in ("ZASSET", "ZGENERICASSET") if t in columns(spark, path)), None)
    if table is None:
        raise ValueError("not a photo library")
    raw = sqlite_table(spark, path, table, "Z_PK long, ZUUID string, ZFILENAME string, ZDIRECTORY string, ZKIND int, ZKINDSUBTYPE int, ZTRASHEDSTATE int, ZDATECREATED double, ZWIDTH long, ZHEIGHT long, ZFAVORITE int, ZHIDDEN int")
    subtype = F.when(F.col("ZKINDSUBTYPE") == 10, 4).when(F.col("ZKINDSUBTYPE") == 2, 8).otherwise(0)
    return raw.filter((F.coalesce("ZTRASHEDSTATE", F.lit(0)) == 0) & F.col("ZKIND").isin(0, 1)).select(
        F.col("Z_PK").alias("source_pk"), F.col("ZUUID").alias("asset_key"), F.col("ZFILENAME").alias("filename"), F.when(F.col("ZKIND") == 1, "video").otherwise("image").alias("media_type"), subtype.alias("subtype"),
        F.timestamp_seconds(F.col("ZDATECREATED") + EPOCH_2001).alias("created_at"), F.col("ZWIDTH").alias("width"), F.col("ZHEIGHT").alias("height"), (F.coalesce("ZFAVORITE", F.lit(0)) == 1).alias("favorite"), (F.coalesce("ZHIDDEN", F.lit(0)) == 1).alias("hidden"),
    )


def scan_albums(spark: SparkSession, path: str) -> DataFrame:
    """(album_id, title, parent_id, asset_key): albums of the user's kinds with their members, from the numbered join table."""
    known = columns(spark, path)
    join = next((t for t in known if re.fullmatch(r"Z_\d+ASSETS", t)), None)
    if join is None:
        raise ValueError("no album table")
    names = known[join]
    album, asset = next(n for n in names if "ALBUMS" in n), next(n for n in names if n.endswith("ASSETS"))
    albums = sqlite_table(spark, path, "ZGENERICALBUM", "Z_PK long, ZTITLE string, ZKIND int, ZPARENTFOLDER long, ZTRASHEDSTATE int")
    albums = albums.filter(F.col("ZKIND").isin(2, 4000, 3999) & (F.coalesce("ZTRASHEDSTATE", F.lit(0)) == 0))
    members = sqlite_table(spark, path, join, f"{album} long, {asset} long").select(F.col(album).alias("Z_PK"), F.col(asset).alias("source_pk"))
    keys = scan_library(spark, path).select("source_pk", "asset_key")
    return albums.join(members.join(keys, "source_pk"), "Z_PK", "left").select(F.col("Z_PK").alias("album_id"), F.col("ZTITLE").alias("title"), F.col("ZPARENTFOLDER").alias("parent_id"), "asset_key")


def _demo(spark: SparkSession) -> str:
    """A small library of the newer schema, in the shared folder."""
    with closing(sqlite3.connect(":memory:")) as db:
        db.executescript("""
            create table ZASSET (Z_PK integer primary key, ZUUID text, ZFILENAME text, ZKIND int, ZKINDSUBTYPE int, ZTRASHEDSTATE int, ZDATECREATED real);
            create table ZGENERICALBUM (Z_PK integer primary key, ZTITLE text, ZKIND int, ZPARENTFOLDER int, ZTRASHEDSTATE int);
            create table Z_28ASSETS (Z_28ALBUMS int, Z_3ASSETS int);
            insert into ZASSET values (1, 'a', 'IMG_1.HEIC', 0, 10, 0, 0), (2, 'b', 'IMG_2.MOV', 1, 0, 0, 60), (3, 'c', 'IMG_3.JPG', 0, 2, 1, 120), (4, 'd', 'x.bin', 7, 0, 0, 180), (5, 'e', 'IMG_5.JPG', 0, 2, 0, 240);
            insert into ZGENERICALBUM values (10, 'Root', 3999, null, 0), (11, 'Trip', 2, 10, 0), (12, 'Other', 1507, 10, 0);
            insert into Z_28ASSETS values (11, 1), (11, 3), (11, 5), (12, 2);
        """)
        db.commit()
        data = db.serialize()
    path = f"{shared_dir(spark)}/library-{uuid.uuid4().hex}.sqlite"
    write_file(spark, path, data)
    return path


def demo_library(spark: SparkSession) -> DataFrame:
    return scan_library(spark, _demo(spark))


def demo_albums(spark: SparkSession) -> DataFrame:
    return scan_albums(spark, _demo(spark))


def scan_folder(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """Files below a folder without their content: key from the relative path, size and time; hidden ones are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder).select("path", "length", "modificationTime")
    relative = F.regexp_replace("path", "^.*?" + re.escape(folder.rstrip("/")) + "/", "")
    return files.select(F.concat(F.lit("file:"), relative).alias("asset_key"), F.col("length").alias("size"), F.col("modificationTime").alias("modified")).filter(~F.col("asset_key").rlike(r"(^|[:/])\."))


def split_by_library(assets: DataFrame) -> DataFrame:
    """Writes one partition a library; (library_id, n) as read back."""
    path = f"{shared_dir(assets.sparkSession)}/libraries-{uuid.uuid4().hex}"
    assets.write.partitionBy("library_id").parquet(path)
    return assets.sparkSession.read.parquet(path).groupBy("library_id").agg(F.count(F.lit(1)).alias("n"))


def try_each(df: DataFrame, schema: str, work: Callable[[dict], tuple]) -> DataFrame:
    """work(row) for every row; one that fails gives its first column and the error, and the others go on."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for r in b.to_pylist():
                try:
                    rows.append(work(r))
                except Exception as e:  # noqa: BLE001
                    rows.append((r[names[0]], *[None] * (len(names) - 2), type(e).__name__))
            if rows:
                yield pa.RecordBatch.from_pylist([dict(zip(names, x, strict=True)) for x in rows], schema=target)

    target = to_arrow_schema(_parse_datatype_string(schema))
    return df.mapInArrow(run, schema)


