"""Cutting lineage with tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_SCOPES: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder of the session; where none is set, a new temporary one in local mode and an error on a cluster."""
    sc = spark.sparkContext
    path = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not path:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="prismlake-"))
        path = sc.getCheckpointDir()
    return path


def new_folder(spark: SparkSession, kind: str) -> str:
    """A path in the shared folder that nothing has yet; inside temporary_tables it is dropped with them."""
    path = f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"
    if _SCOPES:
        _SCOPES[-1].append(path)
    return path


def write_table(df: DataFrame) -> tuple[DataFrame, str]:
    """Write df as Parquet to the shared folder; the reread table and its path."""
    spark = df.sparkSession
    path = new_folder(spark, "table")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def durable(df: DataFrame) -> DataFrame:
    """df, computed once and reread from the shared folder: no later stage recomputes it, and a lost executor loses none of it."""
    return write_table(df)[0]


@contextmanager
def temporary_tables(spark: SparkSession) -> Iterator[None]:
    """Tables that write_table and durable make inside are dropped at the end: what reads them must have been written by then."""
    _SCOPES.append([])
    try:
        yield
    finally:
        for path in _SCOPES.pop():
            drop_table(spark, path)


def drop_table(spark: SparkSession, path: str) -> None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)


def make_folder(spark: SparkSession, path: str) -> None:
    """An empty folder, unless it is there already."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(hadoop)


def names_in(spark: SparkSession, path: str) -> list[str]:
    """The names of what lies in a folder; none where it does not exist."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return [f.getPath().getName() for f in fs.listStatus(hadoop)] if fs.exists(hadoop) else []


def write_file(spark: SparkSession, path: str, data: bytes) -> None:
    """One small file on any Hadoop file system."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(hadoop)
    try:
        out.write(bytearray(data))
    finally:
        out.close()


def size_in_bytes(df: DataFrame, unknown: int = 1 << 27) -> int:
    """Catalyst's estimate of df's size (file sizes for a scan); `unknown` where it has none."""
    n = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return n if n < 1 << 55 else unknown


def partitions_for(df: DataFrame, per_partition: int = 12 << 20) -> int:
    """As many partitions as give each about `per_partition` bytes of df's input, and no fewer than the session's."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, -(-size_in_bytes(df) // per_partition))
