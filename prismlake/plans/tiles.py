"""All pairs of blocks of rows without a shuffle: blocks are rows of a table in the shared folder, and a task reads two ranges of it.

Work on all pairs stays quadratic, but what moves grows as the rows do: they are dealt to blocks once, and Spark's product of the table with itself only reads.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .durable import durable


def packed(rows: DataFrame, key: str, block: int) -> DataFrame:
    """(block, data): the rows, dealt by a hash of a key to blocks of about `block` rows, each an Arrow stream of at least one row."""
    rows = durable(rows)
    n = -(-rows.count() // block) or 1

    def pack(table: pa.Table) -> pa.Table:
        own = table.drop_columns(["block"]).combine_chunks()
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, own.schema) as writer:
            writer.write_table(own)
        return pa.table({"block": pa.array([table.column("block")[0].as_py()], pa.int32()), "data": pa.array([sink.getvalue().to_pybytes()], pa.binary())})

    dealt = rows.withColumn("block", F.pmod(F.xxhash64(key), F.lit(n)).cast("int"))
    return durable(dealt.repartition(n, "block").groupBy("block").applyInArrow(pack, "block int, data binary"))


def product(left: DataFrame, right: DataFrame, where: Column | str) -> DataFrame:
    """Rows of both for which `where` holds; every partition of the one meets every one of the other where Spark reads them."""
    return left.join(right.hint("shuffle_replicate_nl"), F.expr(where) if isinstance(where, str) else where)


def table_of(data: bytes | pa.Buffer) -> pa.Table:
    """The rows of a block."""
    return pa.ipc.open_stream(data).read_all()


def task_pairs(blocks: DataFrame, run: Callable[[Iterator[tuple[pa.Table, pa.Table, bool]]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """What run(pairs) yields in each task, pairs being (rows, others, same) for the pairs of blocks it reads; a block meets itself (same) too."""

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, pa.Table, bool]]:
        for b in batches:
            for same, x, y in zip(*b.columns, strict=True):
                yield table_of(x.as_buffer()), table_of(y.as_buffer()), same.as_py()

    x, y = blocks.select(F.col("block").alias("i"), F.col("data").alias("x")), blocks.select(F.col("block").alias("j"), F.col("data").alias("y"))
    return product(x, y, "i <= j").select(F.expr("i = j").alias("same"), "x", "y").mapInArrow(lambda batches: run(pairs(batches)), schema)


def block_pairs(blocks: DataFrame, run: Callable[[pa.Table, pa.Table, bool], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """What run(rows, others, same) yields for each pair of blocks."""
    return task_pairs(blocks, lambda pairs: (batch for pair in pairs for batch in run(*pair)), schema)
