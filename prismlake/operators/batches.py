"""Long jobs over items that may be stopped, killed and run again: every finished or failed item is a row of a ledger.

A run takes the items that the ledger does not know as done, in chunks of a job each; a chunk's rows go to a folder of their own, so
what a killed job had committed counts and what it had not is done again. An item that fails is tried again in the next pass, at most
`attempts` times over all runs. An attempt that dies with its job leaves no row and is not counted.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BooleanType, IntegerType, StringType, StructType

from ..plans.durable import drop_table, exists, make_folder, write_table

_ATTEMPT = "_attempt"


class Batches:
    """The job whose ledger lies under `folder`.

    key: the name of the items' id. Rows that share an id, null included, are one item: it is done when one of them is.
    result: the schema of what work returns. Columns of the items must not be called _attempt, _chunk or _task.
    """

    def __init__(self, spark: SparkSession, folder: str, key: str, result: StructType, chunk_rows: int = 1_000_000, attempts: int = 3):
        if not 0 < chunk_rows or not 0 < attempts:
            raise ValueError("chunk_rows and attempts are at least 1")
        self.spark, self.folder, self.key, self.result, self.chunk_rows, self.attempts = spark, folder, key, result, chunk_rows, attempts
        make_folder(spark, folder)

    def _schema(self, items: DataFrame) -> StructType:
        fields = StructType([items.schema[self.key]]).add("attempt", IntegerType()).add("done", BooleanType()).add("error", StringType())
        return fields.add("result", self.result)

    def ledger(self, items: DataFrame) -> DataFrame:
        """(key, attempt, done, error, result): one row for each attempt that ended."""
        return self.spark.read.schema(self._schema(items)).option("recursiveFileLookup", True).parquet(self.folder)

    def results(self, items: DataFrame) -> DataFrame:
        """(key, attempts, done, error, result) of every item that was tried: its successful attempt, or else its last."""
        best = F.max_by(F.struct("done", "error", "result"), F.struct("done", "attempt")).alias("r")
        return self.ledger(items).groupBy(self.key).agg(F.max("attempt").alias("attempts"), best).select(self.key, "attempts", "r.done", "r.error", "r.result")

    def pending(self, items: DataFrame) -> DataFrame:
        """Items that are not done and have attempts left, with the number of the next one as _attempt."""
        known = self.ledger(items).groupBy(F.col(self.key).alias("_key")).agg(F.max("attempt").alias("_n"), F.bool_or("done").alias("_done"))
        j = items.join(known, F.col(self.key).eqNullSafe(F.col("_key")), "left")
        open_ = ~F.coalesce("_done", F.lit(False)) & (F.coalesce("_n", F.lit(0)) < self.attempts)
        return j.filter(open_).withColumn(_ATTEMPT, (F.coalesce("_n", F.lit(0)) + 1).cast("int")).drop("_key", "_n", "_done")

    def progress(self, items: DataFrame) -> DataFrame:
        """One row (total, done, failed, left): failed items have no attempt left."""
        r = self.results(items).select(F.col(self.key).alias("_key"), "attempts", "done")
        j = items.select(self.key).distinct().join(r, F.col(self.key).eqNullSafe(F.col("_key")), "left")
        done = F.coalesce("done", F.lit(False))
        failed = ~done & (F.coalesce("attempts", F.lit(0)) >= self.attempts)
        return j.agg(F.count(F.lit(1)).alias("total"), F.count_if(done).alias("done"), F.count_if(failed).alias("failed"), F.count_if(~done & ~failed).alias("left"))

    def run(self, items: DataFrame, work: Callable[[dict], tuple], between: Callable[[int, int], bool] | None = None) -> bool:
        """Works on what is pending until nothing is. work(row) gets the item's columns and _attempt and returns the result's values.

        between(chunks done, chunks of this pass) is asked before each chunk; False stops the run, to be continued by another. True is
        returned when all is done or out of attempts. The items are read once a pass; the first pass holds all, later ones those that failed.
        """
        while True:
            todo, path = write_table(self.pending(items))
            try:
                n = todo.count()
                if not n:
                    return True
                if not self._pass(todo, -(-n // self.chunk_rows), work, between):
                    return False
            finally:
                drop_table(self.spark, path)

    def _pass(self, todo: DataFrame, chunks: int, work: Callable[[dict], tuple], between: Callable[[int, int], bool] | None) -> bool:
        tasks = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        h = F.xxhash64(self.key, F.col(self.key).isNull())
        cut = todo.withColumns({"_chunk": F.pmod(h, F.lit(chunks)), "_task": F.pmod(F.floor(h / chunks), F.lit(tasks))})
        path = f"{self.folder.rstrip('/')}-chunks-{uuid.uuid4().hex}"
        cut.repartition(tasks, "_task").sortWithinPartitions("_chunk").write.partitionBy("_chunk").parquet(path)
        try:
            for k in range(chunks):
                if between and between(k, chunks) is False:
                    return False
                # Chunks are cut by hash, so one may be empty.
                if not exists(self.spark, f"{path}/_chunk={k}"):
                    continue
                rows = self.spark.read.schema(todo.schema).parquet(f"{path}/_chunk={k}")
                rows.mapInArrow(_worker(self.key, work, self._schema(todo)), self._schema(todo)).write.parquet(f"{self.folder}/chunk-{uuid.uuid4().hex}")
        finally:
            drop_table(self.spark, path)
        return True


def _worker(key: str, work: Callable[[dict], tuple], schema: StructType) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    names = schema["result"].dataType.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target = to_arrow_schema(schema)
        for b in batches:
            rows = []
            for r in b.to_pylist():
                row = {key: r[key], "attempt": r[_ATTEMPT]}
                try:
                    values = dict(zip(names, work(r), strict=True))
                    # A result that does not fit its type is a failure of this item, not of the job.
                    pa.array([values], target.field("result").type)
                    row |= {"done": True, "error": None, "result": values}
                except Exception as e:  # noqa: BLE001
                    row |= {"done": False, "error": type(e).__name__, "result": None}
                rows.append(row)
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=target)

    return run
