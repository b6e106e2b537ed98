"""A change feed with state: the newest change of each key, tombstones that are forgotten in time, and a reconcile where history is missing.

Changes (key, seq, op, ..) come as Parquet files in any order, repeated or late; op is upsert or delete, and of a key's changes the one
with the largest seq counts, a delete before an upsert of the same seq. Changes without a key or a seq say nothing and are left out.

The stream's state holds a seq for each living key, and for each deleted one during `keep_seconds`, by buckets of keys. What it lets through goes to a log
(gen, batch, ..) under the feed's folder; a batch that is run again replaces itself. A source that keeps no change older than `first`
has lost some for a feed that has come no further than first - 2: then, and where a change is so late that the tombstone that might
forbid it may be forgotten, apply() returns False and a reconcile with a full snapshot starts the next generation.
"""

from __future__ import annotations

import time
from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import ArrayType, BinaryType, DataType, DoubleType, FloatType, LongType, StringType, StructType, TimestampType

from ..plans.durable import drop_table, make_folder, names_in

_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_LIVE = StructType().add("names", ArrayType(StringType())).add("seqs", ArrayType(LongType()))
_GONE = StructType([*_LIVE.fields]).add("since", ArrayType(LongType()))
# Never changes while a feed lives: its state lies in these buckets.
_BUCKETS = 1 << 12
_NAME, _BUCKET = "__name", "__bucket"
DELETE, UPSERT, LATE = "delete", "upsert", "late"


class Newest(StatefulProcessor):
    """Lets a change through if it is newer than all that its key had; one of a key without state that is not above `horizon` is marked late.

    A group is a bucket of keys, since a call of the state and a group's own Arrow batch cost as much as hundreds of rows.
    """

    def __init__(self, keep_ms: int, horizon: int):
        self.keep_ms, self.horizon = keep_ms, horizon

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.live = handle.getValueState("live", _LIVE)
        # Each tombstone has its own time; one of a bucket that no change touches goes with the last of its bucket.
        self.gone = handle.getValueState("gone", _GONE, self.keep_ms)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        best: dict[str, Row] = {}
        for r in rows:
            b = best.get(name := r[_NAME])
            if b is None or (r.seq, r.op == DELETE) > (b.seq, b.op == DELETE):
                best[name] = r
        now = timerValues.getCurrentProcessingTimeInMs()
        live = dict(zip(*(self.live.get() or ((), ())), strict=True))
        gone = {n: (seq, at) for n, seq, at in zip(*(self.gone.get() or ((), (), ())), strict=True) if now < at + self.keep_ms}
        out, live_new, gone_new = [], False, False
        for name, r in best.items():
            known = live[name] if name in live else gone.get(name, (None,))[0]
            if known is None and r.seq <= self.horizon:
                out.append(Row(**{**r.asDict(), "op": LATE}))
            elif known is None or r.seq > known:
                if r.op == DELETE:
                    live_new |= live.pop(name, None) is not None
                    gone[name], gone_new = (r.seq, now), True
                else:
                    gone_new |= gone.pop(name, None) is not None
                    live[name], live_new = r.seq, True
                out.append(r)
        if live_new:
            self.live.update((list(live), list(live.values()))) if live else self.live.clear()
        if gone_new:
            self.gone.update((list(gone), *map(list, zip(*gone.values(), strict=True)))) if gone else self.gone.clear()
        return iter(out)

    def close(self) -> None:
        pass


def _reduced(key: str):
    """Of each Arrow batch the newest change of a key, so a key with many changes sends few of them through the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            order = pc.sort_indices(pa.table({"k": b[key], "s": b["seq"], "d": pc.equal(b["op"], DELETE)}), [("k", "ascending"), ("s", "ascending"), ("d", "ascending")])
            k = b[key].take(order)
            last = np.append(pc.not_equal(k[:-1], k[1:]).to_numpy(zero_copy_only=False), True)
            yield b.take(order.filter(pa.array(last.astype(bool))))

    return run


def _name(key: str, kind: DataType) -> Column:
    """A string that two keys share only if they are the same."""
    k = F.col(key)
    if isinstance(kind, BinaryType):
        return F.hex(k)
    if isinstance(kind, TimestampType):
        return F.unix_micros(k).cast("string")
    return (k + F.lit(0.0).cast(kind) if isinstance(kind, (FloatType, DoubleType)) else k).cast("string")


class ChangeFeed:
    """The feed whose log and state lie under `folder`. payload: the columns beside key, seq and op, named otherwise than these, gen and batch."""

    def __init__(self, spark: SparkSession, folder: str, key: str, payload: StructType, keep_seconds: float = 7 * 86400.0, key_type: Any = None):
        self.spark, self.folder, self.key, self.payload, self.keep_ms = spark, folder.rstrip("/"), key, payload, int(keep_seconds * 1000)
        self.schema = StructType().add(key, key_type or StringType()).add("seq", LongType()).add("op", StringType())
        for field in payload.fields:
            self.schema = self.schema.add(field)

    # Where the feed is

    def _generation(self) -> tuple[int, int]:
        """(number, floor): changes up to floor are in the snapshot that the generation began with."""
        return max((tuple(map(int, n.split("_"))) for n in names_in(self.spark, f"{self.folder}/generations")), default=(0, -(1 << 62)))

    def _syncs(self) -> list[tuple[int, int, int]]:
        """(generation, time in ms, seq) of runs that ended."""
        return sorted(tuple(map(int, n.split("_"))) for n in names_in(self.spark, f"{self.folder}/syncs"))

    def token(self) -> int | None:
        """The largest seq that the feed has taken in; None before the first run."""
        generation, floor = self._generation()
        found = [seq for g, _, seq in self._syncs() if g == generation]
        return max([*found, floor]) if found or generation else None

    def position(self) -> tuple[int, int]:
        """(gen, batch) of the last entry of the log, for delta()."""
        r = self.log().agg(F.max(F.struct("gen", "batch")).alias("p")).first().p
        return (r.gen, r.batch) if r else (-1, -1)

    def log(self) -> DataFrame:
        """What was let through: the changes' columns, gen and batch."""
        make_folder(self.spark, f"{self.folder}/log")
        schema = StructType([*self.schema.fields]).add("gen", LongType()).add("batch", LongType())
        return self.spark.read.schema(schema).parquet(f"{self.folder}/log").filter((F.col("gen") <= self._generation()[0]) & (F.col("op") != LATE))

    def _newest(self, where: Column | None = None) -> Column:
        row, rank = F.struct(*self.schema.names), F.struct("seq", F.col("op") == DELETE, "gen", "batch")
        return F.max_by(row, rank) if where is None else F.max_by(F.when(where, row), F.when(where, rank))

    def table(self) -> DataFrame:
        """(key, seq, payload): the living keys."""
        return self.log().groupBy(self.key).agg(self._newest().alias("r")).select("r.*").filter(F.col("op") != DELETE).drop("op")

    def delta(self, since: tuple[int, int]) -> DataFrame:
        """(key, change): keys inserted, updated or deleted since a position; one that came and went again in between is not among them."""
        log = self.log()
        old = (F.col("gen") < since[0]) | ((F.col("gen") == since[0]) & (F.col("batch") <= since[1]))
        both = log.groupBy(self.key).agg(self._newest(old).alias("before"), self._newest().alias("after"), F.bool_or(~old).alias("touched"))
        was = F.coalesce(F.col("before.op") != DELETE, F.lit(False))
        now = F.col("after.op") != DELETE
        change = F.when(was & now, "updated").when(was, "deleted").when(now, "inserted")
        return both.filter("touched").select(self.key, change.alias("change")).filter("change is not null")

    # What moves it

    def apply(self, source: str, first: int | None = None) -> bool:
        """Takes in the files under `source` that were not yet, late and repeated changes included; False if a reconcile is needed.

        first: the smallest seq that the source still has.
        """
        token, (generation, floor) = self.token(), self._generation()
        if first is not None and token is not None and first > token + 1:
            return False
        now = int(time.time() * 1000)
        old = [s for s in self._syncs() if s[0] == generation and s[1] < now - self.keep_ms]
        horizon = max((seq for _, _, seq in old), default=floor)
        # The state needs a store with column families; a session of its own leaves the caller's settings alone.
        own = self.spark.newSession()
        for name in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone"):
            own.conf.set(name, self.spark.conf.get(name))
        own.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKSDB)
        changes = own.readStream.schema(self.schema).option("recursiveFileLookup", True).parquet(source)
        changes = changes.filter(F.col(self.key).isNotNull() & (F.col("seq") > floor)).mapInArrow(_reduced(self.key), self.schema)
        changes = changes.withColumn(_NAME, _name(self.key, self.schema[self.key].dataType)).withColumn(_BUCKET, F.pmod(F.xxhash64(_NAME), F.lit(_BUCKETS)).cast("int"))
        through = changes.groupBy(_BUCKET).transformWithState(Newest(self.keep_ms, horizon), self.schema, "Update", "ProcessingTime")
        path = f"{self.folder}/log/gen={generation}"
        # One batch a run: with processing time, which forgets tombstones, a run over what is available would go on without data.
        stream = through.writeStream.outputMode("update").foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{path}/batch={n}"))
        stream.option("checkpointLocation", f"{self.folder}/state/{generation}").trigger(once=True).start().awaitTermination()
        make_folder(self.spark, path)
        raw = self.spark.read.schema(self.schema).option("recursiveFileLookup", True).parquet(path)
        seen = raw.agg(F.max("seq").alias("seq"), F.count_if(F.col("op") == LATE).alias("late")).first()
        if seen.late:
            return False
        make_folder(self.spark, f"{self.folder}/syncs/{generation}_{now}_{max(seen.seq if seen.seq is not None else floor, floor)}")
        for g, at, seq in sorted(old, key=lambda s: s[2])[:-1]:
            drop_table(self.spark, f"{self.folder}/syncs/{g}_{at}_{seq}")
        return True

    def reconcile(self, snapshot: DataFrame, seq: int) -> None:
        """Starts a generation from all that is there (key, payload) as of `seq`: the log gets the differences, and changes up to seq are ignored.

        A snapshot's key is unique and not null. Payloads of any type but maps are compared; with maps every key counts as changed.
        """
        token, (generation, _) = self.token(), self._generation()
        if token is not None and seq < token:
            raise ValueError(f"the snapshot as of {seq} is older than the feed, which has come to {token}")
        names = self.payload.names
        new = snapshot.select(F.col(self.key), F.struct(F.lit(True).alias("there"), *names).alias("new"))
        old = self.table().select(F.col(self.key), F.struct(F.lit(True).alias("there"), *names).alias("old"))
        same = [F.lit(False) if f.dataType.typeName() == "map" else F.col(f"old.{n}").eqNullSafe(F.col(f"new.{n}")) for f, n in zip(self.payload.fields, names, strict=True)]
        unchanged = F.col("old").isNotNull() & F.col("new").isNotNull()
        for s in same:
            unchanged = unchanged & s
        j = old.join(new, self.key, "full_outer").filter(~unchanged)
        op = F.when(F.col("new").isNull(), DELETE).otherwise(UPSERT)
        rows = j.select(self.key, F.lit(seq).cast("long").alias("seq"), op.alias("op"), *[F.col(f"new.{n}").alias(n) for n in names])
        rows.write.mode("overwrite").parquet(f"{self.folder}/log/gen={generation + 1}/batch=-1")
        # The generation counts from here on; a run that ended before this leaves the old one in place.
        make_folder(self.spark, f"{self.folder}/generations/{generation + 1}_{seq}")
