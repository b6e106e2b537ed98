"""A kept inverted index: sorted postings in segments, with tombstones and a dictionary.

A segment is a table (token, asset_id) sorted by token in ranges, so a term or prefix is a range of row groups that the scan's own statistics
select. Additions and changes write a new segment and a tombstone for each of their assets; removals write tombstones only. A posting is alive
if its asset has no tombstone of a later segment. Merging writes all that is alive as one segment. The list of segments is one
small file a version; a reader keeps the version that it opened, and a version is there only once all its tables are.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.durable import drop_table, size_in_bytes, write_file

#: Tombstones of more bytes are hashed by asset on both sides; Spark may send fewer to all workers.
BROADCAST = 8 << 20
POSTINGS, TOMBS, TERMS = "token string, asset_id long", "asset_id long", "token string, n long"


def ranged(postings: DataFrame, n: int) -> DataFrame:
    """Different postings (token, asset_id), sorted in n ranges; equal ones meet in a range, so one shuffle is enough."""
    return postings.repartitionByRange(n, "token", "asset_id").distinct().sortWithinPartitions("token", "asset_id")


@dataclass(frozen=True)
class TextIndex:
    """One version of an index. segments: (name, has postings), oldest first."""

    spark: SparkSession
    path: str
    version: int = 0
    segments: tuple[tuple[str, bool], ...] = ()

    # Reading

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> TextIndex:
        """The newest version; an empty one where there is none."""
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        system = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        versions = [int(s.getPath().getName()[8:-5]) for s in system.listStatus(hadoop) if s.getPath().getName().startswith("version-")] if system.exists(hadoop) else []
        if not versions:
            return cls(spark, path)
        text = "".join(r.value for r in spark.read.text(f"{path}/version-{max(versions):09d}.json").collect())  # one line
        return cls(spark, path, max(versions), tuple((n, p) for n, p in json.loads(text)))

    def _table(self, kind: str, schema: str, only: tuple[tuple[str, bool], ...]) -> DataFrame:
        """(.., segment) of these segments."""
        parts = [self.spark.read.schema(schema).parquet(f"{self.path}/{name}/{kind}").withColumn("segment", F.lit(k)) for k, (name, _) in enumerate(self.segments) if (name, _) in only]
        return reduce(DataFrame.union, parts) if parts else self.spark.createDataFrame([], schema + ", segment int")

    def postings(self, where: Column | None = None) -> DataFrame:
        """(token, asset_id) of all living postings, or of those with a token `where`; the condition reaches the scan."""
        found = self._table("postings", POSTINGS, tuple(s for s in self.segments if s[1]))
        if where is not None:
            found = found.filter(where)
        dead = self._table("tombstones", TOMBS, self.segments[1:]).groupBy("asset_id").agg(F.max("segment").alias("until"))
        if size_in_bytes(dead) > BROADCAST:
            dead = dead.hint("shuffle_hash")  # spares a sort of all postings
        alive = found.join(dead, "asset_id", "left").filter(F.col("until").isNull() | (F.col("segment") >= F.col("until")))
        return alive.select("token", "asset_id")

    def prefix(self, start: str) -> DataFrame:
        """asset_id of those with a token that begins so; an empty prefix means any token."""
        return self.postings(F.startswith("token", F.lit(start))).select("asset_id").distinct()

    def search(self, terms: list[str]) -> DataFrame:
        """asset_id of those that have, for each term, a token that begins with it; none for no terms."""
        if not terms:
            return self.spark.createDataFrame([], TOMBS)
        return reduce(lambda a, b: a.join(b, "asset_id", "left_semi"), [self.prefix(t) for t in terms])

    def dictionary(self) -> DataFrame:
        """(token, n): how many assets have each token. Segments' own counts where nothing has died, else counted anew."""
        if len(self.segments) > 1:
            return self.postings().groupBy("token").agg(F.count(F.lit(1)).alias("n"))
        return self._table("terms", TERMS, self.segments).select("token", "n")

    # Writing; each returns the new version

    def add(self, tokens: DataFrame, changed: DataFrame | None = None) -> TextIndex:
        """With the postings tokens (asset_id, token) in place of all that their assets had; changed: assets (asset_id) that now may have none."""
        new = tokens.select("token", F.col("asset_id").cast("long").alias("asset_id")).filter("token is not null and asset_id is not null")
        name = f"segment-{uuid.uuid4().hex}"
        self._write(name, new)
        ids = self.spark.read.schema(POSTINGS).parquet(f"{self.path}/{name}/postings").select("asset_id")
        if changed is not None:
            ids = ids.union(changed.select(F.col("asset_id").cast("long")))
        self._tombstones(name, ids)
        return self._next((*self.segments, (name, True)))

    def remove(self, ids: DataFrame) -> TextIndex:
        """Without the assets ids (asset_id)."""
        name = f"segment-{uuid.uuid4().hex}"
        self._tombstones(name, ids.select(F.col("asset_id").cast("long")))
        return self._next((*self.segments, (name, False)))

    def merged(self) -> TextIndex:
        """All that is alive as one segment; older versions stay readable until cleared."""
        name = f"segment-{uuid.uuid4().hex}"
        self._write(name, self.postings())
        self._tombstones(name, self.spark.createDataFrame([], TOMBS))
        return self._next(((name, True),))

    def clear_older(self, before: TextIndex) -> None:
        """Drops the segments of an older version that this one no longer has."""
        for name in {n for n, _ in before.segments} - {n for n, _ in self.segments}:
            drop_table(self.spark, f"{self.path}/{name}")

    def _write(self, name: str, postings: DataFrame) -> None:
        # A frequent token's postings are ranges of assets, so none is in one task alone.
        n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        ranged(postings, n).write.parquet(f"{self.path}/{name}/postings")
        written = self.spark.read.schema(POSTINGS).parquet(f"{self.path}/{name}/postings")
        written.groupBy("token").agg(F.count(F.lit(1)).alias("n")).write.parquet(f"{self.path}/{name}/terms")

    def _tombstones(self, name: str, ids: DataFrame) -> None:
        ids.filter("asset_id is not null").distinct().write.parquet(f"{self.path}/{name}/tombstones")

    def _next(self, segments: tuple[tuple[str, bool], ...]) -> TextIndex:
        write_file(self.spark, f"{self.path}/version-{self.version + 1:09d}.json", json.dumps(segments).encode())
        return TextIndex(self.spark, self.path, self.version + 1, segments)
