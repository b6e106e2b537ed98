"""Change feeds and windows over event time, as Structured Streaming queries and in batch."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.durable import shared_dir


def sessions(events: DataFrame, gap_seconds: int, watermark: str | None = None) -> DataFrame:
    """(user_id, n, first_us) of runs of a user's events with gaps under gap_seconds; on a stream give a watermark."""
    df = events.select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    if watermark:
        df = df.withWatermark("ts", watermark)
    w = F.session_window("ts", f"{gap_seconds} seconds")
    return df.groupBy("user_id", w).agg(F.count(F.lit(1)).alias("n"), F.unix_micros(F.min("ts")).alias("first_us")).select("user_id", "n", "first_us")


def tumbling(events: DataFrame, width: str, watermark: str | None = None, slide: str | None = None) -> DataFrame:
    """(start_ms, event_type, n) over tumbling, or with `slide` sliding, windows."""
    df = events.select("event_type", F.col("ts").cast("timestamp").alias("ts"))
    if watermark:
        df = df.withWatermark("ts", watermark)
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    return df.groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.unix_millis("w.start").alias("start_ms"), "event_type", "n")


def apply_changes(target: str, key: str):
    """A foreachBatch function that appends the newest change of each key in a batch, deletes included, under `target`.

    A batch is written to a folder of its own number, so a batch that is run again replaces itself, and nothing older is rewritten.
    """

    def run(batch: DataFrame, number: int) -> None:
        from ..operators.store import latest

        latest(batch, [key], [F.col("seq")]).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return run


def changed_table(spark: SparkSession, target: str, key: str) -> DataFrame:
    """The table that the changes under `target` leave: of each key the change with the largest seq, whatever batch it came in; deleted keys stay away."""
    from ..operators.store import latest

    return latest(spark.read.parquet(target).drop("batch"), [key], [F.col("seq")]).filter("op <> 'delete'")


def compact_changes(spark: SparkSession, source: str, target: str, key: str) -> None:
    """One change of each key, deletes included, from many batches: what a maintenance job writes beside the stream."""
    from ..operators.store import latest

    latest(spark.read.parquet(source).drop("batch"), [key], [F.col("seq")]).write.parquet(f"{target}/batch=0")


def replay_changes(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """Feeds rows through a file stream in four batches and returns the table they leave: upserts, then updates and deletes, then a late
    batch of older upserts, which change nothing, and last newer ones, which bring some deleted keys back."""
    base = f"{shared_dir(spark)}/changes-{uuid.uuid4().hex}"
    change = lambda where, stage, op, seq: rows.filter(where).withColumns({"stage": stage, "op": op, "seq": F.lit(seq)})
    upsert = F.lit("upsert")
    batches = (
        change("true", F.col("stage"), upsert, 1), change("asset_id % 3 = 0", F.lit(1), F.when(F.col("asset_id") % 2 == 0, "delete").otherwise("upsert"), 3),
        change("asset_id % 6 = 0", F.lit(9), upsert, 2), change("asset_id % 5 = 0", F.lit(7), upsert, 4),
    )
    for k, df in enumerate(batches):
        df.write.parquet(f"{base}/in/{k}")
        stream = spark.readStream.schema(df.schema).option("recursiveFileLookup", True).parquet(f"{base}/in")
        stream.writeStream.foreachBatch(apply_changes(f"{base}/out", "asset_key")).option("checkpointLocation", f"{base}/ckpt").trigger(availableNow=True).start().awaitTermination()
    compact_changes(spark, f"{base}/out", f"{base}/compact", "asset_key")
    return changed_table(spark, f"{base}/compact", "asset_key").select("asset_key", "asset_id", "stage")


def streamed_windows(spark: SparkSession, events: DataFrame, width: str = "1 hour") -> DataFrame:
    """tumbling() as an append-mode stream with a watermark, over a folder that also holds one last event far ahead, which closes all windows."""
    base = f"{shared_dir(spark)}/windows-{uuid.uuid4().hex}"
    rows = events.select("event_type", "ts")
    rows.write.parquet(f"{base}/in")
    rows.limit(1).select(F.lit("end").alias("event_type"), F.expr("timestamp_ntz'2100-01-01 00:00:00'").alias("ts")).write.mode("append").parquet(f"{base}/in")
    stream = tumbling(spark.readStream.schema(rows.schema).parquet(f"{base}/in"), width, "10 minutes")
    stream.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/ckpt").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{base}/out")
