"""Catalog sync and mutations as DataFrame -> DataFrame functions: a new table version from an old one.

Keys are hash-partitioned by the joins; lists of ids arrive as DataFrames and become semi- or anti-joins, which Catalyst broadcasts
only when statistics prove them small.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.durable import shared_dir

METADATA, HASHES, FILE_HASH, FACES, FACE_EMBEDDINGS, SCENE, OCR, CLASSIFIED, SENSITIVE = (1 << k for k in range(9))


def set_bits(stage: Column, bits: int) -> Column:
    return stage.bitwiseOR(F.lit(bits))


def clear_bits(stage: Column, bits: int) -> Column:
    return stage.bitwiseAND(F.bitwise_not(F.lit(bits)))


def live(assets: DataFrame, library_id: int | None = None) -> DataFrame:
    df = assets.filter(~F.col("deleted"))
    return df if library_id is None else df.filter(F.col("library_id") == library_id)


def flag(df: DataFrame, ids: DataFrame, key: str, **changes: Column) -> DataFrame:
    """Rows whose key is among ids get the changes; the others stay."""
    marked = df.join(ids.select(key).distinct().withColumn("_hit", F.lit(True)), key, "left")
    return marked.withColumns({c: F.when(F.col("_hit"), v).otherwise(F.col(c)) for c, v in changes.items()}).drop("_hit")


def upsert_assets(old: DataFrame, scanned: DataFrame, stamp: int) -> DataFrame:
    """Insert or update by (library_id, asset_key).

    A changed modification time, compared null-safely, resets the stage to metadata only; a seen row loses its tombstone; filename,
    size and hash keep their old value where the scan has none, availability too.
    """
    key = ["library_id", "asset_key"]
    keep = ["filename", "file_size", "file_hash", "availability"]
    new = scanned.select(*key, F.lit(True).alias("n_seen"), F.col("modified_s").alias("n_modified_s"), *[F.col(c).alias(f"n_{c}") for c in keep])
    j = old.select(*key, F.lit(True).alias("o_seen"), "modified_s", "stage", "deleted", "scan_stamp", *keep).join(new, key, "full_outer")
    seen, both = F.col("n_seen").isNotNull(), F.col("n_seen").isNotNull() & F.col("o_seen").isNotNull()
    changed = ~F.col("modified_s").eqNullSafe(F.col("n_modified_s"))
    return j.select(
        *key,
        F.when(seen, F.col("n_modified_s")).otherwise(F.col("modified_s")).alias("modified_s"),
        F.when(both & ~changed, F.col("stage")).when(seen, METADATA).otherwise(F.col("stage")).alias("stage"),
        F.when(seen, False).otherwise(F.col("deleted")).alias("deleted"),
        F.when(seen, stamp).otherwise(F.col("scan_stamp")).alias("scan_stamp"),
        *[F.coalesce(f"n_{c}", c).alias(c) for c in keep],
    )


def mark_unseen(assets: DataFrame, library_id: int, stamp: int) -> DataFrame:
    """Tombstones what a full scan with this stamp did not see."""
    unseen = (F.col("library_id") == library_id) & (F.col("scan_stamp") < stamp)
    return assets.withColumn("deleted", F.col("deleted") | unseen)


def net_delta(inserted: DataFrame, updated: DataFrame, deleted: DataFrame, key: str) -> DataFrame:
    """(key, op): inserts that were deleted again cancel on both sides; updates of deleted or inserted keys go."""
    ins, dels = inserted.select(key).distinct(), deleted.select(key).distinct()
    both = ins.join(dels, key, "left_semi")
    ins, dels = ins.join(both, key, "left_anti"), dels.join(both, key, "left_anti")
    upd = updated.select(key).distinct().join(deleted.select(key), key, "left_anti").join(inserted.select(key), key, "left_anti")
    return ins.withColumn("op", F.lit("insert")).union(upd.withColumn("op", F.lit("update"))).union(dels.withColumn("op", F.lit("delete")))


def latest(df: DataFrame, keys: Sequence[str], by: Sequence[Column]) -> DataFrame:
    """The last row of each key; a partial aggregate over a struct, so no key's rows meet in one sort."""
    rest = [c for c in df.columns if c not in keys]
    packed = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*by)).alias("_row"))
    return packed.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest])


def delete_all(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    """(name, removed, remaining) after copies of the tables in the shared folder have been overwritten by empty ones of their schema."""
    base, out = f"{shared_dir(spark)}/all-{uuid.uuid4().hex}", []
    for name, df in tables.items():
        df.write.parquet(f"{base}/{name}")
        n = spark.read.parquet(f"{base}/{name}").count()
        spark.createDataFrame([], df.schema).write.mode("overwrite").parquet(f"{base}/{name}")
        out.append((name, n, spark.read.schema(df.schema).parquet(f"{base}/{name}").count()))
    return spark.createDataFrame(out, "name string, removed long, remaining long")


def replace_rows(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """old without the keys of new, and new."""
    return old.join(new.select(*keys).distinct(), list(keys), "left_anti").unionByName(new.select(*old.columns))


def save_categories(old: DataFrame, new_auto: DataFrame) -> DataFrame:
    """Replaces the automatic rows of the assets in new_auto; a user's rows are never touched."""
    dropped = old.filter(F.col("source") == "auto").join(new_auto.select("asset_id").distinct(), "asset_id", "left_anti")
    return old.filter(F.col("source") != "auto").unionByName(dropped).unionByName(new_auto.select(*old.columns))


def top_labels(labels: DataFrame, least: float = 0.3, most: int = 10) -> DataFrame:
    """The `most` labels of each asset with the highest confidence, if at least `least`."""
    w = Window.partitionBy("asset_id").orderBy(F.desc("confidence"), "label")
    return labels.filter(F.col("confidence") >= least).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= most)


def import_dedupe(files: DataFrame, known_hashes: DataFrame) -> DataFrame:
    """files (pos, file_hash) with status added, skipped (known, or again in the batch) or failed (no hash)."""
    known = known_hashes.select("file_hash").filter("file_hash is not null").distinct().withColumn("_known", F.lit(True))
    first = files.filter("file_hash is not null").groupBy("file_hash").agg(F.min("pos").alias("_first"))
    j = files.join(first, "file_hash", "left").join(known, "file_hash", "left")
    status = F.when(F.col("file_hash").isNull(), "failed").when(F.col("_known") | (F.col("pos") > F.col("_first")), "skipped").otherwise("added")
    return j.select("pos", "file_hash", status.alias("status"))


def ordered_pair(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.withColumns({a: F.least(a, b), b: F.greatest(a, b)}).filter(F.col(a) < F.col(b))


def find_or_create(existing: DataFrame, wanted: DataFrame, on: Sequence[str]) -> DataFrame:
    """existing and the wanted rows whose key it lacks."""
    return existing.unionByName(wanted.join(existing.select(*on), list(on), "left_anti").select(*existing.columns))


def delete_confirmed(assets: DataFrame, ids: DataFrame, expected: int) -> DataFrame:
    """Tombstones ids only if exactly `expected` of them are live; otherwise nothing changes."""
    target = live(assets).join(ids.select("asset_id").distinct(), "asset_id", "left_semi").select("asset_id")
    n = target.agg((F.count(F.lit(1)) == expected).alias("_ok"))
    hit = target.crossJoin(F.broadcast(n)).filter("_ok").select("asset_id")  # n is one row
    return flag(assets, hit, "asset_id", deleted=F.lit(True))
