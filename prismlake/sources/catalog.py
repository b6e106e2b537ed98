"""The media catalog's tables, derived from the driver's synthetic tables by fixed arithmetic.

Each adapter is a projection of one source table in expressions that both Spark and ANSI SQL engines read, so a test can give an
oracle the same inputs. Operators never see the source tables; they take DataFrames of these shapes.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

CATEGORIES = ("screenshot", "whatsapp", "social", "document", "receipt", "qr_code", "camera")
_CATEGORY = "CASE CAST(doc_id % 7 AS INT) " + " ".join(f"WHEN {k} THEN '{c}'" for k, c in enumerate(CATEGORIES)) + " END"

#: name -> (source, columns, filter)
ADAPTERS: dict[str, tuple[str, list[str], str]] = {
    "assets": (
        "documents",
        [
            "doc_id AS asset_id", "doc_id % 3 + 1 AS library_id", "'file:' || source || '/' || CAST(doc_id AS STRING) || '.jpg' AS asset_key",
            "CASE WHEN doc_id % 11 = 0 THEN NULL ELSE source || '_' || CAST(doc_id AS STRING) || '.jpg' END AS filename",
            "CASE WHEN doc_id % 4 = 0 THEN NULL WHEN doc_id % 4 = 1 THEN '' ELSE 'Photo ' || lang || ' ' || CAST(doc_id % 10 AS STRING) END AS title",
            "CASE WHEN doc_id % 7 = 0 THEN 'video' ELSE 'image' END AS media_type", "1000 + doc_id * 37 % 3000 AS width", "800 + doc_id * 53 % 2000 AS height",
            "CASE WHEN doc_id % 13 = 0 THEN NULL ELSE 1500000000 + doc_id * 7919 % 100000000 END AS created_s",
            "CASE WHEN doc_id % 12 = 0 THEN NULL ELSE 1600000000 + doc_id % 1000 END AS modified_s",
            "doc_id % 5 = 0 AS favorite", "doc_id % 17 = 0 AS hidden", "doc_id % 19 = 0 AS deleted",
            "CASE WHEN doc_id % 23 IN (0, 3, 6) THEN 'B' || CAST(CAST(floor(doc_id / 23) AS BIGINT) AS STRING) END AS burst_id",
            "CASE WHEN doc_id % 6 = 0 THEN 'cloud_only' WHEN doc_id % 6 = 1 THEN 'shared' ELSE 'local' END AS availability",
            "CASE WHEN doc_id % 9 = 0 THEN NULL ELSE {sha}(text{bits}) END AS file_hash", "CASE WHEN doc_id % 50 = 0 THEN NULL ELSE n_chars END AS file_size",
            "CAST(doc_id * 31 % 512 AS INT) AS stage", "CAST(doc_id % 16 AS INT) AS subtype",
            "CASE WHEN doc_id % 29 = 0 THEN NULL ELSE CAST(doc_id * 13 % 100 AS DOUBLE) / 100 END AS sharpness", "CAST(doc_id * 17 % 100 AS DOUBLE) / 100 AS noise",
            "CASE WHEN doc_id % 8 = 0 THEN NULL ELSE CAST(doc_id * 41 % 100 AS DOUBLE) / 100 END AS face_quality",
            "CASE WHEN doc_id % 3 = 0 THEN NULL ELSE '/photos/' || source || '/' || CAST(doc_id AS STRING) || '.jpg' END AS file_path",
            "CASE WHEN doc_id % 5 = 1 THEN NULL ELSE CAST(doc_id * 7 % 100 AS DOUBLE) / 100 END AS sensitive_score",
            "CASE WHEN doc_id % 10 = 3 THEN TRUE WHEN doc_id % 10 = 7 THEN FALSE END AS sensitive_override", "doc_id % 40 AS scan_stamp",
        ],
        "",
    ),
    "looks": ("documents", ["doc_id AS asset_id", "CAST(doc_id * 19 % 256 AS DOUBLE) AS luma", "CAST(doc_id * 23 % 40 AS DOUBLE) / 100 AS clipped", "CASE WHEN doc_id % 10 = 0 THEN NULL ELSE CAST(doc_id * 43 % 100 AS DOUBLE) / 100 END AS aesthetic"], ""),
    "texts": ("documents", ["doc_id AS asset_id", "text"], ""),
    "libraries": ("nation", ["CAST(n_nationkey AS BIGINT) AS library_id", "n_name AS name", "CASE WHEN n_nationkey = 1 THEN 'photokit_system' WHEN n_nationkey % 2 = 0 THEN 'photoslibrary_readonly' ELSE 'import_folder' END AS kind", "'/lib/' || n_name AS path", "CASE WHEN n_nationkey % 4 = 0 THEN NULL ELSE CAST(n_nationkey * 100 AS BIGINT) END AS opened_s"], ""),
    "faces": (
        "embeddings",
        [
            "vec_id AS face_id", "vec_id % 200 AS asset_id", "CASE WHEN vec_id % 33 = 0 THEN NULL ELSE CAST(vec_id * 29 % 100 AS DOUBLE) / 100 END AS quality",
            "CASE WHEN vec_id % 21 = 0 THEN NULL ELSE CAST(32 + vec_id * 7 % 200 AS DOUBLE) END AS pixel_size", "CASE WHEN vec_id % 10 = 0 THEN NULL ELSE CAST(vec_id * 11 % 200 - 100 AS DOUBLE) / 100 END AS yaw",
            "vec_id % 31 = 0 AS ignored", "CASE WHEN vec_id % 6 = 0 THEN NULL ELSE vec_id + 5000 END AS embedding_id", "CASE WHEN vec_id % 2 = 0 THEN 'crops/' || CAST(vec_id AS STRING) || '.png' END AS crop_path",
        ],
        "",
    ),
    "vectors": ("embeddings", ["vec_id + 5000 AS embedding_id", "embedding AS vector"], ""),
    "embeddings_index": ("embeddings", ["vec_id + 5000 AS embedding_id", "CASE WHEN vec_id % 5 = 0 THEN 'asset' ELSE 'face' END AS entity_type", "vec_id AS entity_id", "CASE WHEN vec_id % 3 = 0 THEN 'print' ELSE 'face-v1' END AS model"], ""),
    "persons": ("nation", ["CAST(n_nationkey AS BIGINT) AS person_id", "CASE WHEN n_nationkey % 3 = 0 THEN NULL ELSE n_name END AS name", "n_nationkey % 4 = 0 AS hidden", "CAST(n_nationkey % 3 + 1 AS BIGINT) AS library_id"], ""),
    "membership": ("embeddings", ["vec_id AS face_id", "vec_id % 25 AS person_id", "vec_id % 5 = 0 AS confirmed"], "vec_id % 4 <> 0"),
    "constraints": ("embeddings", ["vec_id AS face_a", "vec_id + CASE WHEN vec_id % 37 = 0 THEN 1 ELSE 2 END AS face_b", "CASE WHEN vec_id % 37 = 0 THEN 'cannot_link' ELSE 'must_link' END AS kind"], "vec_id % 37 = 0 OR vec_id % 41 = 0"),
    "exclusions": ("documents", ["doc_id AS asset_a", "CASE WHEN doc_id % 97 = 0 THEN doc_id + 1 END AS asset_b"], "doc_id % 97 = 0 OR doc_id % 101 = 0"),
    "tags": ("documents", ["doc_id AS asset_id", "CASE WHEN doc_id % 4 = 0 THEN upper(lang) ELSE lang END AS label", "CASE WHEN doc_id % 2 = 0 THEN 'user' ELSE 'vision-classify' END AS source", "CAST(doc_id * 3 % 100 AS DOUBLE) / 100 AS confidence"], "doc_id % 3 = 0"),
    "categories": ("labels", ["doc_id AS asset_id", f"{_CATEGORY} AS category", "'auto' AS source", "CASE WHEN quality = 1 THEN 0.9 ELSE 0.3 END AS confidence"], ""),
    "overrides": ("labels", ["doc_id AS asset_id", f"{_CATEGORY} AS category", "'user' AS source", "CAST(toxic AS DOUBLE) AS confidence"], "doc_id % 5 = 0"),
    "albums": ("nation", ["CAST(n_nationkey + 100 AS BIGINT) AS album_id", "CAST(n_regionkey AS BIGINT) AS parent_id", "n_name AS title", "n_nationkey % 3 = 0 AS is_folder"], ""),
    "folders": ("region", ["CAST(r_regionkey AS BIGINT) AS album_id", "CAST(NULL AS BIGINT) AS parent_id", "r_name AS title", "TRUE AS is_folder"], ""),
    "album_members": ("customer", ["CAST(c_nationkey + 100 AS BIGINT) AS album_id", "c_custkey % 1000 AS asset_id", "c_custkey AS added_s"], ""),
    "removals": ("documents", ["doc_id AS asset_id", "'duplicate' AS reason", "doc_id * 17 % 1000 AS added_s"], "doc_id % 14 = 0"),
    "edits": ("orders", ["o_orderkey AS edit_id", "o_orderkey % 500 AS asset_id", "CAST(o_custkey AS BIGINT) AS updated_s", "o_orderpriority AS stack"], ""),
    "decisions": ("conversations", ["conv_id", "turn", "role AS kind", "text AS detail"], ""),
    "messages": ("conversations", ["conv_id % 10 AS key_no", "conv_id * 1000 + turn AS at_s", "role", "text"], ""),
    "media_files": ("pages", ["page_id", "url AS path"], ""),
    "moments": ("events", ["event_id AS asset_id", "ts", "user_id", "event_type"], ""),
    "prints": ("embeddings", ["vec_id AS asset_id", "embedding AS coefficients"], ""),
}


def tables_in(sql: str) -> list[str]:
    """The adapters that a query names, in the order of their definition."""
    words = set(re.findall(r"\w+", sql))
    return [name for name in ADAPTERS if name in words]


def oracle(sql: str) -> str:
    """sql for an ANSI engine with the adapters it names in front, as common table expressions."""
    parts = []
    for name in tables_in(sql):
        source, columns, where = ADAPTERS[name]
        text = f"{name} AS (SELECT {', '.join(columns)} FROM {source}{' WHERE ' + where if where else ''})"
        parts.append(text.replace("{sha}", "sha256").replace("{bits}", "").replace("AS STRING)", "AS VARCHAR)"))
    recursive = bool(re.match(r"\s*WITH RECURSIVE", sql))
    body = re.sub(r"^\s*WITH (RECURSIVE )?", ", ", sql) if re.match(r"\s*WITH\b", sql) and parts else sql
    return (f"WITH {'RECURSIVE ' if recursive else ''}{', '.join(parts)} " if parts else "") + body


class Catalog:
    """catalog.assets, catalog.faces, ..: the adapters' DataFrames; catalog.raw(name): a source table."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        if name not in ADAPTERS:
            raise AttributeError(name)
        source, columns, where = ADAPTERS[name]
        df = self.raw(source)
        df = df.where(where) if where else df
        return df.selectExpr(*(c.replace("{sha}", "sha2").replace("{bits}", ", 256") for c in columns))
