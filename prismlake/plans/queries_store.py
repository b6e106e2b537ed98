"""Queries for scans, sync, mutations and small lookups."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import media, text
from ..operators import cascades, library, names, store
from ..operators.cascades import ForeignKey
from ..sources.catalog import Catalog
from .registry import query


@query("SELECT asset_id, created_s FROM assets WHERE NOT deleted AND NOT hidden")
def scan_assets(c: Catalog) -> DataFrame:
    return library.newest_first(store.live(c.assets).filter(~F.col("hidden"))).select("asset_id", "created_s")


@query("SELECT asset_id, coalesce(file_size, 0) AS file_size, coalesce(sharpness, 0.5) AS sharpness, coalesce(availability, 'local') AS availability FROM assets")
def row_decode(c: Catalog) -> DataFrame:
    return c.assets.select("asset_id", F.coalesce("file_size", F.lit(0)).alias("file_size"), F.coalesce("sharpness", F.lit(0.5)).alias("sharpness"), F.coalesce("availability", F.lit("local")).alias("availability"))


@query("SELECT asset_id, CASE WHEN title <> '' THEN title WHEN filename <> '' THEN filename WHEN starts_with(asset_key, 'file:') THEN split_part(asset_key, '/', -1) ELSE 'Untitled' END AS display_name FROM assets")
def display_name(c: Catalog) -> DataFrame:
    return c.assets.select("asset_id", text.display_name(F.col("title"), F.col("filename"), F.col("asset_key")).alias("display_name"))


@query(r"SELECT page_id, lower(regexp_extract(path, '\.([^./]+)$', 1)) AS extension, CASE WHEN lower(regexp_extract(path, '\.([^./]+)$', 1)) IN ('jpg', 'jpeg', 'png', 'heic') THEN 'image' WHEN lower(regexp_extract(path, '\.([^./]+)$', 1)) IN ('mov', 'mp4') THEN 'video' ELSE 'other' END AS kind FROM media_files")
def media_probe(c: Catalog) -> DataFrame:
    ext = text.extension(F.col("path"))
    kind = F.when(ext.isin("jpg", "jpeg", "png", "heic"), "image").when(ext.isin("mov", "mp4"), "video").otherwise("other")
    return c.media_files.select("page_id", ext.alias("extension"), kind.alias("kind"))


_EXPORT_NAME = r"SELECT asset_id, CASE WHEN coalesce(title, '') <> '' THEN title || '.' || CASE WHEN filename IS NULL THEN CASE WHEN media_type = 'video' THEN 'mov' ELSE 'jpg' END ELSE 'jpg' END WHEN filename IS NOT NULL THEN filename ELSE 'Photo-' || CAST(asset_id AS VARCHAR) || CASE WHEN media_type = 'video' THEN '.mov' ELSE '.jpg' END END AS export_name FROM assets"


@query(_EXPORT_NAME)
def export_name(c: Catalog) -> DataFrame:
    return c.assets.select("asset_id", text.export_name(F.col("title"), F.col("filename"), F.col("asset_id"), F.col("media_type") == "video").alias("export_name"))


# Row by row: the first of a name's candidates that is not among the names used so far.
_FREE_SQL = f"""WITH RECURSIVE e AS ({_EXPORT_NAME}), n AS (SELECT row_number() OVER (ORDER BY asset_id) AS k, asset_id, export_name AS name, regexp_replace(export_name, '(.)\\.[^.]+$', '\\1') AS stem,
CASE WHEN regexp_matches(export_name, '.\\.[^.]+$') THEN regexp_extract(export_name, '(\\.[^.]+)$', 1) ELSE '' END AS ext FROM e),
r AS (SELECT CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS asset_id, CAST(NULL AS VARCHAR) AS free_name, CAST([] AS VARCHAR[]) AS used UNION ALL
SELECT k, asset_id, free_name, list_append(used, lower(free_name)) FROM (SELECT n.k, n.asset_id, r.used, list_filter(list_concat([n.name], list_transform(range(2, 3 + len(list_filter(r.used, lambda u: starts_with(u, lower(n.stem))))), lambda i: n.stem || ' ' || CAST(i AS VARCHAR) || n.ext)), lambda x: NOT list_contains(r.used, lower(x)))[1] AS free_name FROM r JOIN n ON n.k = r.k + 1))
SELECT asset_id, free_name FROM r WHERE k > 0"""


@query(_FREE_SQL)
def export_files(c: Catalog) -> DataFrame:
    """The names under which assets are written to a folder."""
    return names.free_names(export_name(c), "export_name", "asset_id").select("asset_id", "free_name")


_SCAN = "SELECT library_id, CASE WHEN asset_id % 9 = 4 THEN asset_key || 'x' ELSE asset_key END AS asset_key, CASE WHEN asset_id % 4 = 0 THEN modified_s ELSE modified_s + 1 END AS modified_s, CASE WHEN asset_id % 2 = 0 THEN filename END AS filename, CAST(NULL AS BIGINT) AS file_size, CASE WHEN asset_id % 8 = 0 THEN 'new' END AS file_hash, CASE WHEN asset_id % 3 = 0 THEN 'cloud_only' END AS availability FROM assets WHERE asset_id % 2 = 0"


def _scanned(c: Catalog) -> DataFrame:
    i = F.col("asset_id")
    return c.assets.filter(i % 2 == 0).select(
        "library_id", F.when(i % 9 == 4, F.concat("asset_key", F.lit("x"))).otherwise(F.col("asset_key")).alias("asset_key"), F.when(i % 4 == 0, F.col("modified_s")).otherwise(F.col("modified_s") + 1).alias("modified_s"),
        F.col("filename"), F.lit(None).cast("bigint").alias("file_size"), F.when(i % 8 == 0, "new").alias("file_hash"), F.when(i % 3 == 0, "cloud_only").alias("availability"),
    )


@query(f"""WITH n AS ({_SCAN}) SELECT coalesce(o.library_id, n.library_id) AS library_id, coalesce(o.asset_key, n.asset_key) AS asset_key, CASE WHEN n.asset_key IS NOT NULL THEN n.modified_s ELSE o.modified_s END AS modified_s,
CAST(CASE WHEN n.asset_key IS NULL THEN o.stage WHEN o.asset_key IS NULL OR o.modified_s IS DISTINCT FROM n.modified_s THEN 1 ELSE o.stage END AS INT) AS stage, CASE WHEN n.asset_key IS NOT NULL THEN FALSE ELSE o.deleted END AS deleted,
CASE WHEN n.asset_key IS NOT NULL THEN 100 ELSE o.scan_stamp END AS scan_stamp, coalesce(n.filename, o.filename) AS filename, coalesce(n.file_size, o.file_size) AS file_size, coalesce(n.file_hash, o.file_hash) AS file_hash, coalesce(n.availability, o.availability) AS availability
FROM assets o FULL JOIN n ON o.library_id = n.library_id AND o.asset_key = n.asset_key""")
def upsert_assets(c: Catalog) -> DataFrame:
    return store.upsert_assets(c.assets, _scanned(c), 100)


@query("SELECT asset_id, deleted OR (library_id = 2 AND scan_stamp < 20) AS deleted FROM assets")
def mark_unseen(c: Catalog) -> DataFrame:
    return store.mark_unseen(c.assets, 2, 20).select("asset_id", "deleted")


@query("SELECT asset_id, deleted OR asset_id IN (SELECT asset_id FROM removals) AS deleted FROM assets")
def mark_deleted(c: Catalog) -> DataFrame:
    return store.flag(c.assets, c.removals, "asset_id", deleted=F.lit(True)).select("asset_id", "deleted")


_DELTA = """WITH i AS (SELECT asset_key FROM assets WHERE asset_id % 3 = 0), d AS (SELECT asset_key FROM assets WHERE asset_id % 5 = 0), u AS (SELECT asset_key FROM assets WHERE asset_id % 2 = 0)
SELECT asset_key, 'insert' AS op FROM i WHERE asset_key NOT IN (SELECT asset_key FROM d) UNION ALL SELECT asset_key, 'delete' FROM d WHERE asset_key NOT IN (SELECT asset_key FROM i)
UNION ALL SELECT asset_key, 'update' FROM u WHERE asset_key NOT IN (SELECT asset_key FROM d) AND asset_key NOT IN (SELECT asset_key FROM i)"""


def _delta(c: Catalog) -> DataFrame:
    part = lambda n: c.assets.filter(F.col("asset_id") % n == 0)
    return store.net_delta(part(3), part(2), part(5), "asset_key")


query(_DELTA, "apply_delta")(_delta)
query(_DELTA, "setop_delta")(_delta)


@query("SELECT entity_id, max(at_s) AS at_s, arg_max(role, at_s) AS role FROM (SELECT key_no AS entity_id, at_s, role FROM messages) GROUP BY 1")
def upsert_vector(c: Catalog) -> DataFrame:
    return store.latest(c.messages.select(F.col("key_no").alias("entity_id"), "at_s", "role"), ["entity_id"], [F.col("at_s")])


@query("SELECT asset_id, round(0.75 * coalesce(sharpness, 0) + 0.25 * noise, 6) AS quality_score, CAST(stage | 34 AS INT) AS stage, 'local' AS availability FROM assets")
def save_analysis(c: Catalog) -> DataFrame:
    q = media.quality_score(F.coalesce("sharpness", F.lit(0.0)), F.col("noise"))
    return c.assets.select("asset_id", F.round(q, 6).alias("quality_score"), store.set_bits(F.col("stage"), store.HASHES | store.SCENE).alias("stage"), F.lit("local").alias("availability"))


@query("SELECT d.doc_id AS asset_id, sha256(d.text) AS file_hash, coalesce(d.n_chars, a.file_size) AS file_size, CAST(a.stage | 4 AS INT) AS stage FROM assets a JOIN documents d ON d.doc_id = a.asset_id")
def set_file_hash(c: Catalog) -> DataFrame:
    new = c.raw("documents").select(F.col("doc_id").alias("asset_id"), F.sha2("text", 256).alias("file_hash"), "n_chars")
    return c.assets.drop("file_hash").join(new, "asset_id").select("asset_id", "file_hash", F.coalesce("n_chars", "file_size").alias("file_size"), store.set_bits(F.col("stage"), store.FILE_HASH).alias("stage"))


@query("WITH o AS (SELECT * FROM categories UNION ALL SELECT * FROM overrides), n AS (SELECT asset_id, 'camera' AS category, 'auto' AS source, 0.8 AS confidence FROM assets WHERE asset_id % 4 = 0) SELECT * FROM o WHERE source <> 'auto' OR asset_id NOT IN (SELECT asset_id FROM n) UNION ALL SELECT * FROM n")
def save_classification(c: Catalog) -> DataFrame:
    new = c.assets.filter("asset_id % 4 = 0").select("asset_id", F.lit("camera").alias("category"), F.lit("auto").alias("source"), F.lit(0.8).alias("confidence"))
    return store.save_categories(c.categories.union(c.overrides), new)


_NEW_FACES = "SELECT 9000 + asset_id AS face_id, asset_id, 0.5 AS quality FROM assets WHERE asset_id < 200 AND asset_id % 7 = 0"


@query(f"WITH n AS ({_NEW_FACES}) SELECT face_id, asset_id, coalesce(quality, 0.5) AS quality FROM faces WHERE asset_id NOT IN (SELECT asset_id FROM n) UNION ALL SELECT * FROM n")
def replace_faces(c: Catalog) -> DataFrame:
    new = c.assets.filter("asset_id < 200 and asset_id % 7 = 0").select((F.col("asset_id") + 9000).alias("face_id"), "asset_id", F.lit(0.5).alias("quality"))
    return store.replace_rows(c.faces.select("face_id", "asset_id", F.coalesce("quality", F.lit(0.5)).alias("quality")), new, ["asset_id"])


# Foreign keys of the catalog: (child, column, parent), and the columns by which a table's rows are told apart in results.
_IDS = {"libraries": "library_id", "assets": "asset_id", "faces": "face_id", "persons": "person_id", "embeddings_index": "embedding_id"}
_SHOWN = {
    "libraries": "library_id", "assets": "asset_id, library_id", "texts": "asset_id", "tags": "asset_id, label, source", "categories": "asset_id, category", "overrides": "asset_id, category",
    "removals": "asset_id", "album_members": "album_id, asset_id", "faces": "face_id, asset_id", "edits": "edit_id, asset_id", "exclusions": "asset_a, asset_b", "persons": "person_id, library_id",
    "embeddings_index": "embedding_id, entity_type, entity_id", "vectors": "embedding_id", "membership": "face_id, person_id", "constraints": "face_a, face_b, kind",
}
_ANALYSIS = [
    ForeignKey("assets", "library_id", "libraries"), *[ForeignKey(t, "asset_id", "assets") for t in ("texts", "tags", "categories", "overrides", "faces")],
    ForeignKey("embeddings_index", "entity_id", "assets", where="entity_type = 'asset'"), ForeignKey("embeddings_index", "entity_id", "faces", where="entity_type = 'face'"),
    ForeignKey("vectors", "embedding_id", "embeddings_index"), ForeignKey("persons", "library_id", "libraries"), ForeignKey("membership", "face_id", "faces"),
    ForeignKey("membership", "person_id", "persons", needed=True), ForeignKey("constraints", "face_a", "faces"), ForeignKey("constraints", "face_b", "faces"),
]
_KEYS = [
    *_ANALYSIS, ForeignKey("removals", "asset_id", "assets"), ForeignKey("album_members", "asset_id", "assets"), ForeignKey("edits", "asset_id", "assets", "restrict"),
    ForeignKey("exclusions", "asset_a", "assets"), ForeignKey("exclusions", "asset_b", "assets"),
]


def _tables(c: Catalog, keys: list[ForeignKey]) -> dict[str, DataFrame]:
    return {n: getattr(c, n) for n in dict.fromkeys(x for k in keys for x in (k.parent, k.child))}


def _shown(tables: dict[str, DataFrame]) -> DataFrame:
    """(table, row): every row of all tables by its telling columns; nulls are dashes."""
    rows = [df.select(F.lit(n).alias("table"), F.concat_ws("|", *[F.coalesce(F.col(x).cast("string"), F.lit("-")) for x in _SHOWN[n].split(", ")]).alias("row")) for n, df in sorted(tables.items())]
    return reduce(DataFrame.union, rows)


def _shown_sql(where: dict[str, str], only: list[str], row: dict[str, str] | None = None) -> str:
    """SQL for _shown over tables restricted by `where`; row: other expressions for a table's telling columns."""
    told = lambda n: (row or {}).get(n) or ", ".join(f"coalesce(CAST({x} AS VARCHAR), '-')" for x in _SHOWN[n].split(", "))
    return " UNION ALL ".join(f"SELECT '{n}' AS \"table\", concat_ws('|', {told(n)}) AS row FROM {n} WHERE {where.get(n, 'TRUE')}" for n in only)


def _dead_sql(asset: str, person: str, library: str) -> dict[str, str]:
    """Of each table the rows that stay when assets and persons for which these hold go."""
    a, f = f"(SELECT asset_id FROM assets WHERE {asset})", f"(SELECT face_id FROM faces WHERE asset_id IN (SELECT asset_id FROM assets WHERE {asset}))"
    e = f"(entity_type = 'asset' AND entity_id IN {a}) OR (entity_type = 'face' AND entity_id IN {f})"
    out = {n: f"asset_id NOT IN {a}" for n in ("assets", "texts", "tags", "categories", "overrides", "removals", "album_members", "faces", "edits")}
    return out | {
        "libraries": f"NOT ({library})", "persons": f"NOT ({person})", "embeddings_index": f"NOT ({e})", "vectors": f"embedding_id NOT IN (SELECT embedding_id FROM embeddings_index WHERE {e})",
        "membership": f"face_id NOT IN {f} AND person_id NOT IN (SELECT person_id FROM persons WHERE {person})", "constraints": f"face_a NOT IN {f} AND face_b NOT IN {f}",
        "exclusions": f"asset_a NOT IN {a} AND (asset_b IS NULL OR asset_b NOT IN {a})",
    }


_ALL = sorted({x for k in _KEYS for x in (k.parent, k.child)})


def _without(c: Catalog, libraries: DataFrame) -> dict[str, DataFrame]:
    """All tables without these libraries and what hangs on them; their assets' edits, which would restrict that, go first."""
    tables = _tables(c, _KEYS)
    lost = c.assets.join(libraries, "library_id", "left_semi").select("asset_id")
    tables["edits"] = tables["edits"].join(lost, "asset_id", "left_anti").select(tables["edits"].columns)
    return cascades.delete(tables, _IDS, _KEYS, {"libraries": libraries})


@query(_shown_sql(_dead_sql("library_id = 2", "library_id = 2", "library_id = 2"), _ALL))
def remove_library(c: Catalog) -> DataFrame:
    """Every row that all tables keep when library 2 goes."""
    return _shown(_without(c, c.libraries.filter("library_id = 2 and kind <> 'photokit_system'").select("library_id")))


_KEEP_1 = _dead_sql("library_id <> 1", "library_id <> 1", "library_id <> 1")
_ORPHANS = {
    "embeddings_index": "((entity_type = 'asset' AND entity_id IN (SELECT asset_id FROM assets WHERE library_id = 1)) OR (entity_type = 'face' AND entity_id IN (SELECT face_id FROM faces WHERE asset_id IN (SELECT asset_id FROM assets WHERE library_id = 1))))",
    "exclusions": "(asset_b IS NULL OR asset_b IN (SELECT asset_id FROM assets WHERE library_id = 1))", "persons": "library_id = 1", "texts": "asset_id IN (SELECT asset_id FROM assets WHERE library_id = 1)",
}


@query(_shown_sql({n: f"({w}) AND {_ORPHANS.get(n, 'TRUE')}" for n, w in _KEEP_1.items()}, _ALL))
def prune_source(c: Catalog) -> DataFrame:
    """Every row that all tables keep when only library 1 stays and orphans go too."""
    tables = _without(c, c.libraries.filter("library_id <> 1").select("library_id"))
    swept = [k for k in _KEYS if k.child in _ORPHANS and k.column != "asset_a"]
    return _shown(cascades.sweep(tables, _IDS, swept))


@query("SELECT asset_id, CAST(stage & ~24 AS INT) AS stage FROM assets")
def delete_face_data(c: Catalog) -> DataFrame:
    return c.assets.select("asset_id", store.clear_bits(F.col("stage"), store.FACES | store.FACE_EMBEDDINGS).alias("stage"))


_COPIED = "(SELECT asset_id FROM assets WHERE library_id = 1)"
_COPIED_FACES = f"(SELECT face_id FROM faces WHERE asset_id IN {_COPIED})"
_COPIED_INDEX = f"((entity_type = 'asset' AND entity_id IN {_COPIED}) OR (entity_type = 'face' AND entity_id IN {_COPIED_FACES}))"
_COPIED_WHERE = {
    **{n: f"asset_id IN {_COPIED}" for n in ("assets", "texts", "tags", "categories", "overrides", "faces")}, "embeddings_index": _COPIED_INDEX, "vectors": f"embedding_id IN (SELECT embedding_id FROM embeddings_index WHERE {_COPIED_INDEX})",
    "persons": f"person_id IN (SELECT person_id FROM membership WHERE face_id IN {_COPIED_FACES})", "membership": f"face_id IN {_COPIED_FACES} AND person_id IN (SELECT person_id FROM persons)", "constraints": f"face_a IN {_COPIED_FACES} AND face_b IN {_COPIED_FACES}",
}
_COPIED_ROW = {
    "assets": "asset_id + 100000, 99", "texts": "asset_id + 100000", "tags": "asset_id + 100000, label, source", "categories": "asset_id + 100000, category", "overrides": "asset_id + 100000, category",
    "faces": "face_id + 500000, asset_id + 100000", "embeddings_index": "embedding_id + 900000, entity_type, entity_id + CASE WHEN entity_type = 'asset' THEN 100000 ELSE 500000 END", "vectors": "embedding_id + 900000",
    "persons": "person_id + 1000, 99", "membership": "face_id + 500000, person_id + 1000", "constraints": "face_a + 500000, face_b + 500000, kind",
}


@query(_shown_sql(_COPIED_WHERE, sorted(_COPIED_WHERE), _COPIED_ROW))
def copy_analysis(c: Catalog) -> DataFrame:
    """All rows that library 1's analysis becomes in a new library 99: assets, texts, tags, categories, faces, vectors, people who have a copied face, memberships and constraints."""
    mapping = c.assets.filter("library_id = 1").select("asset_id", (F.col("asset_id") + 100000).alias("new"))
    new_id = {"faces": F.col("face_id") + 500000, "persons": F.col("person_id") + 1000, "embeddings_index": F.col("embedding_id") + 900000}
    there = {n: {"library_id": F.lit(99).cast("long")} for n in ("assets", "persons")}
    made = cascades.copy(_tables(c, _ANALYSIS), _IDS, _ANALYSIS, {"assets": mapping}, new_id, there)
    return _shown({n: df for n, df in made.items() if n != "libraries"})


@query("WITH f AS (SELECT asset_id AS pos, file_hash FROM assets WHERE asset_id % 2 = 1), k AS (SELECT DISTINCT file_hash FROM assets WHERE asset_id % 10 = 0 AND file_hash IS NOT NULL) SELECT f.pos, f.file_hash, CASE WHEN f.file_hash IS NULL THEN 'failed' WHEN k.file_hash IS NOT NULL OR row_number() OVER (PARTITION BY f.file_hash ORDER BY f.pos) > 1 THEN 'skipped' ELSE 'added' END AS status FROM f LEFT JOIN k ON k.file_hash = f.file_hash")
def import_dedupe(c: Catalog) -> DataFrame:
    files = c.assets.filter("asset_id % 2 = 1").select(F.col("asset_id").alias("pos"), "file_hash")
    return store.import_dedupe(files, c.assets.filter("asset_id % 10 = 0"))


@query("WITH f AS (SELECT asset_id AS pos, file_hash FROM assets WHERE asset_id % 2 = 1), s AS (SELECT CASE WHEN file_hash IS NULL THEN 'failed' WHEN file_hash IN (SELECT file_hash FROM assets WHERE asset_id % 10 = 0 AND file_hash IS NOT NULL) OR row_number() OVER (PARTITION BY file_hash ORDER BY pos) > 1 THEN 'skipped' ELSE 'added' END AS status FROM f) SELECT count(*) AS done, count(*) FILTER (status = 'added') AS added, count(*) FILTER (status = 'skipped') AS skipped, count(*) FILTER (status = 'failed') AS failed FROM s")
def agg_import_progress(c: Catalog) -> DataFrame:
    n = lambda s: F.count_if(F.col("status") == s).alias(s)
    return import_dedupe(c).agg(F.count(F.lit(1)).alias("done"), n("added"), n("skipped"), n("failed"))


@query("SELECT conv_id FROM decisions WHERE turn = 0 AND conv_id NOT IN (SELECT asset_id FROM assets WHERE NOT deleted AND asset_id % 3 = 0)")
def import_resume(c: Catalog) -> DataFrame:
    done = store.live(c.assets).filter("asset_id % 3 = 0").select(F.col("asset_id").alias("conv_id"))
    return c.decisions.filter("turn = 0").join(done, "conv_id", "left_anti").select("conv_id")


@query("WITH disk AS (SELECT asset_key FROM assets WHERE asset_id % 4 <> 0), known AS (SELECT asset_key FROM assets WHERE asset_id % 6 <> 0) SELECT asset_key, 'untracked' AS state FROM disk WHERE asset_key NOT IN (SELECT asset_key FROM known) UNION ALL SELECT asset_key, 'missing' FROM known WHERE asset_key NOT IN (SELECT asset_key FROM disk)")
def untracked_files(c: Catalog) -> DataFrame:
    disk, known = (c.assets.filter(f"asset_id % {n} <> 0").select("asset_key") for n in (4, 6))
    return disk.join(known, "asset_key", "left_anti").withColumn("state", F.lit("untracked")).union(known.join(disk, "asset_key", "left_anti").withColumn("state", F.lit("missing")))


@query("SELECT asset_id, 'Originals/' || strftime(to_timestamp(created_s) AT TIME ZONE 'UTC', '%Y/%m') AS folder FROM assets WHERE created_s IS NOT NULL")
def package_ops(c: Catalog) -> DataFrame:
    t = F.timestamp_seconds("created_s")
    return c.assets.filter("created_s is not null").select("asset_id", F.format_string("Originals/%04d/%02d", F.year(t), F.month(t)).alias("folder"))


@query("SELECT key_no, arg_max(role, at_s) AS value FROM messages GROUP BY key_no")
def settings_kv(c: Catalog) -> DataFrame:
    return store.latest(c.messages.select("key_no", F.col("role").alias("value"), "at_s"), ["key_no"], [F.col("at_s")]).select("key_no", "value")


@query("SELECT conv_id, turn, kind FROM decisions UNION ALL SELECT asset_id, 0, reason FROM removals")
def audit_append(c: Catalog) -> DataFrame:
    return c.decisions.select("conv_id", "turn", "kind").union(c.removals.select("asset_id", F.lit(0).cast("bigint"), "reason"))


# Filters and predicates

_PENDING = "SELECT asset_id, created_s FROM assets WHERE NOT deleted AND library_id = 2 AND media_type = 'image' AND (stage & 2) = 0 AND (availability <> 'cloud_only' OR file_path IS NOT NULL) ORDER BY created_s DESC NULLS LAST, asset_id LIMIT 50"
for _name in ("pending_stage", "topk_pending"):
    query(_PENDING, _name)(lambda c: library.pending(c.assets, store.HASHES, 2, False, 50).select("asset_id", "created_s"))
query("SELECT asset_id, CAST(stage | 256 AS INT) AS stage FROM assets", "stage_set")(lambda c: c.assets.select("asset_id", store.set_bits(F.col("stage"), store.SENSITIVE).alias("stage")))
query("SELECT asset_id, CAST(stage & ~256 AS INT) AS stage FROM assets", "stage_clear")(lambda c: c.assets.select("asset_id", store.clear_bits(F.col("stage"), store.SENSITIVE).alias("stage")))


@query("""SELECT f AS filter, count(*) AS n, CAST(sum(asset_id) AS BIGINT) AS ids FROM (
SELECT 'all' f, asset_id FROM assets WHERE NOT deleted AND media_type = 'image' UNION ALL SELECT 'videos', asset_id FROM assets WHERE NOT deleted AND media_type = 'video'
UNION ALL SELECT 'favorites', asset_id FROM assets WHERE NOT deleted AND media_type = 'image' AND favorite UNION ALL SELECT 'on_this_mac', asset_id FROM assets WHERE NOT deleted AND media_type = 'image' AND availability NOT IN ('cloud_only', 'shared')
UNION ALL SELECT 'screenshots', asset_id FROM assets WHERE NOT deleted AND media_type = 'image' AND subtype & 4 <> 0 UNION ALL SELECT 'blurry', asset_id FROM assets WHERE NOT deleted AND media_type = 'image' AND coalesce(sharpness, 1) < 0.25 AND subtype & 4 = 0
UNION ALL SELECT 'cloud_only', asset_id FROM assets WHERE NOT deleted AND media_type = 'image' AND availability = 'cloud_only' UNION ALL SELECT 'shared', asset_id FROM assets WHERE NOT deleted AND media_type = 'image' AND availability = 'shared'
UNION ALL SELECT 'hidden', asset_id FROM assets WHERE NOT deleted AND media_type = 'image' AND hidden) GROUP BY 1""")
def grid_filter(c: Catalog) -> DataFrame:
    named = F.array(*[F.when(p, name) for name, p in library.grid_predicates().items()])
    return store.live(c.assets).select("asset_id", F.explode(F.array_compact(named)).alias("filter")).groupBy("filter").agg(F.count(F.lit(1)).alias("n"), F.sum("asset_id").alias("ids"))


@query("SELECT asset_id FROM assets WHERE NOT deleted AND media_type = 'image' AND favorite AND (title ILIKE '%en%' OR filename ILIKE '%en%' OR asset_key ILIKE '%en%')")
def search_and(c: Catalog) -> DataFrame:
    hits = library.search(c.assets, _no_tokens(c), c.tags.limit(0), "en")
    return store.live(c.assets).filter(library.grid_predicates()["favorites"]).join(hits, "asset_id", "left_semi").select("asset_id")


def _no_tokens(c: Catalog) -> DataFrame:
    return c.spark.createDataFrame([], "asset_id long, token string")


query("SELECT asset_id FROM assets WHERE NOT deleted AND coalesce(sensitive_override, sensitive_score >= 0.6, FALSE)", "review_filter")(lambda c: library.review(c.assets).select("asset_id"))


@query("SELECT asset_id, CAST(NULL AS DOUBLE) AS sensitive_score, sensitive_override, CAST(stage & ~256 AS INT) AS stage FROM assets")
def review_clear(c: Catalog) -> DataFrame:
    return c.assets.select("asset_id", F.lit(None).cast("double").alias("sensitive_score"), "sensitive_override", store.clear_bits(F.col("stage"), store.SENSITIVE).alias("stage"))


@query("SELECT asset_id FROM assets WHERE NOT deleted AND media_type = 'image' AND NOT coalesce(sensitive_override, sensitive_score >= 0.6, FALSE)")
def slideshow_filter(c: Catalog) -> DataFrame:
    return library.live_images(c.assets).join(library.review(c.assets).select("asset_id"), "asset_id", "left_anti").select("asset_id")


query("SELECT person_id FROM persons WHERE NOT hidden", "people_visible")(lambda c: c.persons.filter(~F.col("hidden")).select("person_id"))


@query("SELECT person_id, name FROM persons WHERE lower(name) LIKE '%ion_1%' ORDER BY name LIMIT 8")
def name_typeahead(c: Catalog) -> DataFrame:
    return c.persons.filter(text.contains_ci(F.col("name"), "ION_1")).select("person_id", "name").orderBy("name").limit(8)


_GROUPS = "SELECT file_hash AS group_id, asset_id FROM assets WHERE file_hash IS NOT NULL"


@query(f"WITH g AS ({_GROUPS}) SELECT group_id, count(*) AS n FROM g WHERE asset_id NOT IN (SELECT asset_id FROM removals) GROUP BY 1 HAVING count(*) > 1")
def queue_group_filter(c: Catalog) -> DataFrame:
    g = c.assets.filter("file_hash is not null").select(F.col("file_hash").alias("group_id"), "asset_id")
    return g.join(c.removals, "asset_id", "left_anti").groupBy("group_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


@query(f"WITH g AS ({_GROUPS}), s AS (SELECT group_id, count(*) AS n, min(asset_id) AS head FROM g WHERE asset_id IN (SELECT asset_id FROM assets WHERE NOT deleted) GROUP BY 1 HAVING count(*) > 1) SELECT s.group_id, s.n, CASE WHEN s.head = f.first THEN s.head END AS recommended FROM s JOIN (SELECT group_id, min(asset_id) AS first FROM g GROUP BY 1) f USING (group_id)")
def prune_groups(c: Catalog) -> DataFrame:
    g = c.assets.filter("file_hash is not null").select(F.col("file_hash").alias("group_id"), "asset_id", "deleted")
    n = g.groupBy("group_id").agg(F.count_if(~F.col("deleted")).alias("n"), F.min("asset_id").alias("first"), F.min(F.when(~F.col("deleted"), F.col("asset_id"))).alias("head"))
    return n.filter("n > 1").select("group_id", "n", F.when(F.col("head") == F.col("first"), F.col("head")).alias("recommended"))


# Small lookups and mutations


@query("SELECT library_id, name, kind, path FROM libraries UNION ALL SELECT 0, 'system', 'photokit_system', NULL WHERE NOT EXISTS (SELECT 1 FROM libraries WHERE kind = 'photokit_system')")
def system_source(c: Catalog) -> DataFrame:
    wanted = c.spark.createDataFrame([(0, "system", "photokit_system", None)], "library_id long, name string, kind string, path string")
    return store.find_or_create(c.libraries.select("library_id", "name", "kind", "path"), wanted, ["kind"])


@query("WITH w AS (SELECT 900 + r_regionkey AS library_id, r_name AS name, 'import_folder' AS kind, '/lib/' || CASE WHEN r_regionkey = 0 THEN 'KENYA' ELSE r_name END AS path FROM region) SELECT library_id, name, kind, path FROM libraries UNION ALL SELECT * FROM w WHERE path NOT IN (SELECT path FROM libraries)")
def add_library(c: Catalog) -> DataFrame:
    w = c.raw("region").selectExpr("cast(900 + r_regionkey as long) as library_id", "r_name as name", "'import_folder' as kind", "'/lib/' || case when r_regionkey = 0 then 'KENYA' else r_name end as path")
    return store.find_or_create(c.libraries.select("library_id", "name", "kind", "path"), w, ["path"])


@query("SELECT library_id, CASE WHEN library_id = 3 THEN 999 ELSE opened_s END AS opened_s FROM libraries")
def touch_library(c: Catalog) -> DataFrame:
    return c.libraries.select("library_id", F.when(F.col("library_id") == 3, F.lit(999).cast("bigint")).otherwise(F.col("opened_s")).alias("opened_s"))


query("SELECT asset_key, file_path FROM assets WHERE library_id = 2 AND file_path IS NOT NULL", "file_paths")(lambda c: c.assets.filter("library_id = 2 and file_path is not null").select("asset_key", "file_path"))
query("SELECT DISTINCT file_hash FROM assets WHERE NOT deleted AND library_id = 1 AND file_hash IS NOT NULL", "file_hashes")(lambda c: store.live(c.assets, 1).filter("file_hash is not null").select("file_hash").distinct())
query("SELECT library_id FROM libraries ORDER BY 1", "source_ids")(lambda c: c.libraries.select("library_id").orderBy("library_id"))
query("SELECT crop_path FROM faces WHERE crop_path IS NOT NULL", "crop_paths")(lambda c: c.faces.filter("crop_path is not null").select("crop_path"))


@query("SELECT asset_id, CASE WHEN asset_id IN (SELECT asset_id FROM removals) THEN 'local' ELSE availability END AS availability FROM assets")
def set_availability(c: Catalog) -> DataFrame:
    return store.flag(c.assets, c.removals, "asset_id", availability=F.lit("local")).select("asset_id", "availability")


query("SELECT asset_id, nullif(trim(title), '') AS title FROM assets", "set_titles")(lambda c: c.assets.select("asset_id", text.blank_to_null(F.col("title")).alias("title")))


@query("SELECT asset_id, CASE WHEN asset_id % 14 = 0 THEN '/new/' || filename ELSE file_path END AS file_path FROM assets")
def update_location(c: Catalog) -> DataFrame:
    return store.flag(c.assets, c.removals, "asset_id", file_path=F.concat(F.lit("/new/"), "filename")).select("asset_id", "file_path")


@query("SELECT asset_id, 'Trip ' || lpad(CAST(row_number() OVER (ORDER BY asset_id) AS VARCHAR), 6, '0') AS new_title FROM assets WHERE asset_id % 14 = 0")
def rename_flow(c: Catalog) -> DataFrame:
    from pyspark.sql import Window

    # The window spans the renamed selection, which a user picks by hand.
    n = F.row_number().over(Window.orderBy("asset_id"))
    return c.assets.join(c.removals.select("asset_id"), "asset_id", "left_semi").select("asset_id", F.concat(F.lit("Trip "), text.padded(n, 6)).alias("new_title"))


query("SELECT text FROM texts WHERE asset_id = 7", "ocr_lookup")(lambda c: c.texts.filter("asset_id = 7").select("text"))
query("SELECT asset_a, asset_b, CASE WHEN asset_b IS NULL THEN 'excluded' ELSE 'pair' END AS kind FROM exclusions", "exclusions_read")(lambda c: c.exclusions.select("asset_a", "asset_b", F.when(F.col("asset_b").isNull(), "excluded").otherwise("pair").alias("kind")))


@query("WITH n AS (SELECT asset_id, 'manual' AS reason, CAST(5 AS BIGINT) AS added_s FROM assets WHERE asset_id % 28 = 0) SELECT * FROM removals WHERE asset_id NOT IN (SELECT asset_id FROM n) UNION ALL SELECT * FROM n")
def queue_add(c: Catalog) -> DataFrame:
    new = c.assets.filter("asset_id % 28 = 0").select("asset_id", F.lit("manual").alias("reason"), F.lit(5).cast("bigint").alias("added_s"))
    return store.replace_rows(c.removals, new, ["asset_id"])


@query("SELECT * FROM removals WHERE asset_id NOT IN (SELECT asset_id FROM assets WHERE favorite)")
def queue_remove(c: Catalog) -> DataFrame:
    return c.removals.join(c.assets.filter("favorite").select("asset_id"), "asset_id", "left_anti")


query("SELECT edit_id, asset_id, stack FROM edits UNION ALL SELECT -1, 7, 'new'", "edit_project_add")(lambda c: c.edits.select("edit_id", "asset_id", "stack").union(c.spark.createDataFrame([(-1, 7, "new")], "edit_id long, asset_id long, stack string")))
query("SELECT kind, count(*) AS n, CAST(sum(face_a) AS BIGINT) AS ids FROM constraints GROUP BY 1", "constraints_read")(lambda c: c.constraints.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.sum("face_a").alias("ids")))


@query("SELECT face_id, CASE WHEN face_id % 9 = 0 THEN 77 ELSE person_id END AS person_id FROM membership UNION ALL SELECT face_id, 77 FROM faces WHERE face_id % 9 = 0 AND face_id NOT IN (SELECT face_id FROM membership)")
def create_person(c: Catalog) -> DataFrame:
    new = c.faces.filter("face_id % 9 = 0").select("face_id", F.lit(77).cast("bigint").alias("person_id"))
    return store.replace_rows(c.membership.select("face_id", "person_id"), new, ["face_id"])


query("SELECT a.album_id, a.title FROM albums a WHERE NOT a.is_folder AND a.album_id IN (SELECT album_id FROM album_members WHERE asset_id = 42)", "album_of_asset")(lambda c: c.albums.filter("not is_folder").join(c.album_members.filter("asset_id = 42"), "album_id", "left_semi").select("album_id", "title"))
query("SELECT f.face_id, m.person_id, p.name FROM faces f LEFT JOIN membership m USING (face_id) LEFT JOIN persons p USING (person_id) WHERE f.asset_id = 42", "faces_of_asset")(lambda c: c.faces.filter("asset_id = 42").select("face_id").join(c.membership, "face_id", "left").join(c.persons, "person_id", "left").select("face_id", "person_id", "name"))
query("SELECT m.face_id, p.person_id, p.name FROM membership m JOIN persons p USING (person_id)", "person_of_face")(lambda c: c.membership.join(c.persons, "person_id").select("face_id", "person_id", "name"))
query("SELECT person_id, name FROM persons WHERE name IS NOT NULL ORDER BY name", "named_people")(lambda c: c.persons.filter("name is not null").select("person_id", "name").orderBy("name"))


@query("WITH w AS (SELECT r_name AS wanted FROM region UNION ALL SELECT 'kenya' UNION ALL SELECT 'Japan') SELECT wanted, p.person_id FROM w LEFT JOIN persons p ON lower(p.name) = lower(w.wanted)")
def identify_face(c: Catalog) -> DataFrame:
    w = c.raw("region").select(F.col("r_name").alias("wanted")).union(c.spark.createDataFrame([("kenya",), ("Japan",)], "wanted string"))
    return w.join(c.persons, F.lower("wanted") == F.lower("name"), "left").select("wanted", "person_id")


@query("SELECT asset_id, round(coalesce(sensitive_score, 0.25), 6) AS sensitive_score, CAST(stage | 256 AS INT) AS stage FROM assets")
def sensitive_save(c: Catalog) -> DataFrame:
    return c.assets.select("asset_id", F.round(F.coalesce("sensitive_score", F.lit(0.25)), 6).alias("sensitive_score"), store.set_bits(F.col("stage"), store.SENSITIVE).alias("stage"))


@query("SELECT asset_id, CASE WHEN asset_id % 14 = 0 THEN TRUE ELSE sensitive_override END AS sensitive_override FROM assets")
def override_set(c: Catalog) -> DataFrame:
    return store.flag(c.assets, c.removals, "asset_id", sensitive_override=F.lit(True)).select("asset_id", "sensitive_override")


@query("SELECT asset_id, CAST(CASE WHEN library_id = 2 THEN stage & ~24 ELSE stage END AS INT) AS stage FROM assets")
def reset_faces(c: Catalog) -> DataFrame:
    return c.assets.select("asset_id", F.when(F.col("library_id") == 2, store.clear_bits(F.col("stage"), store.FACES | store.FACE_EMBEDDINGS)).otherwise(F.col("stage")).alias("stage"))


_ACTIVITY = "SELECT at_s, role FROM messages ORDER BY at_s DESC, role LIMIT 20"
for _name in ("activity_read", "topk_activity"):
    query(_ACTIVITY, _name)(lambda c: c.messages.select("at_s", "role").orderBy(F.desc("at_s"), "role").limit(20))
query("SELECT 'messages' AS name, count(*) AS removed, CAST(0 AS BIGINT) AS remaining FROM messages", "activity_clear")(lambda c: store.delete_all(c.spark, {"messages": c.messages}))


@query("SELECT asset_id FROM assets UNION ALL SELECT DISTINCT 1000000 + asset_id FROM edits WHERE asset_id IN (SELECT asset_id FROM assets)")
def derivative_save(c: Catalog) -> DataFrame:
    made = c.edits.join(c.assets.select("asset_id"), "asset_id", "left_semi").select((F.col("asset_id") + 1000000).alias("asset_id")).distinct()
    return c.assets.select("asset_id").union(made)


@query("SELECT asset_id, deleted OR (asset_id IN (SELECT asset_id FROM removals) AND (SELECT count(*) FROM assets WHERE NOT deleted AND asset_id IN (SELECT asset_id FROM removals)) = 7) AS deleted FROM assets")
def delete_confirmed(c: Catalog) -> DataFrame:
    return store.delete_confirmed(c.assets, c.removals, 7).select("asset_id", "deleted")
