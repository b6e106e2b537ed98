"""Queries for joins, aggregates, rankings, sorts, set operations, search, albums, the read interface and change streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StructType

from ..functions import media, text
from ..operators import library, people, store
from ..operators.batches import Batches
from ..operators.rules import AlbumRule
from ..operators.textindex import TextIndex
from ..sources import foreign, sqlite
from ..sources.catalog import CATEGORIES, Catalog
from ..streaming import feed, windows
from .durable import durable, new_folder
from .registry import query
from .queries_scalar import _MEMBERS

# Joins


@query("SELECT entity_id AS asset_id, round(CAST(v.vector[1] AS DOUBLE), 6) AS head FROM embeddings_index e JOIN vectors v USING (embedding_id) WHERE entity_type = 'asset' AND model = 'print'")
def join_scene_vectors(c: Catalog) -> DataFrame:
    e = c.embeddings_index.filter("entity_type = 'asset' and model = 'print'")
    return e.join(c.vectors, "embedding_id").select(F.col("entity_id").alias("asset_id"), F.round(F.col("vector")[0].cast("double"), 6).alias("head"))


@query("SELECT f.face_id, f.asset_id, e.model, coalesce(quality, 0.5) AS quality, coalesce(pixel_size, 100) AS pixel_size FROM faces f JOIN assets a ON a.asset_id = f.asset_id AND NOT a.deleted JOIN embeddings_index e ON e.embedding_id = f.embedding_id JOIN vectors v ON v.embedding_id = f.embedding_id WHERE NOT f.ignored")
def join_stored_faces(c: Catalog) -> DataFrame:
    return library.stored_faces(c.faces, c.assets, c.embeddings_index, c.vectors).select("face_id", "asset_id", "model", "quality", "pixel_size")


@query("SELECT r.asset_id, r.added_s FROM removals r JOIN assets a USING (asset_id) WHERE NOT a.deleted ORDER BY added_s DESC, asset_id")
def join_removal_queue(c: Catalog) -> DataFrame:
    return c.removals.join(store.live(c.assets).select("asset_id"), "asset_id").select("asset_id", "added_s").orderBy(F.desc("added_s"), "asset_id")


@query("SELECT f.face_id, e.model, v.vector IS NOT NULL AS has_vector FROM faces f LEFT JOIN embeddings_index e ON e.embedding_id = f.embedding_id LEFT JOIN vectors v ON v.embedding_id = f.embedding_id")
def join_left_faces(c: Catalog) -> DataFrame:
    return c.faces.join(c.embeddings_index, "embedding_id", "left").join(c.vectors, "embedding_id", "left").select("face_id", "model", F.col("vector").isNotNull().alias("has_vector"))


_ANTI = "SELECT asset_id, category FROM categories a WHERE NOT EXISTS (SELECT 1 FROM overrides o WHERE o.asset_id = a.asset_id AND o.category = a.category)"
query(_ANTI, "join_category_anti")(lambda c: c.categories.join(c.overrides, ["asset_id", "category"], "left_anti").select("asset_id", "category"))
query("SELECT embedding_id FROM embeddings_index WHERE entity_id IN (SELECT face_id FROM faces WHERE NOT ignored) AND entity_id NOT IN (SELECT face_id FROM membership)", "join_in_subquery")(lambda c: c.embeddings_index.join(c.faces.filter("not ignored").select(F.col("face_id").alias("entity_id")), "entity_id", "left_semi").join(c.membership.select(F.col("face_id").alias("entity_id")), "entity_id", "left_anti").select("embedding_id"))
_LIBS = "SELECT l.library_id, l.name, (SELECT count(*) FROM assets a WHERE a.library_id = l.library_id AND NOT a.deleted) AS n FROM libraries l"


def _libraries(c: Catalog) -> DataFrame:
    n = store.live(c.assets).groupBy("library_id").agg(F.count(F.lit(1)).alias("n"))
    return c.libraries.join(n, "library_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))


query(_LIBS, "join_corr_scalar")(lambda c: _libraries(c).select("library_id", "name", "n"))
query(_LIBS + " ORDER BY l.kind = 'photokit_system' DESC, coalesce(l.opened_s, 0) DESC, l.library_id", "agg_libraries")(lambda c: _libraries(c).orderBy(F.desc(F.col("kind") == "photokit_system"), F.desc(F.coalesce("opened_s", F.lit(0))), "library_id").select("library_id", "name", "n"))

_TOKENS = "SELECT DISTINCT asset_id, unnest(regexp_split_to_array(strip_accents(lower(text)), '[^\\p{L}\\p{N}]+')) AS token FROM texts"


def _tokens(c: Catalog) -> DataFrame:
    return c.texts.select("asset_id", F.explode(F.array_distinct(text.fold_tokens(F.col("text")))).alias("token"))


def _index(c: Catalog) -> TextIndex:
    """An index of the texts as a catalog keeps it: the first half, then the rest in two additions, one of which corrects wrong words, and a few that go and come back."""
    tokens = durable(_tokens(c))  # texts are split once, not for each segment
    index = TextIndex.open(c.spark, new_folder(c.spark, "index"))
    index = index.add(tokens.filter("asset_id % 2 = 0").union(c.texts.filter("asset_id % 7 = 1").select("asset_id", F.lit("the clown"))))
    index = index.add(tokens.filter("asset_id % 2 = 1"), c.texts.filter("asset_id % 7 = 1").select("asset_id"))
    index = index.add(tokens.filter("asset_id % 14 = 8")).remove(c.texts.filter("asset_id % 5 = 0").select("asset_id"))
    return index.add(tokens.filter("asset_id % 5 = 0"))


query(f"WITH t AS ({_TOKENS}) SELECT DISTINCT a.asset_id FROM t JOIN assets a USING (asset_id) WHERE token LIKE 'idiot%'", "join_fts")(lambda c: _tokens(c).filter(F.startswith("token", F.lit("idiot"))).join(c.assets.select("asset_id"), "asset_id").select("asset_id").distinct())
query(f"WITH t AS ({_TOKENS}) SELECT token, count(*) AS n FROM t WHERE token <> '' GROUP BY 1", "fts_index")(lambda c: _index(c).merged().dictionary().filter("token <> ''"))
query(f"WITH t AS ({_TOKENS}) SELECT asset_id FROM texts WHERE asset_id IN (SELECT asset_id FROM t WHERE token LIKE 'the%') AND asset_id IN (SELECT asset_id FROM t WHERE token LIKE 'clow%')", "fts_prefix")(lambda c: _index(c).search(["the", "clow"]))
query("SELECT asset_id FROM assets WHERE title ILIKE '%to_en%' OR filename ILIKE '%to_en%' OR asset_key ILIKE '%to_en%'", "like_name")(lambda c: library.search(c.assets, c.spark.createDataFrame([], "asset_id long, token string"), c.tags.limit(0), "to_en"))
query("SELECT DISTINCT asset_id FROM tags WHERE source = 'user' AND label ILIKE '%E%'", "like_tag")(lambda c: c.tags.filter("source = 'user'").filter(F.col("label").ilike("%E%")).select("asset_id").distinct())
query(f"WITH t AS ({_TOKENS}) SELECT asset_id FROM t WHERE token LIKE 'en%' UNION SELECT asset_id FROM assets WHERE title ILIKE '%en%' OR filename ILIKE '%en%' OR asset_key ILIKE '%en%' UNION SELECT asset_id FROM tags WHERE source = 'user' AND label ILIKE '%en%'", "setop_search")(lambda c: library.search(c.assets, _index(c).postings(F.startswith("token", F.lit("en"))), c.tags, "en"))
query("SELECT w.k AS asset_key, a.asset_id FROM (SELECT 'file:src1/' || CAST(c_custkey AS VARCHAR) || '.jpg' AS k FROM customer) w JOIN assets a ON a.asset_key = w.k", "join_assets_keys")(lambda c: c.raw("customer").select(F.concat(F.lit("file:src1/"), F.col("c_custkey").cast("string"), F.lit(".jpg")).alias("asset_key")).join(c.assets.select("asset_key", "asset_id"), "asset_key"))

# Aggregates


@query("SELECT count(*) FILTER (media_type = 'image') AS photos, count(*) FILTER (media_type = 'video') AS videos, count(*) FILTER (subtype & 4 <> 0) AS screenshots, count(*) FILTER (subtype & 8 <> 0) AS live_photos, count(*) FILTER (favorite) AS favorites, count(*) FILTER (stage & 2 <> 0) AS hashed, count(*) FILTER (stage & 8 <> 0) AS faces_scanned, count(*) FILTER (availability = 'cloud_only') AS cloud_only, count(*) FILTER (availability = 'shared') AS shared, (SELECT count(*) FROM faces WHERE NOT ignored) AS faces, (SELECT count(name) FROM persons) AS named_people FROM assets WHERE NOT deleted")
def agg_library_stats(c: Catalog) -> DataFrame:
    return library.library_stats(c.assets, c.faces, c.persons)


_SUMMARY = "SELECT p.person_id, p.name, count(f.face_id) AS n_faces, count(DISTINCT f.asset_id) AS n_assets FROM persons p LEFT JOIN (SELECT person_id, face_id, asset_id FROM membership JOIN faces USING (face_id)) f USING (person_id) GROUP BY 1, 2"
query(_SUMMARY + " ORDER BY lower(p.name)", "agg_person_summary")(lambda c: library.person_summaries(c.persons, c.membership, c.faces).select("person_id", "name", "n_faces", "n_assets").orderBy(F.lower("name")))
query(_SUMMARY + " ORDER BY p.name IS NULL, n_faces DESC, person_id", "sort_people")(lambda c: library.person_summaries(c.persons, c.membership, c.faces).select("person_id", "name", "n_faces", "n_assets").orderBy(F.col("name").isNull(), F.desc("n_faces"), "person_id"))
query("SELECT p.person_id, coalesce(f.ids, '') AS ids FROM persons p LEFT JOIN (SELECT person_id, string_agg(CAST(face_id AS VARCHAR), ',' ORDER BY face_id) AS ids FROM membership WHERE confirmed GROUP BY 1) f USING (person_id)", "agg_confirmed_faces")(lambda c: c.persons.select("person_id").join(c.membership.filter("confirmed").groupBy("person_id").agg(F.array_join(F.sort_array(F.collect_list("face_id")), ",").alias("ids")), "person_id", "left").select("person_id", F.coalesce("ids", F.lit("")).alias("ids")))
query(f"SELECT category, count(*) AS n FROM ({_MEMBERS}) GROUP BY 1", "agg_category_members")(lambda c: library.category_members(c.categories, c.overrides).groupBy("category").agg(F.count(F.lit(1)).alias("n")))
query("SELECT label, count(DISTINCT asset_id) AS n FROM tags WHERE source = 'user' GROUP BY 1", "agg_user_tags")(lambda c: c.tags.filter("source = 'user'").groupBy("label").agg(F.countDistinct("asset_id").alias("n")))
_ALBUM = "SELECT album_id, string_agg(CAST(asset_id AS VARCHAR), ',' ORDER BY added_s, asset_id) AS members FROM album_members GROUP BY 1"


@query(_ALBUM)
def agg_album_members(c: Catalog) -> DataFrame:
    packed = F.sort_array(F.collect_list(F.struct("added_s", "asset_id")))
    return c.album_members.groupBy("album_id").agg(F.array_join(F.transform(packed, lambda r: r["asset_id"].cast("string")), ",").alias("members"))


query(_ALBUM, "album_order")(agg_album_members)
query("SELECT DISTINCT model FROM embeddings_index WHERE entity_type = 'face'", "agg_distinct_models")(lambda c: c.embeddings_index.filter("entity_type = 'face'").select("model").distinct())


@query("WITH i AS (SELECT asset_id, subtype, width % 40 AS w, file_hash FROM assets WHERE media_type = 'image') SELECT asset_id FROM i JOIN (SELECT subtype, w FROM i GROUP BY 1, 2 HAVING count(*) > 1) g USING (subtype, w) WHERE file_hash IS NULL")
def agg_exact_candidates(c: Catalog) -> DataFrame:
    i = c.assets.filter("media_type = 'image'").select("asset_id", "subtype", (F.col("width") % 40).alias("w"), "file_hash")
    shared = i.groupBy("subtype", "w").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return i.filter("file_hash is null").join(shared, ["subtype", "w"], "left_semi").select("asset_id")


query("SELECT asset_id, arg_max(stack, (updated_s, edit_id)) AS stack FROM edits GROUP BY 1", "agg_audit_latest")(lambda c: store.latest(c.edits, ["asset_id"], [F.col("updated_s"), F.col("edit_id")]).select("asset_id", "stack"))

# Windows and sorts


@query("WITH k AS (SELECT asset_id, library_id, created_s, coalesce(year(t) * 100 + month(t), -1) AS month FROM (SELECT *, to_timestamp(created_s) AT TIME ZONE 'UTC' AS t FROM assets)), r AS (SELECT *, CASE WHEN lag(month) OVER w IS DISTINCT FROM month THEN 1 ELSE 0 END AS new FROM k WINDOW w AS (PARTITION BY library_id ORDER BY created_s DESC NULLS LAST, asset_id)), s AS (SELECT *, CAST(sum(new) OVER (PARTITION BY library_id ORDER BY created_s DESC NULLS LAST, asset_id) AS BIGINT) AS section FROM r) SELECT library_id, section, CAST(month AS INT) AS month, count(*) AS n FROM s GROUP BY ALL")
def sections_runs(c: Catalog) -> DataFrame:
    return library.section_runs(c.assets, "library_id")


query("WITH n AS (SELECT asset_id, 'x' || CAST(asset_id % 50 AS VARCHAR) AS name FROM assets) SELECT asset_id, CASE WHEN row_number() OVER w > 1 THEN name || ' ' || CAST(row_number() OVER w AS VARCHAR) ELSE name END AS unique_name FROM n WINDOW w AS (PARTITION BY lower(name) ORDER BY asset_id)", "uniq_names")(lambda c: library.uniq_names(c.assets.select("asset_id", F.concat(F.lit("x"), (F.col("asset_id") % 50).cast("string")).alias("name")), "name", "asset_id").select("asset_id", "unique_name"))


@query("SELECT asset_id, lpad(CAST(n AS VARCHAR), CAST(greatest(3, length(CAST(n AS VARCHAR))) AS INT), '0') AS number FROM (SELECT asset_id, 7 + row_number() OVER (PARTITION BY library_id ORDER BY asset_id) AS n FROM assets)")
def seq_number(c: Catalog) -> DataFrame:
    n = F.row_number().over(Window.partitionBy("library_id").orderBy("asset_id")) + 7
    return c.assets.select("asset_id", text.padded(n, 3).alias("number"))


@query("SELECT asset_id, round(coalesce(sharpness, 0), 6) AS sharpness FROM assets WHERE NOT deleted ORDER BY coalesce(sharpness, 0) DESC, asset_id")
def sort_grid(c: Catalog) -> DataFrame:
    return store.live(c.assets).orderBy(*library.sort_keys("sharpest")).select("asset_id", F.round(F.coalesce("sharpness", F.lit(0.0)), 6).alias("sharpness"))


query("SELECT person_id, name FROM persons ORDER BY lower(name)", "sort_nocase")(lambda c: c.persons.select("person_id", "name").orderBy(F.expr("name collate UTF8_LCASE")))
query("SELECT CAST((SELECT count(*) FROM assets WHERE NOT deleted) AS BIGINT) AS total, asset_id FROM assets WHERE NOT deleted ORDER BY created_s DESC NULLS LAST, asset_id LIMIT 20 OFFSET 40", "page")(lambda c: library.page(store.live(c.assets), library.sort_keys("newest"), 40, 20).select("asset_id").crossJoin(store.live(c.assets).agg(F.count(F.lit(1)).alias("total"))))
query("SELECT asset_id FROM assets WHERE NOT deleted ORDER BY md5('7/' || CAST(asset_id AS VARCHAR))", "slideshow_order")(lambda c: store.live(c.assets).select("asset_id").orderBy(library.shuffled(F.col("asset_id"), 7)))
query("SELECT asset_id FROM (SELECT asset_id, row_number() OVER (ORDER BY created_s DESC NULLS LAST, asset_id) AS n FROM assets WHERE NOT deleted AND library_id = 2 AND media_type = 'image') WHERE n BETWEEN 5 AND 25", "selection")(lambda c: library.live_images(c.assets).filter("library_id = 2").select("asset_id", "created_s").orderBy(*library.sort_keys("newest")).limit(25).offset(4).select("asset_id"))

# Set operations, trees and albums

_NODES = "SELECT album_id, parent_id FROM albums UNION ALL SELECT album_id, parent_id FROM folders"
_TREE = f"WITH RECURSIVE n AS ({_NODES}), d AS (SELECT album_id AS ancestor, album_id FROM n UNION SELECT d.ancestor, n.album_id FROM d JOIN n ON n.parent_id = d.album_id)"


def _nodes(c: Catalog) -> DataFrame:
    return c.albums.select("album_id", "parent_id").union(c.folders.select("album_id", "parent_id"))


# Every album whose number ends in 5 is smart: it shows the favourites with one label.
_SMART = "SELECT a.album_id, t.asset_id FROM albums a JOIN (SELECT DISTINCT x.asset_id, lower(label) AS label FROM tags x JOIN assets y ON y.asset_id = x.asset_id WHERE favorite AND NOT deleted) t ON t.label = CASE WHEN a.album_id % 2 = 0 THEN 'de' ELSE 'en' END WHERE a.album_id % 10 = 5"


def _shown_members(c: Catalog) -> DataFrame:
    """(album_id, asset_id) of manual and smart albums."""
    smart = [AlbumRule(tags=[label], favorites_only=True).evaluate(_items(c), _person_assets(c), c.tags, library.category_members(c.categories, c.overrides)).select("asset_id", F.lit(label).alias("label")) for label in ("de", "en")]
    wants = c.albums.filter("album_id % 10 = 5").select("album_id", F.when(F.col("album_id") % 2 == 0, "de").otherwise("en").alias("label"))
    return c.album_members.filter("album_id % 10 <> 5").select("album_id", "asset_id").union(wants.join(smart[0].union(smart[1]), "label").select("album_id", "asset_id"))


@query(_TREE + f", m AS (SELECT album_id, asset_id FROM album_members WHERE album_id % 10 <> 5 UNION ALL {_SMART}) SELECT DISTINCT d.ancestor AS album_id, m.asset_id FROM d JOIN m ON m.album_id = d.album_id")
def setop_folder(c: Catalog) -> DataFrame:
    """What every album and folder shows: its own members, manual or smart, and those of all albums below it."""
    return library.descendants(_nodes(c)).join(_shown_members(c), "album_id").select(F.col("ancestor").alias("album_id"), "asset_id").distinct()


_TREE_12 = f"WITH RECURSIVE n AS ({_NODES}), l AS (SELECT album_id AS ancestor, album_id, 0 AS depth FROM n UNION SELECT l.ancestor, n.album_id, depth + 1 FROM l JOIN n ON n.parent_id = l.album_id WHERE depth < 12), d AS (SELECT DISTINCT ancestor, album_id FROM l)"


@query(_TREE_12 + " SELECT d.ancestor AS album_id, count(DISTINCT d.album_id) - 1 AS n_below, count(DISTINCT m.asset_id) AS n_assets FROM d LEFT JOIN album_members m ON m.album_id = d.album_id GROUP BY 1")
def album_tree(c: Catalog) -> DataFrame:
    d = library.descendants(_nodes(c), depth=12).join(c.album_members, "album_id", "left")
    return d.groupBy(F.col("ancestor").alias("album_id")).agg((F.countDistinct("album_id") - 1).alias("n_below"), F.countDistinct("asset_id").alias("n_assets"))


_PATHS = "n AS (SELECT album_id, parent_id, title FROM albums UNION ALL SELECT album_id, parent_id, title FROM folders), p AS (SELECT album_id, title AS path FROM n WHERE parent_id IS NULL OR parent_id NOT IN (SELECT album_id FROM n) UNION ALL SELECT n.album_id, p.path || '/' || n.title FROM n JOIN p ON n.parent_id = p.album_id)"


@query(f"WITH RECURSIVE {_PATHS} SELECT p.path, m.asset_id FROM albums a JOIN p USING (album_id) JOIN album_members m USING (album_id) WHERE NOT a.is_folder")
def album_memberships(c: Catalog) -> DataFrame:
    """Albums' paths from the top, however deep they lie, with their members."""
    nodes = c.albums.select("album_id", "parent_id", "title").union(c.folders.select("album_id", "parent_id", "title"))
    return c.albums.filter("not is_folder").select("album_id").join(library.paths(nodes), "album_id").join(c.album_members, "album_id").select("path", "asset_id")


query(_TREE_12 + " SELECT ancestor, album_id FROM d", "platform_album_tree")(lambda c: library.descendants(_nodes(c), depth=12))


@query("WITH m AS (SELECT asset_id, year(t) AS y, month(t) AS m FROM (SELECT *, to_timestamp(created_s) AT TIME ZONE 'UTC' AS t FROM assets WHERE NOT deleted AND media_type = 'image' AND created_s IS NOT NULL)) SELECT CAST(y AS INT) AS year, CAST(m AS INT) AS month, count(DISTINCT asset_id) AS n FROM m GROUP BY 1, 2 UNION ALL SELECT CAST(y AS INT), NULL, count(DISTINCT asset_id) FROM m GROUP BY 1")
def setop_date_tree(c: Catalog) -> DataFrame:
    t = F.timestamp_seconds("created_s")
    a = library.live_images(c.assets).filter("created_s is not null").select("asset_id", F.year(t).alias("year"), F.month(t).alias("month"))
    return a.rollup("year", "month").agg(F.countDistinct("asset_id").alias("n")).filter("year is not null").select("year", "month", "n")


@query("WITH p AS (SELECT page_id, string_split(path, '/') AS parts FROM media_files) SELECT directory, count(DISTINCT page_id) AS n FROM (SELECT page_id, unnest(list_transform(range(1, len(parts)), lambda k: array_to_string(parts[1:k], '/'))) AS directory FROM p) GROUP BY 1")
def setop_dir_tree(c: Catalog) -> DataFrame:
    return library.path_prefixes(c.media_files, "path").groupBy("directory").agg(F.countDistinct("page_id").alias("n"))


def _items(c: Catalog) -> DataFrame:
    return store.live(c.assets).select("asset_id", F.coalesce("title", "filename", F.lit("")).alias("name"), (F.col("media_type") == "video").alias("is_video"), "favorite")


_PEOPLE = "SELECT f.asset_id, m.person_id FROM membership m JOIN faces f USING (face_id)"


def _person_assets(c: Catalog) -> DataFrame:
    return c.membership.join(c.faces, "face_id").select("asset_id", "person_id")


@query(f"WITH p AS ({_PEOPLE}) SELECT asset_id FROM assets WHERE NOT deleted AND media_type <> 'video' AND (asset_id IN (SELECT asset_id FROM p WHERE person_id IN (3, 7) GROUP BY 1 HAVING count(DISTINCT person_id) = 2) OR contains(lower(coalesce(title, filename, '')), 'photo en') OR asset_id IN (SELECT asset_id FROM tags WHERE lower(label) = 'fr'))")
def setop_rule(c: Catalog) -> DataFrame:
    rule = AlbumRule(people=[3, 7], all_people=True, name_contains="photo EN ", tags=["FR"], match_all=False, media="photos")
    return rule.evaluate(_items(c), _person_assets(c), c.tags, library.category_members(c.categories, c.overrides)).select("asset_id")


@query(f"SELECT asset_id FROM assets WHERE NOT deleted AND favorite AND asset_id IN (SELECT asset_id FROM tags WHERE lower(label) IN ('en', 'de')) AND asset_id IN (SELECT asset_id FROM ({_MEMBERS}) WHERE category IN ('camera', 'document', 'screenshot'))")
def smart_album(c: Catalog) -> DataFrame:
    rule = AlbumRule(tags=["en", "de"], categories=["camera", "document", "screenshot"], favorites_only=True)
    return rule.evaluate(_items(c), _person_assets(c), c.tags, library.category_members(c.categories, c.overrides)).select("asset_id")


query(f"SELECT DISTINCT asset_id FROM ({_PEOPLE}) WHERE person_id = 5", "person_album")(lambda c: _person_assets(c).filter("person_id = 5").select("asset_id").distinct())


@query("WITH r AS (SELECT DISTINCT asset_id, CASE WHEN lower(label) = 'en' THEN 'english' ELSE (SELECT min(t.label) FROM tags t WHERE lower(t.label) = lower(tags.label)) END AS label FROM tags) SELECT label, count(*) AS n FROM r GROUP BY 1")
def tag_crud(c: Catalog) -> DataFrame:
    """Every spelling of a tag becomes the least one in use; 'en' is renamed, and rows that meet become one."""
    spelling = c.tags.groupBy(F.lower("label").alias("k")).agg(F.min("label").alias("spelling"))
    named = c.tags.withColumn("k", F.lower("label")).join(spelling, "k").select("asset_id", F.when(F.col("k") == "en", "english").otherwise(F.col("spelling")).alias("label")).distinct()
    return named.groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT album_id, CASE WHEN album_id = 103 THEN 'Renamed' ELSE title END AS title, CASE WHEN album_id = 104 THEN 2 ELSE parent_id END AS parent_id FROM albums WHERE album_id <> 105 UNION ALL SELECT 999, 'New', 1")
def album_crud(c: Catalog) -> DataFrame:
    a = c.albums.filter("album_id <> 105").select("album_id", F.when(F.col("album_id") == 103, "Renamed").otherwise(F.col("title")).alias("title"), F.when(F.col("album_id") == 104, F.lit(2).cast("bigint")).otherwise(F.col("parent_id")).alias("parent_id"))
    return a.union(c.spark.createDataFrame([(999, "New", 1)], "album_id long, title string, parent_id long"))


# Read interface


@query(f"WITH RECURSIVE n AS ({_NODES}), d AS (SELECT album_id FROM n WHERE album_id = 1 UNION SELECT n.album_id FROM d JOIN n ON n.parent_id = d.album_id), h AS (SELECT asset_id FROM assets WHERE NOT deleted AND NOT coalesce(sensitive_override, sensitive_score >= 0.6, FALSE) AND media_type = 'image' AND asset_id IN (SELECT asset_id FROM tags WHERE lower(label) = 'en' AND source = 'user') AND asset_id IN (SELECT asset_id FROM album_members WHERE album_id IN (SELECT album_id FROM d))) SELECT (SELECT count(*) FROM h) AS total, asset_id FROM h ORDER BY asset_id LIMIT 25 OFFSET 5")
def api_assets(c: Catalog) -> DataFrame:
    a = library.live_images(c.assets).join(library.review(c.assets).select("asset_id"), "asset_id", "left_anti")
    a = a.join(c.tags.filter("source = 'user'").filter(F.lower("label") == "en").select("asset_id"), "asset_id", "left_semi")
    album = library.descendants(_nodes(c)).filter("ancestor = 1").join(c.album_members, "album_id").select("asset_id")
    a = a.join(album, "asset_id", "left_semi").select("asset_id")
    return a.orderBy("asset_id").offset(5).limit(25).crossJoin(a.agg(F.count(F.lit(1)).alias("total")))


@query(f"SELECT 'category' AS kind, k AS name, count(m.asset_id) AS n FROM (SELECT unnest({list(CATEGORIES)!r}) AS k) LEFT JOIN ({_MEMBERS}) m ON m.category = k GROUP BY 2 UNION ALL SELECT 'album', title, count(m.asset_id) FROM albums LEFT JOIN album_members m USING (album_id) GROUP BY 2 UNION ALL SELECT 'tag', label, count(DISTINCT asset_id) FROM tags WHERE source = 'user' GROUP BY 2")
def api_counts(c: Catalog) -> DataFrame:
    names = c.spark.createDataFrame([(k,) for k in CATEGORIES], "category string")
    cats = names.join(library.category_members(c.categories, c.overrides), "category", "left").groupBy("category").agg(F.count("asset_id").alias("n")).select(F.lit("category").alias("kind"), F.col("category").alias("name"), "n")
    albums = c.albums.join(c.album_members, "album_id", "left").groupBy("title").agg(F.count("asset_id").alias("n")).select(F.lit("album").alias("kind"), F.col("title").alias("name"), "n")
    tags = c.tags.filter("source = 'user'").groupBy("label").agg(F.countDistinct("asset_id").alias("n")).select(F.lit("tag").alias("kind"), F.col("label").alias("name"), "n")
    return cats.union(albums).union(tags)


@query("SELECT library_id, name FROM libraries WHERE library_id <> 4 UNION ALL SELECT 50, 'added'")
def registry(c: Catalog) -> DataFrame:
    return c.libraries.filter("library_id <> 4").select("library_id", "name").union(c.spark.createDataFrame([(50, "added")], "library_id long, name string"))


# Foreign sources, streams and batches


def _photo_library(c: Catalog) -> str:
    """The catalog's assets and albums as a photo library's database files, in the newer generation of its schema."""
    path, i = new_folder(c.spark, "photo-library"), F.col("asset_id")
    kind, trashed = F.when(i % 23 == 0, 7).when(F.col("media_type") == "video", 1).otherwise(0), F.col("deleted").cast("int")
    sub = F.when(i % 5 == 0, 10).when(i % 5 == 1, 2).otherwise(0)
    taken = F.col("created_s") - 978307200.0
    sqlite.write_tables(c.assets.select(i.alias("Z_PK"), F.col("asset_key").alias("ZUUID"), F.col("filename").alias("ZFILENAME"), kind.alias("ZKIND"), sub.alias("ZKINDSUBTYPE"), trashed.alias("ZTRASHEDSTATE"), taken.alias("ZDATECREATED")), path, "ZASSET")
    albums = c.albums.select(F.col("album_id").alias("Z_PK"), F.col("title").alias("ZTITLE"), F.when(F.col("is_folder"), 4000).otherwise(2).alias("ZKIND"), F.col("parent_id").alias("ZPARENTFOLDER"), F.when(F.col("album_id") % 9 == 0, 1).alias("ZTRASHEDSTATE"))
    sqlite.write_tables(albums, path, "ZGENERICALBUM")
    sqlite.write_tables(c.album_members.select(F.col("album_id").alias("Z_28ALBUMS"), F.col("asset_id").alias("Z_3ASSETS")), path, "Z_28ASSETS")
    return path


@query("SELECT asset_key, media_type, created_s, CAST(CASE WHEN asset_id % 5 = 0 THEN 4 WHEN asset_id % 5 = 1 THEN 8 ELSE 0 END AS INT) AS subtype FROM assets WHERE NOT deleted AND asset_id % 23 <> 0")
def scan_library_sql(c: Catalog) -> DataFrame:
    """A foreign library's items: its files are written from the assets and read back by ranges of rows."""
    return foreign.scan_library(c.spark, _photo_library(c)).select("asset_key", "media_type", F.unix_seconds("created_at").alias("created_s"), "subtype")


@query("SELECT a.album_id, a.title, a.parent_id, k.asset_key FROM albums a LEFT JOIN (SELECT m.album_id, x.asset_key FROM album_members m JOIN assets x ON x.asset_id = m.asset_id WHERE NOT x.deleted AND x.asset_id % 23 <> 0) k ON k.album_id = a.album_id WHERE a.album_id % 9 <> 0")
def scan_albums_sql(c: Catalog) -> DataFrame:
    """A foreign library's albums with their members."""
    return foreign.scan_albums(c.spark, _photo_library(c))


@query()
def scan_folder(c: Catalog) -> DataFrame:
    return foreign.scan_folder(c.spark, c.folder, "*.parquet").select("asset_key", "size")


@query("SELECT library_id, count(*) AS n FROM assets GROUP BY 1")
def split_db(c: Catalog) -> DataFrame:
    return foreign.split_by_library(c.assets.select("asset_id", "library_id"))


@query("SELECT asset_id, asset_key, CAST(NULL AS DOUBLE) AS sharpness, 'photokit' AS asset_source, CAST(NULL AS VARCHAR) AS file_path, CAST(NULL AS VARCHAR) AS title, CAST(NULL AS DOUBLE) AS sensitive_score, CAST(NULL AS BOOLEAN) AS sensitive_override, CAST(NULL AS VARCHAR) AS rule FROM assets")
def migrations_run(c: Catalog) -> DataFrame:
    from ..sources import schema

    return schema.migrate(c.assets.select("asset_id", "asset_key"), 1)


@query("SELECT asset_id, CASE WHEN asset_id % 5 <> 0 THEN 1000.0 / (asset_id % 5) END AS result, CASE WHEN asset_id % 5 = 0 THEN 'ZeroDivisionError' END AS error FROM assets")
def batch_foreach(c: Catalog) -> DataFrame:
    return foreign.try_each(c.assets.select("asset_id", "width"), "asset_id long, result double, error string", lambda r: (r["asset_id"], 1000.0 / (r["asset_id"] % 5), None))


def _try_ratio(row: dict) -> tuple:
    if row["asset_id"] % 7 == 0 and row["_attempt"] == 1:
        raise OSError
    return (1000.0 / (row["asset_id"] % 5),)


_RATIO_SQL = """
    SELECT asset_id, CAST(CASE WHEN asset_id % 5 = 0 THEN 3 WHEN asset_id % 7 = 0 THEN 2 ELSE 1 END AS INT) AS attempts, asset_id % 5 <> 0 AS done,
        CASE WHEN asset_id % 5 = 0 THEN 'ZeroDivisionError' END AS error, CASE WHEN asset_id % 5 <> 0 THEN 1000.0 / (asset_id % 5) END AS ratio
    FROM assets"""


@query(_RATIO_SQL)
def batch_resume(c: Catalog) -> DataFrame:
    """A job over all assets in four chunks that is stopped after two, and goes on from its ledger in a second run."""
    items = c.assets.select("asset_id")
    job = Batches(c.spark, new_folder(c.spark, "ledger"), "asset_id", StructType().add("ratio", DoubleType()), chunk_rows=items.count() // 4 + 1)
    job.run(items, _try_ratio, lambda done, _: done < 2)
    job.run(items, _try_ratio)
    return job.results(items).select("asset_id", "attempts", "done", "error", "result.ratio")


@query("SELECT asset_key, asset_id, CASE WHEN asset_id % 5 = 0 THEN 7 WHEN asset_id % 3 = 0 THEN 1 ELSE stage END AS stage FROM assets WHERE asset_id % 6 <> 0 OR asset_id % 5 = 0")
def stream_changes(c: Catalog) -> DataFrame:
    return windows.replay_changes(c.spark, c.assets.select("asset_key", "asset_id", "stage"))


_FEED_SQL = """
    WITH s AS (SELECT *, asset_id % 6 <> 0 OR asset_id % 5 = 0 AS was, CASE WHEN asset_id % 5 = 0 THEN 7 WHEN asset_id % 3 = 0 THEN 1 ELSE stage END AS stage_was,
            asset_id % 8 = 0 OR (asset_id % 4 <> 0 AND asset_id % 8 <> 1) AS now, CASE WHEN asset_id % 8 = 0 THEN 6 ELSE 5 END AS stage_now FROM assets)
    SELECT asset_key, CASE WHEN now THEN stage_now END AS stage,
        CASE WHEN was AND NOT now THEN 'deleted' WHEN now AND NOT was THEN 'inserted' WHEN stage_was <> stage_now OR asset_id % 8 = 0 THEN 'updated' END AS change
    FROM s WHERE was OR now"""


@query(_FEED_SQL)
def stream_feed(c: Catalog) -> DataFrame:
    """A feed of upserts, deletes and late repeats in three runs, whose source then loses history: a reconcile from a snapshot, and a run after it.

    Result: the living assets and those that were deleted since the third run, with what became of them since.
    """
    base, rows = new_folder(c.spark, "feed"), c.assets.select("asset_key", "asset_id", "stage")
    f = feed.ChangeFeed(c.spark, f"{base}/feed", "asset_key", StructType().add("asset_id", LongType()).add("stage", IntegerType()))

    def change(run: int, seq: int, where: str, stage: str = "stage", op: str = "'upsert'") -> None:
        df = rows.filter(where).selectExpr("asset_key", f"{seq}L AS seq", f"{op} AS op", "asset_id", f"{stage} AS stage")
        df.write.mode("append").parquet(f"{base}/in/{run}")

    change(0, 1, "true")
    f.apply(f"{base}/in", first=1)
    change(1, 3, "asset_id % 3 = 0", "1", "if(asset_id % 2 = 0, 'delete', 'upsert')")
    f.apply(f"{base}/in", first=1)
    change(2, 2, "asset_id % 6 = 0", "9")
    change(2, 4, "asset_id % 5 = 0", "7")
    f.apply(f"{base}/in", first=1)
    at = f.position()
    change(3, 10, "asset_id % 8 = 0", "6")
    change(3, 11, "asset_id % 8 = 1", "stage", "'delete'")
    if not f.apply(f"{base}/in", first=10):
        f.reconcile(rows.filter("asset_id % 4 <> 0").withColumn("stage", F.lit(5)), 9)
        f.apply(f"{base}/in", first=10)
    return f.table().join(f.delta(at), "asset_key", "full_outer").select("asset_key", "stage", "change")


@query("WITH d AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 15 MINUTE THEN 0 ELSE 1 END AS new FROM moments), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM d) SELECT user_id, count(*) AS n, epoch_us(min(ts)) AS first_us FROM s GROUP BY user_id, s")
def session_windows(c: Catalog) -> DataFrame:
    return windows.sessions(c.moments, 900)


@query("SELECT epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) // 1000 AS start_ms, event_type, count(*) AS n FROM moments GROUP BY 1, 2")
def tumbling_windows(c: Catalog) -> DataFrame:
    return windows.tumbling(c.moments, "1 hour")


@query("SELECT epoch_us(time_bucket(INTERVAL 30 MINUTE, ts) - k * INTERVAL 30 MINUTE) // 1000 AS start_ms, event_type, count(*) AS n FROM moments, (SELECT unnest([0, 1]) AS k) GROUP BY 1, 2")
def sliding_windows(c: Catalog) -> DataFrame:
    return windows.tumbling(c.moments, "1 hour", slide="30 minutes")


@query("SELECT epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) // 1000 AS start_ms, event_type, count(*) AS n FROM moments GROUP BY 1, 2")
def watermark_windows(c: Catalog) -> DataFrame:
    """The tumbling windows as a stream with a watermark, closed by a last event far in the future."""
    return windows.streamed_windows(c.spark, c.moments)


@query("SELECT asset_id FROM assets WHERE deleted AND (title ILIKE '%en%' OR filename ILIKE '%en%' OR asset_key ILIKE '%en%')")
def search_tombstoned(c: Catalog) -> DataFrame:
    """Search does not leave tombstoned rows out, and an empty query finds nothing."""
    none = c.spark.createDataFrame([], "asset_id long, token string")
    found = library.search(c.assets, none, c.tags.limit(0), "en").union(library.search(c.assets, none, c.tags, " "))
    return c.assets.filter("deleted").join(found, "asset_id", "left_semi").select("asset_id")


query("WITH n AS (SELECT face_id FROM faces WHERE asset_id = 43) SELECT face_id, person_id, confirmed FROM membership WHERE face_id NOT IN (SELECT face_id FROM n) UNION ALL SELECT face_id, 8, TRUE FROM n", "add_faces")(lambda c: people.confirm(c.membership, c.constraints, 8, c.faces.filter("asset_id = 43").select("face_id"))[0])
query("SELECT face_id, asset_id, FALSE AS is_manual FROM faces UNION ALL SELECT 77777, 7, TRUE", "add_manual_face")(lambda c: c.faces.select("face_id", "asset_id", F.lit(False).alias("is_manual")).union(c.spark.createDataFrame([(77777, 7, True)], "face_id long, asset_id long, is_manual boolean")))
_ALL = ("assets", "faces", "persons", "tags", "albums", "edits")
query(" UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS removed, CAST(0 AS BIGINT) AS remaining FROM {t}" for t in _ALL), "delete_all_data")(lambda c: store.delete_all(c.spark, {t: getattr(c, t) for t in _ALL}))


@query("SELECT name FROM (SELECT 'backup-' || lpad(CAST(o_custkey AS VARCHAR), 6, '0') AS name FROM (SELECT DISTINCT o_custkey FROM orders)) ORDER BY name DESC LIMIT 3")
def backup(c: Catalog) -> DataFrame:
    """Which snapshots stay: the newest three by name."""
    names = c.raw("orders").select(F.concat(F.lit("backup-"), text.padded(F.col("o_custkey"), 6)).alias("name")).distinct()
    return names.orderBy(F.desc("name")).limit(3)
