"""Queries for scalar functions, rules and policies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import media, text
from ..operators import library, rules
from ..sources.catalog import Catalog
from .registry import query

_STRIP = r"regexp_replace(filename, '^(.+)\.[\p{L}\p{N}]{1,5}$', '\1')"
query(rf"SELECT asset_id, {_STRIP} AS base FROM assets", "sc_strip_extension")(lambda c: c.assets.select("asset_id", text.strip_extension(F.col("filename")).alias("base")))


@query(r"SELECT page_id, trim(regexp_replace(regexp_replace(path, '[/:\x00-\x1f]', '-', 'g'), '\s+', ' ', 'g')) AS cleaned FROM media_files")
def sc_clean_name(c: Catalog) -> DataFrame:
    return c.media_files.select("page_id", text.clean_name(F.col("path")).alias("cleaned"))


_C = r"[\s_\-.]*(?:\(\d+\)|\d+)"


@query(rf"WITH b AS (SELECT asset_id, {_STRIP} || CASE asset_id % 4 WHEN 0 THEN '' ELSE repeat(' (' || CAST(asset_id % 10 AS VARCHAR) || ')', CAST(asset_id % 7 AS INT)) END AS base FROM assets), s AS (SELECT asset_id, base, regexp_replace(CASE WHEN regexp_matches(base, '^({_C})+$') THEN regexp_extract(base, '^({_C})', 1) ELSE regexp_replace(base, '({_C})+$', '') END, '^[ _\-.]+|[ _\-.]+$', '', 'g') AS s FROM b) SELECT asset_id, CASE WHEN s = '' THEN base ELSE s END AS stem FROM s")
def sc_name_stem(c: Catalog) -> DataFrame:
    counters = F.when(F.col("asset_id") % 4 == 0, "").otherwise(F.repeat(F.concat(F.lit(" ("), (F.col("asset_id") % 10).cast("string"), F.lit(")")), (F.col("asset_id") % 7).cast("int")))
    return c.assets.select("asset_id", text.name_stem(F.concat(text.strip_extension(F.col("filename")), counters)).alias("stem"))


@query(rf"SELECT asset_id, {_STRIP} || '_' || lpad(CAST(asset_id + 1 AS VARCHAR), CAST(greatest(3, length(CAST(asset_id + 1 AS VARCHAR))) AS INT), '0') || '_' || coalesce(strftime(to_timestamp(created_s) AT TIME ZONE 'UTC', '%Y-%m-%d %H-%M-%S'), ' ') AS new_name FROM assets WHERE filename IS NOT NULL AND created_s IS NOT NULL")
def sc_rename_pattern(c: Catalog) -> DataFrame:
    a = c.assets.filter("filename is not null and created_s is not null")
    return a.select("asset_id", text.rename_pattern("{Name}_{n}_{date} {time}", F.col("filename"), F.col("asset_id") + 1, F.timestamp_seconds("created_s"), F.lit(None).cast("string")).alias("new_name"))


query(rf"SELECT asset_id, regexp_replace({_STRIP}, 'SRC', 'img-', 'gi') AS new_name FROM assets", "sc_rename_replace")(lambda c: c.assets.select("asset_id", text.rename_replace(F.col("filename"), "SRC", "img-").alias("new_name")))
query(rf"SELECT asset_id, 'a ' || {_STRIP} || ' z' AS new_name FROM assets", "sc_rename_affix")(lambda c: c.assets.select("asset_id", text.rename_affix(F.col("filename"), "a ", " z").alias("new_name")))
query("SELECT asset_id, contains(lower(asset_key), 'src1') AS inside, lower(asset_key) = 'file:src1/1.jpg' AS same, starts_with(lower(asset_key), 'file:src2') AS prefixed FROM assets", "sc_ci_match")(lambda c: c.assets.select("asset_id", text.contains_ci(F.col("asset_key"), "SRC1").alias("inside"), (F.lower("asset_key") == "file:src1/1.jpg").alias("same"), F.startswith(F.lower("asset_key"), F.lit("file:src2")).alias("prefixed")))


@query(r"SELECT asset_id, regexp_matches(n, '^(screenshot|screen shot|screen_shot|scr_|screencapture)', 'i') AS screenshot, regexp_matches(n, '^IMG-\d{8}-WA\d+|^whatsapp (image|video)|-WA\d{4}\.[A-Za-z]+$', 'i') AS whatsapp, regexp_matches(n, '^(FB_IMG_|received_|Snapchat-|InShot_|IMG_\d{8}_\d{6}_\d+)|instagram', 'i') AS social FROM (SELECT asset_id, CASE asset_id % 5 WHEN 0 THEN 'Screenshot ' || CAST(asset_id AS VARCHAR) || '.png' WHEN 1 THEN 'IMG-20200101-WA0001.jpg' WHEN 2 THEN 'FB_IMG_1.jpg' ELSE asset_key END AS n FROM assets)")
def sc_filename_regex(c: Catalog) -> DataFrame:
    i = F.col("asset_id") % 5
    n = F.when(i == 0, F.concat(F.lit("Screenshot "), F.col("asset_id").cast("string"), F.lit(".png"))).when(i == 1, "IMG-20200101-WA0001.jpg").when(i == 2, "FB_IMG_1.jpg").otherwise(F.col("asset_key"))
    return c.assets.select("asset_id", rules.is_screenshot_name(n).alias("screenshot"), rules.is_whatsapp_name(n).alias("whatsapp"), rules.is_social_name(n).alias("social"))


@query("SELECT asset_id, CAST(year(t) AS INT) AS year, CAST(month(t) AS INT) AS month, strftime(t, '%Y-%m-%dT%H:%M:%SZ') AS iso FROM (SELECT asset_id, to_timestamp(created_s) AT TIME ZONE 'UTC' AS t FROM assets)")
def sc_dates(c: Catalog) -> DataFrame:
    t = F.timestamp_seconds("created_s")
    return c.assets.select("asset_id", F.year(t).alias("year"), F.month(t).alias("month"), F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("iso"))


@query("SELECT asset_id, round(1 - exp(-width / 300.0), 6) AS sharp, round(greatest(0, 1 - noise * 20 / 12), 6) AS clean, round(greatest(0, 1 - least(1, abs(height / 10.0 - 118) / 118) - 2 * noise / 10), 6) AS exposure FROM assets")
def sc_quality_scores(c: Catalog) -> DataFrame:
    return c.assets.select("asset_id", F.round(media.sharpness_score(F.col("width")), 6).alias("sharp"), F.round(media.noise_score(F.col("noise") * 20), 6).alias("clean"), F.round(media.exposure_score(F.col("height") / 10, F.col("noise") / 10), 6).alias("exposure"))


@query("SELECT s, CAST(floor(8 - 4 * s + 0.5) AS INT) AS near, CAST(floor(14 - 6 * s + 0.5) AS INT) AS loose, round(0.95 + 0.04 * s, 6) AS near_cosine, round(0.3 + 0.15 * s, 6) AS face FROM (SELECT CAST(r_regionkey AS DOUBLE) / 4 AS s FROM region)")
def sc_strictness(c: Catalog) -> DataFrame:
    rows = [(s, t["near"], t["loose"], round(t["near_cosine"], 6), round(media.face_threshold(0.3, 0.45, s), 6)) for s in (k / 4 for k in range(5)) if (t := media.thresholds(s))]
    return c.spark.createDataFrame(rows, "s double, near int, loose int, near_cosine double, face double")


_BITS = "list_reduce(list_prepend(CAST(0 AS HUGEINT), list_transform({flags}, lambda f: CASE WHEN f THEN CAST(1 AS HUGEINT) ELSE CAST(0 AS HUGEINT) END)), lambda a, b: a * 2 + b)"
_SIGNED = "SELECT asset_id, CAST(CASE WHEN h >= 9223372036854775808 THEN h - 18446744073709551616 ELSE h END AS BIGINT) AS {name} FROM (SELECT asset_id, " + _BITS + " AS h FROM prints)"
PHASH_SQL = _SIGNED.format(name="phash", flags="list_transform(coefficients, lambda x: CAST(x AS DOUBLE) > (CAST(list_sort(coefficients)[32] AS DOUBLE) + CAST(list_sort(coefficients)[33] AS DOUBLE)) / 2)")
DHASH_SQL = _SIGNED.format(name="dhash", flags="list_transform(range(1, 65), lambda k: coefficients[k] < coefficients[k % 64 + 1])")
query(PHASH_SQL, "sc_phash_bits")(lambda c: c.prints.select("asset_id", media.bits_above_median(F.col("coefficients")).alias("phash")))
query(DHASH_SQL, "sc_dhash_bits")(lambda c: c.prints.select("asset_id", media.bits_rising(F.col("coefficients")).alias("dhash")))


@query("SELECT asset_id, CAST(bit_count(xor(asset_id * 7919, asset_id * 104729)) AS INT) AS distance FROM assets")
def sc_hamming(c: Catalog) -> DataFrame:
    return c.assets.select("asset_id", media.hamming(F.col("asset_id") * 7919, F.col("asset_id") * 104729).alias("distance"))


@query("SELECT asset_id, round(list_sum(list_transform(range(1, 65), lambda k: CAST(coefficients[k] AS DOUBLE) * CAST(coefficients[65 - k] AS DOUBLE))), 6) AS cross_dot, round(sqrt(list_sum(list_transform(coefficients, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))), 6) AS norm FROM prints")
def sc_dot_norm(c: Catalog) -> DataFrame:
    v = F.col("coefficients")
    return c.prints.select("asset_id", F.round(media.dot(v, F.reverse(v)), 6).alias("cross_dot"), F.round(media.norm(v), 6).alias("norm"))


@query("SELECT asset_id, CAST(greatest(1, floor(width * (2048.0 / greatest(width, height)) + 0.5)) AS INT) AS w, CAST(greatest(1, floor(height * (2048.0 / greatest(width, height)) + 0.5)) AS INT) AS h, round(abs((0 * 0 - width * 0) + (width * height - width * 0) + (width * height - 0 * height) + (0 * 0 - 0 * height)) / 2.0, 3) AS area FROM assets")
def sc_geometry(c: Catalog) -> DataFrame:
    w, h = media.fit_size(F.col("width"), F.col("height"), 2048)
    zero = F.lit(0)
    corners = [(zero, zero), (F.col("width"), zero), (F.col("width"), F.col("height")), (zero, F.col("height"))]
    return c.assets.select("asset_id", w.alias("w"), h.alias("h"), F.round(media.quad_area(corners), 3).alias("area"))


query("SELECT asset_id, sha256(text) AS sha256 FROM texts", "sc_sha256")(lambda c: c.texts.select("asset_id", F.sha2("text", 256).alias("sha256")))


@query("SELECT event_id, CASE WHEN json_extract_string(j, '$.version') = '1' THEN json_extract_string(j, '$.nameContains') END AS needle, CAST(json_array_length(j, '$.people') AS INT) AS people FROM (SELECT event_id, '{\"version\":' || CAST(event_id % 2 AS VARCHAR) || ',\"nameContains\":\"' || event_type || '\",\"people\":[1,' || CAST(user_id AS VARCHAR) || ']}' AS j FROM events)")
def sc_json_rule(c: Catalog) -> DataFrame:
    j = F.format_string('{"version":%d,"nameContains":"%s","people":[1,%d]}', F.col("event_id") % 2, "event_type", "user_id")
    r = rules.decode_rule(j)
    return c.raw("events").select("event_id", F.when(r["version"] == 1, r["nameContains"]).alias("needle"), F.size(r["people"]).alias("people"))


@query(r"SELECT item_id, array_to_string(list_filter(regexp_split_to_array(text, '[\s\x22]+'), lambda t: t <> ''), '|') AS terms FROM benchmark")
def sc_tokens(c: Catalog) -> DataFrame:
    return c.raw("benchmark").select("item_id", F.array_join(text.query_terms(F.col("text")), "|").alias("terms"))


@query("SELECT asset_id, CASE WHEN s >= 3600 THEN CAST(s // 3600 AS VARCHAR) || ':' || lpad(CAST(s // 60 % 60 AS VARCHAR), 2, '0') ELSE CAST(s // 60 AS VARCHAR) END || ':' || lpad(CAST(s % 60 AS VARCHAR), 2, '0') AS duration FROM (SELECT asset_id, asset_id * 37 % 9000 AS s FROM assets)")
def sc_duration(c: Catalog) -> DataFrame:
    return c.assets.select("asset_id", text.duration_text(F.col("asset_id") * 37 % 9000).alias("duration"))


@query("SELECT person_id, concat_ws(' · ', name, CASE WHEN hidden THEN 'hidden' END, CASE WHEN library_id = 1 THEN 'photos only' END) AS summary FROM persons")
def sc_summary(c: Catalog) -> DataFrame:
    return c.persons.select("person_id", F.concat_ws(" · ", "name", F.when(F.col("hidden"), "hidden"), F.when(F.col("library_id") == 1, "photos only")).alias("summary"))


_TOP = "SELECT asset_id, label, rank FROM (SELECT asset_id, label, confidence, CAST(row_number() OVER (PARTITION BY asset_id ORDER BY confidence DESC, label) AS INT) AS rank FROM tags WHERE confidence >= 0.3) WHERE rank <= 10"


@query(_TOP)
def sc_top_labels(c: Catalog) -> DataFrame:
    from ..operators.store import top_labels

    return top_labels(c.tags).select("asset_id", "label", "rank")


def _rasters(c: Catalog) -> DataFrame:
    """Square rasters whose pixels are the characters of a whole text, from its start again where the square is larger; pixels stay a text on their way to Python."""
    side = F.ceil(F.sqrt(F.length("text"))).cast("int")
    px = F.substring(F.repeat("text", F.lit(4)), F.lit(1), side * side)
    return c.texts.filter("length(text) > 0").select("asset_id", side.alias("width"), side.alias("height"), px.alias("pixels"))


@query()
def sc_raster_phash(c: Catalog) -> DataFrame:
    from ..functions import raster

    return _rasters(c).select("asset_id", raster.phash_udf("width", "height", "pixels").alias("phash"), raster.dhash_udf("width", "height", "pixels").alias("dhash"))


@query()
def sc_raster_quality(c: Catalog) -> DataFrame:
    from ..functions import raster

    return _rasters(c).select("asset_id", raster.quality_udf("width", "height", "pixels").alias("q")).select("asset_id", "q.*")


# Classification, gates and policies

_SIG = """SELECT doc_id AS asset_id, CASE CAST(doc_id % 9 AS INT) WHEN 0 THEN 'Screenshot 1.png' WHEN 1 THEN 'IMG-20200101-WA0001.jpg' WHEN 2 THEN 'FB_IMG_1.jpg' WHEN 3 THEN 'a.png' ELSE 'b.jpg' END AS filename,
CASE WHEN doc_id % 4 = 0 THEN 'Apple' END AS make, CASE WHEN doc_id % 8 = 0 THEN 'iPhone 13' END AS model, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE doc_id % 4 = 0 END AS has_camera, CASE WHEN doc_id % 7 = 0 THEN NULL ELSE doc_id % 3 = 0 END AS has_exif,
CASE WHEN doc_id % 3 = 0 THEN 1080 ELSE 1600 END AS width, CASE WHEN doc_id % 2 = 0 THEN 1920 ELSE 900 END AS height, doc_id % 31 = 0 AS subtype_screenshot, CAST(doc_id % 10 AS DOUBLE) / 10 AS doc_confidence, CAST(doc_id % 6 AS DOUBLE) / 10 AS doc_area,
CAST(doc_id % 11 AS DOUBLE) / 12 AS doc_label, n_chars % 400 AS text_chars, CAST(doc_id % 5 AS DOUBLE) / 20 AS text_area, CASE WHEN doc_id % 6 = 0 THEN 'total tax paid' WHEN doc_id % 6 = 1 THEN 'invoice' ELSE '' END AS text, CAST(CASE WHEN doc_id % 17 = 0 THEN doc_id % 3 ELSE 0 END AS INT) AS barcodes FROM documents"""


def _signals(c: Catalog) -> DataFrame:
    c.raw("documents").createOrReplaceTempView("documents_signals")
    return c.spark.sql(_SIG.replace("FROM documents", "FROM documents_signals"))


@query(rf"""WITH s AS ({_SIG}), a AS (SELECT *, filename LIKE '%.png' AS png, filename LIKE '%.jpg' AS jpg, has_camera IS NOT DISTINCT FROM FALSE AS nocam, has_exif IS NOT DISTINCT FROM FALSE AS noexif, greatest(width, height) AS le, least(width, height) AS se FROM s),
b AS (SELECT *, CASE WHEN subtype_screenshot THEN 1.0 WHEN filename LIKE 'Screenshot%' THEN 0.95 WHEN nocam AND png AND (se, le) IN ((1080, 1920), (900, 1440)) THEN 0.75 END AS shot FROM a), d AS (SELECT *, coalesce(shot, 0) >= 0.9 AS iss FROM b),
e AS (SELECT *, CASE WHEN filename LIKE 'IMG-%' THEN 0.98 WHEN noexif AND jpg AND NOT iss AND le IN (1600, 1280, 2560, 4096, 1024) THEN 0.6 END AS wa FROM d),
f AS (SELECT *, CASE WHEN filename LIKE 'FB_IMG_%' THEN 0.9 WHEN nocam AND NOT iss AND wa IS NULL AND (width, height) IN ((1080, 1920), (1600, 900)) THEN CASE WHEN text_chars >= 20 THEN 0.75 ELSE 0.65 END END AS soc,
greatest(CASE WHEN doc_confidence >= 0.8 AND doc_area >= 0.2 AND text_chars >= 40 THEN 0.9 END, CASE WHEN NOT iss AND text_chars >= 250 AND text_area >= 0.08 THEN 0.75 END, CASE WHEN NOT iss AND doc_label >= 0.4 AND text_chars >= 20 THEN 0.7 END) AS doc FROM e),
g AS (SELECT *, CASE WHEN (doc IS NOT NULL OR text_chars >= 60) AND NOT iss AND text = 'total tax paid' THEN 0.9 END AS rec, CASE WHEN barcodes > 0 THEN 0.95 END AS qr, CASE WHEN make <> '' AND NOT iss AND coalesce(doc, 0) < 0.7 THEN 0.9 END AS cam FROM f)
SELECT asset_id, category, confidence FROM (SELECT asset_id, unnest(['screenshot', 'whatsapp', 'social', 'document', 'receipt', 'qr_code', 'camera']) AS category, unnest([shot, wa, soc, doc, rec, qr, cam]) AS confidence FROM g) WHERE confidence IS NOT NULL""")
def classify_rules(c: Catalog) -> DataFrame:
    found = rules.classify(_signals(c))
    return found.select("asset_id", F.explode("categories").alias("d")).select("asset_id", "d.category", F.round("d.confidence", 6).alias("confidence"))


@query(f"WITH s AS ({_SIG}) SELECT asset_id FROM s WHERE doc_confidence >= 0.5 OR doc_label >= 0.1 OR subtype_screenshot OR has_camera IS DISTINCT FROM TRUE")
def ocr_gate(c: Catalog) -> DataFrame:
    return _signals(c).filter(rules.needs_ocr()).select("asset_id")


_MEMBERS = "SELECT asset_id, category FROM overrides WHERE confidence >= 0.5 UNION SELECT asset_id, category FROM categories a WHERE confidence >= 0.5 AND NOT EXISTS (SELECT 1 FROM overrides o WHERE o.asset_id = a.asset_id AND o.category = a.category)"
query(_MEMBERS, "category_membership")(lambda c: library.category_members(c.categories, c.overrides))
query("SELECT asset_id, category, source, confidence FROM (SELECT * FROM categories UNION ALL SELECT * FROM overrides) WHERE asset_id IN (5, 10, 15, 20, 25) ORDER BY asset_id, source DESC", "category_details")(lambda c: c.categories.union(c.overrides).filter("asset_id in (5, 10, 15, 20, 25)").orderBy("asset_id", F.desc("source")))


@query("WITH n AS (SELECT asset_id, 'receipt' AS category, 'user' AS source, CASE WHEN asset_id % 28 = 0 THEN 1.0 ELSE 0.0 END AS confidence FROM removals) SELECT asset_id, category, source, confidence FROM overrides WHERE (asset_id, category) NOT IN (SELECT (asset_id, category) FROM n) UNION ALL SELECT * FROM n")
def user_override(c: Catalog) -> DataFrame:
    from ..operators.store import replace_rows

    new = c.removals.select("asset_id", F.lit("receipt").alias("category"), F.lit("user").alias("source"), F.when(F.col("asset_id") % 28 == 0, 1.0).otherwise(0.0).alias("confidence"))
    return replace_rows(c.overrides, new, ["asset_id", "category"])


_PROMPT = "SELECT item_id, CASE item_id % 5 WHEN 0 THEN 'a nude portrait' WHEN 1 THEN 'a kid in a park' WHEN 2 THEN 'naked teen' WHEN 3 THEN 'kidney bean' ELSE 'sky' END AS prompt, CAST(item_id % 7 AS DOUBLE) / 7 AS source_explicit, CAST(item_id % 4 AS DOUBLE) / 4 AS output_explicit, CAST(item_id % 9 AS DOUBLE) / 20 AS minor, item_id % 2 = 0 AS real_person, item_id % 3 = 0 AS adult FROM benchmark"


@query(rf"""WITH s AS ({_PROMPT}), t AS (SELECT *, regexp_matches(prompt, 'nude|naked') AS sexual, regexp_matches(prompt, '\b(kid|teen)\b') AS minor_term FROM s)
SELECT item_id, CASE WHEN (sexual OR source_explicit >= 0.5) AND (minor_term OR minor >= 0.2) THEN 'block_hard' WHEN sexual AND real_person AND source_explicit < 0.5 THEN 'block_hard' WHEN sexual AND NOT adult THEN 'block_soft' ELSE 'allow' END AS request,
CASE WHEN (output_explicit >= 0.5 OR source_explicit >= 0.5) AND minor >= 0.2 THEN 'block_hard' WHEN real_person AND output_explicit >= 0.5 AND output_explicit > source_explicit + 0.15 THEN 'block_hard' WHEN output_explicit >= 0.5 AND NOT adult THEN 'block_soft' WHEN output_explicit >= 0.5 THEN 'label' ELSE 'allow' END AS output,
CASE WHEN source_explicit >= 0.5 AND minor >= 0.2 THEN 'block_hard' WHEN source_explicit >= 0.5 AND NOT adult THEN 'block_soft' ELSE 'allow' END AS conventional FROM t""")
def edit_policy(c: Catalog) -> DataFrame:
    c.raw("benchmark").createOrReplaceTempView("benchmark_prompts")
    s = c.spark.sql(_PROMPT.replace("FROM benchmark", "FROM benchmark_prompts"))
    return s.select("item_id", rules.request_policy().alias("request"), rules.output_policy().alias("output"), rules.conventional_policy().alias("conventional"))


@query("SELECT person_id, CASE WHEN name IS NULL THEN 'not_registered' WHEN hidden AND library_id <> 1 THEN 'cloud_disabled' WHEN library_id = 3 THEN 'not_commercial' ELSE 'ok' END AS verdict FROM persons")
def model_gate(c: Catalog) -> DataFrame:
    gate = rules.model_gate(F.col("name").isNotNull(), F.col("hidden"), F.col("library_id") == 1, F.col("library_id") != 3)
    return c.persons.select("person_id", gate.alias("verdict"))


@query("SELECT asset_id, CAST(len(layers[1:cursor]) AS INT) AS active, list_contains(layers[1:cursor], 'generative') AS generative, CAST(cursor + 1 AS INT) AS after_push FROM (SELECT asset_id, ['adjust', CASE WHEN asset_id % 3 = 0 THEN 'generative' ELSE 'crop' END, 'adjust'] AS layers, asset_id % 4 AS cursor FROM assets)")
def edit_stack(c: Catalog) -> DataFrame:
    layers = F.array(F.lit("adjust"), F.when(F.col("asset_id") % 3 == 0, "generative").otherwise("crop"), F.lit("adjust"))
    cursor = (F.col("asset_id") % 4).cast("int")
    active = rules.active_layers(layers, cursor)
    return c.assets.select("asset_id", F.size(active).alias("active"), F.array_contains(active, "generative").alias("generative"), F.size(rules.push_layer(layers, cursor, F.lit("x"))).alias("after_push"))


@query()
def upscale(c: Catalog) -> DataFrame:
    """How much of each whole raster comes back when it is made smaller by 2 or 4 and enlarged again."""
    from ..functions import raster

    q = _rasters(c).select("asset_id", raster.upscale_udf(2, 4)("width", "height", "pixels").alias("q"))
    rows = [F.struct(F.lit(k).alias("factor"), F.col(f"q.psnr_{k}").alias("psnr"), F.col(f"q.sharpness_{k}").alias("sharpness")) for k in (2, 4)]
    return q.select("asset_id", F.inline(F.array(*rows)))


@query("SELECT vec_id + 5000 AS embedding_id, CAST(len(embedding) AS INT) AS n, TRUE AS same FROM embeddings")
def sc_sealed_vectors(c: Catalog) -> DataFrame:
    """Vectors sealed with a key and opened again."""
    v, key = F.transform("vector", lambda x: x.cast("double")), F.lit(b"a key of 16 byte")
    opened = media.unseal(media.seal(v, key), key)
    return c.vectors.select("embedding_id", F.size(opened).alias("n"), (opened == v).alias("same"))


@query("SELECT asset_id, '{\"cursor\":' || CAST(asset_id % 3 AS VARCHAR) || ',\"layers\":[\"adjust\",\"crop ' || CAST(asset_id AS VARCHAR) || '\"],\"version\":1}' AS stack, CAST(asset_id % 3 AS INT) AS cursor, 'crop ' || CAST(asset_id AS VARCHAR) AS top FROM assets")
def sc_stack_codec(c: Catalog) -> DataFrame:
    layers = F.array(F.lit("adjust"), F.concat(F.lit("crop "), F.col("asset_id").cast("string")))
    a = c.assets.select("asset_id", rules.encode_stack(layers, F.col("asset_id") % 3).alias("stack"))
    return a.select("asset_id", "stack", (d := rules.decode_stack(F.col("stack")))["cursor"].alias("cursor"), F.element_at(d["layers"], -1).alias("top"))


@query("SELECT person_id, '{\"version\":1,\"people\":[' || CAST(person_id AS VARCHAR) || '],\"nameContains\":\"' || coalesce(name, '') || '\",\"favoritesOnly\":' || CAST(hidden AS VARCHAR) || '}' AS rule, coalesce(name, '') AS needle FROM persons")
def sc_rule_codec(c: Catalog) -> DataFrame:
    rule = F.struct(F.lit(1).alias("version"), F.array("person_id").alias("people"), F.coalesce("name", F.lit("")).alias("nameContains"), F.col("hidden").alias("favoritesOnly"))
    p = c.persons.select("person_id", rules.encode_rule(rule).alias("rule"))
    return p.select("person_id", "rule", rules.decode_rule(F.col("rule"))["nameContains"].alias("needle"))


@query("SELECT asset_id, CASE WHEN asset_id % 6 <> 0 THEN created_s END AS seconds FROM assets")
def sc_exif_dates(c: Catalog) -> DataFrame:
    shown = F.when(F.col("asset_id") % 6 == 0, "0000:00:00 00:00:00").otherwise(F.date_format(F.timestamp_seconds("created_s"), "yyyy:MM:dd HH:mm:ss"))
    return c.assets.select("asset_id", text.exif_seconds(shown).alias("seconds"))


@query("SELECT face_id, round(1 - (CAST(face_id % 50 AS DOUBLE) / 100 + CAST(face_id % 30 AS DOUBLE) / 100), 6) AS top FROM faces")
def sc_flip_box(c: Catalog) -> DataFrame:
    return c.faces.select("face_id", F.round(media.flip_box((F.col("face_id") % 50).cast("double") / 100, (F.col("face_id") % 30).cast("double") / 100), 6).alias("top"))


@query("SELECT face_id, 0.0 AS a, round(-1.0 / (1 + face_id % 5), 6) AS b, round(-3.0 / (1 + face_id % 5), 6) AS tx, round(CAST(face_id % 7 AS DOUBLE) / (1 + face_id % 5), 6) AS ty FROM faces")
def sc_similarity_transform(c: Catalog) -> DataFrame:
    """Points that are the aligned face's turned by a right angle, enlarged and shifted."""
    k = (1 + F.col("face_id") % 5).cast("double")
    points = [(-k * y + (F.col("face_id") % 7).cast("double"), k * x + 3) for x, y in media.FACE_POINTS]
    t = c.faces.select("face_id", media.similarity_transform(points).alias("t"))
    return t.select("face_id", *[(F.round(F.col(f"t.{n}"), 6) + 0.0).alias(n) for n in ("a", "b", "tx", "ty")])
