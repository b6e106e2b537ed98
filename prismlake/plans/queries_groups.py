"""Queries for duplicate grouping and people clustering.

The tables' vectors are near random, so thresholds are lower here than the operators' defaults; otherwise results would be empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import media
from ..operators import duplicates, extensions, neighbours, people, store
from ..sources.catalog import Catalog
from .durable import durable
from .queries_scalar import DHASH_SQL, PHASH_SQL
from .registry import query
from .tiles import packed

LOOSE = duplicates.Thresholds(near=16, loose=19, dhash=40, near_cosine=0.2, burst_cosine=0.1, similar_cosine=0.25, similar_seconds=900)

# Duplicates

query("SELECT asset_id FROM assets WHERE asset_id NOT IN (SELECT asset_a FROM exclusions WHERE asset_b IS NULL)", "dup_exclude")(lambda c: c.assets.join(c.exclusions.filter("asset_b is null").select(F.col("asset_a").alias("asset_id")), "asset_id", "left_anti").select("asset_id"))
_EXACT = "SELECT min(asset_id) OVER w AS group_id, asset_id FROM assets WHERE file_hash IS NOT NULL WINDOW w AS (PARTITION BY file_hash, coalesce(file_size, -1)) QUALIFY count(*) OVER w > 1"
query(_EXACT, "dup_exact")(lambda c: duplicates.exact_groups(c.assets).select("group_id", "asset_id"))


def _prints(c: Catalog) -> DataFrame:
    v = F.col("coefficients")
    return c.prints.select("asset_id", media.bits_above_median(v).alias("phash"), media.bits_rising(v).alias("dhash"), v.alias("vector"))


def _hamming_rows(c: Catalog) -> DataFrame:
    """A row for each pair of assets with different hashes within the radius: hashes that several assets have come more than once."""
    p = durable(_prints(c).select("phash"))
    return duplicates.hash_pairs(p, 18).join(p.toDF("a"), "a").join(p.toDF("b"), "b").select("a", "b", "distance")


_P = f"p AS ({PHASH_SQL}), d AS ({DHASH_SQL})"
query(f"WITH p AS ({PHASH_SQL}) SELECT x.phash AS a, y.phash AS b, CAST(bit_count(xor(x.phash, y.phash)) AS INT) AS distance FROM p x JOIN p y ON x.phash < y.phash WHERE bit_count(xor(x.phash, y.phash)) <= 18", "join_hamming_range")(lambda c: _hamming_rows(c))
_PAIRS = f"""{_P}, f AS (SELECT p.asset_id, phash, dhash, coefficients AS v FROM p JOIN d USING (asset_id) JOIN prints USING (asset_id)),
pairs AS (SELECT x.asset_id AS a, y.asset_id AS b, CAST(bit_count(xor(x.phash, y.phash)) AS INT) AS distance FROM f x JOIN f y ON x.asset_id < y.asset_id WHERE bit_count(xor(x.phash, y.phash)) <= 19 AND ((bit_count(xor(x.phash, y.phash)) <= 16 AND bit_count(xor(x.dhash, y.dhash)) <= 40)
OR list_sum(list_transform(range(1, 65), lambda k: CAST(x.v[k] AS DOUBLE) * CAST(y.v[k] AS DOUBLE))) >= 0.2) AND NOT EXISTS (SELECT 1 FROM exclusions e WHERE e.asset_b IS NOT NULL AND ((e.asset_a = x.asset_id AND e.asset_b = y.asset_id) OR (e.asset_a = y.asset_id AND e.asset_b = x.asset_id))))"""


def _pairs(c: Catalog) -> DataFrame:
    return duplicates.near_pairs(_prints(c), c.exclusions.filter("asset_b is not null"), LOOSE)


def _near(c: Catalog) -> DataFrame:
    return duplicates.near_groups(_prints(c), c.exclusions.filter("asset_b is not null"), LOOSE)


query(f"WITH {_PAIRS} SELECT a, b, distance FROM pairs", "near_pairs")(_pairs)
_GROUPS = f"WITH RECURSIVE {_PAIRS}, e AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs), r AS (SELECT DISTINCT a, a AS c FROM e UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.a), g AS (SELECT a AS asset_id, min(c) AS group_id FROM r GROUP BY 1)"
query(_GROUPS + " SELECT g.group_id, g.asset_id, round(s.s, 6) AS similarity FROM g JOIN (SELECT group_id, avg(1 - distance / 64.0) AS s FROM pairs JOIN g ON g.asset_id = pairs.a GROUP BY 1) s USING (group_id)", "near_components")(lambda c: _near(c).withColumn("similarity", F.round("similarity", 6)))
query(_GROUPS + " SELECT group_id, round(avg(1 - distance / 64.0), 6) AS mean_score FROM pairs JOIN g ON g.asset_id = pairs.a GROUP BY 1", "agg_mean_pair_score")(lambda c: _near(c).groupBy("group_id").agg(F.round(F.max("similarity"), 6).alias("mean_score")))
_BURST = "SELECT min(asset_id) OVER w AS group_id, asset_id FROM assets WHERE burst_id IS NOT NULL WINDOW w AS (PARTITION BY library_id, burst_id) QUALIFY count(*) OVER w > 1"
query(_BURST, "burst_id")(lambda c: duplicates.burst_id_groups(c.assets).select("group_id", "asset_id"))


def _timed(c: Catalog) -> DataFrame:
    """Moments with the vector of the print their number falls on."""
    m = c.moments.select("asset_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), F.pmod("asset_id", F.lit(c.prints.count())).alias("v"))
    return m.join(c.prints.select(F.col("asset_id").alias("v"), F.col("coefficients").alias("vector")), "v").select("asset_id", (F.pmod("asset_id", F.lit(2))).alias("library_id"), (F.col("us") / 1e6).alias("at"), "vector")


def _blocks(c: Catalog) -> DataFrame:
    return c.exclusions.filter("asset_b is not null")


query(name="burst_window")(lambda c: duplicates.star_groups(_timed(c), _blocks(c), 300, LOOSE.burst_cosine))
query(name="similar_window")(lambda c: duplicates.star_groups(_timed(c), _blocks(c), LOOSE.similar_seconds, LOOSE.similar_cosine))
query(name="join_time_window")(lambda c: duplicates.star_groups(_timed(c), _blocks(c), 300, -1.0))


def _factors(c: Catalog) -> DataFrame:
    """Every asset's factors of the ranking."""
    edited = c.edits.select("asset_id").distinct().withColumn("edited", F.lit(True))
    placed = c.album_members.select("asset_id").distinct().withColumn("placed", F.lit(True))
    a = c.assets.join(c.looks, "asset_id").join(edited, "asset_id", "left").join(placed, "asset_id", "left")
    exposure = F.when(F.col("sharpness").isNotNull(), media.exposure_score(F.col("luma"), F.col("clipped")))
    return a.select("asset_id", media.quality_score(F.col("sharpness"), F.col("noise")).alias("technical"), "face_quality", "aesthetic", (F.col("width") * F.col("height") / 1e6).alias("resolution"), exposure.alias("exposure"), media.preference(F.col("favorite"), F.col("edited"), F.col("placed")).alias("preference"))


def _members(c: Catalog) -> DataFrame:
    """Exact groups with the factors of the ranking."""
    return duplicates.exact_groups(c.assets).select("group_id", "asset_id").join(_factors(c), "asset_id")


_WEIGHTS = [(f, w) for f, w, _ in duplicates.FACTORS]
_RANK = f"""g AS ({_EXACT}), m AS (SELECT g.group_id, a.asset_id, 0.75 * sharpness + 0.25 * noise AS technical, face_quality, aesthetic, width * height / 1e6 AS resolution, CASE WHEN sharpness IS NOT NULL THEN greatest(0, 1 - least(1, abs(luma - 118) / 118) - 2 * clipped) END AS exposure, CASE WHEN favorite THEN 0.7 ELSE 0.0 END + CASE WHEN a.asset_id IN (SELECT asset_id FROM edits) THEN 0.2 ELSE 0.0 END + CASE WHEN a.asset_id IN (SELECT asset_id FROM album_members) THEN 0.1 ELSE 0.0 END AS preference FROM g JOIN assets a USING (asset_id) JOIN looks USING (asset_id)),
n AS (SELECT group_id, asset_id, {', '.join(f"CASE WHEN min({f}) OVER w IS NULL THEN NULL WHEN max({f}) OVER w > min({f}) OVER w THEN coalesce(({f} - min({f}) OVER w) / (max({f}) OVER w - min({f}) OVER w), 0) ELSE 0 END AS {f}" for f, _ in _WEIGHTS)} FROM m WINDOW w AS (PARTITION BY group_id)),
s AS (SELECT *, ({' + '.join(f"{w} * coalesce({f}, 0)" for f, w in _WEIGHTS)}) / ({' + '.join(f"CASE WHEN {f} IS NULL THEN 0 ELSE {w} END" for f, w in _WEIGHTS)}) AS score FROM n),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY group_id ORDER BY round(score, 9) DESC, asset_id) AS INT) AS rank FROM s)"""
query(f"WITH {_RANK} SELECT group_id, asset_id, round(score, 6) AS score, rank FROM r", "rank_best_shot")(lambda c: duplicates.rank_best(_members(c)).select("group_id", "asset_id", F.round("score", 6).alias("score"), "rank"))
_EXPLAIN = f"""WITH {_RANK}, x AS (SELECT group_id, asset_id, rank, unnest({[k for k, _ in enumerate(duplicates.FACTORS)]}) AS k, unnest({[w for _, w in _WEIGHTS]}) AS wt, unnest([{', '.join("'" + p + "'" for _, _, p in duplicates.FACTORS)}]) AS phrase, unnest([{', '.join(f for f, _ in _WEIGHTS)}]) AS v FROM r),
l AS (SELECT group_id, k, phrase, wt * max(v) FILTER (rank = 1) AS lead FROM x GROUP BY group_id, k, phrase, wt HAVING max(v) FILTER (rank = 1) > coalesce(max(coalesce(v, 0)) FILTER (rank > 1), 0) + 0.1),
t AS (SELECT group_id, list(phrase ORDER BY lead DESC, k)[1:3] AS top FROM l GROUP BY 1)
SELECT r.group_id, r.asset_id AS recommended, CASE WHEN top IS NULL THEN 'Recommended as the best overall balance; differences are small.' WHEN len(top) = 1 THEN 'Recommended because it has ' || top[1] || '.' ELSE 'Recommended because it has ' || array_to_string(top[1:len(top) - 1], ', ') || ', and ' || top[len(top)] || '.' END AS explanation FROM r LEFT JOIN t USING (group_id) WHERE rank = 1"""
query(_EXPLAIN, "rank_explain")(lambda c: duplicates.explain_best(duplicates.rank_best(_members(c))))
query(_EXPLAIN, "dup_rank")(lambda c: duplicates.explain_best(duplicates.rank_best(_members(c))))


def _features(c: Catalog) -> DataFrame:
    return store.live(c.assets).filter("media_type = 'image'").select("asset_id", "library_id", "file_hash", "file_size", F.col("created_s").cast("double").alias("at"), "burst_id").join(_prints(c), "asset_id", "left")


def _all_groups(c: Catalog) -> DataFrame:
    return duplicates.duplicate_groups(_features(c), c.exclusions, LOOSE)


@query()
def duplicates_all(c: Catalog) -> DataFrame:
    return _all_groups(c)


@query(name="duplicates")
def flagship(c: Catalog) -> DataFrame:
    """Every group of every tier with its ranking and explanation, in the order the tiers are shown."""
    g = _all_groups(c)
    ranked = duplicates.rank_best(g.join(_factors(c), "asset_id"))
    told = duplicates.explain_best(ranked)
    return ranked.select("tier", "group_id", "asset_id", F.round("score", 6).alias("score"), "rank").join(told.select("group_id", "explanation"), "group_id")


@query(name="dup_wiring")
def dup_wiring(c: Catalog) -> DataFrame:
    """As an application runs it: images with a hash, thresholds from a strictness, no size."""
    t = media.thresholds(0.5)
    th = duplicates.Thresholds(near=t["near"], loose=t["loose"], near_cosine=t["near_cosine"], burst_cosine=t["burst_cosine"], similar_cosine=t["similar_cosine"])
    return duplicates.duplicate_groups(_features(c).filter("phash is not null").withColumn("file_size", F.lit(None).cast("bigint")), c.exclusions, th)


query(f"WITH g AS ({_EXACT}) SELECT a.asset_id AS asset_a, b.asset_id AS asset_b FROM g a JOIN g b ON a.group_id = b.group_id AND a.asset_id < b.asset_id", "dup_feedback")(lambda c: duplicates.not_similar_pairs(duplicates.exact_groups(c.assets)))


def _typed(c: Catalog) -> DataFrame:
    e = duplicates.exact_groups(c.assets).withColumn("tier", F.lit("exact"))
    return e.union(duplicates.burst_id_groups(c.assets).withColumn("tier", F.lit("burst")))


_TYPED = f"SELECT 'exact' AS tier, group_id, asset_id FROM ({_EXACT}) UNION ALL SELECT 'burst', group_id, asset_id FROM ({_BURST})"
query(f"SELECT tier, count(DISTINCT group_id) AS n FROM ({_TYPED}) GROUP BY 1", "agg_group_counts")(lambda c: _typed(c).groupBy("tier").agg(F.countDistinct("group_id").alias("n")))
query(f"SELECT tier, group_id, count(*) AS n FROM ({_TYPED}) GROUP BY 1, 2 ORDER BY tier = 'burst', n DESC, group_id", "sort_groups")(lambda c: _typed(c).groupBy("tier", "group_id").agg(F.count(F.lit(1)).alias("n")).orderBy(F.when(F.col("tier") == "exact", 0).when(F.col("tier") == "near", 1).when(F.col("tier") == "burst", 2).otherwise(3), F.desc("n"), "group_id"))

# People

_FACES = "SELECT face_id, asset_id, coalesce(quality, 0.5) AS quality, coalesce(pixel_size, 100) AS pixel_size, yaw, embedding FROM faces JOIN embeddings ON vec_id = face_id WHERE NOT ignored"


def _faces(c: Catalog) -> DataFrame:
    v = c.raw("embeddings").select(F.col("vec_id").alias("face_id"), F.col("embedding").alias("vector"))
    return c.faces.filter("not ignored").select("face_id", "asset_id", F.coalesce("quality", F.lit(0.5)).alias("quality"), F.coalesce("pixel_size", F.lit(100.0)).alias("pixel_size"), "yaw").join(v, "face_id")


def _usable(c: Catalog) -> DataFrame:
    return _faces(c).filter("quality >= 0.15")


_DOT = "list_sum(list_transform(range(1, 65), lambda k: CAST(x.embedding[k] AS DOUBLE) * CAST(y.embedding[k] AS DOUBLE)))"
_KNN = f"f AS ({_FACES}), u AS (SELECT * FROM f WHERE quality >= 0.15), k AS (SELECT face_id, neighbor, similarity, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY face_id ORDER BY similarity DESC, neighbor) AS rank FROM (SELECT x.face_id, y.face_id AS neighbor, {_DOT} AS similarity FROM u x JOIN u y ON x.face_id <> y.face_id) WHERE similarity >= 0.2) WHERE rank <= 10)"


def _knn(c: Catalog) -> DataFrame:
    return neighbours.nearest(_usable(c).select("face_id", "vector"), 10)


_KNN_ALL = f"WITH {_KNN} SELECT face_id, neighbor, round(similarity, 6) AS similarity, rank FROM k"
for _name in ("join_knn", "topk_neighbors"):
    query(_KNN_ALL, _name)(lambda c: _knn(c).withColumn("similarity", F.round("similarity", 6)))


@query(_KNN_ALL)
def knn_incremental(c: Catalog) -> DataFrame:
    """Lists of all but every seventh face, plus faces that go away again; then the seventh added and those removed."""
    f = _usable(c).select("face_id", "vector")
    strange = f.filter("face_id % 50 = 1").select((F.col("face_id") + 100000).alias("face_id"), "vector")
    old = neighbours.nearest(f.filter("face_id % 7 <> 0").union(strange), 10)
    return neighbours.nearest_added(old, f, f.filter("face_id % 7 = 0").select("face_id"), strange.select("face_id"), 10).withColumn("similarity", F.round("similarity", 6))


query(f"WITH f AS ({_FACES}) SELECT face_id, CASE WHEN quality < 0.15 THEN 'low_quality' ELSE 'usable' END AS state FROM f", "face_quality_split")(lambda c: _faces(c).select("face_id", F.when(F.col("quality") < 0.15, "low_quality").otherwise("usable").alias("state")))
_ROOTS = f"""f AS ({_FACES}), u AS (SELECT * FROM f WHERE quality >= 0.15), sure AS (SELECT m.face_id, person_id FROM membership m JOIN u USING (face_id) WHERE confirmed),
e0 AS (SELECT face_a AS a, face_b AS b FROM constraints WHERE kind = 'must_link' AND face_a IN (SELECT face_id FROM u) AND face_b IN (SELECT face_id FROM u) UNION ALL SELECT x.face_id, y.face_id FROM sure x JOIN sure y ON x.person_id = y.person_id AND x.face_id < y.face_id),
e AS (SELECT a, b FROM e0 UNION ALL SELECT b, a FROM e0), w AS (SELECT face_id AS a, face_id AS c FROM u UNION SELECT e.b, w.c FROM w JOIN e ON e.a = w.a), roots AS (SELECT a AS face_id, min(c) AS root FROM w GROUP BY 1)"""


def _roots(c: Catalog) -> DataFrame:
    return people.must_link_roots(_usable(c), c.constraints, c.membership)


query(f"WITH RECURSIVE {_ROOTS} SELECT face_id, root FROM roots", "must_link_nodes")(_roots)
_CANNOT = """no AS (SELECT x.root AS x, y.root AS y FROM constraints c JOIN roots x ON x.face_id = face_a JOIN roots y ON y.face_id = face_b WHERE kind = 'cannot_link' UNION ALL SELECT p.r, q.r FROM (SELECT person_id, min(root) AS r FROM sure JOIN roots USING (face_id) GROUP BY 1) p JOIN (SELECT person_id, min(root) AS r FROM sure JOIN roots USING (face_id) GROUP BY 1) q ON p.person_id < q.person_id),
cannot AS (SELECT DISTINCT least(x, y) AS a, greatest(x, y) AS b FROM no WHERE x <> y)"""


def _cannot(c: Catalog) -> DataFrame:
    return people.cannot_link_roots(_roots(c), c.constraints, c.membership)


query(f"WITH RECURSIVE {_ROOTS}, {_CANNOT} SELECT a, b FROM cannot", "cannot_link_nodes")(_cannot)
_T = "0.1 + 0.10 * (1 - least(x.quality, y.quality)) + CASE WHEN least(x.pixel_size, y.pixel_size) < 64 THEN 0.05 ELSE 0 END + CASE WHEN (abs(x.yaw) > 0.6) <> (abs(y.yaw) > 0.6) THEN 0.04 ELSE 0 END"


@query(f"WITH f AS ({_FACES}) SELECT x.face_id AS a, y.face_id AS b, round({_T}, 6) AS threshold FROM f x JOIN f y ON y.face_id = x.face_id + 7")
def adaptive_threshold(c: Catalog) -> DataFrame:
    f = _faces(c).drop("vector")
    x, y = f.select([F.col(k).alias(f"x_{k}") for k in f.columns]), f.select([F.col(k).alias(f"y_{k}") for k in f.columns])
    t = media.adaptive_threshold(0.1, *[F.col(f"{s}_{k}") for k in ("quality", "pixel_size", "yaw") for s in "xy"])
    return x.join(y, F.col("y_face_id") == F.col("x_face_id") + 7).select(F.col("x_face_id").alias("a"), F.col("y_face_id").alias("b"), F.round(t, 6).alias("threshold"))


def _edges(c: Catalog) -> DataFrame:
    roots = _roots(c)
    return people.graph_edges(_knn(c), _usable(c), roots, people.cannot_link_told(roots, c.constraints), people.root_persons(roots, c.membership), 0.1)


_KNN_ONLY = _KNN.split("u AS (SELECT * FROM f WHERE quality >= 0.15), ")[1]
query(f"WITH RECURSIVE {_ROOTS}, {_CANNOT}, {_KNN_ONLY} SELECT least(ra.root, rb.root) AS a, greatest(ra.root, rb.root) AS b, round(sum(similarity), 5) AS weight FROM k JOIN u x ON x.face_id = k.face_id JOIN u y ON y.face_id = k.neighbor JOIN roots ra ON ra.face_id = k.face_id JOIN roots rb ON rb.face_id = k.neighbor WHERE ra.root <> rb.root AND similarity >= {_T} AND NOT EXISTS (SELECT 1 FROM cannot n WHERE n.a = least(ra.root, rb.root) AND n.b = greatest(ra.root, rb.root)) GROUP BY 1, 2", "knn_edges")(lambda c: _edges(c).withColumn("weight", F.round("weight", 5)))


def _labels(c: Catalog) -> DataFrame:
    roots = _roots(c)
    return people.whispers(_edges(c), people.cannot_link_told(roots, c.constraints), people.root_persons(roots, c.membership))


query(name="chinese_whispers")(_labels)


def _clusters(c: Catalog, by_person: bool = False) -> DataFrame:
    if by_person:  # clusters known beforehand, for the steps that SQL can follow
        return _faces(c).select("face_id", "asset_id").join(c.membership, "face_id").select(F.col("person_id").alias("cluster"), "face_id", F.col("person_id"))
    return people.build_clusters(_usable(c), _roots(c), _labels(c), c.membership, 2)


_BUILD = "n AS (SELECT label, count(*) AS n, count(DISTINCT p) AS np, max(p) AS one FROM l GROUP BY 1)"


@query(f"WITH l AS (SELECT f.face_id, f.asset_id AS label, m.person_id AS p FROM faces f LEFT JOIN membership m ON m.face_id = f.face_id AND m.confirmed WHERE NOT f.ignored), {_BUILD} SELECT l.label AS cluster, l.face_id, CASE WHEN n.np = 1 THEN n.one END AS person_id FROM l JOIN n USING (label) WHERE n.n >= 3 OR n.np > 0")
def cluster_build(c: Catalog) -> DataFrame:
    f = _faces(c)
    return people.build_clusters(f, f.select("face_id", F.col("face_id").alias("root")), f.select(F.col("face_id").alias("root"), F.col("asset_id").alias("label")), c.membership, 3)


query(name="cluster_verify")(lambda c: people.verify_clusters(_clusters(c), _usable(c), c.constraints, c.membership, 0.1))
query(name="cluster_ambiguity")(lambda c: people.ambiguous(_clusters(c, True), _faces(c), _knn(c), c.constraints, c.membership))


@query()
def face_clustering(c: Catalog) -> DataFrame:
    """From neighbours to clusters and the review queue: a row for each face, with a cluster and its confidence or a reason."""
    clusters, review = people.cluster_faces(_faces(c), _knn(c), c.constraints, c.membership, base=0.1, min_size=2)
    kept = clusters.select("face_id", "cluster", "person_id", F.round("mean_similarity", 6).alias("similarity"), F.col("confidence").alias("state"))
    return kept.union(review.select("face_id", "cluster", F.lit(None).cast("long"), F.round("similarity", 6), "reason"))


_STATS = f"f AS ({_FACES}), m AS (SELECT person_id, f.* FROM f JOIN membership USING (face_id)), s AS (SELECT person_id, d, sum(quality * CAST(embedding[d] AS DOUBLE)) AS x FROM m, (SELECT unnest(range(1, 65)) AS d) GROUP BY 1, 2), c AS (SELECT person_id, list(x ORDER BY d) AS c, sqrt(sum(x * x)) AS n FROM s GROUP BY 1), t AS (SELECT person_id, list_sum(list_transform(range(1, 65), lambda k: CAST(embedding[k] AS DOUBLE) * c[k] / n)) AS s FROM m JOIN c USING (person_id)), g AS (SELECT person_id AS cluster, count(*) AS n, avg(s) AS mean, stddev_pop(s) AS sd FROM t GROUP BY 1)"
query(f"WITH {_STATS} SELECT cluster, n, round(mean, 6) AS mean_similarity, round(sd, 6) AS deviation FROM g", "agg_cluster_stats")(lambda c: people.cluster_stats(_clusters(c, True), _faces(c)).select("cluster", "n", F.round("mean_similarity", 6).alias("mean_similarity"), F.round("deviation", 6).alias("deviation")))
query(f"WITH {_STATS} SELECT cluster, CASE WHEN cluster % 4 = 0 THEN 'confirmed' WHEN mean >= 0.70 AND n >= 5 THEN 'likely' WHEN mean >= 0.55 THEN 'needs_review' ELSE 'low_confidence' END AS label FROM g", "confidence_label")(lambda c: people.cluster_stats(_clusters(c, True), _faces(c)).select("cluster", people.confidence_label(F.col("cluster") % 4 == 0, F.col("mean_similarity"), F.col("n")).alias("label")))


def _label_pairs(c: Catalog) -> DataFrame:
    return people.pair_scores(c.raw("embeddings").select(F.col("vec_id").alias("face_id"), "label", F.col("embedding").alias("vector")))


_LP = f"lp AS (SELECT round({_DOT}, 6) AS similarity, x.label = y.label AS same FROM embeddings x JOIN embeddings y ON x.vec_id < y.vec_id)"
query(f"WITH {_LP}, h AS (SELECT least(greatest(CAST(floor(round(similarity * 100, 6)) AS INT), -21), 99) AS h, count(*) FILTER (same) AS s, count(*) FILTER (NOT same) AS d FROM lp GROUP BY 1), t AS (SELECT k, CAST(sum(CASE WHEN h >= k THEN s ELSE 0 END) AS BIGINT) AS tp, CAST(sum(CASE WHEN h >= k THEN d ELSE 0 END) AS BIGINT) AS fp, CAST(sum(CASE WHEN h < k THEN s ELSE 0 END) AS BIGINT) AS fn, CAST(sum(CASE WHEN h < k THEN d ELSE 0 END) AS BIGINT) AS tn FROM h, (SELECT unnest(range(-20, 100)) AS k) GROUP BY 1) SELECT k / 100 AS threshold, tp, fp, fn, tn, round((tp / (tp + fn) + tn / (tn + fp)) / 2, 6) AS balanced FROM t", "agg_calibration")(lambda c: people.calibration(_label_pairs(c)))


@query(f"WITH {_LP}, o AS (SELECT same, similarity, row_number() OVER (PARTITION BY same ORDER BY similarity) - 1 AS i, count(*) OVER (PARTITION BY same) AS n FROM lp) SELECT same, p, similarity FROM o, (SELECT unnest([5, 50, 99]) AS p) WHERE i = CAST(floor((n - 1) * p / 100) AS BIGINT)")
def percentile_rank_sweep(c: Catalog) -> DataFrame:
    """Percentiles as elements of the sorted scores, at index floor((n - 1) p); counts of equal scores come first."""
    from pyspark.sql import Window

    n = _label_pairs(c)
    w = Window.partitionBy("same").orderBy("similarity")
    cum = n.withColumn("upto", F.sum("k").over(w)).withColumn("n", F.sum("k").over(Window.partitionBy("same")))
    at = F.explode(F.transform(F.array(*map(F.lit, (5, 50, 99))), lambda p: F.struct(p.alias("p"), F.floor((F.col("n") - 1) * p / 100).alias("i"))))
    return cum.select("same", "similarity", "upto", "k", at.alias("q")).filter("q.i < upto and q.i >= upto - k").select("same", F.col("q.p").alias("p"), "similarity")


# Edits of people


@query("SELECT p.person_id, p.name, c.cluster FROM persons p FULL JOIN (SELECT DISTINCT person_id AS cluster FROM membership WHERE person_id % 2 = 0) c ON c.cluster = p.person_id")
def people_assembly(c: Catalog) -> DataFrame:
    have = c.membership.filter("person_id % 2 = 0").select(F.col("person_id").alias("cluster")).distinct()
    return c.persons.join(have, F.col("person_id") == F.col("cluster"), "full_outer").select("person_id", "name", "cluster")


_CONFIRM = "WITH n AS (SELECT face_id FROM faces WHERE asset_id = 42), m AS (SELECT face_id, person_id FROM membership WHERE face_id NOT IN (SELECT face_id FROM n) UNION ALL SELECT face_id, 3 FROM n)"
query(_CONFIRM + ", a AS (SELECT min(face_id) AS a FROM m WHERE person_id = 3), l AS (SELECT least(face_id, a) AS face_a, greatest(face_id, a) AS face_b FROM n, a WHERE face_id <> a) SELECT face_a, face_b, kind FROM constraints WHERE (face_a, face_b) NOT IN (SELECT (face_a, face_b) FROM l) UNION ALL SELECT face_a, face_b, 'must_link' FROM l UNION ALL SELECT face_id, person_id, 'member' FROM m", "confirm_faces")(lambda c: _both(*people.confirm(c.membership, c.constraints, 3, c.faces.filter("asset_id = 42").select("face_id"))))


def _both(members: DataFrame, constraints: DataFrame) -> DataFrame:
    return constraints.select("face_a", "face_b", "kind").union(members.select("face_id", "person_id", F.lit("member")))


query("WITH m AS (SELECT face_id, CASE WHEN person_id = 4 THEN 3 ELSE person_id END AS person_id FROM membership) SELECT face_a, face_b, kind FROM constraints WHERE NOT (kind = 'cannot_link' AND face_a IN (SELECT face_id FROM m WHERE person_id = 3) AND face_b IN (SELECT face_id FROM m WHERE person_id = 3)) UNION ALL SELECT face_id, person_id, 'member' FROM m", "merge_persons")(lambda c: _both(*people.merge_persons(c.membership, c.constraints, 4, 3)))
query("WITH o AS (SELECT least(face_id, 28) AS a, greatest(face_id, 28) AS b FROM membership WHERE person_id = 3 AND face_id <> 28) SELECT face_a, face_b, kind FROM constraints WHERE (face_a, face_b) NOT IN (SELECT (a, b) FROM o) UNION ALL SELECT a, b, 'cannot_link' FROM o UNION ALL SELECT face_id, person_id, 'member' FROM membership WHERE NOT (face_id = 28 AND person_id = 3)", "reject_face")(lambda c: _both(*people.reject(c.membership, c.constraints, 28, 3)))
query("SELECT face_id, person_id FROM membership WHERE person_id <> 6", "delete_person")(lambda c: c.membership.filter("person_id <> 6").select("face_id", "person_id"))
query("SELECT face_id, ignored OR asset_id = 42 AS ignored FROM faces", "ignore_face")(lambda c: c.faces.select("face_id", (F.col("ignored") | (F.col("asset_id") == 42)).alias("ignored")))
query("SELECT person_id, CASE WHEN person_id = 5 THEN 'New name' ELSE name END AS name FROM persons", "rename")(lambda c: c.persons.select("person_id", F.when(F.col("person_id") == 5, "New name").otherwise(F.col("name")).alias("name")))
query("SELECT person_id, hidden OR person_id = 5 AS hidden FROM persons", "hide")(lambda c: c.persons.select("person_id", (F.col("hidden") | (F.col("person_id") == 5)).alias("hidden")))
_SUGGEST = f"""WITH f AS ({_FACES}), mine AS (SELECT face_id FROM membership WHERE person_id = 3), a AS (SELECT d, avg(CAST(embedding[d] AS DOUBLE)) AS x FROM f, (SELECT unnest(range(1, 65)) AS d) WHERE face_id IN (SELECT face_id FROM mine) GROUP BY 1), c AS (SELECT list(x ORDER BY d) AS c, sqrt(sum(x * x)) AS n FROM a),
gone AS (SELECT face_id FROM mine UNION SELECT face_id FROM membership WHERE person_id <> 3 AND person_id IN (SELECT person_id FROM persons WHERE name IS NOT NULL) UNION SELECT face_b FROM constraints WHERE kind = 'cannot_link' AND face_a IN (SELECT face_id FROM mine) UNION SELECT face_a FROM constraints WHERE kind = 'cannot_link' AND face_b IN (SELECT face_id FROM mine))
SELECT face_id, round(s, 6) AS similarity FROM (SELECT face_id, list_sum(list_transform(range(1, 65), lambda k: CAST(embedding[k] AS DOUBLE) * c[k] / n)) AS s FROM f, c WHERE face_id NOT IN (SELECT face_id FROM gone)) WHERE s >= 0.05 ORDER BY s DESC, face_id LIMIT 60"""
for _name in ("topk_suggestions", "suggestions"):
    query(_SUGGEST, _name)(lambda c: people.suggestions(_faces(c), c.membership, c.persons, c.constraints, 3, 0.1).withColumn("similarity", F.round("similarity", 6)))


# Extension points for SQL users

_RADIUS_SQL = f"""
    WITH p AS (SELECT DISTINCT phash FROM ({PHASH_SQL}))
    SELECT x.phash AS a, y.phash AS b, CAST(bit_count(xor(x.phash, y.phash)) AS INT) AS distance
    FROM p x JOIN p y ON x.phash < y.phash WHERE bit_count(xor(x.phash, y.phash)) <= 14"""


@query(_RADIUS_SQL)
def sql_radius(c: Catalog) -> DataFrame:
    """Different hashes within 14 bits of each other, found in SQL by the table functions: by probes, or block by block where these would let too many candidates through."""
    hashes = durable(_prints(c).select(F.col("phash").alias("h")).distinct())
    share, parts = duplicates.best_parts(hashes, 14)
    extensions.register(c.spark, {14: parts})
    if hashes.count() > duplicates.NESTED_LOOP_ROWS and share > duplicates.WIDE:
        return c.spark.sql(
            """
            SELECT p.* FROM
                (SELECT /*+ SHUFFLE_REPLICATE_NL(y) */ x.data AS x, y.data AS y, x.block = y.block AS same FROM {blocks} x JOIN {blocks} y ON x.block <= y.block),
                LATERAL hash_block_pairs(x, y, same, 14) p""",
            blocks=packed(hashes.withColumnRenamed("h", "a"), "a", duplicates.HASH_BLOCK),
        )
    return c.spark.sql(
        """
        SELECT DISTINCT x.h AS a, y.h AS b, bit_count(x.h ^ y.h) AS distance FROM
            (SELECT h, p.* FROM {hashes}, LATERAL hash_probes(h, 14, TRUE) p) x JOIN
            (SELECT h, p.* FROM {hashes}, LATERAL hash_probes(h, 14, FALSE) p) y USING (part, value)
        WHERE x.h < y.h AND bit_count(x.h ^ y.h) <= 14""",
        hashes=hashes,
    )


_CENTROIDS_SQL = """
    WITH t AS (SELECT person_id, CASE WHEN confirmed THEN 3 ELSE 1 END AS w, vector, unnest(range(1, len(vector) + 1)) AS position
        FROM membership JOIN faces USING (face_id) JOIN vectors USING (embedding_id))
    SELECT person_id, CAST(position AS INT) AS position, round(sum(w * floor(256 * CAST(vector[position] AS DOUBLE))) / sum(w), 6) AS value FROM t GROUP BY 1, 2"""


@query(_CENTROIDS_SQL)
def weighted_centroids(c: Catalog) -> DataFrame:
    """The mean vector of each person's faces, confirmed ones counting three times; components in 256ths, so sums are exact in any order."""
    v = c.membership.join(c.faces.select("face_id", "embedding_id"), "face_id").join(c.vectors, "embedding_id")
    v = v.withColumn("vector", F.transform("vector", lambda x: F.floor(x.cast("double") * 256).cast("double"))).withColumn("w", F.when(F.col("confirmed"), 3).otherwise(1))
    m = extensions.centroids(v, "person_id", "vector", "w", "face_id")
    return m.select("person_id", F.posexplode("centroid").alias("position", "value")).select("person_id", (F.col("position") + 1).alias("position"), F.round("value", 6).alias("value"))
