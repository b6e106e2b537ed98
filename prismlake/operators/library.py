"""Reads over the catalog: filters, joins, aggregates, rankings, pages, search and trees."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import fold_text
from ..plans.durable import durable
from .store import FACES, HASHES, live

SCREENSHOT, LIVE_PHOTO = 4, 8


def newest_first(df: DataFrame) -> DataFrame:
    return df.orderBy(F.col("created_s").desc_nulls_last(), "asset_id")


def pending(assets: DataFrame, bit: int, library_id: int | None, include_cloud: bool, limit: int) -> DataFrame:
    """Live images that lack a stage, newest first: the work list of a resumable pipeline."""
    df = live(assets, library_id).filter((F.col("media_type") == "image") & (F.col("stage").bitwiseAND(F.lit(bit)) == 0))
    if not include_cloud:
        df = df.filter((F.col("availability") != "cloud_only") | F.col("file_path").isNotNull())
    return newest_first(df).limit(limit)


def has_subtype(mask: int) -> Column:
    return F.col("subtype").bitwiseAND(F.lit(mask)) != 0


def grid_predicates() -> dict[str, Column]:
    """The grid's named filters, without the media rule and those by id set."""
    image, video = F.col("media_type") == "image", F.col("media_type") == "video"
    return {
        "all": image, "videos": video, "favorites": image & F.col("favorite"),
        "on_this_mac": image & ~F.col("availability").isin("cloud_only", "shared"), "screenshots": image & has_subtype(SCREENSHOT),
        "blurry": image & (F.coalesce("sharpness", F.lit(1.0)) < 0.25) & ~has_subtype(SCREENSHOT),
        "cloud_only": image & (F.col("availability") == "cloud_only"), "shared": image & (F.col("availability") == "shared"), "hidden": image & F.col("hidden"),
    }


def review(assets: DataFrame, level: float = 0.6) -> DataFrame:
    """Live assets to review: the override, else the score at the level or above; no score is not included."""
    return live(assets).filter(F.coalesce("sensitive_override", F.col("sensitive_score") >= level, F.lit(False)))


def sort_keys(kind: str, name: Column | None = None) -> list[Column]:
    return {
        "newest": [F.col("created_s").desc_nulls_last()], "oldest": [F.col("created_s").asc_nulls_first()], "name": [name],
        "sharpest": [F.coalesce("sharpness", F.lit(0.0)).desc()], "largest": [(F.col("width") * F.col("height")).desc()],
    }[kind] + [F.col("asset_id")]


def page(df: DataFrame, order: list[Column], offset: int, limit: int = 100) -> DataFrame:
    """One page in order; offset at least 0, limit 1..1000."""
    return df.orderBy(*order).offset(max(offset, 0)).limit(min(max(limit, 1), 1000))


def live_images(assets: DataFrame) -> DataFrame:
    return live(assets).filter("media_type = 'image'")


def stored_faces(faces: DataFrame, assets: DataFrame, index: DataFrame, vectors: DataFrame) -> DataFrame:
    """Faces with a vector on live assets; missing quality is 0.5, missing size 100."""
    return faces.filter("not ignored").join(live(assets).select("asset_id"), "asset_id").join(index.select("embedding_id", "model"), "embedding_id").join(vectors, "embedding_id").select("face_id", "asset_id", "model", F.coalesce("quality", F.lit(0.5)).alias("quality"), F.coalesce("pixel_size", F.lit(100.0)).alias("pixel_size"), "yaw", "vector")


def category_members(auto: DataFrame, overrides: DataFrame) -> DataFrame:
    """(asset_id, category) where a user's word, at 0.5 or more, beats the automatic one."""
    said = overrides.select("asset_id", "category", "confidence")
    kept = auto.select("asset_id", "category", "confidence").join(said.select("asset_id", "category"), ["asset_id", "category"], "left_anti")
    return said.union(kept).filter("confidence >= 0.5").select("asset_id", "category").distinct()


def library_stats(assets: DataFrame, faces: DataFrame, persons: DataFrame) -> DataFrame:
    """One row of counts in one pass over each table."""
    n = lambda c: F.count_if(c)
    a = live(assets).agg(
        n(F.col("media_type") == "image").alias("photos"), n(F.col("media_type") == "video").alias("videos"), n(has_subtype(SCREENSHOT)).alias("screenshots"),
        n(has_subtype(LIVE_PHOTO)).alias("live_photos"), n(F.col("favorite")).alias("favorites"), n(F.col("stage").bitwiseAND(F.lit(HASHES)) != 0).alias("hashed"),
        n(F.col("stage").bitwiseAND(F.lit(FACES)) != 0).alias("faces_scanned"), n(F.col("availability") == "cloud_only").alias("cloud_only"), n(F.col("availability") == "shared").alias("shared"),
    )
    f = faces.agg(n(~F.col("ignored")).alias("faces"))
    p = persons.agg(n(F.col("name").isNotNull()).alias("named_people"))
    return a.crossJoin(f).crossJoin(p)  # three single rows


def person_summaries(persons: DataFrame, members: DataFrame, faces: DataFrame) -> DataFrame:
    n = members.join(faces.select("face_id", "asset_id"), "face_id").groupBy("person_id").agg(F.count(F.lit(1)).alias("n_faces"), F.countDistinct("asset_id").alias("n_assets"))
    return persons.join(n, "person_id", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n_faces", "n_assets")})


def uniq_names(df: DataFrame, name: str, pos: str) -> DataFrame:
    """The n-th repeat of a name, in any case, gets ' n'."""
    n = F.row_number().over(Window.partitionBy(F.lower(name)).orderBy(pos))
    return df.withColumn("unique_name", F.when(n > 1, F.concat_ws(" ", name, n.cast("string"))).otherwise(F.col(name)))


def month_key(seconds: Column) -> Column:
    t = F.timestamp_seconds(seconds)
    return F.coalesce(F.year(t) * 100 + F.month(t), F.lit(-1))


def section_runs(df: DataFrame, group: str) -> DataFrame:
    """(section, month, n) for runs of one month in date order, newest first, within each `group`.

    In date order every month is one run, and undated rows (month -1) are the last, so runs are counted by month where the rows lie and only
    the months, not the rows, are put in order.
    """
    runs = df.groupBy(group, month_key(F.col("created_s")).alias("month")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(group).orderBy(F.desc("month"))
    return runs.select(group, F.row_number().over(w).cast("long").alias("section"), "month", "n")


def shuffled(key: Column, seed: int) -> Column:
    """A sort key that puts rows in an order of its own for each seed."""
    return F.md5(F.concat(F.lit(f"{seed}/"), key.cast("string")))


def search(assets: DataFrame, tokens: DataFrame, tags: DataFrame, query: str) -> DataFrame:
    """asset_id of rows that match: all terms as token prefixes, or the query inside title, filename or key, or inside a user's tag.

    As in the catalog it serves, tombstoned rows are found too and an empty query finds nothing. % and _ act as in LIKE.
    tokens: (asset_id, token), lower case without diacritics.
    """
    terms = [t for t in fold_text(query).replace('"', " ").split() if t]
    ids = assets.select("asset_id")
    if not terms:
        return ids.limit(0)
    by_text = reduce(lambda df, t: df.join(tokens.filter(F.startswith("token", F.lit(t))).select("asset_id"), "asset_id", "left_semi"), terms, ids)
    like = f"%{query}%"
    by_name = assets.filter(F.col("title").ilike(like) | F.col("filename").ilike(like) | F.col("asset_key").ilike(like)).select("asset_id")
    by_tag = tags.filter((F.col("source") == "user") & F.col("label").ilike(like)).select("asset_id")
    return by_text.union(by_name).union(by_tag).distinct()


def descendants(nodes: DataFrame, depth: int | None = None) -> DataFrame:
    """(ancestor, album_id) for every node and itself, down to `depth` levels or, by default, all. nodes: album_id, parent_id; a cycle ends where it begins.

    The distance that is covered doubles each round: pairs at a distance of 2^k extend all pairs nearer than that, so a chain of n levels takes log n rounds, each a table of its own.
    """
    child = nodes.filter("parent_id is not null").select(F.col("album_id"), F.col("parent_id").alias("ancestor"))
    step = durable(child.join(nodes.select(F.col("album_id").alias("ancestor")).distinct(), "ancestor").select("ancestor", "album_id").distinct())
    out = durable(nodes.select(F.col("album_id").alias("ancestor"), "album_id").distinct())
    if depth is not None:
        level = out
        for _ in range(depth):
            level = durable(level.join(step.select(F.col("ancestor").alias("album_id"), F.col("album_id").alias("below")), "album_id").select("ancestor", F.col("below").alias("album_id")).distinct())
            if level.isEmpty():
                break
            out = out.union(level)
        return out.distinct()
    known = out.count()
    while not step.isEmpty():
        further = step.select("ancestor", F.col("album_id").alias("mid"))
        out = durable(out.union(further.join(out.select(F.col("ancestor").alias("mid"), "album_id"), "mid").select("ancestor", "album_id")).distinct())
        now = out.count()
        if now == known:
            break
        known = now
        step = durable(further.join(step.select(F.col("ancestor").alias("mid"), "album_id"), "mid").select("ancestor", "album_id").distinct())
    return out


def paths(nodes: DataFrame) -> DataFrame:
    """(album_id, path): the titles from the top down to each node, joined by slashes. nodes: album_id, parent_id, title.

    A node whose parent is missing is at the top; nodes in or below a cycle are not reached from the top and have no row. The steps upward double each round.
    """
    here = nodes.select(F.col("album_id").alias("up")).distinct().withColumn("there", F.lit(True))
    now = nodes.select("album_id", F.col("parent_id").alias("up"), F.coalesce("title", F.lit("")).alias("path")).join(here, "up", "left")
    now = durable(now.select("album_id", F.when(F.col("there"), F.col("up")).alias("up"), "path"))
    left = now.filter("up is not null").count()
    while left:
        above = now.select(F.col("album_id").alias("up"), F.col("up").alias("further"), F.col("path").alias("before"))
        now = durable(now.join(above, "up", "left").select("album_id", F.col("further").alias("up"), F.concat_ws("/", "before", "path").alias("path")))
        still = now.filter("up is not null").count()
        if still == left:  # a cycle and what hangs below it
            break
        left = still
    return now.filter("up is null").select("album_id", "path")


def path_prefixes(df: DataFrame, path: str) -> DataFrame:
    """Each row once for every directory above it: (.., directory, depth)."""
    parts = F.split(path, "/")
    dirs = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    return df.filter(F.size(parts) > 1).select("*", F.posexplode(dirs).alias("depth", "directory"))
