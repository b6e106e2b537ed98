"""Rule tables as column expressions: classification, gates, policies, smart albums."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# File-name patterns, size tables, label and word lists that decide categories.
SCREENSHOT_NAMES = "^(screenshot|screen shot|screen_shot|scr_|screencapture|capture d’écran|bildschirmfoto)"
WHATSAPP_NAMES = (r"^IMG-\d{8}-WA\d+", r"^whatsapp (image|video)", r"-WA\d{4}\.[A-Za-z]+$")
SOCIAL_NAMES = (r"^FB_IMG_", r"^received_", r"^Snapchat-", r"^InShot_", r"^IMG_\d{8}_\d{6}_\d+", r"instagram")
SCREEN_SIZES = (
    (1170, 2532), (1179, 2556), (1284, 2778), (1290, 2796), (1125, 2436), (1242, 2688), (828, 1792), (750, 1334), (1080, 1920), (1242, 2208), (640, 1136), (1206, 2622),
    (1320, 2868), (1080, 2340), (1080, 2400), (1080, 2220), (1440, 3200), (1440, 3120), (1440, 3040), (1440, 2960), (720, 1600), (720, 1520), (1080, 2408), (1080, 2412),
    (1600, 2560), (1800, 2880), (900, 1440), (800, 1280), (1440, 2560), (1964, 3024), (2234, 3456), (1664, 2560), (1117, 1728), (982, 1512), (1050, 1680), (1200, 1920),
    (768, 1366), (1620, 2160), (1668, 2388), (2048, 2732), (1536, 2048),
)
WHATSAPP_EDGES = (1600, 1280, 2560, 4096, 1024)
SOCIAL_SIZES = (
    (1080, 1080), (1080, 1350), (1080, 1920), (1080, 566), (1080, 608), (1200, 630), (1200, 675), (1600, 900), (1080, 1440), (640, 640), (750, 750), (720, 1280),
    (1024, 512), (1500, 500), (1200, 1200),
)
RECEIPT_WORDS = ("total", "subtotal", "grand total", "gst", "cgst", "sgst", "igst", "invoice", "receipt", "bill no", "amount", "qty", "tax", "cash", "paid", "₹", "rs.", "inr", "mrp", "balance", "upi", "gstin", "hsn", "payment")
SEXUAL_TERMS = ("nude", "naked", "topless", "undress", "nsfw", "explicit", "sexual", "lingerie", "porn")
MINOR_TERMS = ("child", "children", "kid", "kids", "teen", "teenage", "underage", "minor", "schoolgirl", "schoolboy", "young-looking", "loli", "shota", "baby", "toddler")


def is_screenshot_name(name: Column) -> Column:
    return name.rlike("(?i)" + SCREENSHOT_NAMES)


def is_whatsapp_name(name: Column) -> Column:
    return _any_like(name, WHATSAPP_NAMES)


def is_social_name(name: Column) -> Column:
    return _any_like(name, SOCIAL_NAMES)


def _size_in(a: Column, b: Column, sizes: tuple[tuple[int, int], ...]) -> Column:
    return F.concat_ws("x", a.cast("string"), b.cast("string")).isin(*[f"{x}x{y}" for x, y in sizes])


def _any_like(name: Column, patterns: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [name.rlike("(?i)" + p) for p in patterns])


def _device() -> Column:
    make, model = F.col("make"), F.coalesce("model", F.lit(""))
    brand = F.element_at(F.split(F.lower(make), " "), 1)
    return F.when(model == "", make).when((F.lower(make) == "apple") | F.contains(F.lower(model), brand), model).otherwise(F.concat_ws(" ", make, model))


def classify(signals: DataFrame) -> DataFrame:
    """signals plus categories: array<(category, confidence, reason)> in the categories' order.

    has_camera and has_exif are three-valued: only a known false counts as absent. doc_label is the highest score of the document
    labels. Each category takes its first rule of the highest confidence; later categories read earlier ones.
    """
    name, lower = F.trim(F.coalesce("filename", F.lit(""))), F.lower(F.trim(F.coalesce("filename", F.lit(""))))
    no_camera, no_exif = F.col("has_camera").eqNullSafe(F.lit(False)), F.col("has_exif").eqNullSafe(F.lit(False))
    png, jpeg = lower.endswith(".png"), lower.endswith(".jpg") | lower.endswith(".jpeg")
    long_edge, short_edge = F.greatest("width", "height"), F.least("width", "height")
    chars, size = F.col("text_chars"), F.concat_ws("x", F.col("width").cast("string"), F.col("height").cast("string"))

    def rule(*cases: tuple[Column, Column | float, Column | str]) -> Column:
        out = None
        for test, confidence, why in cases:
            value = F.struct(F.lit(confidence).cast("double").alias("confidence"), (F.lit(why) if isinstance(why, str) else why).alias("reason"))
            out = F.when(test, value) if out is None else out.when(test, value)
        return out

    quoted = F.concat(F.lit("“"), name, F.lit("”"))
    shot = rule((F.col("subtype_screenshot"), 1.0, "marked as a screenshot"), (is_screenshot_name(lower), 0.95, F.concat(F.lit("file name "), quoted)), (no_camera & png & _size_in(short_edge, long_edge, SCREEN_SIZES), 0.75, F.concat(F.lit("screen-sized PNG "), size)))
    df = signals.withColumn("_shot", shot).withColumn("_is_shot", F.coalesce(F.col("_shot.confidence") >= 0.9, F.lit(False)))
    not_shot = ~F.col("_is_shot")
    df = df.withColumn("_whatsapp", rule((is_whatsapp_name(name), 0.98, F.concat(F.lit("file name "), quoted)), (no_exif & jpeg & not_shot & long_edge.isin(*WHATSAPP_EDGES), 0.6, "no metadata and a typical size")))
    social = no_camera & not_shot & F.col("_whatsapp").isNull() & _size_in(F.col("width"), F.col("height"), SOCIAL_SIZES)
    df = df.withColumn("_social", rule((is_social_name(name), 0.9, F.concat(F.lit("file name "), quoted)), (social & (chars >= 20), 0.75, F.concat(size, F.lit(" post size with text"))), (social, 0.65, F.concat(size, F.lit(" post size")))))
    page = (F.col("doc_confidence") >= 0.8) & (F.col("doc_area") >= 0.2) & (chars >= 40)
    df = df.withColumn("_document", rule((page, 0.9, "a page with text"), (not_shot & (chars >= 250) & (F.col("text_area") >= 0.08), 0.75, "mostly text"), (not_shot & (F.col("doc_label") >= 0.4) & (chars >= 20), 0.7, "looks like a document")))
    words = F.filter(F.array(*map(F.lit, RECEIPT_WORDS)), lambda w: F.contains(F.coalesce("text", F.lit("")), w))
    receipt = (F.col("_document").isNotNull() | (chars >= 60)) & not_shot & (F.size(words) >= 2)
    df = df.withColumn("_receipt", F.when(receipt, F.struct(F.least(F.lit(0.95), 0.6 + 0.1 * F.size(words)).alias("confidence"), F.concat(F.lit("mentions "), F.array_join(F.slice(words, 1, 4), ", ")).alias("reason"))))
    df = df.withColumn("_qr", rule((F.col("barcodes") > 0, 0.95, "a code was found")))
    camera = (F.coalesce("make", F.lit("")) != "") & not_shot & (F.coalesce("_document.confidence", F.lit(0.0)) < 0.7)
    df = df.withColumn("_camera", rule((camera, 0.9, F.concat(F.lit("taken with "), _device()))))
    parts = {"screenshot": "_shot", "whatsapp": "_whatsapp", "social": "_social", "document": "_document", "receipt": "_receipt", "qr_code": "_qr", "camera": "_camera"}
    found = [F.when(F.col(c).isNotNull(), F.struct(F.lit(k).alias("category"), F.col(f"{c}.confidence").alias("confidence"), F.col(f"{c}.reason").alias("reason"))) for k, c in parts.items()]
    return df.withColumn("categories", F.array_compact(F.array(*found))).drop("_is_shot", *parts.values())


def needs_ocr() -> Column:
    return (F.col("doc_confidence") >= 0.5) | (F.col("doc_label") >= 0.1) | F.col("subtype_screenshot") | ~F.col("has_camera").eqNullSafe(F.lit(True))


def request_policy(explicit: float = 0.5, minor: float = 0.2) -> Column:
    """What happens to a generative request, before anything is made."""
    p = F.lower("prompt")
    sexual = reduce(or_, [F.contains(p, F.lit(t)) for t in SEXUAL_TERMS])
    young = p.rlike(r"\b(" + "|".join(MINOR_TERMS) + r")\b") | (F.col("minor") >= minor)
    hot = F.col("source_explicit") >= explicit
    return F.when((sexual | hot) & young, "block_hard").when(sexual & F.col("real_person") & ~hot, "block_hard").when(sexual & ~F.col("adult"), "block_soft").otherwise("allow")


def output_policy(explicit: float = 0.5, minor: float = 0.2, margin: float = 0.15) -> Column:
    """What happens to a generated result, whatever the request's verdict was."""
    hot = F.col("output_explicit") >= explicit
    worse = F.col("output_explicit") > F.col("source_explicit") + margin
    return F.when((hot | (F.col("source_explicit") >= explicit)) & (F.col("minor") >= minor), "block_hard").when(F.col("real_person") & hot & worse, "block_hard").when(hot & ~F.col("adult"), "block_soft").when(hot, "label").otherwise("allow")


def conventional_policy(explicit: float = 0.5, minor: float = 0.2) -> Column:
    hot = F.col("source_explicit") >= explicit
    return F.when(hot & (F.col("minor") >= minor), "block_hard").when(hot & ~F.col("adult"), "block_soft").otherwise("allow")


def model_gate(registered: Column, cloud: Column, cloud_enabled: Column, commercial: Column) -> Column:
    return F.when(~registered, "not_registered").when(cloud & ~cloud_enabled, "cloud_disabled").when(~commercial, "not_commercial").otherwise("ok")


def active_layers(layers: Column, cursor: Column) -> Column:
    return F.slice(layers, F.lit(1), cursor)


def push_layer(layers: Column, cursor: Column, layer: Column) -> Column:
    """Pushing drops what had been undone."""
    return F.concat(active_layers(layers, cursor), F.array(layer))


STACK_VERSION = 1
STACK_SCHEMA = "cursor int, layers array<string>, version int"


def encode_stack(layers: Column, cursor: Column, version: int = STACK_VERSION) -> Column:
    """JSON of an edit stack, keys in order."""
    return F.to_json(F.struct(cursor.cast("int").alias("cursor"), layers.alias("layers"), F.lit(version).alias("version")))


def decode_stack(json: Column) -> Column:
    """The stack of encode_stack(); one that is unreadable or of a newer version is an error."""
    stack = F.from_json(json, STACK_SCHEMA)
    known = F.when(stack["version"].isNull(), F.raise_error(F.lit("unreadable edit stack"))).when(stack["version"] > STACK_VERSION, F.raise_error(F.lit("edit stack is newer than this library"))).otherwise(stack)
    return F.when(json.isNotNull(), known)


RULE_SCHEMA = "version int, people array<long>, peopleMatch string, nameContains string, tags array<string>, categories array<string>, match string, media string, favoritesOnly boolean"


def decode_rule(json: Column) -> Column:
    return F.from_json(json, RULE_SCHEMA)


def encode_rule(rule: Column) -> Column:
    """JSON of an album rule with RULE_SCHEMA's fields."""
    return F.to_json(rule)


@dataclass
class AlbumRule:
    people: list[int] = field(default_factory=list)
    all_people: bool = False
    name_contains: str = ""
    tags: list[str] = field(default_factory=list)
    categories: list[str] = field(default_factory=list)
    match_all: bool = True
    media: str = "any"
    favorites_only: bool = False

    def evaluate(self, items: DataFrame, person_assets: DataFrame, tag_assets: DataFrame, category_assets: DataFrame) -> DataFrame:
        """The items (asset_id, name, is_video, favorite) of the album: each criterion is a flag from one distinct-key join, then one predicate."""
        flags: list[Column] = []

        def with_flag(df: DataFrame, ids: DataFrame) -> DataFrame:
            c = f"_f{len(flags)}"
            flags.append(F.coalesce(c, F.lit(False)))
            return df.join(ids.select("asset_id").distinct().withColumn(c, F.lit(True)), "asset_id", "left")

        df = items
        if self.people:
            n = len(set(self.people)) if self.all_people else 1
            have = person_assets.filter(F.col("person_id").isin(self.people)).groupBy("asset_id").agg(F.countDistinct("person_id").alias("n")).filter(F.col("n") >= n)
            df = with_flag(df, have)
        if needle := self.name_contains.strip():
            flags.append(F.contains(F.lower("name"), F.lit(needle.lower())))
        if self.tags:
            df = with_flag(df, tag_assets.filter(F.lower("label").isin([t.lower() for t in self.tags])))
        if self.categories:
            df = with_flag(df, category_assets.filter(F.col("category").isin(self.categories)))
        if flags:
            df = df.filter(reduce(and_ if self.match_all else or_, flags))
        if self.media != "any":
            df = df.filter(F.col("is_video") == (self.media == "videos"))
        if self.favorites_only:
            df = df.filter("favorite")
        return df.select(*items.columns)

    def summary(self, names: dict[int, str]) -> str:
        parts = []
        if self.people:
            known = [names[p] for p in self.people if p in names]
            parts.append((" and " if self.all_people else " or ").join(known) + (" together" if self.all_people and len(known) > 1 else ""))
        if needle := self.name_contains.strip():
            parts.append(f"name contains “{needle}”")
        if self.tags:
            parts.append("tagged " + " or ".join(self.tags))
        if self.categories:
            parts.append(" or ".join(self.categories))
        extra = ([f"{self.media} only"] if self.media != "any" else []) + (["favorites"] if self.favorites_only else [])
        return " · ".join([*([(" · " if self.match_all else " — or — ").join(parts)] if parts else []), *extra]) or "Everything"
