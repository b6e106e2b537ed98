"""Hash, quality, vector and geometry expressions, as Column builders."""

from __future__ import annotations

import math
from decimal import ROUND_HALF_UP, Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def bits_above_median(v: Column) -> Column:
    """A 64-bit hash of 64 coefficients, most significant first: 1 where one is above the median of all."""
    d = F.transform(v, lambda x: x.cast("double"))
    s = F.array_sort(d)
    median = (F.element_at(s, 32) + F.element_at(s, 33)) / 2
    return _bits(F.zip_with(d, spread(median, d), lambda x, m: x > m))


def bits_rising(v: Column) -> Column:
    """A 64-bit hash: 1 where a coefficient is below the next (the last is compared with the first)."""
    d = F.transform(v, lambda x: x.cast("double"))
    nexts = F.concat(F.slice(d, 2, 63), F.slice(d, 1, 1))
    return _bits(F.zip_with(d, nexts, lambda a, b: a < b))


def spread(value: Column, like: Column) -> Column:
    """An array of value, as long as `like`: inside a lambda, an expression over the row would be computed again for each element."""
    return F.array_repeat(value, F.size(like))


def scaled(a: Column) -> Column:
    """Of unit length; zero vectors stay."""
    return F.zip_with(a, spread(F.greatest(norm(a), F.lit(1e-300)), a), lambda x, n: x / n)


def _bits(flags: Column) -> Column:
    return F.aggregate(flags, F.lit(0).cast("long"), lambda acc, f: F.shiftleft(acc, 1).bitwiseOR(f.cast("long")))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def centred(a: Column) -> Column:
    """Minus its mean, then of unit length."""
    mean = F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x.cast("double")) / F.size(a)
    return scaled(F.zip_with(a, spread(mean, a), lambda x, m: x.cast("double") - m))


def sharpness_score(laplacian_variance: Column) -> Column:
    return 1 - F.exp(-laplacian_variance / 300)


def noise_score(sigma: Column) -> Column:
    return F.greatest(F.lit(0.0), 1 - sigma / 12)


def exposure_score(mean_luma: Column, clipped: Column) -> Column:
    off = F.least(F.lit(1.0), F.abs(mean_luma - 118) / 118)
    return F.greatest(F.lit(0.0), 1 - off - 2 * clipped)


def quality_score(sharpness: Column, noise: Column) -> Column:
    return 0.75 * sharpness + 0.25 * noise


def preference(favorite: Column, edited: Column, placed: Column) -> Column:
    """How much a user has done with a picture: a favourite, edits, a place in an album."""
    said = lambda c, w: F.when(F.coalesce(c, F.lit(False)), w).otherwise(0.0)
    return said(favorite, 0.7) + said(edited, 0.2) + said(placed, 0.1)


def half_away(x: float) -> int:
    return int(Decimal(repr(x)).quantize(Decimal(1), ROUND_HALF_UP)) if x >= 0 else -half_away(-x)


def thresholds(strictness: float) -> dict[str, float]:
    """Duplicate thresholds for a strictness in 0..1."""
    s = min(max(strictness, 0.0), 1.0)
    return {"near": half_away(8 - 4 * s), "loose": half_away(14 - 6 * s), "near_cosine": 0.95 + 0.04 * s, "burst_cosine": 0.88 + 0.08 * s, "similar_cosine": 0.93 + 0.05 * s}


def face_threshold(low: float, high: float, strictness: float) -> float:
    return low + (high - low) * min(max(strictness, 0.0), 1.0)


def adaptive_threshold(base: float, q_a: Column, q_b: Column, px_a: Column, px_b: Column, yaw_a: Column, yaw_b: Column) -> Column:
    """A pair's link threshold: higher for poor quality, small faces and profile against frontal."""
    profile = (F.abs(yaw_a) > 0.6) != (F.abs(yaw_b) > 0.6)
    return F.lit(base) + 0.10 * (1 - F.least(q_a, q_b)) + F.when(F.least(px_a, px_b) < 64, 0.05).otherwise(0.0) + F.when(F.coalesce(profile, F.lit(False)), 0.04).otherwise(0.0)


def fit_size(width: Column, height: Column, long_edge: int) -> tuple[Column, Column]:
    s = F.lit(float(long_edge)) / F.greatest(width, height)
    return tuple(F.greatest(F.lit(1), F.round(x * s).cast("int")) for x in (width, height))


def quad_area(points: list[tuple[Column, Column]]) -> Column:
    """The shoelace area of a polygon."""
    total = F.lit(0.0)
    for (xa, ya), (xb, yb) in zip(points, points[1:] + points[:1], strict=True):
        total = total + xa * yb - xb * ya
    return F.abs(total) / 2


def flip_box(y: Column, height: Column) -> Column:
    """The top of a normalised box measured from the other edge."""
    return 1 - (y + height)


# The five points (eyes, nose, corners of the mouth) of a 112 x 112 aligned face.
FACE_POINTS = ((38.2946, 51.6963), (73.5318, 51.5014), (56.0252, 71.7366), (41.5493, 92.3655), (70.7299, 92.2041))


def similarity_transform(source: list[tuple[Column, Column]], target: list[tuple[float, float]] = FACE_POINTS) -> Column:
    """struct(a, b, tx, ty) of the least-squares rotation, scale and shift x' = a x - b y + tx, y' = b x + a y + ty; null where all points are one."""
    n = len(source)
    mean = lambda cs: sum(cs[1:], cs[0]) / n
    mx, my = mean([x for x, _ in source]), mean([y for _, y in source])
    ux, uy = sum(x for x, _ in target) / n, sum(y for _, y in target) / n
    total = lambda f: sum((f(x - mx, y - my, u - ux, v - uy) for (x, y), (u, v) in zip(source, target, strict=True)), F.lit(0.0))
    spread = total(lambda x, y, u, v: x * x + y * y)
    a, b = total(lambda x, y, u, v: x * u + y * v) / spread, total(lambda x, y, u, v: x * v - y * u) / spread
    return F.when(spread > 1e-9, F.struct(a.alias("a"), b.alias("b"), (ux - (a * mx - b * my)).alias("tx"), (uy - (b * mx + a * my)).alias("ty")))


def seal(vector: Column, key: Column) -> Column:
    """A vector under AES-GCM with a random nonce of its own."""
    return F.aes_encrypt(F.to_json(vector).cast("binary"), key, F.lit("GCM"), F.lit("DEFAULT"))


def unseal(sealed: Column, key: Column) -> Column:
    """The vector of seal(); another key or changed bytes are an error."""
    return F.from_json(F.aes_decrypt(sealed, key, F.lit("GCM"), F.lit("DEFAULT")).cast("string"), "array<double>")


def psnr(mean_squared_error: Column, peak: float = 255.0) -> Column:
    return F.when(mean_squared_error > 0, 10 * F.log10(F.lit(peak * peak) / mean_squared_error)).otherwise(F.lit(math.inf))
