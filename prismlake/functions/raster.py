"""Perceptual hashes and quality metrics of luma rasters, in Arrow batches."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUALITY = T.StructType([T.StructField(n, T.DoubleType()) for n in ("laplacian_variance", "noise_sigma", "mean_luma", "clipped")])


def _resize(a: np.ndarray, h: int, w: int) -> np.ndarray:
    """Box average onto h x w."""
    rows = np.linspace(0, a.shape[0], h + 1)
    cols = np.linspace(0, a.shape[1], w + 1)
    sums = np.zeros((a.shape[0] + 1, a.shape[1] + 1))
    sums[1:, 1:] = a.cumsum(0).cumsum(1)

    def at(r: np.ndarray, c: np.ndarray) -> np.ndarray:
        r0, c0 = np.minimum(r.astype(int), a.shape[0] - 1), np.minimum(c.astype(int), a.shape[1] - 1)
        fr, fc = (r - r0)[:, None], (c - c0)[None, :]
        g = lambda i, j: sums[np.ix_(r0 + i, c0 + j)]
        return g(0, 0) * (1 - fr) * (1 - fc) + g(1, 0) * fr * (1 - fc) + g(0, 1) * (1 - fr) * fc + g(1, 1) * fr * fc

    grid = at(rows, cols)
    area = np.diff(rows)[:, None] * np.diff(cols)[None, :]
    return (grid[1:, 1:] - grid[:-1, 1:] - grid[1:, :-1] + grid[:-1, :-1]) / area


def _signed(flags: np.ndarray) -> int:
    return int(np.packbits(flags).view(">u8")[0].astype(np.uint64).view(np.int64))


def phash(raster: np.ndarray) -> int:
    """Signs of the 8 x 8 lowest DCT-II coefficients of a 32 x 32 reduction against their median."""
    a = raster if raster.shape == (32, 32) else _resize(raster, 32, 32)
    k, x = np.arange(8)[:, None], np.arange(32)[None, :]
    basis = np.cos((2 * x + 1) * k * np.pi / 64)
    c = (basis @ a @ basis.T).ravel()
    return _signed(c > np.median(c))


def dhash(raster: np.ndarray) -> int:
    """Whether each of 9 columns rises to the next, over 8 rows."""
    a = raster if raster.shape == (8, 9) else _resize(raster, 8, 9)
    return _signed((a[:, :-1] < a[:, 1:]).ravel())


def _laplacian_variances(a: np.ndarray) -> np.ndarray:
    """Of each raster of a stack."""
    if min(a.shape[-2:]) < 3:
        return np.zeros(a.shape[:-2])
    lap = a[..., :-2, 1:-1] + a[..., 2:, 1:-1]
    lap += a[..., 1:-1, :-2]
    lap += a[..., 1:-1, 2:]
    lap -= 4 * a[..., 1:-1, 1:-1]
    return lap.var((-2, -1))


def laplacian_variance(a: np.ndarray) -> float:
    return float(_laplacian_variances(a))


def noise_sigma(a: np.ndarray) -> float:
    """Immerkaer's estimate."""
    if min(a.shape) < 3:
        return 0.0
    m = a[:-2, :-2] - 2 * a[:-2, 1:-1] + a[:-2, 2:] - 2 * a[1:-1, :-2] + 4 * a[1:-1, 1:-1] - 2 * a[1:-1, 2:] + a[2:, :-2] - 2 * a[2:, 1:-1] + a[2:, 2:]
    return float(np.abs(m).sum() * np.sqrt(np.pi / 2) / (6 * m.size))


def _numbers(pixels: np.ndarray | str) -> np.ndarray:
    """Pixels as an array of numbers, or as a text whose code points they are."""
    return np.frombuffer(pixels.encode("utf-32-le"), "<u4").astype(float) if isinstance(pixels, str) else np.asarray(pixels, float)


def _each(f, width: pd.Series, height: pd.Series, pixels: pd.Series) -> list:
    return [f(_numbers(p).reshape(h, w)) for w, h, p in zip(width, height, pixels, strict=True)]


@F.pandas_udf(T.LongType())
def phash_udf(width: pd.Series, height: pd.Series, pixels: pd.Series) -> pd.Series:
    return pd.Series(_each(phash, width, height, pixels), dtype="int64")


@F.pandas_udf(T.LongType())
def dhash_udf(width: pd.Series, height: pd.Series, pixels: pd.Series) -> pd.Series:
    return pd.Series(_each(dhash, width, height, pixels), dtype="int64")


@F.pandas_udf(QUALITY)
def quality_udf(width: pd.Series, height: pd.Series, pixels: pd.Series) -> pd.DataFrame:
    rows = _each(lambda a: (laplacian_variance(a), noise_sigma(a), float(a.mean()), float(((a <= 2) | (a >= 253)).mean())), width, height, pixels)
    return pd.DataFrame(rows, columns=["laplacian_variance", "noise_sigma", "mean_luma", "clipped"])


# Enlarging

TAPS = 3
TILE = 64
STACK_PIXELS = 1 << 16


@lru_cache(256)
def _box(size: int, out: int, first: int, last: int) -> tuple[np.ndarray, int]:
    """As _lanczos, for the sum over the places that an output place covers; sums are divided last, so that flat rasters stay flat."""
    edge = np.linspace(0, size, out + 1)[first : last + 1]
    lo = min(int(edge[0]), size - 1)
    x = np.arange(lo, min(int(np.ceil(edge[-1])), size))[None, :]
    w = np.minimum(edge[1:, None], x + 1) - np.maximum(edge[:-1, None], x)
    return np.maximum(w, 0.0), lo


@lru_cache(256)
def _lanczos(size: int, out: int, first: int, last: int) -> tuple[np.ndarray, int]:
    """Weights of input places for the output places first..last, and the first input place that they need; places beyond the edge count as the edge."""
    scale = size / out
    wide = TAPS * max(scale, 1.0)
    centre = (np.arange(first, last) + 0.5) * scale - 0.5
    begin, end = int(np.floor(centre[0] - wide)), int(np.ceil(centre[-1] + wide)) + 1
    x = (np.arange(begin, end)[None, :] - centre[:, None]) / max(scale, 1.0)
    w = np.where(np.abs(x) < TAPS, np.sinc(x) * np.sinc(x / TAPS), 0.0)
    w /= w.sum(1, keepdims=True)
    places = np.clip(np.arange(begin, end), 0, size - 1)
    lo = places[0]
    out_w = np.zeros((len(centre), places[-1] - lo + 1))
    np.add.at(out_w.T, places - lo, w.T)
    return out_w, int(lo)


def _resample(weights, a: np.ndarray, h: int, w: int, tile: int) -> np.ndarray:
    """a, a raster or a stack of them, at h x w in tiles of the result; weights: _box or _lanczos."""
    out = np.empty((*a.shape[:-2], h, w))
    for i in range(0, h, tile):
        rows, top = weights(a.shape[-2], h, i, min(i + tile, h))
        for j in range(0, w, tile):
            cols, left = weights(a.shape[-1], w, j, min(j + tile, w))
            part = a[..., top : top + rows.shape[1], left : left + cols.shape[1]]
            out[..., i : i + tile, j : j + tile] = rows @ part @ cols.T
    return out


def lanczos(a: np.ndarray, h: int, w: int, tile: int = 256) -> np.ndarray:
    """a at h x w by a Lanczos filter, in tiles that read so much beyond their edges that no seam shows."""
    return _resample(_lanczos, a, h, w, tile)


def psnr(a: np.ndarray, b: np.ndarray, peak: float = 255.0) -> float:
    mse = float(((a - b) ** 2).mean())
    return float("inf") if mse == 0 else 10 * np.log10(peak * peak / mse)


def upscale_qualities(a: np.ndarray, factors: tuple[int, ...]) -> np.ndarray:
    """(raster, factor, [PSNR, sharpness]) of a stack of rasters that were made smaller by each factor and enlarged again; sharpness is a share of the Laplacian's variance."""
    h, w = a.shape[1:]
    sharp, out = _laplacian_variances(a), np.empty((len(a), len(factors), 2))
    for k, factor in enumerate(factors):
        to = max(1, h // factor), max(1, w // factor)
        rows, cols = (np.diff(np.linspace(0, size, n + 1)) for size, n in zip((h, w), to, strict=True))
        small = _resample(_box, a, *to, TILE) / np.outer(rows, cols)
        again = _resample(_lanczos, small, h, w, TILE)
        out[:, k, 0] = [psnr(x, y) for x, y in zip(a, again, strict=True)]
        out[:, k, 1] = np.divide(_laplacian_variances(again), sharp, out=np.ones(len(a)), where=sharp > 0)
    return out


def upscale_quality(a: np.ndarray, factor: int) -> tuple[float, float]:
    """PSNR and sharpness of one raster."""
    psnr, sharpness = upscale_qualities(a[None], (factor,))[0, 0]
    return float(psnr), float(sharpness)


def upscale_udf(*factors: int):
    """psnr_k and sharpness_k of whole rasters, whatever their size, for each factor k; rasters of one size are worked on together."""
    names = [f"{n}_{k}" for k in factors for n in ("psnr", "sharpness")]

    @F.pandas_udf(T.StructType([T.StructField(n, T.DoubleType()) for n in names]))
    def run(width: pd.Series, height: pd.Series, pixels: pd.Series) -> pd.DataFrame:
        places: dict[tuple[int, int], list[int]] = {}
        for i, size in enumerate(zip(height, width, strict=True)):
            places.setdefault(size, []).append(i)
        px, out = pixels.to_numpy(), np.empty((len(pixels), len(factors), 2))
        for (h, w), at in places.items():
            step = max(1, STACK_PIXELS // (h * w))
            for k in range(0, len(at), step):
                some = at[k : k + step]
                out[some] = upscale_qualities(np.stack([_numbers(px[i]).reshape(h, w) for i in some]), factors)
        return pd.DataFrame(out.reshape(len(out), -1), columns=names)

    return run
