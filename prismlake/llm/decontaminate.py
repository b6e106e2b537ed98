"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

Test items are short, documents long, so the search is for containment, not resemblance. Items are partitioned by the number of
their shingles; a partition's sketch keeps the least hashes (bottom-k MinHash) of each item, with k one more than the shingles its
largest item may lack. A document with enough of an item's shingles has at least one of any k of them, so probing every document's
shingles against the sketches loses no match. Documents that share a sketch hash are compared with the item, shingle by shingle.
The items are a stated query set: they go to the workers in blocks of bounded size, and each block is one pass over the documents
without a shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from ..plans.durable import durable
from .substring import Words
from .textkit import Slice, quoted, slices

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def shingles(text: bytes, width: int) -> set[bytes]:
    words = text.lower().split()
    return set(map(b" ".join, zip(*(words[k:] for k in range(width)), strict=False)))


def needed(n: int, threshold: float) -> int:
    """The least number of n shingles that makes a containment of at least the threshold."""
    return max(1, math.ceil(round(threshold * n, 9)))


class ItemIndex:
    """Sketches of a block of items, and their shingles for the verification."""

    def __init__(self, items: list[tuple[int, str | None]], shingle: int, threshold: float):
        self.items: list[tuple[int, set[bytes], int, int]] = []
        for item_id, text in items:
            raw = (text or "").encode()
            if width := min(shingle, len(raw.split())):
                grams = shingles(raw, width)
                self.items.append((item_id, grams, width, needed(len(grams), threshold)))
        found: dict[int, list[tuple[int, int]]] = {}
        by_size: dict[tuple[int, int], list[int]] = {}
        for k, (_, grams, width, _) in enumerate(self.items):
            by_size.setdefault((width, len(grams).bit_length()), []).append(k)
        for (width, _), members in by_size.items():
            sketch = max(len(self.items[k][1]) - self.items[k][3] + 1 for k in members)
            for k in members:
                for h in np.sort(_hashes(self.items[k][1], width))[:sketch].tolist():
                    found.setdefault(width, []).append((h, k))
        self.sketches = {}
        for width, pairs in found.items():
            pairs.sort()
            self.sketches[width] = (np.array([h for h, _ in pairs], np.uint64), np.array([k for _, k in pairs]))

    def matches(self, s: Slice) -> list[tuple[int, int, int, int]]:
        """(row, item_id, shared shingles, the item's shingles), in the order of the rows."""
        w, raw, out = _lower_words(s), None, []
        near: list[np.ndarray] = []
        for width, (keys, of) in self.sketches.items():
            at = np.flatnonzero(w.left >= width)
            h = w.runs.of(width)[at]
            some = np.zeros(1 << 20, bool)
            some[(keys >> np.uint64(44)).astype(np.int64)] = True
            hit = np.flatnonzero(some[(h >> np.uint64(44)).astype(np.int64)])
            lo, hi = np.searchsorted(keys, h[hit], "left"), np.searchsorted(keys, h[hit], "right")
            one = hi > lo
            for a, b, row in np.unique(np.stack([lo[one], hi[one], w.doc[at[hit[one]]]]), axis=1).T.tolist():
                near.append(np.stack([np.full(b - a, row), of[a:b]]))
        if near:
            raw = s.data.tobytes()
            cache: dict[tuple[int, int], set[bytes]] = {}
            for row, k in np.unique(np.concatenate(near, axis=1), axis=1).T.tolist():
                item_id, grams, width, need = self.items[k]
                if (row, width) not in cache:
                    cache = {(row, width): shingles(raw[s.off[row] : s.off[row + 1]], width)}
                if (shared := len(grams & cache[row, width])) >= need:
                    out.append((row, item_id, shared, len(grams)))
        return out


def _lower_words(s: Slice) -> Words:
    low = Slice.__new__(Slice)
    low.rows, low.texts, low.off, low.data = s.rows, s.texts, s.off, _LOWER[s.data]
    return Words(low)


def _hashes(grams: set[bytes], width: int) -> np.ndarray:
    texts = pa.array([g.decode() for g in grams])
    s = Slice(texts, pa.RecordBatch.from_arrays([texts], ["text"]))
    w = Words(s)
    return w.runs.of(width)[w.first[:-1]]


def _blocks(items: DataFrame, block_bytes: int) -> Iterator[tuple[list[tuple[int, str | None]], int]]:
    """The items in blocks of about block_bytes of text, each collected when its turn comes, and the number of blocks."""
    items = items.select("item_id", "text")
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = -(-int(total) // block_bytes) or 1
    for k in range(n):
        yield [tuple(r) for r in items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).orderBy("item_id", "text").collect()], n


def find_contaminated(docs: DataFrame, items: DataFrame, *, shingle: int = 5, threshold: float = 0.8, block_bytes: int = 8 << 20) -> DataFrame:
    """(doc_id, item_id, n_shared, n_item, containment) for every document that holds at least `threshold` of an item's shingles.

    docs: doc_id (any type), text; items: item_id, text; other columns are ignored. Words are runs of other characters than ASCII
    spaces, A-Z lower-cased; shingles are distinct runs of `shingle` words, or of all an item's words if it has fewer. Items and
    documents that are null or wordless match nothing. Repeated rows each give their rows. Empty tables give an empty result.
    """
    return _matches(docs.select("doc_id", "text"), items, shingle, threshold, block_bytes)


def _matches(texts: DataFrame, items: DataFrame, shingle: int, threshold: float, block_bytes: int) -> DataFrame:
    """The matches of texts (a name, text). Each block is a pass that ends before the next block is broadcast, unless there is only one."""
    spark, name = texts.sparkSession, texts.columns[0]
    schema = StructType([texts.schema[0], *(StructField(c, LongType()) for c in ("item_id", "n_shared", "n_item")), StructField("containment", DoubleType())])
    out = None
    for block, n in _blocks(items, block_bytes):
        shared = spark.sparkContext.broadcast(ItemIndex(block, shingle, threshold))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for s in slices(batches):
                row, item, n, of = np.array(shared.value.matches(s), np.int64).reshape(-1, 4).T
                yield pa.RecordBatch.from_arrays([s.rows.column(0).take(pa.array(row)), pa.array(item), pa.array(n), pa.array(of), pa.array(n / np.maximum(of, 1))], [name, "item_id", "n_shared", "n_item", "containment"])

        part = texts.mapInArrow(run, schema)
        if n > 1:
            part = durable(part)
            shared.unpersist()
        out = part if out is None else out.union(part)
    return out


def drop_contaminated(docs: DataFrame, items: DataFrame, *, shingle: int = 5, threshold: float = 0.8, block_bytes: int = 8 << 20) -> DataFrame:
    """docs, all columns, without the documents that find_contaminated reports; rows that repeat a dropped one go too."""
    block, n = next(_blocks(items, block_bytes))
    if n == 1:  # one pass that filters where the texts lie
        shared = docs.sparkSession.sparkContext.broadcast(ItemIndex(block, shingle, threshold))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for s in slices(batches):
                keep = np.ones(len(s), bool)
                keep[[m[0] for m in shared.value.matches(s)]] = False
                yield s.rows.filter(pa.array(keep))

        plain = ["text" if c == "text" else f"c{k}" for k, c in enumerate(docs.columns)]
        rows = docs.select(*[F.col(quoted(c)).alias(p) for c, p in zip(docs.columns, plain, strict=True)])
        return rows.mapInArrow(run, rows.schema).select(*[F.col(p).alias(c) for c, p in zip(docs.columns, plain, strict=True)])
    key = F.xxhash64("doc_id", "text")
    gone = durable(_matches(docs.select(key.alias("row"), "text"), items, shingle, threshold, block_bytes).select("row").distinct())
    keyed = docs.select(key.alias("row"), *[F.col(quoted(c)).alias(f"c{k}") for k, c in enumerate(docs.columns)])
    return keyed.join(gone, "row", "left_anti").select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(docs.columns)])
