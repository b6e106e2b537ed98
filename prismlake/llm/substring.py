"""Substring dedup over words, with difference-cover anchors.

A difference cover D of the residues modulo a period v holds, for any two positions i and j, a shift under v that brings both to
residues in D. So two equal windows of `window` words share an anchor: equal runs of window - v + 1 words that begin at cover
positions in both documents. Only those runs are hashed and shuffled. Where an anchor repeats, every window that holds it is a
candidate; the candidates' whole windows are hashed (64 bits) and the repeated ones cover the words that go.
"""

from __future__ import annotations

import hashlib
from itertools import combinations, compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from . import marks
from .textkit import Slice, Windows, owner, quoted, range_hashes


def difference_cover(period: int) -> tuple[int, ...]:
    """A smallest set of residues whose differences are all residues modulo the period."""
    size = 1
    while True:
        for rest in combinations(range(1, period), size - 1):
            cover = (0, *rest)
            if len({(a - b) % period for a in cover for b in cover}) == period:
                return cover
        size += 1


class Words:
    """The words of a slice with hashes of runs of them."""

    def __init__(self, s: Slice):
        self.start, self.end, self.first = s.words()
        self.runs = Windows(range_hashes(s.data, self.start, self.end))
        self.n = len(self.start)
        self.doc = owner(self.first, self.n)
        self.place = np.arange(self.n) - self.first[self.doc]
        self.left = self.first[self.doc + 1] - np.arange(self.n)


def remove_repeated(docs: DataFrame, *, window: int = 35, period: int = 21, with_text: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256[, text], carried columns): words covered by a window that also starts anywhere else.

    docs: doc_id, text; other columns are ignored unless named in `carry` (of any types). Words are runs
    of other characters than ASCII spaces, unchanged. Null and empty texts have no words. A row repeated with the same id and text
    counts as a document of its own, so its windows repeat; it travels once, with a count. Rows of one id with different texts are
    different documents. An empty table gives an empty result. with_text adds the text without those words and the white space
    behind them; all other white space stays (null for a null text). n_removed of a whole text leaves an empty one.
    """
    found = _found(docs, window, period, with_text, carry)
    return found.select("doc_id", "n_words", "n_removed", "kept_sha256", *["text"] * with_text, *[F.col(f"c{i}").alias(c) for i, c in enumerate(carry)])


def drop_repeated(docs: DataFrame, *, window: int = 35, period: int = 21) -> DataFrame:
    """docs, all columns, with remove_repeated's texts in place of their own."""
    carried = [c for c in docs.columns if c not in ("doc_id", "text")]
    place = {c: F.col(f"c{i}").alias(c) for i, c in enumerate(carried)}
    return _found(docs, window, period, True, tuple(carried)).select(*[place.get(c, F.col(quoted(c))) for c in docs.columns])


def _found(docs: DataFrame, window: int, period: int, with_text: bool, carry: tuple[str, ...]) -> DataFrame:
    """remove_repeated's columns, the carried ones as c0, c1, .."""
    if not 1 < period <= window:
        raise ValueError("the period must be in 2..window")
    cover = np.zeros(period, bool)
    cover[list(difference_cover(period))] = True
    width = window - period + 1
    rows, text_bytes = marks.distinct_rows(docs, carry)
    router = marks.router_for(docs.sparkSession, text_bytes)

    def anchors(s: Slice, keys: np.ndarray, copied: np.ndarray) -> list[tuple]:
        w = Words(s)
        whole = np.diff(w.first)[w.doc] >= window
        at = np.flatnonzero(cover[w.place % period] & (w.left >= width) & whole)
        return router.candidates(keys[w.doc[at]], w.place[at], w.runs.of(width)[at], copied[w.doc[at]])

    def windows(s: Slice, rows: np.ndarray, places: np.ndarray) -> pa.RecordBatch:
        w = Words(s)
        edges = np.zeros(w.n + 1, np.int64)
        anchor = w.first[rows] + places
        np.add.at(edges, np.maximum(anchor - period + 1, w.first[rows]), 1)
        np.add.at(edges, anchor + 1, -1)
        at = np.flatnonzero((np.cumsum(edges[:-1]) > 0) & (w.left >= window))
        return marks.batch(router.candidates(s.column("k")[w.doc[at]], w.place[at], w.runs.of(window)[at], s.column("copies")[w.doc[at]] > 1))

    def cut(s: Slice, rows: np.ndarray, places: np.ndarray) -> pa.RecordBatch:
        start, _, first = s.words()
        edges = np.zeros(len(start) + 1, np.int64)
        at = first[rows] + places
        np.add.at(edges, at, 1)
        np.add.at(edges, at + window, -1)
        gone = np.cumsum(edges[:-1]) > 0
        raw, off, bounds, digests = s.data.tobytes(), s.off.tolist(), first.tolist(), []
        n_removed = np.concatenate([[0], np.cumsum(gone)])[first]
        n_removed = n_removed[1:] - n_removed[:-1]
        for k in range(len(s)):
            words = raw[off[k] : off[k + 1]].split()
            digests.append(hashlib.sha256(b" ".join(compress(words, ~gone[bounds[k] : bounds[k + 1]]) if n_removed[k] else words)).hexdigest())
        arrays = [s.rows.column(2), s.rows.column(4), pa.array(np.diff(first)), pa.array(n_removed), pa.array(digests)]
        if with_text:
            arrays.append(pa.array(_without(s, start, first, gone), pa.string(), mask=s.rows.column(3).is_null().to_numpy(zero_copy_only=False)))
        return pa.RecordBatch.from_arrays([*arrays, *s.rows.columns[5:]], names)

    counts = [StructField(c, LongType()) for c in ("copies", "n_words", "n_removed")]
    carried = [StructField(f"c{i}", docs.schema[c].dataType) for i, c in enumerate(carry)]
    schema = StructType([StructField("doc_id", docs.schema["doc_id"].dataType), *counts, StructField("kept_sha256", StringType()), *[StructField("text", StringType())] * with_text, *carried])
    names = schema.names
    dealt = marks.dealt(rows, router)
    found = marks.find(marks.scan(rows, anchors), router)
    found = marks.find(marks.with_told(dealt, found, windows, marks.SCHEMA), router)
    return marks.repeated_out(marks.with_told(dealt, found, cut, schema))


def _without(s: Slice, start: np.ndarray, first: np.ndarray, gone: np.ndarray) -> list[str]:
    """The slice's texts without the words that are gone and the white space up to the next word or the text's end."""
    at = np.flatnonzero(gone)
    ends = np.minimum(np.append(start[1:], len(s.data))[at], s.off[np.searchsorted(first, at, "right")])
    stays = _stays(start[at], ends, len(s.data))
    kept, size = s.data[stays].tobytes(), np.concatenate([[0], np.cumsum(stays)])[s.off].tolist()
    return [kept[a:b].decode() for a, b in zip(size[:-1], size[1:], strict=True)]


def _stays(start: np.ndarray, end: np.ndarray, n: int) -> np.ndarray:
    """For each of n bytes, whether no range holds it."""
    edges = np.zeros(n + 1, np.int64)
    np.add.at(edges, start, 1)
    np.add.at(edges, end, -1)
    return np.cumsum(edges[:-1]) == 0
