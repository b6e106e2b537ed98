"""An interpolated modified Kneser-Ney word model of order 2, counted in Spark and kept in sorted hash arrays that workers memory-map.

A text is its words, A-Z lower-cased, and one end; the first token follows a start. Words are told apart by 48-bit hashes. Pairs meet by a cell
of their first word (a frequent first word is spread over many cells by its second), each task's counts first. A cell's task
writes its pairs as a sorted hash array and passes on, for each word, what the lower order needs: how often it occurs, after how many different words, and how many different
words follow it once, twice, or more often. These meet by word in a second, smaller shuffle and become the word arrays. Texts are then scored in one
pass without any shuffle: a slice's pairs are sorted and looked up in the mapped arrays, so a task reads at most a page for each different pair it holds.

    p(w) = (n(w) - d(n(w))) / pairs + free / (words + 1)                 n(w): different words before w
    p(w | v) = (c(vw) - d'(c(vw))) / c(v) + free(v) / c(v) * p(w)
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.durable import durable, new_folder, size_in_bytes
from .charlm import _pack, _unpack, discounts
from .shards import arrays, look_up, write_arrays
from .textkit import ODD, SEED, Slice, mix, per_text, range_hashes, slices

U = np.uint64
#: Hashes of the end and of what stands before the first token; those of words are 48 bits of a 64-bit hash.
END, START = U(1), U(2)
#: Different pairs that a counting task holds before it sends them on.
HELD = 1 << 21
#: A first word above this share of a sample's words is spread over SPREAD cells; the sample (at most so many documents) decides nothing else.
FREQUENT, SPREAD, SAMPLE = 1 / 2000, 64, 2000
PARTS = "cell int, payload binary"
LOW = "bucket int, payload binary, t1 long, t2 long, t3 long, t4 long"
TOTALS = "tokens double, words long, pairs double, t1 long, t2 long, t3 long, t4 long"


def token_hashes(s: Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(the word before each token, each token, the first token of each text, one more at the end)."""
    data = np.where((s.data >= 65) & (s.data <= 90), s.data | 32, s.data).astype(np.uint8)
    start, end, first = s.words(data)
    h = range_hashes(data, start, end) >> U(16)
    return np.insert(h, first[:-1], START), np.insert(h, first[1:], END), first + np.arange(len(first))


def cell_of(v: np.ndarray, w: np.ndarray, frequent: np.ndarray, cells: int) -> np.ndarray:
    spread = np.isin(v, frequent) if len(frequent) else np.zeros(len(v), bool)
    salt = np.where(spread, w % U(SPREAD) + U(1), U(0))
    return ((mix(v * ODD + salt) >> U(32)) % U(cells)).astype(np.int64)


def pair_key(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    return mix(mix(v + SEED) ^ w)


def _sum_pairs(v: np.ndarray, w: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different pairs in order of both words, and the sum of each one's counts."""
    order = np.lexsort((w, v))
    v, w, n = v[order], w[order], n[order]
    new = np.ones(len(v), bool)
    new[1:] = (v[1:] != v[:-1]) | (w[1:] != w[:-1])
    first = np.flatnonzero(new)
    return v[first], w[first], np.add.reduceat(n, first) if len(first) else n


def _sums(key: np.ndarray, *values: np.ndarray) -> list[np.ndarray]:
    """The different keys in order and the sums of their values."""
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.diff(key, prepend=key[:1] + U(1)))
    return [key[first], *(np.add.reduceat(v[order], first) if len(first) else v for v in values)]


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "binary": pa.binary()}
    names, types = zip(*(c.split() for c in schema.split(", ")), strict=True)
    columns = zip(*rows, strict=True) if rows else ((),) * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, t in zip(columns, types, strict=True)], list(names))


def _pair_parts(v: np.ndarray, w: np.ndarray, n: np.ndarray, to: np.ndarray) -> Iterator[tuple]:
    """(cell, packed pairs) for each cell; a first word is written once."""
    order = np.argsort(to, kind="stable")
    for part in np.split(order, np.flatnonzero(np.diff(to[order])) + 1) if len(order) else ():
        pv = v[part]
        first = np.flatnonzero(np.diff(pv, prepend=pv[:1] + U(1)) != 0)
        yield int(to[part[0]]), _pack(pv[first].astype(np.int64), np.diff(first, append=len(pv)), w[part].astype(np.int64), n[part])


def _word_parts(buckets: int, words: np.ndarray, *values: np.ndarray) -> Iterator[tuple]:
    """(bucket, packed words and values, no pairs counted) for each bucket."""
    to = ((mix(words) >> U(32)) % U(buckets)).astype(np.int64)
    order = np.argsort(to, kind="stable")
    for part in np.split(order, np.flatnonzero(np.diff(to[order])) + 1) if len(order) else ():
        yield int(to[part[0]]), _pack(words[part].astype(np.int64), *(x[part] for x in values)), 0, 0, 0, 0


@dataclass(frozen=True)
class WordModel:
    """Where the arrays lie, and the numbers that hold for all of them."""

    folder: str
    cells: int
    buckets: int
    frequent: np.ndarray
    tokens: int
    words: int
    pairs: int
    one: tuple[float, ...]
    two: tuple[float, ...]
    free: float

    def of_words(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(count, probability, weight of the lower order after it) of different words in order; a word that was not learned has 0, that of any unknown one, and 1."""
        count, before, weight = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64), np.ones(len(words))
        bucket = (mix(words) >> U(32)) % U(self.buckets)
        for b in np.unique(bucket).tolist():
            part = np.flatnonzero(bucket == b)
            table = arrays(self.folder, f"words-{b}")
            if table:
                at, hit = look_up(table["word"], words[part])
                at, part = at[hit], part[hit]
                count[part], before[part], weight[part] = table["count"][at], table["before"][at], table["weight"][at]
        cut = np.array([0.0, *self.one])[np.minimum(before, 3)]
        return count, (before - cut) / max(self.pairs, 1) + self.free / (self.words + 1), weight

    def of_pairs(self, v: np.ndarray, w: np.ndarray) -> np.ndarray:
        """The count of each pair."""
        out = np.zeros(len(v), np.int64)
        cell, key = cell_of(v, w, self.frequent, self.cells), pair_key(v, w)
        order = np.lexsort((key, cell))
        for part in np.split(order, np.flatnonzero(np.diff(cell[order])) + 1) if len(order) else ():
            table = arrays(self.folder, f"pairs-{int(cell[part[0]])}")
            if table:
                at, hit = look_up(table["pair"], key[part])
                at, part = at[hit], part[hit]
                n = table["count"][at].astype(np.int64)
                large = np.flatnonzero(n == 255)
                n[large] = table["large"][np.searchsorted(table["large_at"], at[large])]
                out[part] = n
        return out

    def log10(self, s: Slice) -> tuple[np.ndarray, ...]:
        """(tokens, known tokens, base score, score) of each text of a slice."""
        v, w, first = token_hashes(s)
        words, place = np.unique(np.concatenate([v, w]), return_inverse=True)
        count, low, weight = self.of_words(words)
        pv, pw = place[: len(v)], place[len(v) :]
        seen, p = count[pw], weight[pv] * low[pw]
        may = np.flatnonzero((count[pv] > 0) & (seen > 0))
        n = self.of_pairs(v[may], w[may])
        may, n = may[n > 0], n[n > 0]
        p[may] += (n - np.array(self.two)[np.minimum(n, 3) - 1]) / count[pv[may]]
        base = np.log10((seen + 0.5) / (self.tokens + 0.5 * (self.words + 1)))
        return np.diff(first), per_text(seen > 0, first), per_text(base, first), per_text(np.log10(p), first)


def _frequent(docs: DataFrame) -> np.ndarray:
    """The first words that a bounded sample shows to be frequent."""
    rows = docs.filter(F.pmod(F.xxhash64("text"), F.lit(64)) == 0).limit(SAMPLE).select(F.substring("text", 1, 4096).alias("text"))
    found = [token_hashes(s)[0] for s in slices(iter(rows.toArrow().to_batches()))]
    if not found:
        return np.empty(0, U)
    words, n = np.unique(np.concatenate(found), return_counts=True)
    return words[n > max(FREQUENT * n.sum(), 8)]


def train(docs: DataFrame, *, per_cell: int = 12 << 20) -> WordModel:
    """The model of all whole texts of docs (text; other columns are ignored). Null texts are empty: an end alone. Repeated rows count each time.

    per_cell: bytes of input for each cell; a cell's pairs are what one task holds. An empty table gives a model that knows no word.
    """
    spark = docs.sparkSession
    folder = new_folder(spark, "wordlm")
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cells = max(least, -(-size_in_bytes(docs) // per_cell))
    buckets = cells
    docs = docs.select("text")
    frequent = _frequent(docs)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held, since = [], 0, 0
        for s in slices(batches):
            v, w, _ = token_hashes(s)
            parts.append(_sum_pairs(v, w, np.ones(len(v), np.int64)))
            since += len(parts[-1][0])
            if since > HELD // 4:
                parts = [_sum_pairs(*map(np.concatenate, zip(*parts, strict=True)))]
                held, since = len(parts[0][0]), 0
            if held > HELD:
                yield _batch(list(_pair_parts(*parts[0], cell_of(*parts[0][:2], frequent, cells))), PARTS)
                parts, held = [], 0
        if parts:
            pairs = _sum_pairs(*map(np.concatenate, zip(*parts, strict=True)))
            yield _batch(list(_pair_parts(*pairs, cell_of(*pairs[:2], frequent, cells))), PARTS)

    def cell(table: pa.Table) -> pa.Table:
        """Writes a cell's pairs; what its words count, by word bucket."""
        parts = []
        for raw in table.column("payload"):
            v, size, w, n = _unpack(raw.as_py())
            parts.append((np.repeat(v, size).astype(U), w.astype(U), n))
        v, w, n = _sum_pairs(*map(np.concatenate, zip(*parts, strict=True)))
        del parts
        key = pair_key(v, w)
        order = np.argsort(key)
        large = np.flatnonzero(n[order] >= 255)
        write_arrays(f"{folder}/pairs-{table.column('cell')[0].as_py()}", pair=key[order], count=np.minimum(n[order], 255).astype(np.uint8), large_at=large, large=n[order][large])
        t = [int((n == k).sum()) for k in (1, 2, 3, 4)]
        # Of each word how often it occurs and after how many different ones; of each first word (the start's occurrences) how many follow it once, twice, more often.
        first = np.flatnonzero(np.diff(v, prepend=v[:1] + U(1)))
        follow = [np.add.reduceat(x, first) for x in ((n * (v == START)), (n == 1).astype(np.int64), (n == 2).astype(np.int64), (n > 2).astype(np.int64))]
        out = [r for rows in (_sums(w, n, np.ones(len(w), np.int64)), [v[first], *follow]) for r in _word_parts(buckets, *rows)]
        return pa.Table.from_batches([_batch([*out, (-1, b"", *t)], LOW)])

    rows = docs.mapInArrow(count, PARTS).repartition(cells, "cell").groupBy("cell").applyInArrow(cell, LOW)
    low = durable(rows)
    t = low.agg(*[F.coalesce(F.sum(f"t{k}"), F.lit(0)) for k in (1, 2, 3, 4)]).first()
    two = discounts(np.array(t, np.int64), True)

    def bucket(table: pa.Table) -> pa.Table:
        parts = [_unpack(raw.as_py()) for raw in table.column("payload")]
        words = np.unique(np.concatenate([p[0] for p in parts]))

        def total(arrays_: int, k: int) -> np.ndarray:
            """Column k summed over the payloads that have so many arrays."""
            out = np.zeros(len(words), np.int64)
            for p in parts:
                if len(p) == arrays_:
                    out[np.searchsorted(words, p[0])] += p[k]
            return out

        n, before = total(3, 1) + total(5, 1), total(3, 2)
        free = sum(two[k] * total(5, 2 + k) for k in range(3))
        words = words.astype(U)
        write_arrays(f"{folder}/words-{table.column('bucket')[0].as_py()}", word=words, count=n, before=before.astype(np.uint32), weight=np.where(free > 0, free / np.maximum(n, 1), 1).astype(np.float32))
        token = words != START
        before = before[token]
        return pa.Table.from_batches([_batch([(float(n[token].sum()), int(token.sum()), float(before.sum()), *(int((before == k).sum()) for k in (1, 2, 3, 4)))], TOTALS)])

    names = [c.split()[0] for c in TOTALS.split(", ")]
    totals = low.filter("bucket >= 0").select("bucket", "payload").repartition(buckets, "bucket").groupBy("bucket").applyInArrow(bucket, TOTALS)
    got = totals.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in names]).first()
    one = discounts(np.array([got.t1, got.t2, got.t3, got.t4], np.int64), True)
    freed = float(np.dot(one, [got.t1, got.t2, got.words - got.t1 - got.t2])) / got.pairs if got.pairs else 1.0
    return WordModel(folder, cells, buckets, frequent, int(got.tokens), int(got.words), int(got.pairs), tuple(one.tolist()), tuple(two.tolist()), freed)


def score(docs: DataFrame, model: WordModel, *keep: Column) -> DataFrame:
    """(the `keep` columns, n_tokens, n_known, train_tokens, base_score, score) of every whole text of docs; a row each for repeated rows.

    Scores are sums of log10 probabilities over a text's tokens, its end included: base_score of smoothed word counts, score of the model. A null or empty text is
    its end alone. keep: columns of docs of any type; an empty table gives an empty result.
    """
    carried = docs.select(*keep).schema
    names = [f"c{k}" for k in range(len(carried))]
    rows = docs.select("text", *[c.alias(n) for c, n in zip(keep, names, strict=True)])
    from pyspark.sql.types import DoubleType, LongType, StructField, StructType

    added = ["n_tokens", "n_known", "train_tokens", "base_score", "score"]
    schema = StructType([*(StructField(n, f.dataType) for n, f in zip(names, carried, strict=True)), *(StructField(n, DoubleType() if "score" in n else LongType()) for n in added)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in slices(batches, size=8 << 20):
            n, known, base, own = model.log10(s)
            values = [n.astype(np.int64), known.astype(np.int64), np.full(len(s), model.tokens, np.int64), base, own]
            yield pa.RecordBatch.from_arrays([*s.rows.columns[1:], *map(pa.array, values)], [*names, *added])

    found = rows.mapInArrow(run, schema)
    return found.select(*[F.col(n).alias(f.name) for n, f in zip(names, carried, strict=True)], *added)
