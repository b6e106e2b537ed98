"""Kneser-Ney character n-gram models, one for each group of texts (a language), kept in sorted hash arrays that grow with the corpus.

A character is a symbol of 12 bits: lower-cased and white space made one, code points below U+0C00 stand for themselves (Latin, Greek,
Cyrillic, Hebrew, Arabic and most Indic letters), higher ones share 1,024 symbols such that neighbours in a block differ. An n-gram of
order 5 is then one number, and only those that occur are kept.

Counts are Spark's. Tasks count their texts; the counts of an n-gram meet by its hash, and then all n-grams with the same third and
fourth symbol meet in one cell, where their orders 5, 4 and 3 are complete: contexts hold those two symbols, and so do the shorter
n-grams that orders are counted down to. Orders 2 and 1 of a group are sums over its cells. A cell's task writes its sorted hash arrays to
a file of the shared folder, and workers memory-map the files that they look into: texts are scored in one pass and never shuffled, and neither a worker nor the driver
holds a model. Every n-gram of every text is counted and every character is scored.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.durable import durable, new_folder, size_in_bytes
from .shards import arrays, look_up, write_arrays
from .textkit import HashTable, Slice, fill, mix, slices

ORDER, BITS = 5, 12
SYMBOLS = 1 << BITS
EXACT, SHARED = 0xC00, 1024
SPACE = 32
COUNTS = "grp string, cell int, payload binary"
MODEL = "grp string, cell int, entries long"
#: Different n-grams that a counting task holds before it sends them on, and log probabilities that a scoring worker keeps.
HELD, KEPT = 1 << 20, 1 << 22
_TABLES: list[np.ndarray] = []


def _tables() -> list[np.ndarray]:
    """The symbol of each code point, and whether it is a letter (2: not looked up yet)."""
    if not _TABLES:
        points = np.arange(0x110000)
        low = points.copy()
        for c in range(0x2000):
            low[c] = SPACE if chr(c).isspace() else ord(chr(c).lower()[0])
        low[[c for c in (*range(0x2000, 0x2030), 0x205F, 0x3000) if chr(c).isspace()]] = SPACE
        shared = EXACT + ((low >> 7) * 37 + (low & 127)) % SHARED
        _TABLES.extend([np.where(low < EXACT, low, shared).astype(np.uint16), np.full(0x110000, 2, np.uint8)])
    return _TABLES


def symbols_of(code_points: np.ndarray) -> np.ndarray:
    return _tables()[0][code_points]


def is_letter(code_points: np.ndarray) -> np.ndarray:
    table = _tables()[1]
    out = table[code_points]
    if (out == 2).any():
        for c in np.unique(code_points[out == 2]).tolist():
            table[c] = unicodedata.category(chr(c))[0] == "L"
        out = table[code_points]
    return out.astype(bool)


def codes(s: Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The n-gram that ends at each character of the slice's texts, each text's first character (one more at the end), and whether each is a letter."""
    points = np.frombuffer(s.data.tobytes().decode().encode("utf-32-le"), "<u4")
    begins = np.concatenate([[0], np.cumsum((s.data & 0xC0) != 0x80)])[s.off]
    pad = ORDER - 1
    at = np.arange(len(points)) + pad * np.repeat(np.arange(1, len(s) + 1), np.diff(begins))
    run = np.full(len(points) + pad * len(s), SPACE, np.int64)
    run[at] = symbols_of(points)
    code = np.zeros(len(points), np.int64)
    for back in range(pad, -1, -1):
        code = code << BITS | run[at - back]
    return code, begins, is_letter(points)


def _sums(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different keys in order, and the sum of each one's values."""
    order = np.argsort(keys, kind="stable")
    keys, values = keys[order], values[order]
    first = np.flatnonzero(np.diff(keys, prepend=keys[:1] - 1)) if len(keys) else np.empty(0, np.int64)
    return keys[first], np.add.reduceat(values, first) if len(first) else values


def _pack(*arrays: np.ndarray) -> bytes:
    """int64 arrays, each as its length and its bytes by significance, which compress well."""
    out = []
    for a in arrays:
        out += [np.int64(len(a)).tobytes(), np.ascontiguousarray(a.astype("<i8").view(np.uint8).reshape(-1, 8).T).tobytes()]
    return b"".join(out)


def _unpack(raw: bytes) -> list[np.ndarray]:
    out, at = [], 0
    while at < len(raw):
        n = int(np.frombuffer(raw, "<i8", 1, at)[0])
        planes = np.frombuffer(raw, np.uint8, 8 * n, at + 8).reshape(8, n)
        out.append(np.ascontiguousarray(planes.T).view("<i8").ravel())
        at += 8 + 8 * n
    return out


def cell_of(code: np.ndarray, cells: int) -> np.ndarray:
    """The cell of n-grams, by their third and fourth symbols."""
    return ((mix((code >> BITS & (1 << 2 * BITS) - 1).astype(np.uint64) + np.uint64(1)) >> np.uint64(32)) % np.uint64(cells)).astype(np.int64)


class _Held:
    """Counts of different n-grams by group, bounded in number."""

    def __init__(self):
        self.parts: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        self.n = self.since = 0

    def add(self, group: str, code: np.ndarray, n: np.ndarray) -> bool:
        """Whether it is time to send on what is held."""
        self.parts.setdefault(group, []).append((code, n))
        self.since += len(code)
        if self.since > HELD:
            self.parts = {g: [_sums(*map(np.concatenate, zip(*p, strict=True)))] for g, p in self.parts.items()}
            self.n = sum(len(p[0][0]) for p in self.parts.values())
            self.since = 0
        return self.n > HELD

    def take(self) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
        parts, self.parts, self.n, self.since = self.parts, {}, 0, 0
        for g, p in parts.items():
            yield g, *_sums(*map(np.concatenate, zip(*p, strict=True)))


def _rows(rows: list[tuple], schema: str = COUNTS) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    names, types = zip(*(c.split() for c in schema.split(", ")), strict=True)
    columns = zip(*rows, strict=True) if rows else ((),) * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, t in zip(columns, types, strict=True)], list(names))


def _split(group: str, code: np.ndarray, n: np.ndarray, to: np.ndarray) -> Iterator[tuple]:
    order = np.argsort(to, kind="stable")
    for part in np.split(order, np.flatnonzero(np.diff(to[order])) + 1) if len(order) else ():
        yield group, int(to[part[0]]), _pack(code[part], n[part])


def count_grams(docs: DataFrame, group: str = "grp", text: str = "text") -> tuple[DataFrame, int]:
    """(grp, cell, payload) with the counts of all n-grams of the texts of each group, a row a cell, and the number of cells.

    Rows of a null group are not counted. The counts meet by the n-gram's hash first, so that no frequent pair of symbols, and no
    group, brings the counts of all tasks into one.
    """
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cells = min(4096, max(16, 1 << (size_in_bytes(docs) >> 27).bit_length()))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Held()

        def out() -> pa.RecordBatch:
            return _rows([r for g, c, k in held.take() for r in _split(g, c, k, (mix(c.astype(np.uint64)) >> np.uint64(32)).astype(np.int64) % n)])

        for s in slices(batches):
            groups = s.rows.column(0).to_pylist()
            code, begins, _ = codes(s)
            names = sorted(set(groups))
            of = np.repeat(np.searchsorted(names, groups), np.diff(begins))
            for k, g in enumerate(names):
                if held.add(g, *np.unique(code[of == k] if len(names) > 1 else code, return_counts=True)):
                    yield out()
        yield out()

    def total(cell: int | None):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = _Held()
            for b in batches:
                for g, raw in zip(b.column(0).to_pylist(), b.column(2), strict=True):
                    if held.add(g, *_unpack(raw.as_py())) and cell:
                        yield _rows([r for g, c, k in held.take() for r in _split(g, c, k, cell_of(c, cell))])
            for g, c, k in held.take():
                yield _rows(list(_split(g, c, k, cell_of(c, cell or cells))))

        return run

    parts = docs.filter(F.col(group).isNotNull()).select(F.col(group).alias("grp"), F.col(text).alias("text")).mapInArrow(count, COUNTS)
    return parts.repartition(n, "cell").mapInArrow(total(cells), COUNTS).repartition(n, "grp", "cell").mapInArrow(total(None), COUNTS), cells


def _orders(code: np.ndarray, n: np.ndarray, least: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(order, n-grams, counts) from order 5 down to `least`; lower orders count the different symbols seen before the n-gram."""
    for order in range(ORDER, least - 1, -1):
        if order < ORDER:
            code, n = np.unique(code & (1 << BITS * order) - 1, return_counts=True)
        yield order, code, n.astype(np.int64)


def _spread(n: np.ndarray) -> np.ndarray:
    return np.array([(n == k).sum() for k in (1, 2, 3, 4)], np.int64)


def discounts(t: np.ndarray, modified: bool) -> np.ndarray:
    """What is cut from counts of one, two, and three or more, from how many n-grams have counts of one to four."""
    y = t[0] / (t[0] + 2 * t[1]) if t[0] else 0.5
    if not modified:
        return np.full(3, y)
    return np.array([min(max(k - (k + 1) * y * t[k] / t[k - 1], 0.05), k - 0.05) if t[k - 1] else y * k / 2 for k in (1, 2, 3)])


def _probabilities(code: np.ndarray, n: np.ndarray, t: np.ndarray, lower: np.ndarray, modified: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(probability of each n-gram's last symbol, contexts, back-off weight of each); n-grams sorted, lower: those of the n-grams without their first symbol."""
    d = discounts(t, modified)
    cut = d[np.minimum(n, 3) - 1]
    context = code >> BITS
    first = np.flatnonzero(np.diff(context, prepend=context[:1] - 1))
    size = np.diff(first, append=len(code))
    total, freed = np.add.reduceat(n, first), np.add.reduceat(cut, first)
    weight = freed / total
    return (n - cut) / np.repeat(total, size) + np.repeat(weight, size) * lower, context[first], weight


def _salt(group: str, order: int, context: bool) -> np.uint64:
    return np.uint64(xxhash.xxh3_64_intdigest(f"{order}{'c' if context else 'n'}{group}".encode()))


def _keys(code: np.ndarray, group: str, order: int, context: bool = False) -> np.ndarray:
    return mix(code.astype(np.uint64) ^ _salt(group, order, context))


def estimate(counts: DataFrame, cells: int, modified: bool) -> Model:
    """The models of all groups from count_grams: hashes of n-grams and of contexts with log probabilities and log weights, a file a cell.

    The file `low` of a group holds its orders 2 and 1, at most 4,096 * 4,097 n-grams.
    """
    folder = new_folder(counts.sparkSession, "charlm")
    n = int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def low(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each cell how many n-grams of orders 5, 4 and 3 have counts of one to four, and its order 2."""
        for b in batches:
            for g, raw in zip(b.column(0).to_pylist(), b.column(2), strict=True):
                levels = [*_orders(*_unpack(raw.as_py()), 2)]
                yield _rows([(g, 0, _pack(np.concatenate([_spread(k) for _, _, k in levels[:3]]), *levels[3][1:]))])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spread: dict[str, np.ndarray] = {}
        pairs = _Held()
        for b in batches:
            for g, raw in zip(b.column(0).to_pylist(), b.column(2), strict=True):
                t, code, k = _unpack(raw.as_py())
                spread[g] = spread.get(g, 0) + t
                pairs.add(g, code, k)
        for g, code, k in pairs.take():
            yield _rows([(g, 0, _pack(spread[g], code, k))])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for g, cell, raw, below in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3), strict=True):
                t, pairs, k2 = _unpack(below.as_py())
                ones, k1 = np.unique(pairs & SYMBOLS - 1, return_counts=True)
                p1, none, w1 = _probabilities(ones, k1, _spread(k1), np.full(len(ones), 1 / SYMBOLS), modified)
                p2, single, w2 = _probabilities(pairs, k2, _spread(k2), p1[np.searchsorted(ones, pairs & SYMBOLS - 1)], modified)
                grams, contexts = [], []
                if cell < 0:
                    grams = [(1, ones, p1), (2, pairs, p2)]
                    contexts = [(0, none, w1), (1, single, w2)]
                else:
                    code, k5 = _unpack(raw.as_py())
                    shorter, p = pairs, p2
                    for order, own, k in [*_orders(code, k5, 3)][::-1]:
                        p, ctx, w = _probabilities(own, k, t.reshape(3, 4)[ORDER - order], p[np.searchsorted(shorter, own & (1 << BITS * (order - 1)) - 1)], modified)
                        grams.append((order, own, p))
                        contexts.append((order - 1, ctx, w))
                        shorter = own
                keys = np.concatenate([*(_keys(c, g, o) for o, c, _ in grams), *(_keys(c, g, o, True) for o, c, _ in contexts)])
                values = np.log(np.concatenate([x for _, _, x in grams + contexts])).astype("<f4")
                order = np.argsort(keys)
                write_arrays(f"{folder}/{file_of(g, cell)}", key=keys[order].astype("<u8"), value=values[order])
                yield _rows([(g, cell, len(keys))], MODEL)

    below = counts.mapInArrow(low, COUNTS).repartition(n, "grp").mapInArrow(merge, COUNTS)
    below = durable(below.select("grp", F.col("payload").alias("below")))
    parts = counts.union(below.select("grp", F.lit(-1), F.lit(b"")))
    written = parts.join(below, "grp").select("grp", "cell", "payload", "below").mapInArrow(finish, MODEL).groupBy("grp").agg(F.sum("entries").alias("entries"))
    return Model(folder, cells, {r.grp: r.entries for r in written.collect()})  # one row a group


def file_of(group: str, cell: int) -> str:
    return f"{xxhash.xxh3_128_hexdigest(group.encode())}-{cell if cell >= 0 else 'low'}"


class Model:
    """Where the arrays of some groups lie, with the number of each one's entries; workers map them when they look into them."""

    def __init__(self, folder: str, cells: int, entries: dict[str, int]):
        self.folder, self.cells, self.entries = folder, cells, entries
        self._forget()

    def _forget(self) -> None:
        self.known: dict[tuple[str, ...], tuple[HashTable, np.ndarray]] = {}

    def __getstate__(self):
        return self.folder, self.cells, self.entries

    def __setstate__(self, state):
        self.folder, self.cells, self.entries = state
        self._forget()

    def _descend(self, out: np.ndarray, code: np.ndarray, left: np.ndarray, group: str, cell: int, orders: range) -> np.ndarray:
        """Adds what a file knows of the n-grams at `left`, from the longest order down; those that it does not end."""
        table = arrays(self.folder, file_of(group, cell))
        if not table:
            return left
        for order in orders:
            part = code[left] & (1 << BITS * order) - 1
            at, hit = look_up(table["key"], _keys(part, group, order))
            out[left[hit]] += table["value"][at[hit]]
            left, part = left[~hit], part[~hit]
            at, hit = look_up(table["key"], _keys(part >> BITS, group, order - 1, True))
            out[left[hit]] += table["value"][at[hit]]
        return left

    def log_prob(self, code: np.ndarray, group: str) -> np.ndarray:
        """The log probability of each n-gram's last symbol after the others."""
        out = np.zeros(len(code))
        cell = cell_of(code, self.cells)
        order = np.argsort(cell, kind="stable")
        cuts = np.flatnonzero(np.diff(cell[order])) + 1
        left = [self._descend(out, code, part, group, int(cell[part[0]]), range(ORDER, 2, -1)) for part in np.split(order, cuts) if len(part)]
        left = self._descend(out, code, np.concatenate(left) if left else order, group, -1, range(2, 0, -1))
        out[left] -= np.log(SYMBOLS)
        assert not len(out) or out.max() < 1e-3
        return out

    def log_probs(self, code: np.ndarray, groups: tuple[str, ...]) -> np.ndarray:
        """[character, group]: log_prob, with what was looked up kept for the next texts up to a bound."""
        if sum(x.size for _, x in self.known.values()) > KEPT:
            self._forget()
        table, values = self.known.get(groups) or (HashTable(), np.empty((0, len(groups)), np.float32))
        key = mix(code.astype(np.uint64) + np.uint64(1))
        at = table.find(key)
        if (new := np.flatnonzero(at < 0)).size:
            some = np.unique(code[new])
            table.add(mix(some.astype(np.uint64) + np.uint64(1)), np.arange(len(values), len(values) + len(some)))
            values = np.concatenate([values, np.stack([self.log_prob(some, g) for g in groups], axis=1).astype(np.float32)])
            at = table.find(key)
        self.known[groups] = table, values
        return values[at]


#: Groups whose log probabilities of a slice are held at once.
AT_ONCE = 8


def text_log_probs(model: Model, groups: list[str], code: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """[text, group]: summed log probabilities of each text under each group's model."""
    out = np.zeros((len(begins) - 1, len(groups)))
    for at in range(0, len(groups) if len(code) else 0, AT_ONCE):
        some = tuple(groups[at : at + AT_ONCE])
        sums = np.zeros((len(code) + 1, len(some)))
        np.cumsum(model.log_probs(code, some), axis=0, dtype=np.float64, out=sums[1:])
        out[:, at : at + len(some)] = sums[begins[1:]] - sums[begins[:-1]]
    return out


def own_log_probs(model: Model, groups: list[str | None], code: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Each text's summed log probability under the model of its own group; 0 where there is none."""
    out, length, of = np.zeros(len(groups)), np.diff(begins), np.array([g or "" for g in groups], object)
    for g in sorted(set(of.tolist()) & set(model.entries)):
        which = np.flatnonzero(of == g)
        part = code[fill(begins[:-1][which], length[which])]
        sums = np.concatenate([[0.0], np.cumsum(model.log_probs(part, (g,))[:, 0], dtype=np.float64)])
        ends = np.cumsum(length[which])
        out[which] = sums[ends] - sums[ends - length[which]]
    return out
