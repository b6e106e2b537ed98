"""Vectorised work on the bytes of many texts at once: words, rolling hashes, hash tables.

Texts come as Arrow batches and are worked on in slices of about 1 MB, so memory is bounded by the slice (or the one text that is
longer). Every word, shingle or window of a slice is hashed with a few array operations: short byte ranges in lanes of eight bytes,
windows by doubling; each step scrambles, so there is no algebra by which different content could cancel out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import SparkSession

SLICE = 1 << 20
U = np.uint64
ODD, SEED, SEED2 = U(0x9E3779B97F4A7C15), U(0x243F6A8885A308D3), U(0x13198A2E03707344)
#: Byte ranges up to so many eight-byte lanes are hashed all at once, longer ones by XXH3 one by one.
LANES = 8
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], U)
#: Space, tab, line feed, vertical tab, form feed, carriage return.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    h = h ^ (h >> U(31))
    h *= U(0x7FB5D329728EA185)
    h ^= h >> U(27)
    h *= U(0x81DADEF4BC2DD44D)
    h ^= h >> U(33)
    return h


def _lanes(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as a number, zeros behind the end."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    return np.ndarray((len(data) + 1,), "<u8", padded, 0, (1,))


def range_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: np.uint64 = SEED) -> np.ndarray:
    """A 64-bit hash of each byte range of data: lanes of eight bytes, scrambled one after another with the length."""
    length = end - start
    h = mix(length.astype(U) + seed)
    lanes = _lanes(data)
    live = np.flatnonzero((length > 0) & (length <= 8 * LANES))
    for k in range(LANES):
        if k:
            live = live[length[live] > 8 * k]
        if not len(live):
            break
        lane = lanes[start[live] + 8 * k] & _MASK[np.minimum(length[live] - 8 * k, 8)]
        h[live] = mix(h[live] ^ lane)
    if len(long := np.flatnonzero(length > 8 * LANES)):
        raw = memoryview(np.ascontiguousarray(data))
        h[long] = [xxhash.xxh3_64_intdigest(raw[a:b], int(seed)) for a, b in zip(start[long].tolist(), end[long].tolist(), strict=True)]
    return h


def _join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The hash of two neighbouring parts from theirs."""
    h = a * ODD
    h ^= h >> U(32)
    h += b
    h *= U(0xD6E8FEB86659FD93)
    h ^= h >> U(29)
    return h


class Windows:
    """Hashes of all windows of a sequence, of any width: those of 2w from two of w each. No window's hash is a sum over its members,
    so rearranged or periodic content does not cancel out."""

    def __init__(self, codes: np.ndarray):
        self.n, self.unit, self.levels = len(codes), 1, {1: codes}

    @classmethod
    def of_bytes(cls, data: np.ndarray) -> Windows:
        """Windows of bytes, with eight of them as the least level."""
        w = cls(_lanes(data)[: len(data)])
        w.unit, w.levels = 8, {8: w.levels[1]}
        return w

    def _level(self, width: int) -> np.ndarray:
        if width not in self.levels:
            half = self._level(width // 2)
            self.levels[width] = _join(half[: max(len(half) - width // 2, 0)], half[width // 2 :])
        return self.levels[width]

    def of(self, width: int) -> np.ndarray:
        """The hash of the window that begins at each of the n - width + 1 places."""
        n = self.n - width + 1
        if n <= 0:
            return np.empty(0, U)
        at, out = 0, None
        while at < width:
            left = width - at
            if left < self.unit:
                part = self.levels[self.unit][at : at + n] & _MASK[left]
                size = left
            else:
                size = self.unit * (1 << (left // self.unit).bit_length() - 1)
                part = self._level(size)[at : at + n]
            out = part if out is None else _join(out, part)
            at += size
        return mix(out + U(width))


def quoted(name: str) -> str:
    """A column's name for F.col, whatever it holds."""
    return "`" + name.replace("`", "``") + "`"


def small_batches(spark: SparkSession, rows: int = 1000, size: int = 8 << 20) -> None:
    """Arrow batches of at most so many rows and bytes in this session, where it has Spark's defaults: a batch of texts is held by the JVM and by the worker."""
    for key, usual, ours in (("maxRecordsPerBatch", "10000", rows), ("maxBytesPerBatch", "67108864b", size)):
        if spark.conf.get(f"spark.sql.execution.arrow.{key}", usual) == usual:
            spark.conf.set(f"spark.sql.execution.arrow.{key}", str(ours))


class Slice:
    """Some whole texts: bytes `data`, text k at off[k]:off[k+1], and the rows they came from."""

    def __init__(self, texts: pa.Array, rows: pa.RecordBatch):
        self.rows, self.texts = rows, texts
        off = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, texts.offset * 4) if len(texts) else np.zeros(1, np.int32)
        raw = texts.buffers()[2] if len(texts) else None
        self.data = np.frombuffer(raw, np.uint8)[off[0] : off[-1]] if raw is not None and off[-1] > off[0] else np.empty(0, np.uint8)
        self.off = off.astype(np.int64) - int(off[0])

    def __len__(self) -> int:
        return len(self.texts)

    def column(self, name: str) -> np.ndarray:
        return self.rows.column(self.rows.schema.get_field_index(name)).to_numpy(zero_copy_only=False)

    def words(self, data: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of the maximal runs of other bytes than ASCII spaces, and the first word of each text (one more at the end)."""
        data = self.data if data is None else data
        n = len(data)
        if not n:
            return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(self) + 1, np.int64)
        solid = ~IS_SPACE[data]
        edge = np.zeros(n + 1, bool)
        edge[self.off] = True
        start = solid.copy()
        start[1:] &= ~solid[:-1] | edge[1:-1]
        end = solid.copy()
        end[:-1] &= ~solid[1:] | edge[1:-1]
        starts = np.flatnonzero(start)
        return starts, np.flatnonzero(end) + 1, np.searchsorted(starts, self.off)


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", size: int = SLICE) -> Iterator[Slice]:
    """The rows of the batches, cut into slices of about `size` bytes of text; null texts are empty."""
    for batch in batches:
        if not batch.num_rows:
            continue
        texts = batch.column(batch.schema.get_field_index(column))
        texts = pc.fill_null(texts.cast(pa.string()), "")
        length = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
        total, at = np.cumsum(length), 0
        while at < len(texts):
            to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + size, "right")))
            yield Slice(texts.slice(at, to - at), batch.slice(at, to - at))
            at = to


def owner(first: np.ndarray, n: int) -> np.ndarray:
    """For n items of which text k has first[k]:first[k+1], the text of each."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))[:n]


def per_text(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of values over each text's range first[k]:first[k+1]."""
    sums = np.zeros(len(values) + 1, values.dtype if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, out=sums[1:])
    return sums[first[1:]] - sums[first[:-1]]


def fill(offset: np.ndarray, length: np.ndarray) -> np.ndarray:
    """offset[0], offset[0]+1, .. (length[0] of them), offset[1], .."""
    ends = np.cumsum(length)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(offset - (ends - length), length)


class HashTable:
    """Non-zero 64-bit keys to small integers, by open addressing; lookups and inserts take whole arrays."""

    def __init__(self, bits: int = 16):
        self._clear(bits)

    def _clear(self, bits: int) -> None:
        self.bits, self.n = bits, 0
        self.keys = np.zeros(1 << bits, U)
        self.values = np.zeros(1 << bits, np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The value of each key, -1 where there is none."""
        out = np.full(len(keys), -1, np.int64)
        slot = (keys >> U(64 - self.bits)).astype(np.int64)
        there = self.keys[slot]
        hit = there == keys
        out[hit] = self.values[slot[hit]]
        left = np.flatnonzero(~hit & (there != 0))
        while len(left):
            at = (slot[left] + 1) & ((1 << self.bits) - 1)
            slot[left] = at
            there = self.keys[at]
            hit = there == keys[left]
            out[left[hit]] = self.values[at[hit]]
            left = left[~hit & (there != 0)]
        return out

    def add(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Insert different keys that are not there yet."""
        if (self.n + len(keys)) * 2 > 1 << self.bits:
            old = np.flatnonzero(self.keys)
            k, v, bits = self.keys[old], self.values[old], self.bits
            while (len(k) + len(keys)) * 2 > 1 << bits:
                bits += 1
            self._clear(bits)
            self.add(k, v)
        self.n += len(keys)
        slot, left = (keys >> U(64 - self.bits)).astype(np.int64), np.arange(len(keys))
        while len(left):
            at = slot[left]
            free = self.keys[at] == 0
            self.keys[at[free]] = keys[left[free]]
            mine = free & (self.keys[at] == keys[left])
            self.values[at[mine]] = values[left[mine]]
            left = left[~mine]
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)
