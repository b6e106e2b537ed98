"""Byte-level dedup by sparse suffix arrays with deep-shallow sorting.

Every window of `window` bytes has a minimiser: the position of the least hash among its `gram`-byte substrings, so equal windows
have it at the same place and about one position in 80 has to be looked at. Positions whose gram occurs once settle all their
windows. The others send their context (the bytes of all windows they are the minimiser of) to the gram's task, which sorts the
suffixes that begin there, and the reversed prefixes that end there, by deep-shallow sorting: multikey quicksort over eight-byte
characters to a shallow depth, then blind tries for the groups that still agree. With both common-prefix arrays, a window with d bytes
before the minimiser starts elsewhere exactly if some other context shares d bytes to the left and window - d to the right: for each
d these are the cells of two partitions of the contexts, counted at once, without pairs. These comparisons are of bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import marks
from .textkit import SLICE, Slice, Windows, fill, mix, range_hashes, slices

GRAM = 32
_CHUNK = 1 << 23


def least_in_windows(h: np.ndarray, width: int) -> np.ndarray:
    """For each run of `width` values, the position of the least (by the upper 40 bits; the leftmost of equals)."""
    n = len(h) - width + 1
    out = np.empty(max(n, 0), np.int64)
    for at in range(0, n, _CHUNK):
        part = h[at : min(at + _CHUNK + width - 1, len(h))] & np.uint64(0xFFFFFFFFFF000000)
        part |= np.arange(len(part), dtype=np.uint64)
        size = 1
        while size * 2 <= width:
            part = np.minimum(part[:-size], part[size:])
            size *= 2
        rest = width - size
        part = np.minimum(part[: len(part) - rest], part[rest:]) if rest else part
        out[at : at + len(part)] = (part & np.uint64(0xFFFFFF)).astype(np.int64) + at
    return out


class Minimisers:
    """The minimisers of a slice: gram at `pos`, minimiser of the windows that start at lo..hi, with its document."""

    def __init__(self, s: Slice, window: int, gram: int):
        n = len(s.data)
        self.doc = self.pos = self.lo = self.hi = np.empty(0, np.int64)
        self.hash = np.empty(0, np.uint64)
        if n < window:
            return
        h = Windows.of_bytes(s.data).of(gram)
        least = least_in_windows(h, window - gram + 1)
        doc = np.repeat(np.arange(len(s)), np.diff(s.off))
        at = np.flatnonzero(np.arange(len(least)) + window <= s.off[doc[: len(least)] + 1])
        if not len(at):
            return
        pos = least[at]
        new = np.ones(len(at), bool)
        new[1:] = pos[1:] != pos[:-1]
        first = np.flatnonzero(new)
        self.pos, self.lo, self.hi = pos[first], at[first], at[np.append(first[1:], len(at)) - 1]
        self.doc, self.hash = doc[self.pos], h[self.pos]


def _common(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    lo, hi = 0, n
    while hi - lo > 1:
        mid = (lo + hi) >> 1
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid
    return lo


class Strings:
    """Byte strings inside one buffer: string k is data[start[k]], data[start[k] + step], .. of length[k] bytes, step 1 or -1."""

    def __init__(self, data: np.ndarray, start: np.ndarray, length: np.ndarray, step: int):
        self.data, self.start, self.length, self.step = data, start, length, step

    def __len__(self) -> int:
        return len(self.start)

    def word(self, which: np.ndarray, depth: np.ndarray | int) -> np.ndarray:
        """Eight bytes from `depth` on as a big-endian number, zeros behind the end."""
        place = np.asarray(depth)[..., None] + np.arange(8)
        at = self.start[which][:, None] + self.step * place
        there = place < self.length[which][:, None]
        got = np.where(there, self.data[np.where(there, at, 0)], np.uint8(0))
        return np.ascontiguousarray(got).view(">u8")[:, 0].astype(np.uint64)

    def text(self, k: int) -> bytes:
        a, n = int(self.start[k]), int(self.length[k])
        part = self.data[a : a + n] if self.step > 0 else self.data[a - n + 1 : a + 1][::-1]
        return part.tobytes()


def blind_trie_order(strings: Strings, members: list[int]) -> list[int]:
    """members, sorted by their strings, from a blind trie: inner nodes keep only a depth and the branching bytes.

    A node is [depth, {byte or -1 for an end: child}], a leaf a list of members with equal strings under the key None.
    """
    text = {m: strings.text(m) for m in members}
    root: list = [None, [members[0]]]
    for m in members[1:]:
        s, node = text[m], root
        while node[0] is not None:  # descend blindly: any child where the byte is missing
            node = node[1].get(s[node[0]] if node[0] < len(s) else -1) or next(iter(node[1].values()))
        other = text[node[1][0]]
        common = _common(s, other)
        if common == len(s) == len(other):
            node[1].append(m)
            continue
        node = root
        while node[0] is not None and node[0] < common:
            node = node[1][s[node[0]]]
        mine, byte = [None, [m]], s[common] if common < len(s) else -1
        if node[0] == common:
            node[1][byte] = mine
        else:
            was = [*node]
            node[:] = [common, {byte: mine, (other[common] if common < len(other) else -1): was}]
    out: list[int] = []
    stack = [root]
    while stack:
        node = stack.pop()
        if node[0] is None:
            out += node[1]
        else:
            stack += [node[1][c] for c in sorted(node[1], reverse=True)]
    return out


def deep_shallow_order(strings: Strings, shallow: int = 48) -> np.ndarray:
    """The positions of the strings in sorted order: multikey quicksort by eight-byte characters down to `shallow`, blind tries below."""
    n = len(strings)
    everyone = np.arange(n)
    word = strings.word(everyone, 0)
    order = np.argsort(word, kind="stable")
    word = word[order]
    new = np.ones(n, bool)
    new[1:] = word[1:] != word[:-1]
    for depth in range(8, shallow, 8):
        group = np.cumsum(new)
        busy = np.flatnonzero(np.bincount(group)[group] > 1)
        if not len(busy):
            return order
        part = order[busy]
        word = strings.word(part, depth)
        to = np.lexsort((word, group[busy]))
        order[busy] = part[to]
        word, group = word[to], group[busy]
        new[busy[1:]] |= word[1:] != word[:-1]
        new[busy[1:][group[1:] != group[:-1]]] = True
    first = np.flatnonzero(new)
    size = np.diff(first, append=n)
    for at, k in zip(first[size > 1].tolist(), size[size > 1].tolist(), strict=True):
        order[at : at + k] = blind_trie_order(strings, order[at : at + k].tolist())
    return order


def common_prefixes(strings: Strings, order: np.ndarray, most: int) -> np.ndarray:
    """For each place in the order, the bytes (at most `most`) shared with the one before; 0 at the first."""
    out = np.zeros(len(order), np.int64)
    left = np.arange(1, len(order))
    for depth in range(0, most, 8):
        differ = strings.word(order[left - 1], depth) ^ strings.word(order[left], depth)
        same = differ == 0
        out[left[same]] = depth + 8
        raw = differ[~same].astype(">u8").view(np.uint8).reshape(-1, 8)
        out[left[~same]] = depth + (raw != 0).argmax(axis=1)
        left = left[same]
        if not len(left):
            break
    shorter = np.minimum(strings.length[order[1:]], strings.length[order[:-1]])
    out[1:] = np.minimum(out[1:], np.minimum(shorter, most))
    return out


def _gather(data: np.ndarray, start: np.ndarray, length: np.ndarray, step: int = 2048) -> np.ndarray:
    """The bytes of many ranges in a row; `step` ranges at a time, for their indexes take eight times the bytes."""
    parts = [data[fill(start[k : k + step], length[k : k + step])] for k in range(0, len(start), step)]
    return np.concatenate(parts) if parts else data[:0]


class Contexts:
    """Contexts of a task: the bytes of all windows of one minimiser, `before` of them in front of it, in one buffer."""

    def __init__(self, key: np.ndarray, lo: np.ndarray, before: np.ndarray, many: np.ndarray, length: np.ndarray, data: np.ndarray):
        self.key, self.lo, self.before, self.many, self.length, self.data = key, lo, before, many, length, data
        self.start = np.cumsum(length) - length

    @classmethod
    def unpack(cls, raw: bytes) -> Contexts:
        n = int(np.frombuffer(raw, "<u4", 1)[0])
        at, cols = 4, []
        for kind in ("<i8", "<u4", "<u2", "u1", "<u4"):
            cols.append(np.frombuffer(raw, kind, n, at).astype(np.int64))
            at += np.dtype(kind).itemsize * n
        return cls(*cols[:3], cols[3].astype(bool), cols[4], np.frombuffer(raw, np.uint8, -1, at))

    def pack(self) -> bytes:
        head = np.uint32(len(self.key)).tobytes()
        cols = ((self.key, "<i8"), (self.lo, "<u4"), (self.before, "<u2"), (self.many, "u1"), (self.length, "<u4"))
        return b"".join([head, *(c.astype(kind).tobytes() for c, kind in cols), self.data.tobytes()])

    @classmethod
    def join(cls, parts: list[Contexts]) -> Contexts:
        return cls(*(np.concatenate(c) for c in zip(*((p.key, p.lo, p.before, p.many, p.length, p.data) for p in parts), strict=True)))

    def take(self, which: np.ndarray) -> Contexts:
        return Contexts(self.key[which], self.lo[which], self.before[which], self.many[which], self.length[which], _gather(self.data, self.start[which], self.length[which]))

    def hashes(self) -> np.ndarray:
        """Of each whole context with its place of the minimiser."""
        return mix(range_hashes(self.data, self.start, self.start + self.length) + self.before.astype(np.uint64))

    def windows(self, width: int, at: np.ndarray) -> np.ndarray:
        """The hashes of windows of the buffer."""
        return Windows.of_bytes(self.data).of(width)[at]

    def same(self, a: int, b: int) -> bool:
        x, y, n = int(self.start[a]), int(self.start[b]), int(self.length[a])
        return self.before[a] == self.before[b] and n == self.length[b] and self.data[x : x + n].tobytes() == self.data[y : y + n].tobytes()

    def leaders(self, hashes: np.ndarray) -> np.ndarray:
        """For each context the first equal one, compared byte by byte."""
        order = np.argsort(hashes, kind="stable")
        h, lead = hashes[order], np.arange(len(hashes))
        for k in np.flatnonzero(h[1:] == h[:-1]).tolist():
            a, b = lead[order[k]], order[k + 1]
            if self.same(a, b):
                lead[b] = a
        return lead


def repeated_windows(c: Contexts, window: int) -> np.ndarray:
    """c: different contexts. [context, d]: whether the window with d bytes before the minimiser is one of another context too."""
    n = len(c.key)
    right = Strings(c.data, c.start + c.before, c.length - c.before, 1)
    left = Strings(c.data, c.start + c.before - 1, c.before, -1)
    least = c.before - (c.length - window)
    order_r, order_l = deep_shallow_order(right), deep_shallow_order(left)
    lcp, lcs = common_prefixes(right, order_r, window), common_prefixes(left, order_l, window)
    out = np.zeros((n, int(c.before.max()) + 1), bool)
    cell_r, cell_l = np.empty(n, np.int64), np.empty(n, np.int64)
    for d in range(out.shape[1]):
        has = np.flatnonzero((c.before >= d) & (least <= d))
        if len(has) < 2:
            continue
        cell_r[order_r], cell_l[order_l] = np.cumsum(lcp < window - d), np.cumsum(lcs < d)
        cell = cell_r[has] * (n + 1) + cell_l[has]
        order = np.argsort(cell)
        same = cell[order][1:] == cell[order][:-1]
        again = np.zeros(len(has), bool)
        again[order[1:][same]] = True
        again[order[:-1][same]] = True
        out[has[again], d] = True
    return out


def _pack_runs(key: np.ndarray, start: np.ndarray, n: np.ndarray) -> bytes:
    return key.astype("<i8").tobytes() + start.astype("<u4").tobytes() + n.astype("<u4").tobytes()


def _unpack_runs(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = len(raw) // 16
    return np.frombuffer(raw, "<i8", n), np.frombuffer(raw, "<u4", n, 8 * n).astype(np.int64), np.frombuffer(raw, "<u4", n, 12 * n).astype(np.int64)


class _Runs:
    """A bucket's runs of repeated window starts, looked up for a slice."""

    def __init__(self, table: pa.Table):
        parts = [_unpack_runs(x.as_py()) for x in table.column("payload")]
        cols = [np.concatenate(x) for x in zip(*parts, strict=True)] if parts else [np.empty(0, np.int64)] * 3
        order = np.argsort(cols[0], kind="stable")
        self.key, self.start, self.n = (c[order] for c in cols)

    def of(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        lo, hi = np.searchsorted(self.key, keys, "left"), np.searchsorted(self.key, keys, "right")
        at = fill(lo, hi - lo)
        return np.repeat(np.arange(len(keys)), hi - lo), self.start[at], self.n[at]


def remove_repeated_bytes(docs: DataFrame, *, window: int = 200, gram: int = GRAM, hot_gram: int = 1 << 16, with_bytes: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256[, kept]): bytes covered by a window that also starts anywhere else.

    docs: doc_id, text; other columns are ignored. Texts are UTF-8 bytes; null and empty ones have none. Matches never cross
    documents. A row repeated with the same id and text counts as a document of its own, but travels once, with a count; rows of one
    id with different texts are different documents. An empty table gives an empty result. with_bytes adds the remaining bytes, which need not be UTF-8.
    A task holds the different contexts of its grams, at most hot_gram of each gram; the windows of a gram that has more are found by
    64-bit hashes, a row each, in one more round.
    """
    rows, text_bytes = marks.distinct_rows(docs)
    router = marks.router_for(docs.sparkSession, text_bytes)

    def anchors(s: Slice, keys: np.ndarray, copied: np.ndarray) -> list[tuple]:
        m = Minimisers(s, window, gram)
        return router.candidates(keys[m.doc], m.pos - s.off[m.doc], m.hash, copied[m.doc])

    def runs(key: np.ndarray, start: np.ndarray, n: np.ndarray) -> list[tuple]:
        return list(router._rows(np.mod(key, router.n), marks.RUNS, lambda i: _pack_runs(key[i], start[i], n[i])))

    def single(key: np.ndarray, start: np.ndarray) -> list[tuple]:
        return runs(key, start, np.ones(len(key), np.int64))

    def contexts(s: Slice, rows: np.ndarray, places: np.ndarray) -> pa.RecordBatch:
        m = Minimisers(s, window, gram)
        take = np.flatnonzero(np.isin(m.pos, s.off[rows] + places))
        if not len(take):
            return marks.batch([])
        doc, lo, length = m.doc[take], m.lo[take], m.hi[take] + window - m.lo[take]
        c = Contexts(s.column("k")[doc], lo - s.off[doc], m.pos[take] - lo, np.zeros(len(take), bool), length, _gather(s.data, lo, length))
        lead = c.leaders(c.hashes())
        c.many = np.bincount(lead, np.where(s.column("copies")[doc] > 1, 2, 1), len(lead))[lead] > 1
        out = runs(c.key[c.many], c.lo[c.many], (length - window + 1)[c.many])
        one = np.unique(lead)
        out += router._rows(router.place(m.hash[take][one]), marks.CANDIDATES, lambda i: c.take(one[i]).pack())
        return marks.batch(out)

    def windows(c: Contexts) -> list[tuple]:
        """Rows of all windows of the contexts by their hash."""
        if not len(c.key):
            return []
        n = c.length - window + 1
        at = fill(c.start, n)
        order = np.lexsort((fill(c.lo, n), np.repeat(c.key, n)))
        return router.candidates(np.repeat(c.key, n)[order], fill(c.lo, n)[order], c.windows(window, at)[order])

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[Contexts] = []
        hashes: list[np.ndarray] = []
        grams: list[np.ndarray] = []
        met: dict[int, int] = {}
        for b in batches:
            for bucket, kind, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                if kind == marks.RUNS:
                    yield marks.batch([(bucket, kind, raw.as_py())])
                    continue
                c = Contexts.unpack(raw.as_py())
                whole, g = c.hashes(), c.windows(gram, c.start + c.before)
                for x, k in zip(*np.unique(g, return_counts=True), strict=True):
                    met[int(x)] = met.get(int(x), 0) + int(k)
                hot = np.array([met[x] > hot_gram for x in g.tolist()], bool)
                if hot.any():
                    yield marks.batch(windows(c.take(np.flatnonzero(hot))))
                    c, whole, g = c.take(np.flatnonzero(~hot)), whole[~hot], g[~hot]
                held.append(c)
                hashes.append(whole)
                grams.append(g)
        if not held:
            return
        c, h, g = Contexts.join(held), np.concatenate(hashes), np.concatenate(grams)
        held.clear()
        if turned := [x for x, k in met.items() if k > hot_gram]:
            late = np.isin(g, np.array(turned, np.uint64))
            for part in np.array_split(np.flatnonzero(late), 1 + late.sum() // 4096):
                yield marks.batch(windows(c.take(part)))
            c, h = c.take(np.flatnonzero(~late)), h[~late]
        if not len(c.key):
            return
        lead = c.leaders(h)
        many = np.bincount(lead, minlength=len(lead)) > 1
        tell = many[lead] & ~c.many
        yield marks.batch(runs(c.key[tell], c.lo[tell], (c.length - window + 1)[tell]))
        one = np.unique(lead)
        told = (many | c.many)[one]
        c = c.take(one)
        again = repeated_windows(c, window)
        again[told] = False  # told as a whole already
        edge = np.diff(np.pad(again, ((0, 0), (1, 1))).astype(np.int8), axis=1)
        who, since = np.nonzero(edge == 1)
        until = np.nonzero(edge == -1)[1]
        # Windows with since..until-1 bytes before the minimiser start at its place minus these.
        yield marks.batch(runs(c.key[who], c.lo[who] + c.before[who] - until + 1, until - since))

    def of_documents(left: pa.Table, right: pa.Table) -> Iterator[tuple]:
        found = _Runs(right)
        for s in slices(iter(left.combine_chunks().to_batches())):
            yield s, *found.of(s.column("k"))

    def cut(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for s, rows, start, n in of_documents(left, right):
            edges = np.zeros(len(s.data) + 1, np.int64)
            at = s.off[rows] + start
            np.add.at(edges, at, 1)
            np.add.at(edges, at + n + window - 1, -1)
            gone = np.cumsum(edges[:-1]) > 0
            begins = gone.copy()
            begins[1:] &= ~gone[:-1]
            ahead = s.off[1:-1][s.off[1:-1] < len(gone)]
            begins[ahead] = gone[ahead]
            count = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[s.off])
            kept, size = s.data[~gone].tobytes(), np.concatenate([[0], np.cumsum(~gone)])[s.off].tolist()
            texts = [kept[a:b] for a, b in zip(size[:-1], size[1:], strict=True)]
            arrays = [s.rows.column(2), s.rows.column(4), pa.array(np.diff(s.off)), pa.array(count(gone)), pa.array(count(begins)), pa.array([hashlib.sha256(t).hexdigest() for t in texts])]
            out.append(pa.RecordBatch.from_arrays(arrays + ([pa.array(texts, pa.binary())] if with_bytes else []), names))
        return pa.Table.from_batches(out, arrow_schema)

    names = ["doc_id", "copies", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * with_bytes
    arrow_schema = pa.schema(zip(names, [pa.int64()] * 5 + [pa.string(), pa.binary()], strict=False))
    schema = "doc_id long, copies long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_bytes
    dealt = marks.dealt(rows, router)
    found = marks.find(marks.scan(rows, anchors, SLICE), router)
    found = marks.with_told(dealt, found, contexts, marks.SCHEMA, SLICE).repartition(router.n, "bucket").mapInArrow(settle, marks.SCHEMA)
    found = marks.find(found, router, single)
    return marks.repeated_out(dealt.groupBy("bucket").cogroup(found.groupBy("bucket")).applyInArrow(cut, schema))
