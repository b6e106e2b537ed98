"""Hierarchical multi-length packing of tokenised documents into training sequences.

Documents are routed to the smallest window size (tier) that holds them; what is longer is cut into windows of the largest size and a
rest. Tiers are packed from the largest down: a window opens with its tier's longest document, and its gap is filled from its own and
the shorter tiers, by one document that fits exactly, else by two that do, else by the longest that fits and so on. A reserve of documents is held
back between blocks, so that there are many to choose from. Only where nothing fits is a document cut, the longest there is.
Every sequence is full; the last documents of a task become sequences of powers of two. All of it happens where the text is
tokenised: there is no shuffle, and a task holds one block of documents and the reserve at a time.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

from .textkit import slices
from .tokens import encoder

TIERS = (512, 1024, 2048, 4096)
#: Documents that may open a window before one is cut.
TRIES = 16
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, step_group long"


class Packer:
    """Packs items (document, start, length) into full windows; what doesn't fill one waits for the next call."""

    def __init__(self, tiers: tuple[int, ...] = TIERS):
        self.tiers, self.top = sorted(tiers), max(tiers)
        self.by_length: list[list[tuple[int, int]]] = [[] for _ in range(self.top + 1)]
        self.have = np.zeros(self.top + 1, bool)
        self.tokens = 0

    def add(self, doc: int, length: int, out: list) -> None:
        """Route a document to its tier; whole windows of the largest one go to `out` at once."""
        start = 0
        while length - start >= self.top:
            out.append((self.top, [(doc, start, self.top)]))
            start += self.top
        self._put(doc, start, length - start)

    def _put(self, doc: int, start: int, length: int) -> None:
        if length:
            self.by_length[length].append((doc, start))
            self.have[length] = True
            self.tokens += length

    def _take(self, length: int) -> tuple[int, int, int]:
        doc, start = self.by_length[length].pop()
        self.have[length] = bool(self.by_length[length])
        self.tokens -= length
        return doc, start, length

    def _longest(self, low: int, high: int) -> int:
        """The longest length in low+1..high, 0 if there is none."""
        at = self.have[low + 1 : high + 1][::-1].argmax() if high > low else 0
        return high - int(at) if high > low and self.have[high - at] else 0

    def _pair(self, gap: int) -> int:
        """The longer of two lengths that fill the gap, 0 if there are none."""
        half = self.have[1:gap] & self.have[gap - 1 : 0 : -1]
        for a in np.flatnonzero(half)[::-1].tolist():
            a += 1
            if 2 * a != gap or len(self.by_length[a]) > 1:
                return a
        return 0

    def _window(self, size: int, first: int, cut: bool) -> list[tuple[int, int, int]] | None:
        """A full window that opens with a document of `first` tokens; None where that needs a cut which is not wanted."""
        pieces, gap = [self._take(first)], size - first
        while gap:
            if self.have[gap]:
                pieces.append(self._take(gap))
                break
            if a := self._pair(gap):
                pieces += [self._take(a), self._take(gap - a)]
                break
            if length := self._longest(0, gap):
                pieces.append(self._take(length))
                gap -= length
            elif cut:
                doc, start, length = self._take(self._longest(gap, self.top))
                pieces.append((doc, start, gap))
                self._put(doc, start + gap, length - gap)
                break
            else:
                for doc, start, length in pieces:
                    self._put(doc, start, length)
                return None
        return pieces

    def pack(self, out: list, reserve: int = 0) -> None:
        """Full windows to `out`, tier by tier, until no more than `reserve` tokens are left; documents are cut only while four times that are."""
        for cut in (False, True):
            for low, tier in [*zip([0, *self.tiers[:-1]], self.tiers, strict=True)][::-1]:
                while self.tokens >= max(tier, 4 * reserve if cut else reserve) and self._open(low, tier, cut, out):
                    pass
            if not reserve:
                break

    def _open(self, low: int, tier: int, cut: bool, out: list) -> bool:
        """One more window of a tier to `out`, if there can be."""
        lengths = (np.flatnonzero(self.have[low + 1 : tier + 1])[::-1] + low + 1).tolist()
        for first in lengths[:: -(-len(lengths) // TRIES) or 1]:
            if made := self._window(tier, first, cut):
                out.append((tier, made))
                return True
        return False

    def finish(self, out: list) -> None:
        """Everything to `out`: what fills no window without a cut goes to windows of powers of two."""
        self.pack(out)
        while self.tokens:
            size = min(1 << (self.tokens.bit_length() - 1), self.top)
            if longest := self._longest(0, size):
                out.append((size, self._window(size, longest, True)))
            else:  # only longer ones are left
                doc, start, length = self._take(self._longest(0, self.top))
                out.append((size, [(doc, start, size)]))
                self._put(doc, start + size, length - size)


def step_groups(windows: list[list[int]], tokens: int, wide: int = max(TIERS)) -> list[int]:
    """Groups of about `tokens` tokens with like cost, of windows given as the lengths of their pieces: a piece of n tokens costs
    n * (n + wide), for attention and the rest; the costliest window left goes to the cheapest group."""
    n = max(1, -(-sum(map(sum, windows)) // tokens))
    cost = [sum(k * (k + wide) for k in w) for w in windows]
    load, out = [(0, g) for g in range(n)], [0] * len(windows)
    for k in sorted(range(len(windows)), key=lambda k: -cost[k]):
        total, group = load[0]
        heapq.heapreplace(load, (total + cost[k], group))
        out[k] = group
    return out


def pack_documents(docs: DataFrame, tokenizer: str, *, spaces_inside: bool = False, end_id: int = 2, tiers: tuple[int, ...] = TIERS, block_tokens: int = 2_000_000, reserve: int = 200_000, group_tokens: int = 1 << 17, with_ids: bool = False) -> DataFrame:
    """Pieces of all documents packed into sequences. docs: doc_id, text; other columns are ignored.

    tokenizer: a file of the tokenizers library. Null and empty texts are the end id alone; repeated rows are packed each; an empty
    table gives an empty result; doc_id may have any type. sequence_id is unique over all tasks; step_group numbers balanced groups of a task's block.
    with_ids adds the pieces' ids (array<int>).
    """
    rest = _parse_datatype_string(SCHEMA + (", ids array<int>" if with_ids else "")).fields[1:]
    schema = StructType([StructField("doc_id", docs.schema["doc_id"].dataType), *rest])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer, spaces_inside)
        base = TaskContext.get().partitionId() << 33
        packer, made, groups = Packer(tiers), 0, 0
        held: dict[int, tuple] = {}
        fresh = 0

        def flush(out: list) -> pa.RecordBatch:
            nonlocal made, groups
            of = step_groups([[n for _, _, n in pieces] for _, pieces in out], group_tokens)
            cols: list[list] = [[] for _ in range(10)]
            for (tier, pieces), group in zip(out, of, strict=True):
                offset = 0
                for doc, start, length in pieces:
                    doc_id, ids = held[doc][:2]
                    part = ids[start : start + length]
                    for c, v in zip(cols, (doc_id, start, length, zlib.crc32(part), len(ids), base + made, offset, tier, base + groups + group, part), strict=True):
                        c.append(v)
                    offset += length
                    held[doc][2][0] -= length
                    if not held[doc][2][0]:
                        del held[doc]
                made += 1
            groups += max(of, default=-1) + 1
            types = [id_type, *[pa.int64()] * 6, pa.int32(), pa.int64()]
            arrays = [pa.array(c, t) for c, t in zip(cols, types, strict=False)]
            names = [x.split()[0] for x in SCHEMA.split(", ")]
            if with_ids:
                arrays.append(pa.array([p.astype(np.int32) for p in cols[9]], pa.list_(pa.int32())))
                names.append("ids")
            return pa.RecordBatch.from_arrays(arrays, names)

        out: list = []
        number = 0
        id_type = pa.int64()
        for s in slices(batches):
            id_type = s.rows.schema.field(0).type
            ids, first = encode.ids_with_end(s, end_id)
            for k, doc_id in enumerate(s.rows.column(0).to_pylist()):
                held[number] = (doc_id, ids[first[k] : first[k + 1]], [int(first[k + 1] - first[k])])
                packer.add(number, int(first[k + 1] - first[k]), out)
                number += 1
            fresh += len(ids)
            if fresh >= block_tokens:
                packer.pack(out, reserve)
                yield flush(out)
                out, fresh = [], 0
        packer.finish(out)
        if out:
            yield flush(out)

    return docs.select("doc_id", "text").mapInArrow(run, schema)
