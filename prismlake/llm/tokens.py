"""Token ids of whole texts from a tokenizers file, each different chunk of text encoded once per worker.

Both tokenizer kinds handled here split at every place where an ASCII space follows other characters, so the ids of a text are the
ids of its chunks in a row. Short chunks are looked up in a table bounded in entries and ids, by one hash with a second one to confirm
it; new ones, and long ones each time, go through the library. A text whose chunks would not be independent (a special token's string,
or a space outside ASCII where spaces belong to tokens) is one chunk.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow.compute as pc

from .textkit import IS_SPACE, SEED2, HashTable, Slice, fill, range_hashes

_ENCODERS: dict[tuple[str, str], Encoder] = {}
#: UTF-8 of the White_Space characters outside ASCII.
WIDE_SPACES = [chr(c).encode() for c in (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]
#: What a worker's table holds at most, before the chunks of one more slice; longer chunks than LONG bytes are not kept.
MAX_ENTRIES, MAX_IDS, LONG = 1 << 20, 1 << 23, 256


def has_wide_space(s: Slice) -> np.ndarray:
    """For each text, whether it holds a white-space character outside ASCII."""
    out = np.zeros(len(s), bool)
    lead = np.zeros(256, bool)
    lead[[w[0] for w in WIDE_SPACES]] = True
    at = np.flatnonzero(lead[s.data])
    if not len(at):
        return out
    wide = np.zeros(1 << 24, bool)
    wide[[int.from_bytes(w.ljust(3, b"\0"), "big") for w in WIDE_SPACES]] = True
    data = np.append(s.data, [0, 0]).astype(np.int64)
    code = data[at] << 16 | data[at + 1] << 8
    code |= np.where(data[at] >= 0xE0, data[at + 2], 0)
    out[np.searchsorted(s.off, at[wide[code]], "right") - 1] = True
    return out


class Encoder:
    """ids(slice) of one tokenizer file. spaces_inside: spaces are part of tokens (byte-level files), not dropped."""

    def __init__(self, path: str, spaces_inside: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.spaces_inside = Tokenizer.from_file(path), spaces_inside
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self._reset()

    def _reset(self) -> None:
        self.table, self.pool, self.used = HashTable(), np.empty(1 << 20, np.uint32), 0
        self.confirm, self.place = np.empty(1 << 10, np.uint64), np.empty((2, 1 << 10), np.int64)

    def _chunks(self, s: Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        whole = has_wide_space(s) if self.spaces_inside else np.zeros(len(s), bool)
        for t in self.special:
            whole |= pc.match_substring(s.texts, t).to_numpy(zero_copy_only=False).astype(bool)
        whole &= np.diff(s.off) > 0
        if not self.spaces_inside:
            start, end, first = s.words()
        else:
            space = IS_SPACE[s.data]
            cut = space.copy()
            cut[1:] &= ~space[:-1]
            cut[s.off[:-1][np.diff(s.off) > 0]] = True
            start = np.flatnonzero(cut)
            end = np.append(start[1:], len(s.data))[: len(start)]
            first = np.searchsorted(start, s.off)
        if whole.any():
            keep = np.ones(len(start), bool)
            for k in np.flatnonzero(whole):
                keep[first[k] : first[k + 1]] = False
            start = np.concatenate([start[keep], s.off[:-1][whole]])
            end = np.concatenate([end[keep], s.off[1:][whole]])
            order = np.argsort(start, kind="stable")
            start, end = start[order], end[order]
            first = np.searchsorted(start, s.off)
        return start, end, first

    def ids(self, s: Slice) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the slice's texts (unsigned 32-bit), and where each text's begin (one more at the end)."""
        if not len(s.data):
            return np.empty(0, np.uint32), np.zeros(len(s) + 1, np.int64)
        start, end, first = self._chunks(s)
        h, confirm = range_hashes(s.data, start, end), range_hashes(s.data, start, end, SEED2)
        h[h == 0] = 1
        if self.table.n > MAX_ENTRIES or self.used > MAX_IDS:
            self._reset()
        at, length = np.empty(len(h), np.int64), np.empty(len(h), np.int64)
        usual = np.flatnonzero(end - start <= LONG)
        entry = self.table.find(h[usual])
        if (new := usual[entry < 0]).size:
            keys, one = np.unique(h[new], return_index=True)
            self._keep(keys, confirm[new[one]], *self._encode(s, start[new[one]], end[new[one]]))
            entry = self.table.find(h[usual])
        at[usual], length[usual] = self.place[:, entry]
        odd = np.ones(len(h), bool)
        odd[usual] = self.confirm[entry] != confirm[usual]
        if (odd := np.flatnonzero(odd)).size:  # long chunks, and hashes that two chunks share, for this slice only
            ids, length[odd] = self._encode(s, start[odd], end[odd])
            at[odd] = self.used + np.cumsum(length[odd]) - length[odd]
            self._room(len(ids))
            self.pool[self.used : self.used + len(ids)] = ids
        ends = np.zeros(len(length) + 1, np.int64)
        np.cumsum(length, out=ends[1:])
        return self.pool[fill(at, length)], ends[first]

    def _encode(self, s: Slice, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the chunks in a row, and how many each has."""
        lengths, got = np.empty(len(start), np.int64), []
        for at in range(0, len(start), 4096):
            pieces = [s.data[a:b].tobytes().decode() for a, b in zip(start[at : at + 4096].tolist(), end[at : at + 4096].tolist(), strict=True)]
            part = [e.ids for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]
            lengths[at : at + len(part)] = [len(x) for x in part]
            got.append(np.array([i for x in part for i in x], np.uint32))
        return np.concatenate(got), lengths

    def _room(self, n: int) -> None:
        if self.used + n > len(self.pool):
            self.pool = np.concatenate([self.pool[: self.used], np.empty(max(n, self.used), np.uint32)])

    def _keep(self, keys: np.ndarray, confirm: np.ndarray, ids: np.ndarray, lengths: np.ndarray) -> None:
        entry, n = self.table.n, len(keys)
        if entry + n > len(self.confirm):
            more = max(n, entry)
            self.confirm = np.concatenate([self.confirm[:entry], np.empty(more, np.uint64)])
            self.place = np.concatenate([self.place[:, :entry], np.empty((2, more), np.int64)], axis=1)
        self._room(len(ids))
        self.pool[self.used : self.used + len(ids)] = ids
        self.confirm[entry : entry + n] = confirm
        self.place[:, entry : entry + n] = self.used + np.cumsum(lengths) - lengths, lengths
        self.table.add(keys, np.arange(entry, entry + n))
        self.used += len(ids)

    def ids_with_end(self, s: Slice, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """As ids(), with end_id after each text."""
        ids, first = self.ids(s)
        return np.insert(ids, first[1:], np.uint32(end_id)), first + np.arange(len(first))


def encoder(path: str, spaces_inside: bool) -> Encoder:
    """The worker's encoder of this file."""
    key = (path, str(spaces_inside))
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(path, spaces_inside)
    return _ENCODERS[key]
