"""Token counts by finite-state tokenizer compilation, for byte-level BPE files.

Two deterministic transducers read a text. The first splits it into pretokens: its 12 states read character classes and mark where
pretokens begin, at the character or the one before. Texts are cut into chunks; every chunk is read from all states at once, which
gives a map of states to states; a parallel prefix scan composes the maps, so each chunk's first state is known and all chunks are
read again in step, writing marks. The second counts the tokens of a pretoken: a state holds, for each place where a token that may
still grow began, its node in the vocabulary's trie, the token before it and the tokens up to there. Its transitions carry the
change of the count and are compiled from the merges when they are first needed; one hash array holds them all.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .textkit import SEED2, HashTable, Slice, mix, range_hashes, slices

# Character classes. The letters of contractions have their own: s t m d end one, r and v need an e, l another l.
ENDS, RV, E, L, LETTER, NUMBER, ELSE, QUOTE, BLANK, SPACE = range(10)
LETTERS = (ENDS, RV, E, L, LETTER)
CLASSES = 10
PAD = 2 * CLASSES  # class + CLASSES: the first character of a text
WIDTH = PAD + 1
BEGIN, WORD, DIGITS, MARKS, DONE, BLANK1, SPACE1, BLANKS, SPACES, QUOTED, QUOTED_RV, QUOTED_L = range(12)
HERE, BEFORE = 1, 2
CHUNK = 256
#: Characters outside ASCII that the split's \s takes.
WIDE = (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
_CLASS: list[np.ndarray] = []
_COUNTERS: dict[str, Counter] = {}
#: What a worker keeps at most; pretokens longer than LONG bytes are not kept, and are read in pieces of PIECE bytes.
MAX_PRETOKENS, MAX_STATES, MAX_PAIRS = 1 << 19, 1 << 18, 1 << 20
LONG, PIECE, WARM = 64, 1024, 128


def _first(c: int) -> int:
    """The state after a pretoken's first character."""
    return WORD if c in LETTERS else {NUMBER: DIGITS, ELSE: MARKS, QUOTE: QUOTED, BLANK: BLANK1, SPACE: SPACE1}[c]


def _step(state: int, c: int) -> tuple[int, int]:
    """(next state, marks) for the split  's|'t|'re|'ve|'m|'ll|'d| ?letters| ?numbers| ?others|spaces before a space or the end|spaces."""
    kind = LETTER if c in LETTERS else c
    inside = {LETTER: WORD, NUMBER: DIGITS, ELSE: MARKS, QUOTE: MARKS}
    spaces = {BLANK: BLANKS, SPACE: SPACES}
    if state == WORD and kind == LETTER or state == DIGITS and kind == NUMBER or state == MARKS and kind in (ELSE, QUOTE):
        return state, 0
    if state in (BLANK1, SPACE1, BLANKS, SPACES) and kind in spaces:
        return spaces[kind], 0
    if state == BLANK1:
        return inside[kind], 0
    if state == BLANKS:
        return inside[kind], BEFORE
    if state == SPACES:
        return _first(c), HERE | BEFORE
    if state == QUOTED:
        if c in (ENDS, RV, L):
            return {ENDS: DONE, RV: QUOTED_RV, L: QUOTED_L}[c], 0
        if kind in (ELSE, QUOTE):
            return MARKS, 0
    if state in (QUOTED_RV, QUOTED_L):
        if c == (E if state == QUOTED_RV else L):
            return DONE, 0
        return (WORD, BEFORE) if kind == LETTER else (_first(c), HERE | BEFORE)
    return _first(c), HERE


def _compile_split() -> tuple[np.ndarray, np.ndarray]:
    after, marks = np.zeros((12, WIDTH), np.uint8), np.zeros((12, WIDTH), np.uint8)
    for state in range(12):
        for c in range(CLASSES):
            after[state, c], marks[state, c] = _step(state, c)
            after[state, c + CLASSES] = _first(c)
            marks[state, c + CLASSES] = HERE | (BEFORE if state in (QUOTED_RV, QUOTED_L) else 0)
        after[state, PAD] = state
    return after.ravel(), marks.ravel()


AFTER, MARK = _compile_split()


def classes(points: np.ndarray) -> np.ndarray:
    if not _CLASS:
        _CLASS.append(np.full(0x110000, 255, np.uint8))
    out = _CLASS[0][points]
    if (out == 255).any():
        for p in np.unique(points[out == 255]).tolist():
            c, kind = chr(p), unicodedata.category(chr(p))[0]
            _CLASS[0][p] = ENDS if c in "stmd" else RV if c in "rv" else E if c == "e" else L if c == "l" else LETTER if kind == "L" else NUMBER if kind == "N" else QUOTE if c == "'" else BLANK if c == " " else SPACE if 9 <= p <= 13 or p in WIDE else ELSE
        out = _CLASS[0][points]
    return out


def split_marks(c: np.ndarray) -> np.ndarray:
    """Whether a pretoken begins at each character, from classes where a text's first character has CLASSES added."""
    n = len(c)
    chunks = -(-(n + 1) // CHUNK)
    rows = np.full(chunks * CHUNK, PAD, np.uint8)
    rows[:n] = c
    rows[n] = CLASSES + LETTER  # as if another text began: ends what is pending
    rows = np.ascontiguousarray(rows.reshape(chunks, CHUNK).T)
    # Each chunk's map of states, by reading from all of them until they agree.
    maps = np.tile(np.arange(12, dtype=np.uint8), (chunks, 1))
    for t in range(CHUNK):
        if t % 16 == 0 and t and (maps == maps[:, :1]).all():
            one = maps[:, 0]
            for u in range(t, CHUNK):
                one = AFTER[one.astype(np.uint16) * WIDTH + rows[u]]
            maps = np.repeat(one[:, None], 12, axis=1)
            break
        maps = AFTER[maps.astype(np.uint16) * WIDTH + rows[t][:, None]]
    # Parallel prefix scan: after the round with distance d, maps[k] is the composition of up to 2d chunks that end with k.
    d = 1
    while d < chunks:
        maps = np.concatenate([maps[:d], np.take_along_axis(maps[d:], maps[:-d].astype(np.intp), axis=1)])
        d *= 2
    state = np.concatenate([[BEGIN], maps[:-1, BEGIN]]).astype(np.uint16)
    out = np.empty((CHUNK, chunks), np.uint8)
    for t in range(CHUNK):
        at = state * WIDTH + rows[t]
        out[t] = MARK[at]
        state = AFTER[at].astype(np.uint16)
    out = out.T.ravel()[: n + 1]
    return ((out[:-1] & HERE) | (out[1:] & BEFORE)) != 0


class BpeTransducer:
    """Counts the tokens of pretokens; its transitions are compiled when they are first needed."""

    def __init__(self, tokens: dict[bytes, int], merges: list[tuple[bytes, bytes]]):
        self.rank = {pair: k for k, pair in enumerate(merges)}
        self.children: list[dict[int, int]] = [{}]
        self.token: list[bytes | None] = [None]
        for t in tokens:
            node = 0
            for b in t:
                if b not in self.children[node]:
                    self.children[node][b] = len(self.children)
                    self.children.append({})
                    self.token.append(None)
                node = self.children[node][b]
            self.token[node] = t
        self._reset()

    def _reset(self) -> None:
        self.fits: dict[tuple[bytes, bytes], bool] = {}
        start = ((0, b"", 0),)
        self.states, self.number = [start], {start: 0}
        self.steps = HashTable()

    def encode(self, word: bytes) -> list[bytes]:
        """The merges applied by rank, as the library does."""
        parts = [word[k : k + 1] for k in range(len(word))]
        while len(parts) > 1:
            best, at = min((self.rank.get(p, 1 << 30), k) for k, p in enumerate(zip(parts, parts[1:], strict=False)))
            if best == 1 << 30:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _fit(self, left: bytes, right: bytes) -> bool:
        """Whether the two tokens stay apart where they meet."""
        key = (left, right)
        if key not in self.fits:
            self.fits[key] = not left or self.encode(left + right) == [left, right]
        return self.fits[key]

    def compile(self, state: int, byte: int) -> tuple[int, int]:
        """(next state, change of the count)."""
        grown, last = [], None
        for node, before, n in self.states[state]:
            if (to := self.children[node].get(byte)) is not None:
                grown.append((to, before, n))
                t = self.token[to]
                if last is None and t is not None and self._fit(before, t):
                    last = (t, n + 1)
        if last is None:
            raise ValueError("the vocabulary does not cover every byte")
        t, base = last
        after = (*((node, before, n - base) for node, before, n in grown if self.children[node]), (0, t, 0))
        if after not in self.number:
            self.number[after] = len(self.states)
            self.states.append(after)
        return self.number[after], base

    def read(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(state after, change of the count) of each byte range read from its state, all ranges in step."""
        order = np.argsort(start - end, kind="stable")
        at, length = start[order], (end - start)[order]
        state, total, t = state[order], np.zeros(len(at), np.int64), 0
        while len(at) and (n := int(np.searchsorted(-length, -t, "left"))):
            arc = state[:n] << 8 | data[at[:n] + t]
            key = mix(arc.astype(np.uint64) + np.uint64(1))
            to = self.steps.find(key)
            if (new := np.flatnonzero(to < 0)).size:
                arcs, one = np.unique(arc[new], return_index=True)
                made = [self.compile(a >> 8, a & 255) for a in arcs.tolist()]
                self.steps.add(key[new[one]], np.array([s << 8 | (d + 128) for s, d in made]))
                to = self.steps.find(key)
            state[:n], t = to >> 8, t + 1
            total[:n] += (to & 255) - 128
        after, out = np.empty(len(at), np.int64), np.empty(len(at), np.int64)
        after[order], out[order] = state, total
        return after, out

    def count(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The tokens of each byte range.

        Ranges longer than a piece are read piece by piece, all pieces in step: each from the state that the bytes just before it lead
        to, and again from the true one where its predecessor ends in another, until all agree.
        """
        if len(self.states) > MAX_STATES or len(self.fits) > MAX_PAIRS:
            self._reset()
        pieces = np.maximum(-(-(end - start) // PIECE), 1)
        of = np.repeat(np.arange(len(start)), pieces)
        nth = np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        a = start[of] + PIECE * nth
        b = np.minimum(a + PIECE, end[of])
        begin = np.zeros(len(of), np.int64)
        if len(later := np.flatnonzero(nth)):
            begin[later] = self.read(data, a[later] - WARM, a[later], begin[later])[0]
        after, total = self.read(data, a, b, begin)
        while len(wrong := later[after[later - 1] != begin[later]]):
            begin[wrong] = after[wrong - 1]
            after[wrong], total[wrong] = self.read(data, a[wrong], b[wrong], begin[wrong])
        return np.bincount(of, total, len(start)).astype(np.int64)


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of bytes in byte-level files: printable Latin-1 bytes stand for themselves, the others for 256 and up in order."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


class Counter:
    """Token counts of whole texts for one tokenizers file (byte-level BPE with the usual split)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        split = spec["pre_tokenizer"]
        if split["type"] != "ByteLevel" or split["add_prefix_space"] or not split.get("use_regex", True) or spec["normalizer"] or spec["model"]["type"] != "BPE":
            raise ValueError(f"{path}: only byte-level BPE with its own split and no normaliser can be compiled")
        byte = byte_alphabet()
        plain = lambda t: bytes(byte[c] for c in t)
        self.special = [t["content"] for t in spec["added_tokens"]]
        tokens = {plain(t): k for t, k in spec["model"]["vocab"].items() if t not in self.special}
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.transducer = BpeTransducer(tokens, [(plain(a), plain(b)) for a, b in merges])
        self.known, self.entries = HashTable(), np.empty((2, 0), np.int64)

    def counts(self, s: Slice) -> np.ndarray:
        """The tokens of each whole text of a slice."""
        if not len(s.data):
            return np.zeros(len(s), np.int64)
        points = np.frombuffer(s.data.tobytes().decode().encode("utf-32-le"), "<u4")
        byte_at = np.append(np.flatnonzero((s.data & 0xC0) != 0x80), len(s.data))
        c = classes(points)
        first = np.searchsorted(byte_at, s.off[:-1][np.diff(s.off) > 0])
        special = self._special(s)
        fresh = np.concatenate([first, *(np.searchsorted(byte_at, x) for x in special)]) if len(special[0]) else first
        c[fresh[fresh < len(c)]] |= 0x80
        c = np.where(c & 0x80, (c & 0x7F) + CLASSES, c).astype(np.uint8)
        start = byte_at[:-1][split_marks(c)]
        end = np.append(start[1:], len(s.data))
        n = np.ones(len(start), np.int64)
        if len(special[0]):  # a special string is one token, whatever was marked inside it
            inside = np.searchsorted(special[0], start, "right") - 1
            inside = np.where((inside >= 0) & (start < special[1][inside]), inside, -1)
            n[inside >= 0] = start[inside >= 0] == special[0][inside[inside >= 0]]
            usual = np.flatnonzero(inside < 0)
            n[usual] = self._pretokens(s, start[usual], end[usual])
        else:
            n = self._pretokens(s, start, end)
        sums = np.concatenate([[0], np.cumsum(n)])[np.searchsorted(start, s.off)]
        return sums[1:] - sums[:-1]

    def _special(self, s: Slice) -> tuple[np.ndarray, np.ndarray]:
        spans: list[tuple[int, int]] = []
        raw = None
        for t in self.special:
            if len(rows := np.flatnonzero(pc.match_substring(s.texts, t).to_numpy(zero_copy_only=False).astype(bool))):
                raw, find = raw or s.data.tobytes(), t.encode()
                for k in rows.tolist():
                    at = raw.find(find, s.off[k], s.off[k + 1])
                    while at >= 0:
                        spans.append((at, at + len(find)))
                        at = raw.find(find, at + len(find), s.off[k + 1])
        spans.sort()
        return tuple(np.array(spans, np.int64).reshape(-1, 2).T)

    def _pretokens(self, s: Slice, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        h, confirm = range_hashes(s.data, start, end), range_hashes(s.data, start, end, SEED2).view(np.int64)
        h[h == 0] = 1
        if self.known.n > MAX_PRETOKENS:
            self.known, self.entries = HashTable(), np.empty((2, 0), np.int64)
        out, usual = np.empty(len(h), np.int64), np.flatnonzero(end - start <= LONG)
        entry = self.known.find(h[usual])
        if (new := usual[entry < 0]).size:
            keys, one = np.unique(h[new], return_index=True)
            n = self.transducer.count(s.data, start[new[one]], end[new[one]])
            self.known.add(keys, np.arange(self.known.n, self.known.n + len(keys)))
            self.entries = np.concatenate([self.entries, [confirm[new[one]], n]], axis=1)
            entry = self.known.find(h[usual])
        out[usual] = self.entries[1, entry]
        odd = np.ones(len(h), bool)
        odd[usual] = self.entries[0, entry] != confirm[usual]
        if (odd := np.flatnonzero(odd)).size:  # long ones, and hashes that two pretokens share
            out[odd] = self.transducer.count(s.data, start[odd], end[odd])
        return out


def counter(path: str) -> Counter:
    """The worker's counter of this file."""
    if path not in _COUNTERS:
        _COUNTERS[path] = Counter(path)
    return _COUNTERS[path]


def count_tokens(docs: DataFrame, tokenizer: str, *, limit: int = 512) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every whole text; over_limit: more than `limit` tokens.

    docs: doc_id, text; other columns are ignored. Null and empty texts have no bytes and tokens. Strings of special tokens in a
    text are one token each, as the library's default has it. Repeated rows each give a row; an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(tokenizer)
        for s in slices(batches):
            n = count.counts(s)
            yield pa.RecordBatch.from_arrays([s.rows.column(0), pa.array(np.diff(s.off)), pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


