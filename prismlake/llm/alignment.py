"""Cross-tokenizer alignment: which tokens of one tokenizer stand for which of another, over all texts.

Both tokenizers read the same bytes, a space and the text. Cumulative sums of token lengths are the tokens' ends; the ends that both have
(intersect1d) cut a text into groups; searchsorted labels each token with its group, and repeats expand the tokens of a
group into links. Texts are tokenized once: a document becomes its numbers and its different id pairs with their occurrences. The
pairs are counted over documents by tasks, then by pair and salt, then by pair, and the counts become sorted arrays that workers map
to value each document's links. A pair's count is bounded in space by the two vocabularies, not by the corpus.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from ..plans.durable import durable, new_folder
from .shards import arrays, look_up, write_arrays
from .textkit import ODD, Slice, fill, mix, per_text, slices
from .tokens import Encoder

#: Pairs that a counting task holds before it sends them on; links of one group above which its equal ids are counted before they are expanded.
HELD, LARGE, SALTS = 1 << 21, 1 << 12, 16
_SIDES: dict[str, Side] = {}


class _Bytes(Encoder):
    """A byte-level file whose special tokens' strings are plain text."""

    def __init__(self, path: str):
        super().__init__(path, spaces_inside=True)
        self.tokenizer.encode_special_tokens = True
        self.special = []
        from tokenizers.pre_tokenizers import ByteLevel

        kept = [k for k in range(256) if 33 <= k <= 126 or 161 <= k <= 172 or 174 <= k <= 255]
        rest = [k for k in range(256) if k not in set(kept)]
        byte_of = {chr(c): b for b, c in [*((k, k) for k in kept), *((k, 256 + i) for i, k in enumerate(rest))]}
        assert set(byte_of) == set(ByteLevel.alphabet())
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.spelled = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            self.spelled[i] = bytes(byte_of[c] for c in token) if all(c in byte_of for c in token) else token.encode()


class _Pieces(Encoder):
    """A sentencepiece file that adds a space in front; texts come with that space. Where no piece has a space after something else,
    chunks that begin at a space are independent."""

    def __init__(self, path: str):
        import sentencepiece

        self.tokenizer = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.tokenizer.id_to_piece(i) for i in range(self.tokenizer.get_piece_size())]
        self.space = [self.tokenizer.piece_to_id("▁")]
        self.whole = any(re.search("[^▁]▁", p) for p in pieces)
        self.spelled = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) and self.tokenizer.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self._reset()

    def _chunks(self, s: Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        cut = np.zeros(len(s.data), bool)
        if not self.whole:
            cut = s.data == 32
            cut[1:] &= s.data[:-1] != 32
        cut[s.off[:-1][np.diff(s.off) > 0]] = True
        start = np.flatnonzero(cut)
        return start, np.append(start[1:], len(s.data))[: len(start)], np.searchsorted(start, s.off)

    def _encode(self, s: Slice, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        lengths, got = [], []
        for a in range(0, len(start), 4096):
            texts = [s.data[x + 1 : y].tobytes().decode() for x, y in zip(start[a : a + 4096].tolist(), end[a : a + 4096].tolist(), strict=True)]
            part = [ids if t else self.space for t, ids in zip(texts, self.tokenizer.encode(texts, num_threads=1), strict=True)]  # a last space alone
            lengths += [len(x) for x in part]
            got.append(np.array([i for x in part for i in x], np.uint32))
        return np.concatenate(got), np.array(lengths, np.int64)


class Side:
    """A tokenizer with the bytes and the decimal digits of its ids."""

    def __init__(self, path: str):
        self.encoder = _Pieces(path) if path.endswith(".model") else _Bytes(path)
        spelled = self.encoder.spelled
        self.size = len(spelled)
        self.length = np.array([len(x) for x in spelled], np.int64)
        self.bytes, self.at = np.frombuffer(b"".join(spelled), np.uint8), np.cumsum(self.length) - self.length
        digits = [b"%d," % i for i in range(self.size)]
        self.digits = np.frombuffer(b"".join(digits), np.uint8)
        self.n_digits = np.array([len(x) for x in digits], np.int64)
        self.digits_at = np.cumsum(self.n_digits) - self.n_digits


def side(path: str) -> Side:
    """The worker's side of this file."""
    if path not in _SIDES:
        _SIDES[path] = Side(path)
    return _SIDES[path]


def _spaced(s: Slice) -> Slice:
    """The slice with a space before each text that is not empty."""
    full = np.diff(s.off) > 0
    data = np.insert(s.data, s.off[:-1][full], 32)
    off = s.off + np.concatenate([[0], np.cumsum(full)])
    texts = pa.Array.from_buffers(pa.large_string(), len(s), [None, pa.py_buffer(off.astype(np.int64).tobytes()), pa.py_buffer(data.tobytes())])
    out = Slice(pa.array([], pa.string()), s.rows)
    out.texts, out.data, out.off = texts, data, off
    return out


def _agrees(s: Slice, t: Side, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each text, whether the bytes of its tokens are its own."""
    length = t.length[ids]
    good = per_text(length, first) == np.diff(s.off)
    keep = np.repeat(good, np.diff(first))
    mine = t.bytes[fill(t.at[ids[keep]], length[keep])]
    start, n = s.off[:-1][good], np.diff(s.off)[good]
    wrong = mine != s.data[fill(start, n)]
    good[np.flatnonzero(good)] = per_text(wrong, np.concatenate([[0], np.cumsum(n)])) == 0
    return good


class Aligned:
    """The tokens of a slice's texts on both sides, their groups and their links."""

    def __init__(self, s: Slice, a: Side, b: Side):
        s = _spaced(s)
        self.a, self.b, self.n = a, b, len(s)
        (ia, fa), (ib, fb) = a.encoder.ids(s), b.encoder.ids(s)
        good = (np.diff(s.off) > 0) & _agrees(s, a, ia, fa) & _agrees(s, b, ib, fb)
        self.ia, self.ib = ia[np.repeat(good, np.diff(fa))].astype(np.int64), ib[np.repeat(good, np.diff(fb))].astype(np.int64)
        self.na, self.nb = np.where(good, np.diff(fa), 0), np.where(good, np.diff(fb), 0)
        ends_a, ends_b = np.cumsum(a.length[self.ia]), np.cumsum(b.length[self.ib])
        cuts = np.intersect1d(ends_a, ends_b, assume_unique=True)
        self.ga, self.gb = np.searchsorted(cuts, ends_a), np.searchsorted(cuts, ends_b)
        self.in_a, self.in_b = np.bincount(self.ga, minlength=len(cuts)), np.bincount(self.gb, minlength=len(cuts))
        text_ends = np.cumsum(np.where(good, np.diff(s.off), 0))
        self.group_first = np.concatenate([[0], np.searchsorted(cuts, text_ends, "right")])
        self.n_groups = np.diff(self.group_first)
        self.group_text = np.repeat(np.arange(self.n), self.n_groups)
        self.n_links = per_text(self.in_a * self.in_b, self.group_first)

    def _merged(self) -> tuple[np.ndarray, np.ndarray]:
        """Where each token stands when every group's tokens of one side come before those of the other."""
        before_b, upto_a = np.cumsum(self.in_b) - self.in_b, np.cumsum(self.in_a)
        return np.arange(len(self.ia)) + before_b[self.ga], np.arange(len(self.ib)) + upto_a[self.gb]

    def digests(self) -> list[str]:
        """SHA-256 of each text's groups as `a1,a2|b1;a3|b2,b3`; empty for texts without tokens."""
        pa_, pb = self._merged()
        total = len(pa_) + len(pb)
        length, source = np.empty(total, np.int64), np.empty(total, np.int64)
        length[pa_], length[pb] = self.a.n_digits[self.ia], self.b.n_digits[self.ib]
        source[pa_], source[pb] = self.a.digits_at[self.ia], self.b.digits_at[self.ib] + len(self.a.digits)
        out = np.concatenate([self.a.digits, self.b.digits])[fill(source, length)]
        ends = np.cumsum(length)
        last_a, last_b = np.cumsum(self.in_a) - 1, np.cumsum(self.in_b) - 1
        out[ends[pa_[last_a]] - 1] = ord("|")
        out[ends[pb[last_b]] - 1] = ord(";")
        text_end = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(self.na + self.nb)])]
        raw = memoryview(out)
        return [hashlib.sha256(raw[x : y - 1]).hexdigest() if y > x else "" for x, y in zip(text_end[:-1].tolist(), text_end[1:].tolist(), strict=True)]

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, pair, occurrences) of the different linked id pairs of each text in order; a pair is a * size of b's vocabulary + b."""
        links = self.in_a * self.in_b
        usual = links <= LARGE
        token = np.flatnonzero(usual[self.ga])
        group = self.ga[token]
        n = self.in_b[group]
        first_b = np.cumsum(self.in_b) - self.in_b
        other = fill(first_b[group], n)
        texts, keys = [np.repeat(self.group_text[group], n)], [np.repeat(self.ia[token], n) * self.b.size + self.ib[other]]
        counts = [np.ones(len(other), np.int64)]
        first_a = np.cumsum(self.in_a) - self.in_a
        for g in np.flatnonzero(~usual).tolist():
            ua, ca = np.unique(self.ia[first_a[g] : first_a[g] + self.in_a[g]], return_counts=True)
            ub, cb = np.unique(self.ib[first_b[g] : first_b[g] + self.in_b[g]], return_counts=True)
            keys.append((ua[:, None] * self.b.size + ub).ravel())
            counts.append((ca[:, None] * cb).ravel())
            texts.append(np.full(len(keys[-1]), self.group_text[g]))
        text, key, count = map(np.concatenate, (texts, keys, counts))
        order = np.lexsort((key, text))
        text, key, count = text[order], key[order], count[order]
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (text[1:] != text[:-1])
        first = np.flatnonzero(new)
        return text[first], key[first], np.add.reduceat(count, first) if len(first) else count


def _planes(a: np.ndarray) -> bytes:
    kind = "<u4" if not len(a) or int(a.max()) < 1 << 32 else "<u8"
    return kind[2].encode() + np.ascontiguousarray(a.astype(kind).view(np.uint8).reshape(-1, int(kind[2])).T).tobytes()


def _read(raw: bytes) -> np.ndarray:
    width = int(raw[:1] or b"4")
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8, -1, 1).reshape(width, -1).T).view(f"<u{width}").ravel().astype(np.int64)


def _runs(a: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, pair, occurrences) of a column of packed pairs."""
    parts = [_read(x.as_py()) for x in a]
    n = np.array([len(p) // 2 for p in parts], np.int64)
    keys = [np.cumsum(p[: k]) for p, k in zip(parts, n.tolist(), strict=True)]
    counts = [p[k:] for p, k in zip(parts, n.tolist(), strict=True)]
    none = np.empty(0, np.int64)
    return np.repeat(np.arange(len(n)), n), np.concatenate([none, *keys]), np.concatenate([none, *counts])


def _sums(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(key, kind="stable")
    key, n = key[order], n[order]
    first = np.flatnonzero(np.diff(key, prepend=-1)) if len(key) else np.empty(0, np.int64)
    return key[first], np.add.reduceat(n, first) if len(first) else n


NUMBERS = ("n_a", "n_b", "n_groups", "n_links")


def _tokenized(docs: DataFrame, path_a: str, path_b: str, keep: tuple[Column, ...]) -> DataFrame:
    """(c0, .., n_a, n_b, n_groups, n_links, groups_sha256, pairs) of every text."""
    carried = [StructField(f"c{k}", f.dataType) for k, f in enumerate(docs.select(*keep).schema)]
    schema = StructType([*carried, *(StructField(n, LongType()) for n in NUMBERS), StructField("groups_sha256", StringType()), StructField("pairs", BinaryType())])
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in slices(batches):
            x = Aligned(s, side(path_a), side(path_b))
            text, key, count = x.pairs()
            first = np.searchsorted(text, np.arange(len(s) + 1)).tolist()
            packed = [_planes(np.concatenate([np.diff(key[i:j], prepend=0), count[i:j]])) for i, j in zip(first[:-1], first[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*s.rows.columns[1:], *(pa.array(v) for v in (x.na, x.nb, x.n_groups, x.n_links)), pa.array(x.digests(), pa.string()), pa.array(packed, pa.binary())], names)

    return docs.select("text", *[c.alias(f"c{k}") for k, c in enumerate(keep)]).mapInArrow(run, schema)


def pair_counts(tokenized: DataFrame) -> DataFrame:
    """(pair, n): how many documents hold each linked id pair. Tasks sum first, then pair and salt, then the pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, since, held, salt = [], 0, 0, 0

        def out() -> pa.RecordBatch:
            key, n = _sums(*map(np.concatenate, zip(*parts, strict=True)))
            return pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.full(len(key), salt % SALTS, np.int32)), pa.array(n)], ["pair", "salt", "n"])

        for b in batches:
            _, key, _ = _runs(b.column(0))
            parts.append(_sums(key, np.ones(len(key), np.int64)))
            salt += int(key.sum() & 0xFFFF) + 1 if len(key) else 1
            since += len(parts[-1][0])
            if since > HELD // 2:
                parts = [_sums(*map(np.concatenate, zip(*parts, strict=True)))]
                held, since = len(parts[0][0]), 0
            if held > HELD:
                yield out()
                parts, held = [], 0
        if parts:
            yield out()

    parts = tokenized.select("pairs").mapInArrow(run, "pair long, salt int, n long")
    return parts.groupBy("pair", "salt").agg(F.sum("n").alias("n")).groupBy("pair").agg(F.sum("n").alias("n"))


def _bucket(a: np.ndarray, buckets: int) -> np.ndarray:
    return ((mix(a.astype(np.uint64) + ODD) >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)


def align(docs: DataFrame, path_a: str, path_b: str, *keep: Column) -> DataFrame:
    """(the `keep` columns, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every whole text; a row each for repeated rows.

    path_a: a byte-level tokenizers file, read over a space and the text; path_b: a sentencepiece file that adds the space itself.
    Special tokens' strings are plain text. A link is an occurrence of a token of each side whose bytes share a group; a pair's
    count is how many documents of docs hold it; n_best counts the links whose count is the highest that their first id has anywhere, ties
    included; count_sum adds up the links' counts. Null and empty texts, and those whose tokens on either side do not spell the space and the text, have
    zeros and an empty digest, and hold no pair. keep: columns of docs of any type. An empty table gives an empty result. A task
    holds one text's tokens and different pairs, and of a group with many tokens only its different ids' pairs.
    """
    spark = docs.sparkSession
    tokenized = durable(_tokenized(docs, path_a, path_b, keep))
    folder, buckets = new_folder(spark, "links"), max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    size_b = side(path_b).size

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            a = b.column(0).to_numpy(zero_copy_only=False) // size_b
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(_bucket(a, buckets).astype(np.int32))], ["pair", "n", "bucket"])

    def write(table: pa.Table) -> pa.Table:
        """A bucket's pairs with all pairs of each first id, and which are its best."""
        key, n = (table.column(c).to_numpy() for c in ("pair", "n"))
        order = np.argsort(key)
        key, n = key[order], n[order]
        first = np.flatnonzero(np.diff(key // size_b, prepend=-1))
        best = n == np.repeat(np.maximum.reduceat(n, first), np.diff(first, append=len(key)))
        write_arrays(f"{folder}/pairs-{table.column('bucket')[0].as_py()}", pair=key, n=n, best=best.astype(np.uint8))
        return pa.table({"pairs": pa.array([len(key)], pa.int64())})

    pair_counts(tokenized).mapInArrow(deal, "pair long, n long, bucket int").repartition(buckets, "bucket").groupBy("bucket").applyInArrow(write, "pairs long").agg(F.sum("pairs")).first()
    carried = [f for f in tokenized.schema if re.fullmatch(r"c\d+", f.name)]
    schema = StructType([*(f for f in tokenized.schema if f.name != "pairs"), StructField("n_best", LongType()), StructField("count_sum", LongType())])
    names = schema.names

    def value(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, key, count = _runs(b.column(b.num_columns - 1))
            pairs, place = np.unique(key, return_inverse=True)
            n, best = np.zeros(len(pairs), np.int64), np.zeros(len(pairs), np.int64)
            to = _bucket(pairs // size_b, buckets)
            for k in np.unique(to).tolist():
                part = np.flatnonzero(to == k)
                table = arrays(folder, f"pairs-{k}")
                at, hit = look_up(table["pair"], pairs[part])
                assert hit.all(), "a pair of the texts has no count"
                n[part], best[part] = table["n"][at], table["best"][at]
            first = np.searchsorted(row, np.arange(b.num_rows + 1))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(per_text(count * best[place], first)), pa.array(per_text(count * n[place], first))], names)

    out = tokenized.mapInArrow(value, schema)
    own = docs.select(*keep).columns
    return out.select(*[F.col(f.name).alias(n) for f, n in zip(carried, own, strict=True)], *NUMBERS, "n_best", "count_sum", "groups_sha256")
