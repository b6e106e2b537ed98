"""Finding repeated hashes over all documents, and telling each document where its own are.

Rows that travel are blocks of packed arrays, one for each slice of text and hash bucket, so the shuffle moves few rows of dense
bytes. What repeats inside a slice is settled there and sends one representative, so a hash that a third of all texts hold sends one
entry a slice. A bucket's task reads its blocks as a stream and keeps one entry for each different hash, never a group. Both
directions are routed by labels that hash evenly over the partitions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, MapType, StringType, StructType

from ..plans.durable import durable
from .textkit import Slice, fill, mix, quoted, slices

CANDIDATES, KNOWN, RUNS = 0, 1, 2
SCHEMA = "bucket int, kind int, payload binary"
_STREAM = 1 << 19
#: Larger slices settle more repeats before the shuffle.
SLICE = 2 << 20


def labels(spark: SparkSession, n: int) -> np.ndarray:
    """n integers that repartition(n, ..) sends to n different partitions; beyond 4096, where chance is even enough, 0..n-1."""
    if n > 4096:
        return np.arange(n)
    out, at = np.full(n, -1, np.int64), 0
    while (out < 0).any():
        for value, to in spark.range(at, at + 16 * n, 1, 1).selectExpr("id", f"pmod(hash(cast(id as int)), {n})").collect():
            if out[to] < 0:
                out[to] = value
        at += 16 * n
    return out


def _planes(a: np.ndarray) -> bytes:
    """The bytes of an integer array by significance, so that small values leave long runs of zeros to the shuffle's compression."""
    return np.ascontiguousarray(a.view(np.uint8).reshape(-1, a.itemsize).T).tobytes()


def _read(raw: memoryview, at: int, n: int, dtype: str) -> tuple[np.ndarray, int]:
    size = np.dtype(dtype).itemsize
    planes = np.frombuffer(raw, np.uint8, n * size, at).reshape(size, n)
    return np.ascontiguousarray(planes.T).view(dtype).ravel(), at + n * size


def pack(key: np.ndarray, pos: np.ndarray, hashes: np.ndarray | None = None, many: np.ndarray | None = None) -> bytes:
    """Entries (document key, position) that are sorted by document and position in it, with hashes and flags or without."""
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (pos[1:] < pos[:-1])  # rows that repeat have one key
    first = np.flatnonzero(new)
    delta = np.diff(pos, prepend=0)
    delta[first] = pos[first]
    head = np.array([len(first), len(key), hashes is not None], "<u4").tobytes()
    parts = [head, key[first].astype("<i8").tobytes(), _planes(np.diff(first, append=len(key)).astype("<u4")), _planes(delta.astype("<u4"))]
    if hashes is not None:
        parts += [hashes.astype("<u8").tobytes(), np.packbits(many).tobytes()]
    return b"".join(parts)


def unpack(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray | None, np.ndarray | None]:
    docs, n, hashed = np.frombuffer(raw, "<u4", 3).tolist()
    raw, at = memoryview(raw), 12
    keys = np.frombuffer(raw, "<i8", docs, at)
    counts, at = _read(raw, at + 8 * docs, docs, "<u4")
    delta, at = _read(raw, at, n, "<u4")
    sums, first = np.cumsum(delta.astype(np.int64)), np.cumsum(counts.astype(np.int64)) - counts
    before = np.where(first > 0, sums[first - 1], 0) if docs else first
    key, pos = np.repeat(keys, counts), sums - np.repeat(before, counts)
    if not hashed:
        return key, pos, None, None
    hashes = np.frombuffer(raw, "<u8", n, at)
    return key, pos, hashes, np.unpackbits(np.frombuffer(raw, np.uint8, -1, at + 8 * n), count=n).astype(bool)


def repeats(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each entry, whether its hash occurs again among these, and whether it is the first of its hash."""
    order = np.argsort(hashes, kind="stable")
    h = hashes[order]
    new = np.ones(len(h), bool)
    new[1:] = h[1:] != h[:-1]
    first = np.flatnonzero(new)
    size = np.diff(first, append=len(h))
    many, lead = np.empty(len(h), bool), np.empty(len(h), bool)
    many[order], lead[order] = np.repeat(size > 1, size), new
    return many, lead


class Router:
    """Sends entries to hash buckets and documents' buckets."""

    def __init__(self, spark: SparkSession, n: int):
        self.n, self.label = n, labels(spark, n)

    def _rows(self, to: np.ndarray, kind: int, packed: Callable[[np.ndarray], bytes]) -> Iterator[tuple]:
        order = np.argsort(to, kind="stable")
        cuts = np.flatnonzero(np.diff(to[order])) + 1
        for part in np.split(order, cuts) if len(order) else ():
            yield int(self.label[to[part[0]]]), kind, packed(part)

    def candidates(self, key: np.ndarray, pos: np.ndarray, hashes: np.ndarray, copied: np.ndarray | None = None) -> list[tuple]:
        """Rows for a slice's entries, sorted by document and position; those of `copied` rows repeat anyway."""
        many, lead = repeats(hashes)
        if copied is not None and copied.any():
            order = np.argsort(hashes, kind="stable")
            first = np.flatnonzero(lead[order])
            many[order] |= np.repeat(np.logical_or.reduceat(copied[order], first), np.diff(first, append=len(order)))
        out = self.known(key[many], pos[many])
        k, p, h, m = key[lead], pos[lead], hashes[lead], many[lead]
        return out + list(self._rows(self.place(h), CANDIDATES, lambda i: pack(k[i], p[i], h[i], m[i])))

    def place(self, hashes: np.ndarray) -> np.ndarray:
        """The bucket of each hash, evenly even where the hashes were chosen for being small."""
        return ((mix(hashes) >> np.uint64(32)) * np.uint64(self.n) >> np.uint64(32)).astype(np.int64)

    def known(self, key: np.ndarray, pos: np.ndarray) -> list[tuple]:
        """Rows for entries that are known to repeat, sorted by document and position."""
        return list(self._rows(np.mod(key, self.n), KNOWN, lambda i: pack(key[i], pos[i])))


def batch(rows: list[tuple]) -> pa.RecordBatch:
    bucket, kind, payload = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), pa.array(kind, pa.int32()), pa.array(payload, pa.binary())], ["bucket", "kind", "payload"])


class _Seen:
    """The different hashes of one task, each with the entry that came first; `open` ones have not been found again.

    They lie in CELLS sorted parts by their leading bits, and an insertion copies one part, so there is never a second copy of all of them.
    """

    CELLS = 64

    def __init__(self):
        self.parts = [(np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int32), np.empty(0, bool)) for _ in range(self.CELLS)]

    def meet(self, key: np.ndarray, pos: np.ndarray, h: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Take in entries; those now known to repeat, older ones included, but not those flagged `many`, which their slice has told."""
        h = mix(h)  # hashes of a bucket share their leading bits
        order = np.argsort(h, kind="stable")
        h = h[order]
        cuts = np.searchsorted(h, np.arange(1, self.CELLS, dtype=np.uint64) << np.uint64(64 - self.CELLS.bit_length() + 1))
        out = [self._cell(c, key[at], pos[at], h[a:b], many[at]) for c, (a, b) in enumerate(zip([0, *cuts.tolist()], [*cuts.tolist(), len(h)], strict=True)) if b > a for at in [order[a:b]]]
        return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.empty(0, np.int64),) * 2

    def _cell(self, c: int, key: np.ndarray, pos: np.ndarray, h: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        hashes, keys, places, open_ = self.parts[c]
        new = np.ones(len(h), bool)
        new[1:] = h[1:] != h[:-1]
        first = np.flatnonzero(new)
        size = np.diff(first, append=len(h))
        at = np.searchsorted(hashes, h[first])
        old = at < len(hashes)
        old[old] = hashes[at[old]] == h[first][old]
        again = old | (size > 1) | np.logical_or.reduceat(many, first)
        tell = np.repeat(again, size) & ~many
        reopened = at[old]
        reopened = reopened[open_[reopened]]
        open_[reopened] = False
        out = np.concatenate([key[tell], keys[reopened]]), np.concatenate([pos[tell], places[reopened]])
        add = first[~old]
        if len(add):
            to = at[~old]
            self.parts[c] = np.insert(hashes, to, h[add]), np.insert(keys, to, key[add]), np.insert(places, to, pos[add]), np.insert(open_, to, ~again[~old])
        return out


def find(rows: DataFrame, router: Router, emit: Callable[[np.ndarray, np.ndarray], list[tuple]] | None = None) -> DataFrame:
    """rows (bucket, kind, payload) of candidates and known entries -> rows (bucket, kind, payload) of all known entries, by document bucket.

    emit makes the rows of known entries, router.known by default; rows of kind RUNS go through as they are.
    """
    emit = emit or router.known

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, waiting, size = _Seen(), [], 0
        told: list[tuple[np.ndarray, np.ndarray]] = []

        def out() -> pa.RecordBatch:
            nonlocal waiting, size, told
            if waiting:
                told.append(seen.meet(*(np.concatenate(x) for x in zip(*waiting, strict=True))))
            key, pos = (np.concatenate(x) for x in zip(*told, strict=True)) if told else (np.empty(0, np.int64),) * 2
            waiting, size, told = [], 0, []
            order = np.lexsort((pos, key))
            return batch(emit(key[order], pos[order]))

        for b in batches:
            for bucket, kind, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                if kind == RUNS:
                    yield batch([(bucket, kind, raw.as_py())])
                    continue
                key, pos, h, many = unpack(raw.as_py())
                if kind == KNOWN:
                    told.append((key, pos))
                else:
                    waiting.append((key, pos, h, many))
                size += len(key)
                if size >= _STREAM:
                    yield out()
        yield out()

    return rows.repartition(router.n, "bucket").mapInArrow(run, SCHEMA)


def row_key(docs: DataFrame, names: tuple[str, ...]) -> Column:
    """A hash of these columns of any type; nulls count, and maps as their JSON."""

    def has_map(kind: DataType) -> bool:
        return isinstance(kind, MapType) or isinstance(kind, ArrayType) and has_map(kind.elementType) or isinstance(kind, StructType) and any(has_map(f.dataType) for f in kind)

    return F.xxhash64(*[x for c in names for col in [F.col(quoted(c))] for x in (col.isNull(), F.to_json(F.struct(col.alias("c"))) if has_map(docs.schema[c].dataType) else col)])


def _weight(docs: DataFrame, names: tuple[str, ...]) -> Column:
    """Bytes of a row's text and of the columns it carries; texts of very short words count as six bytes a word, as their entries do."""
    words = F.length("text") - F.length(F.translate("text", " \t\n\x0b\f\r", ""))
    out = F.coalesce(F.greatest(F.octet_length("text"), 6 * words), F.lit(0))
    for c in names:
        kind = docs.schema[c].dataType
        if isinstance(kind, StringType | BinaryType):
            out += F.coalesce(F.octet_length(quoted(c)), F.lit(0))
        elif isinstance(kind, MapType | ArrayType | StructType):
            out += F.coalesce(F.length(F.to_json(F.struct(F.col(quoted(c)).alias("c")))), F.lit(0))
    return out


def distinct_rows(docs: DataFrame, carry: tuple[str, ...] = ()) -> tuple[DataFrame, int]:
    """(k, doc_id, text, copies, c0, c1, ..), every different row once with how often it occurs, and the bytes of all rows (_weight).

    k names a row by its id, text and the `carry` columns, of any types, which become c0.. . Copies of a row meet as counts, each task's first;
    where no row repeats, which is counted before, nothing is shuffled but one number a row.
    """
    columns = [row_key(docs, ("doc_id", "text", *carry)).alias("k"), "doc_id", "text"]
    rows = docs.select(*columns, *[F.col(quoted(c)).alias(f"c{i}") for i, c in enumerate(carry)])
    sizes = durable(docs.select(columns[0], _weight(docs, carry).alias("n")).groupBy("k").agg(F.count(F.lit(1)).alias("copies"), F.first("n").alias("n")))
    again = sizes.filter("copies > 1").select("k", "copies")
    total = sizes.agg(F.coalesce(F.sum(F.col("n") * 1.0), F.lit(0.0)), F.coalesce(F.max("copies"), F.lit(1))).first()
    rest = [F.col(f"c{i}") for i in range(len(carry))]
    if total[1] == 1:
        return rows.select("k", "doc_id", "text", F.lit(1).cast("long").alias("copies"), *rest), int(total[0])
    once = rows.join(again, "k", "left_anti").select("k", "doc_id", "text", F.lit(1).cast("long").alias("copies"), *rest)
    met = rows.join(again.select("k"), "k", "left_semi").groupBy("k").agg(F.first(F.struct("doc_id", "text", *rest)).alias("r"), F.count(F.lit(1)).alias("copies"))
    return once.union(met.select("k", "r.doc_id", "r.text", "copies", *[F.col(f"r.c{i}") for i in range(len(carry))])), int(total[0])


def repeated_out(df: DataFrame, block: int = 1 << 12) -> DataFrame:
    """df without its column `copies`, each row so often."""
    blocks = df.withColumn("_at", F.expr(f"explode(sequence(0L, (copies - 1) div {block}))"))
    return blocks.withColumn("_at", F.expr(f"explode(sequence(1L, least(copies - _at * {block}, {block}L)))")).drop("_at", "copies")


def dealt(rows: DataFrame, router: Router) -> DataFrame:
    """rows of distinct_rows by bucket, with the bucket in front."""
    label = F.array(*[F.lit(int(x)) for x in router.label]) if router.n <= 4096 else None
    spot = F.pmod("k", F.lit(router.n))
    bucket = F.element_at(label, (spot + 1).cast("int")) if label is not None else spot
    return rows.select(bucket.cast("int").alias("bucket"), "*").repartition(router.n, "bucket")


class Told:
    """A bucket's known entries, looked up for a slice."""

    def __init__(self, table: pa.Table):
        parts = [unpack(x.as_py())[:2] for x in table.column("payload")]
        key, pos = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.empty(0, np.int64),) * 2
        order = np.lexsort((pos, key))
        key, pos = key[order], pos[order]
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (pos[1:] != pos[:-1])
        self.key, self.pos = key[new], pos[new]

    def of(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row of keys, position) for all rows."""
        lo, hi = np.searchsorted(self.key, keys, "left"), np.searchsorted(self.key, keys, "right")
        return np.repeat(np.arange(len(keys)), hi - lo), self.pos[fill(lo, hi - lo)]


def scan(rows: DataFrame, entries: Callable[[Slice, np.ndarray, np.ndarray], list[tuple]], size: int = SLICE) -> DataFrame:
    """Rows that `entries` makes of each slice, its documents' keys and whether they have copies; nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in slices(batches, size=size):
            yield batch(entries(s, s.column("k"), s.column("copies") > 1))

    return rows.select("k", "text", "copies").mapInArrow(run, SCHEMA)


def with_told(dealt: DataFrame, known: DataFrame, work: Callable[[Slice, np.ndarray, np.ndarray], pa.RecordBatch], schema: str | StructType, size: int = SLICE) -> DataFrame:
    """work(slice, rows, positions) over the documents of each bucket together with what is known of them."""

    def run(left: pa.Table, right: pa.Table) -> Iterator[pa.RecordBatch] | pa.Table:
        told = Told(right)
        out = [work(s, *told.of(s.column("k"))) for s in slices(iter(left.combine_chunks().to_batches()), size=size)]
        return pa.Table.from_batches(out) if out else empty

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    empty = to_arrow_schema(_parse_datatype_string(schema) if isinstance(schema, str) else schema).empty_table()
    return dealt.groupBy("bucket").cogroup(known.groupBy("bucket")).applyInArrow(run, schema)


def router_for(spark: SparkSession, text_bytes: int, per_bucket: int = 24 << 20) -> Router:
    """Buckets of about per_bucket bytes of text, and no fewer than the session's shuffle partitions."""
    return Router(spark, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-text_bytes // per_bucket)))
