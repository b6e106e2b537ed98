"""SimHash near-duplicates by Golay-code fuzzy hashing.

Fingerprints are cut into three segments of at most 23 bits. A pair within two differing bits leaves at least one segment untouched
(pigeonhole), and at most two errors in any other. The perfect binary Golay code puts every 23-bit word within three errors of one
codeword; the codewords nearest a segment and each of its one-bit neighbours are its keys (one to six of them), and two segments
within two errors always share one, through the word half way between them. So a key is (untouched segment's bits, a codeword index
of the next segment); fingerprints that share a key are verified bit by bit. A bucket with more than `hot_bucket` different
fingerprints is not paired: its members meet at their one-bit neighbours instead, which links exactly those within two bits through
65 rows each. Equal fingerprints are one vertex, so copies never make pairs.

near_copies() is for texts that share most of their shingles rather than for fingerprints within a fixed distance. Its fingerprints
are of a text's different words, of which near copies share more than of its shingles, and there are several, each with its own hash.
Their keys are the same; texts that share a key are compared by their sets of shingles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..plans.components import connected_components
from ..plans.durable import durable
from .textkit import Windows, mix, quoted, range_hashes, slices

#: (first bit, bits) of the segments.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: The generator polynomial of the binary Golay code [23, 12, 7]: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GENERATOR = 0b110001110101
_TABLES: list[np.ndarray] = []


def syndromes(words: np.ndarray) -> np.ndarray:
    """The remainder of 23-bit words by the generator polynomial."""
    r = words.astype(np.int64)
    for bit in range(22, 10, -1):
        r = np.where(r >> bit & 1, r ^ (GENERATOR << (bit - 11)), r)
    return r


def golay_decode(words: np.ndarray) -> np.ndarray:
    """The index (message bits) of the codeword within three errors of each 23-bit word; the code is perfect, so there is exactly one."""
    if not _TABLES:
        one = 1 << np.arange(23)
        errors = [np.zeros(1, np.int64), one]
        i, j = np.triu_indices(23, 1)
        errors.append(one[i] | one[j])
        errors.append(np.array([one[a] | one[b] | one[c] for a in range(23) for b in range(a) for c in range(b)]))
        errors = np.concatenate(errors)
        table = np.full(2048, -1, np.int64)
        table[syndromes(errors)] = errors
        assert (table >= 0).all(), "not a perfect code"
        _TABLES.append(table)
    return (words ^ _TABLES[0][syndromes(words)]) >> 11


def golay_keys(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position in words, codeword index): the codewords nearest each word and its one-bit neighbours, each once."""
    flips = np.concatenate([[0], 1 << np.arange(23)])
    found = golay_decode((words[:, None] ^ flips).ravel()).reshape(len(words), 24)
    found.sort(axis=1)
    new = np.ones(found.shape, bool)
    new[:, 1:] = found[:, 1:] != found[:, :-1]
    rows, cols = np.nonzero(new)
    return rows, found[rows, cols]


def fingerprint(text: bytes, shingle: int = 3, seed: int = 42) -> int:
    """SimHash of a text's shingles of ASCII-lower-cased words: a bit is 1 if set in over half of the shingles' XXH64."""
    words = text.lower().split()
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) < shingle:
        parts = [b" ".join(words)]
    else:
        parts = map(b" ".join, zip(*(words[k:] for k in range(shingle)), strict=False))
    h = np.array([digest(p, seed) for p in parts], np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 16):
        bits = np.unpackbits(h[at : at + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h)).view(">u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, row_key, fp): the signed 64-bit fingerprint of each whole text. Null and wordless texts get zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in slices(batches):
            raw, off = s.data.tobytes(), s.off.tolist()
            fp = np.array([fingerprint(raw[a:b], shingle) for a, b in zip(off[:-1], off[1:], strict=True)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([s.rows.column(0), s.rows.column(1), pa.array(fp)], ["doc_id", "row_key", "fp"])

    return docs.select("doc_id", F.xxhash64("doc_id", "text").alias("row_key"), "text").mapInArrow(run, "doc_id long, row_key long, fp long")


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fp = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        for at in range(0, len(fp), 1 << 15):
            part = fp[at : at + (1 << 15)]
            segment = [(part >> np.uint64(b) & np.uint64((1 << n) - 1)).astype(np.int64) for b, n in SEGMENTS]
            for k in range(3):
                rows, index = golay_keys(segment[(k + 1) % 3])
                key = segment[k][rows] << 14 | index << 2 | k
                yield pa.RecordBatch.from_arrays([pa.array(part.view(np.int64)[rows]), pa.array(key)], ["fp", "key"])


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    flips = np.concatenate([[0], np.uint64(1) << np.arange(64, dtype=np.uint64)]).astype(np.uint64)
    for batch in batches:
        fp = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        for at in range(0, len(fp), 1 << 13):
            part = fp[at : at + (1 << 13)]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(part.view(np.int64), 65)), pa.array((part[:, None] ^ flips).ravel().view(np.int64))], ["fp", "key"])


def links(distinct_fp: DataFrame, hot_bucket: int = 64) -> DataFrame:
    """Edges (a, b) between different fingerprints such that their connected components are those of all pairs within two bits."""
    keys = durable(distinct_fp.select("fp").mapInArrow(_keys, "fp long, key long"))
    sizes = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    usual, hot = sizes.filter(F.col("n") <= hot_bucket).select("key"), sizes.filter(F.col("n") > hot_bucket).select("key")
    cold = keys.join(usual, "key")
    pairs = cold.alias("x").join(cold.alias("y"), "key").filter("x.fp < y.fp and bit_count(x.fp ^ y.fp) <= 2").selectExpr("x.fp as a", "y.fp as b")
    members = keys.join(hot, "key", "left_semi").select("fp").distinct().mapInArrow(_neighbours, "fp long, key long")
    least = members.groupBy("key").agg(F.min("fp").alias("a"), F.max("fp").alias("top")).filter("a < top")
    stars = members.join(least, "key").filter("fp > a").select("a", F.col("fp").alias("b"))
    return pairs.union(stars).distinct()


def near_duplicates(docs: DataFrame, hot_bucket: int = 64, shingle: int = 3) -> DataFrame:
    """(doc_id, fp, component_id, row_key) of every document: component_id is the least doc_id that links reach, row_key a hash of id and text.

    docs: doc_id, text; other columns are ignored. Links join fingerprints within two bits. Null and wordless texts have fingerprint
    zero and link like any other. A null doc_id is kept and counts as larger than any other. Repeated rows each give a row.
    """
    return _classes(docs, hot_bucket, shingle).select("doc_id", "fp", "component_id", "row_key")


def _classes(docs: DataFrame, hot_bucket: int, shingle: int) -> DataFrame:
    """near_duplicates with `component`, the least fingerprint that links reach, which tells components apart whose doc_ids are all null."""
    prints = durable(fingerprints(docs, shingle))
    own = durable(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    parts = connected_components(links(own, hot_bucket))
    joined = own.join(parts.withColumnRenamed("id", "fp"), "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    heads = joined.groupBy("component").agg(F.min("least").alias("component_id"))
    return prints.join(joined.join(heads, "component").select("fp", "component", "component_id"), "fp")


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class _Shingles:
    """The words and shingles of a slice's texts, A-Z lower-cased: text k has the codes word[first[k]:first[k+1]]."""

    def __init__(self, s, width: int):
        data = _LOWER[s.data]
        start, end, self.first = s.words(data)
        self.word, self.width = range_hashes(data, start, end), width
        self.runs = Windows(self.word)
        self.wide = self.runs.of(width)

    def of(self, k: int) -> np.ndarray:
        """The different shingles of text k in order; a text of fewer words is one shingle, one without words none."""
        a, b = self.first[k], self.first[k + 1]
        if b - a >= self.width:
            return np.unique(self.wide[a : b - self.width + 1])
        return self.runs.of(int(b - a))[a : a + 1] if b > a else np.empty(0, np.uint64)


def word_prints(words: np.ndarray, n: int) -> np.ndarray:
    """n SimHashes of a set of words."""
    out = np.zeros(n, np.uint64)
    for t in range(n):
        h = mix(words ^ mix(np.array([t + 1], np.uint64)))
        ones = np.zeros(64, np.int64)
        for at in range(0, len(h), 1 << 16):
            ones += np.unpackbits(h[at : at + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
        out[t] = np.packbits(2 * ones > len(h)).view(">u8")[0]
    return out


def _word_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        vertex = batch.column(0).to_numpy(zero_copy_only=False)
        for t, column in enumerate(batch.columns[1:]):
            for part in _keys(iter([pa.RecordBatch.from_arrays([column], ["fp"])])):
                fp, at = np.unique(column.to_numpy(zero_copy_only=False), return_inverse=True)
                place = np.searchsorted(fp, part.column(0).to_numpy())
                # Each vertex of a fingerprint gets its keys.
                members = np.argsort(at, kind="stable")
                size = np.bincount(at, minlength=len(fp))
                begin = np.cumsum(size) - size
                which = np.repeat(begin[place] - np.cumsum(size[place]) + size[place], size[place]) + np.arange(size[place].sum())
                key = np.repeat(part.column(1).to_numpy() | t << 40, size[place])
                yield pa.RecordBatch.from_arrays([pa.array(vertex[members[which]]), pa.array(key)], ["vertex", "key"])


def near_copies(docs: DataFrame, *, shingle: int = 5, similarity: float = 0.8, prints: int = 4, hot_bucket: int = 8) -> DataFrame:
    """(doc_id, row_key, vertex, component) of every document: components of texts whose sets of shingles have a Jaccard similarity of at least `similarity`.

    docs: doc_id, text; other columns are ignored. Texts with equal sets are one vertex, wordless and null ones too. Pairs that share
    a key are found and compared exactly; how many do is a matter of `prints`. Members of buckets of more than hot_bucket are joined by
    their rarest shingles instead of in pairs (_alike_in_crowds), which finds all that are alike. Repeated rows each give a row; an
    empty table gives an empty result.
    """
    names = [f"f{t}" for t in range(prints)]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in slices(batches):
            g, vertex, size, fp = _Shingles(s, shingle), np.empty(len(s), np.int64), np.empty(len(s), np.int64), np.empty((prints, len(s)), np.int64)
            for k in range(len(s)):
                own = g.of(k)
                vertex[k], size[k] = np.array([xxhash.xxh3_64_intdigest(own.tobytes())], np.uint64).view(np.int64)[0], len(own)
                fp[:, k] = word_prints(np.unique(g.word[g.first[k] : g.first[k + 1]]), prints).view(np.int64)
            yield pa.RecordBatch.from_arrays([*s.rows.columns[:2], pa.array(vertex), pa.array(size), *map(pa.array, fp)], ["doc_id", "row_key", "vertex", "size", *names])

    keyed = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("row_key"), "text")
    found = durable(keyed.mapInArrow(scan, StructType([docs.schema["doc_id"], *(StructField(f, LongType()) for f in ("row_key", "vertex", "size", *names))])))
    own = found.groupBy("vertex").agg(F.first("size").alias("size"), F.min("row_key").alias("row_key"), *[F.first(f).alias(f) for f in names]).filter("size > 0")
    own = durable(own)
    keys = own.select("vertex", *names).mapInArrow(_word_keys, "vertex long, key long")
    keys = durable(keys)
    met = durable(keys.join(keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "key"))
    cold, hot = met.filter(F.col("n") <= hot_bucket), met.filter(F.col("n") > hot_bucket).select("key", "vertex")
    a, b = F.least("x.vertex", "y.vertex").alias("a"), F.greatest("x.vertex", "y.vertex").alias("b")
    pairs = cold.alias("x").join(cold.alias("y"), "key").filter("x.vertex < y.vertex").select(a, b)
    links = _alike(docs, own, pairs, shingle, similarity)
    if not hot.isEmpty():
        links = links.union(_alike_in_crowds(docs, own, hot.select("vertex").distinct(), shingle, similarity, hot_bucket))
    parts = connected_components(links)
    return found.select("doc_id", "row_key", "vertex").join(parts.withColumnRenamed("id", "vertex"), "vertex", "left").select("doc_id", "row_key", "vertex", F.coalesce("component", "vertex").alias("component"))


def _sets(docs: DataFrame, own: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """(vertex, shingles) of the wanted vertices, a table of its own; shingles: sorted 64-bit hashes."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in slices(batches):
            g = _Shingles(s, shingle)
            lists = [g.of(k).view(np.int64) for k in range(len(s))]
            ends = np.cumsum([0, *map(len, lists)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([s.rows.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(lists)))], ["vertex", "shingles"])

    texts = docs.select(F.xxhash64("doc_id", "text").alias("row_key"), "text")
    got = texts.join(wanted.join(own.select("vertex", "row_key"), "vertex"), "row_key").select("vertex", "text").dropDuplicates(["vertex"])
    return durable(got.mapInArrow(sets, "vertex long, shingles array<long>"))


def _compared(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose sets are similar, a table of its own."""
    x, y = sets.toDF("a", "sa"), sets.toDF("b", "sb")
    both = pairs.distinct().join(x, "a").join(y, "b").withColumns({"na": F.size("sa"), "nb": F.size("sb")})
    both = both.filter(F.least("na", "nb") >= similarity * F.greatest("na", "nb") - 1e-9)
    shared = F.size(F.array_intersect("sa", "sb"))
    return durable(both.filter(shared >= similarity * (F.col("na") + F.col("nb") - shared) - 1e-9).select("a", "b"))


def _alike(docs: DataFrame, own: DataFrame, pairs: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """The pairs (a, b) of vertices whose sets of shingles are similar."""
    sizes = own.select("vertex", "size")
    pairs = pairs.distinct().join(sizes.toDF("a", "na"), "a").join(sizes.toDF("b", "nb"), "b").filter(F.least("na", "nb") >= similarity * F.greatest("na", "nb") - 1e-9)
    pairs = durable(pairs.select("a", "b"))
    wanted = pairs.select(F.col("a").alias("vertex")).union(pairs.select("b")).distinct()
    return _compared(pairs, _sets(docs, own, wanted, shingle), similarity)


def _alike_in_crowds(docs: DataFrame, own: DataFrame, crowd: DataFrame, shingle: int, similarity: float, hot_bucket: int) -> DataFrame:
    """Links between vertices of `crowd` whose components are those of all similar pairs among them.

    Two sets with a Jaccard similarity of s share one of the (1 - s) n + 1 rarest shingles of either, so only these are joined: texts that have
    much in common but each a fifth of their own never meet; and from the places of the first such shingle in both orders of
    rarity follows how much they can share at most. Where a rare shingle is in more than hot_bucket sets, all are compared with three, among
    them the one with the most common shingles, the likely centre; those unlike all three are joined with every one by those places.
    """
    place = ["n", "place"]
    possible = 1 + F.least(F.col("x.n") - F.col("x.place"), F.col("y.n") - F.col("y.place")) >= similarity / (1 + similarity) * (F.col("x.n") + F.col("y.n")) - 1e-9
    sets = _sets(docs, own, crowd, shingle)
    each = sets.select("vertex", F.size("shingles").alias("n"), F.explode("shingles").alias("g"))
    often = each.groupBy("g").agg(F.count(F.lit(1)).alias("often"))
    ranked = each.join(often, "g").withColumn("place", F.row_number().over(Window.partitionBy("vertex").orderBy("often", "g")))
    ranked = ranked.withColumn("common", F.avg(F.log("often")).over(Window.partitionBy("vertex")))
    rare = ranked.filter((F.col("place") <= F.floor((1 - similarity) * F.col("n") + 1e-9) + 1) & (F.col("often") > 1)).select("g", "vertex", "common", *place)
    rare = durable(rare)
    rare = durable(rare.join(rare.groupBy("g").agg(F.count(F.lit(1)).alias("k")).filter("k > 1"), "g"))
    few, many = rare.filter(F.col("k") <= hot_bucket), rare.filter(F.col("k") > hot_bucket)
    a, b = F.least("x.vertex", "y.vertex").alias("a"), F.greatest("x.vertex", "y.vertex").alias("b")
    pairs = few.alias("x").join(few.alias("y"), (F.col("x.g") == F.col("y.g")) & F.expr("x.vertex < y.vertex") & possible).select(a, b)
    centre = many.groupBy("g").agg(F.max_by("vertex", F.struct("common", "vertex")).alias("p0"), F.max_by("vertex", F.struct(F.round("common", 1), F.xxhash64("vertex"))).alias("p1"), F.min_by("vertex", F.xxhash64("vertex")).alias("p2"))
    centre = centre.select("g", F.explode(F.array_distinct(F.array("p0", "p1", "p2"))).alias("vertex"))
    near = durable(many.alias("x").join(centre.alias("y"), "g").filter("x.vertex != y.vertex").select("x.g", F.col("x.vertex").alias("vertex"), F.col("y.vertex").alias("pivot")))
    links = _compared(pairs.union(near.select(F.least("vertex", "pivot").alias("a"), F.greatest("vertex", "pivot").alias("b"))), sets, similarity)
    like = links.select(F.col("a").alias("vertex"), F.col("b").alias("pivot")).union(links.select("b", "a"))
    left = many.select("g", "vertex", *place).join(centre, ["g", "vertex"], "left_anti").join(near.join(like, ["vertex", "pivot"], "left_semi").select("g", "vertex"), ["g", "vertex"], "left_anti")
    rest = left.alias("x").join(many.alias("y"), (F.col("x.g") == F.col("y.g")) & F.expr("x.vertex != y.vertex") & possible).select(a, b)
    return links.union(_compared(rest, sets, similarity))


def keep_one(docs: DataFrame, *, shingle: int = 5, similarity: float = 0.8, prints: int = 4, hot_bucket: int = 8) -> DataFrame:
    """docs, all columns, with one document of each component of near_copies: that with the least doc_id (null after all others), and of rows that repeat it one."""
    found = durable(near_copies(docs, shingle=shingle, similarity=similarity, prints=prints, hot_bucket=hot_bucket))
    first = found.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row_key")).alias("r")).select(F.col("r.row_key").alias("row_key"))
    gone = durable(found.select("row_key").distinct().join(first, "row_key", "left_anti"))
    kept = _with_key(docs).join(gone, F.col("_row_key") == F.col("row_key"), "left_anti")
    if not found.groupBy("row_key").count().filter("count > 1").isEmpty():
        n = F.row_number().over(Window.partitionBy("_row_key").orderBy("_row_key"))
        kept = kept.withColumn("_n", n).filter("_n = 1").drop("_n")
    return kept.select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(docs.columns)])


def _with_key(docs: DataFrame) -> DataFrame:
    """docs with columns c0, c1, .. and _row_key."""
    return docs.select(F.xxhash64("doc_id", "text").alias("_row_key"), *[F.col(quoted(c)).alias(f"c{k}") for k, c in enumerate(docs.columns)])
