"""Token ids on disk: every document its own zstandard frame, all with one dictionary trained on serialised id arrays.

A file set is two tables in a folder any Hadoop file system can hold. `dictionary`: one row (sha256, width, bytes, kind, samples), of
kind `trained`, `raw` where zstandard finds the samples too few to train on and their bytes are the dictionary, or `none`. `blocks`: rows
of about 1 MB (shard, block, dictionary sha256, tokens before it in its shard, doc_ids, n_tokens, offsets, payload).
Shards are ranges of doc_id in ascending order, blocks ascend in a shard, documents in a block. A short document is read by the
block whose first and last ids hold it, its slice of the payload and one frame.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.durable import partitions_for
from .textkit import Slice, slices
from .tokens import encoder

BLOCKS = "shard int, block int, dictionary string, tokens_before long, first_id long, last_id long, doc_ids array<long>, n_tokens array<long>, offsets array<long>, payload binary"
BLOCK_BYTES = 1 << 20
_CODECS: dict[tuple, object] = {}


def _codec(kind: type, dictionary: bytes, **more):
    key = (kind, dictionary)
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = kind(dict_data=zstandard.ZstdCompressionDict(dictionary), **more) if dictionary else kind(**more)
    return _CODECS[key]


def train_dictionary(docs: DataFrame, tokenizer: str, width: int, end_id: int, sample_docs: int, size: int, longest: int = 1 << 16) -> tuple[bytes, str, int]:
    """(dictionary, its kind, number of samples) from at most sample_docs documents of at most `longest` bytes, the least by a hash of their id."""
    short = docs.filter(F.col("doc_id").isNotNull() & (F.coalesce(F.octet_length("text"), F.lit(0)) <= longest))
    ids = short.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_docs).distinct()
    rows = short.select("doc_id", "text").join(F.broadcast(ids), "doc_id", "left_semi").limit(sample_docs).toArrow()
    encode, samples = encoder(tokenizer, True), []
    for s in slices(iter(rows.combine_chunks().to_batches())):
        got, first = encode.ids_with_end(s, end_id)
        samples += [got[a:b].astype(f"<u{width}").tobytes() for a, b in zip(first[:-1], first[1:], strict=True)]
    if not samples:
        return b"", "none", 0
    try:
        return zstandard.train_dictionary(size, samples).as_bytes(), "trained", len(samples)
    except zstandard.ZstdError:
        return b"".join(samples)[:size], "raw", len(samples)


def shard_bounds(docs: DataFrame, n: int, level: int = 512) -> np.ndarray:
    """Ascending doc_ids that cut the rows into about n even ranges: `level` quantiles, and quantiles of each of their ranges where n is more."""
    coarse = min(n, level)
    ids = docs.select("doc_id").filter("doc_id is not null")
    share = lambda k: [j / k for j in range(1, k)]
    bounds = np.unique(np.array(ids.agg(F.percentile_approx("doc_id", share(coarse), 50_000)).first()[0] or [], np.int64)) if coarse > 1 else np.empty(0, np.int64)
    fine = -(-n // coarse)
    if fine == 1:
        return bounds

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(np.searchsorted(bounds, b.column(0).to_numpy(zero_copy_only=False), "left")), b.column(0)], ["r", "doc_id"])

    # One row a coarse range, of as many numbers as it gets shards.
    rows = ids.mapInArrow(ranges, "r long, doc_id long").groupBy("r").agg(F.percentile_approx("doc_id", share(fine), 20 * fine).alias("q")).collect()
    return np.unique(np.concatenate([bounds, *(np.array(r.q, np.int64) for r in rows)]))


def write_ids(docs: DataFrame, path: str, tokenizer: str, *, end_id: int = 2, sample_docs: int = 1000, dictionary_size: int = 1 << 16, level: int = 3) -> None:
    """Write the ids of all documents (doc_id, text; other columns are ignored) to the folder `path`, in ascending doc_id order.

    Null and empty texts are the end id alone. A null doc_id sorts first. Rows of equal doc_id are kept, each as a document. An
    empty table gives files without blocks. sample_docs bounds what the dictionary is trained on, never what is written; more than
    1,000 documents do not make the files smaller (README).
    """
    spark = docs.sparkSession
    from tokenizers import Tokenizer

    width = 2 if max(Tokenizer.from_file(tokenizer).get_vocab_size(), end_id + 1) <= 1 << 16 else 4
    dictionary, kind, samples = train_dictionary(docs, tokenizer, width, end_id, sample_docs, dictionary_size)
    sha = hashlib.sha256(dictionary).hexdigest()
    spark.createDataFrame([(sha, width, dictionary, kind, samples)], "sha256 string, width int, bytes binary, kind string, samples int").coalesce(1).write.parquet(f"{path}/dictionary")
    n = partitions_for(docs)
    bounds = shard_bounds(docs, n)

    def compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, codec = encoder(tokenizer, True), _codec(zstandard.ZstdCompressor, dictionary, level=level, write_content_size=True)
        for s in slices(batches):
            ids, first = encode.ids_with_end(s, end_id)
            raw = ids.astype(f"<u{width}").tobytes()
            frames = [codec.compress(raw[a * width : b * width]) for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
            doc = s.rows.column(0)
            known = doc.fill_null(-(1 << 63)).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([pa.array(np.searchsorted(bounds, known, "left").astype(np.int32)), doc, pa.array(np.diff(first)), pa.array(frames, pa.binary())], ["shard", "doc_id", "n_tokens", "frame"])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, block, before, rows, size = None, 0, 0, [], 0

        def out() -> pa.RecordBatch:
            nonlocal block, before, rows, size
            ids, n, frames = zip(*rows, strict=True)
            offsets = np.concatenate([[0], np.cumsum([len(f) for f in frames])])
            values = [shard, block, sha, before, ids[0], ids[-1], list(ids), list(n), offsets.tolist(), b"".join(frames)]
            kinds = [pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64(), *[pa.list_(pa.int64())] * 3, pa.binary()]
            block, before, rows, size = block + 1, before + sum(n), [], 0
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], [c.split()[0] for c in BLOCKS.split(", ")])

        for b in batches:
            for k, *row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if rows and (k != shard or size > BLOCK_BYTES):
                    yield out()
                if k != shard:
                    shard, block, before = k, 0, 0
                rows.append(row)
                size += len(row[2])
        if rows:
            yield out()

    frames = docs.select("doc_id", "text").mapInArrow(compress, "shard int, doc_id long, n_tokens long, frame binary")
    dealt = frames.repartition(n, "shard").sortWithinPartitions("shard", "doc_id", "n_tokens", "frame")
    dealt.mapInArrow(blocks, BLOCKS).write.option("compression", "none").parquet(f"{path}/blocks")


def _dictionary(spark: SparkSession, path: str) -> tuple[str, int, bytes]:
    sha, width, raw = spark.read.parquet(f"{path}/dictionary").select("sha256", "width", "bytes").first()
    if hashlib.sha256(raw).hexdigest() != sha:
        raise ValueError("the dictionary does not match its hash")
    return sha, width, bytes(raw)


def _frames(row: dict, width: int, dictionary: bytes) -> Iterator[np.ndarray]:
    codec, payload, at = _codec(zstandard.ZstdDecompressor, dictionary), memoryview(row["payload"]), row["offsets"]
    for a, b in zip(at[:-1], at[1:], strict=True):
        yield np.frombuffer(codec.decompress(payload[a:b]), f"<u{width}")


def read_ids(spark: SparkSession, path: str, digests_only: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32 and, unless digests_only, ids) of every document in the files; start counts the ids of all before it."""
    sha, width, dictionary = _dictionary(spark, path)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                if row["dictionary"] != sha:
                    raise ValueError("a block was written with another dictionary")
                ids = [x.astype("<u4") for x in _frames(row, width, dictionary)]
                n = np.array([len(x) for x in ids], np.int64)
                start = row["shard_start"] + row["tokens_before"] + np.cumsum(n) - n
                arrays = [pa.array(row["doc_ids"], pa.int64()), pa.array(start), pa.array(n), pa.array([zlib.crc32(x) for x in ids], pa.int64())]
                names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                if not digests_only:
                    arrays.append(pa.array([x.astype(np.int64) for x in ids], pa.list_(pa.int64())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(arrays, names)

    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    totals = blocks.select("shard", F.expr("aggregate(n_tokens, 0L, (a, x) -> a + x)").alias("n")).groupBy("shard").agg(F.sum("n").alias("n"))
    # One row a shard, so the running sum is over as many rows as there are partitions, not documents.
    totals = totals.selectExpr("shard", "sum(n) over (order by shard) - n as shard_start")
    return blocks.join(totals, "shard").mapInArrow(decode, "doc_id long, start long, n_tokens long, ids_crc32 long" + ("" if digests_only else ", ids array<long>"))


def read_document(spark: SparkSession, path: str, doc_id: int) -> list[int] | None:
    """The ids of one document, from the one block that holds it."""
    _, width, dictionary = _dictionary(spark, path)
    row = spark.read.schema(BLOCKS).parquet(f"{path}/blocks").filter((F.col("first_id") <= doc_id) & (F.col("last_id") >= doc_id) & F.array_contains("doc_ids", doc_id)).first()
    if row is None:
        return None
    k = row["doc_ids"].index(doc_id)
    frame = memoryview(row["payload"])[row["offsets"][k] : row["offsets"][k + 1]]
    return np.frombuffer(_codec(zstandard.ZstdDecompressor, dictionary).decompress(frame), f"<u{width}").tolist()


__all__ = ["Slice", "read_document", "read_ids", "train_dictionary", "write_ids"]
