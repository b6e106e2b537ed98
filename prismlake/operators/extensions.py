"""Extension points for SQL users: a table function that finds hashes within a radius, and a grouped aggregate of vectors.

    register(spark)
    SELECT DISTINCT x.h AS query, y.h AS found FROM
        (SELECT h, p.* FROM queries, LATERAL hash_probes(h, 12, TRUE) p) x JOIN
        (SELECT h, p.* FROM hashes, LATERAL hash_probes(h, 12, FALSE) p) y USING (part, value) WHERE bit_count(x.h ^ y.h) <= 12

The table function runs where its rows are, at most 500 rows out for one in and both sides together; the join on its rows is Spark's,
which splits hot values. A grouped aggregate in Python takes a group whole, so it is used in two levels, as centroids() does.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StructType

from ..plans.tiles import table_of
from .duplicates import Part, even_parts, near_hashes


_PROBE = StructType().add("part", IntegerType()).add("value", LongType())


@cache
def _masks(radius: int, first: bool) -> list[tuple[int, int, list[int]]]:
    return _flips(even_parts(radius), first)


def _flips(parts: list[Part], first: bool) -> list[tuple[int, int, list[int]]]:
    return [(p.offset, (1 << p.width) - 1, p.masks(first)) for p in parts]


def hash_probes(parts: Mapping[int, list[Part]] | None = None):
    """The table function hash_probes(hash bigint, radius int, first boolean) -> (part int, value bigint).

    Any two hashes within the radius share a row if one of them is probed with first true and the other with first false; others may,
    so the join verifies. A null argument gives no rows. parts: cuts by radius as hamming_parts() counts them on the hashes at hand;
    a radius that is not there is cut as for even bits, which is as right but slower where many hashes share bits.
    """
    counted = {(r, first): _flips(p, first) for r, p in (parts or {}).items() for first in (True, False)}

    class HashProbes:
        def eval(self, hash: int, radius: int, first: bool) -> Iterator[tuple[int, int]]:
            if hash is None or radius is None or first is None:
                return
            h = hash & 0xFFFFFFFFFFFFFFFF
            for k, (offset, low, masks) in enumerate(counted.get((radius, first)) or _masks(radius, first)):
                own = h >> offset & low
                for m in masks:
                    v = own ^ m
                    yield k, v - (1 << 64) if v >> 63 else v

    return F.udtf(HashProbes, returnType=_PROBE, useArrow=True)


_NEAR = StructType().add("a", LongType()).add("b", LongType()).add("distance", IntegerType())


class HashBlockPairs:
    """The table function hash_block_pairs(x binary, y binary, same boolean, radius int) -> (a bigint, b bigint, distance int).

    Different hashes within the radius of two blocks (column a, as tiles.packed() makes them), a < b; same: both are one block. For radii at which a cut of the hashes lets so many
    candidates through that the join on hash_probes is dearer than comparing all pairs (duplicates.WIDE).
    """

    def eval(self, x: bytes, y: bytes, same: bool, radius: int) -> Iterator[tuple[int, int, int]]:
        if x is None or y is None or same is None or radius is None:
            return
        for batch in near_hashes(radius)(table_of(x), table_of(y), same):
            yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def _vector_sum(vector: pa.Array, weight: pa.Array) -> pa.Scalar:
    """Sum of weight * vector over a group, null where no row has both; vectors of different lengths are an error."""
    keep = pc.and_(pc.is_valid(vector), pc.is_valid(weight))
    v, w = vector.filter(keep), weight.filter(keep)
    if not len(v):
        return None
    wide = pc.list_value_length(v).to_numpy(zero_copy_only=False)
    if wide.min() != wide.max():
        raise ValueError("the vectors of a group have one length")
    rows = v.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(v), int(wide[0]))
    return (w.to_numpy(zero_copy_only=False).astype(float) @ rows).tolist()


vector_sum = F.arrow_udf(_vector_sum, ArrayType(DoubleType()))


def register(spark: SparkSession, parts: Mapping[int, list[Part]] | None = None) -> None:
    """hash_probes, hash_block_pairs and vector_sum(vector, weight) for the session's SQL."""
    spark.udtf.register("hash_probes", hash_probes(parts))
    spark.udtf.register("hash_block_pairs", F.udtf(HashBlockPairs, returnType=_NEAR, useArrow=True))
    spark.udf.register("vector_sum", vector_sum)


def centroids(df: DataFrame, by: str, vector: str, weight: str, key: str, per_task: int = 50_000) -> DataFrame:
    """(by, centroid, weight): the mean of a group's vectors, weighted; null where the weights of its vectors add up to zero.

    A group is summed in shares of about `per_task` rows, dealt by the hash of `key`, an id of the rows, and the shares' sums are summed:
    no task holds a hot group. Rows without a vector or a weight take no part; a null group is a group.
    """
    # One more component of 1 makes the last one of a sum its weight.
    v = F.concat(F.col(vector).cast("array<double>"), F.array(F.lit(1.0)))
    rows = df.select(F.col(by).alias("g"), v.alias("v"), F.col(weight).cast("double").alias("w"), F.xxhash64(key).alias("h"))
    hot = rows.groupBy(F.col("g").alias("k")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > per_task)
    share = F.coalesce(F.pmod("h", F.ceil(F.col("n") / per_task)), F.lit(0)).alias("share")
    shares = rows.join(hot, F.col("g").eqNullSafe(F.col("k")), "left").select("g", share, "v", "w")
    part = shares.groupBy("g", "share").agg(vector_sum("v", "w").alias("s")).withColumn("one", F.lit(1.0))
    total = part.groupBy("g").agg(vector_sum("s", "one").alias("s"))
    w = F.element_at("s", -1)
    mean = F.when(w != 0, F.transform(F.slice("s", 1, F.size("s") - 1), lambda x: x / w))
    return total.select(F.col("g").alias(by), mean.alias("centroid"), w.alias("weight"))
