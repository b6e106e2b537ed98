"""Connected components by alternating large-star and small-star rounds.

Every round is two grouped minima and joins over the edge table; hub vertices are pre-aggregated before the shuffle and their join
is one that adaptive execution may split. Edges, labels and components stay distributed; each round's edges are a table in the
shared folder, so lineage stays short and a lost executor loses nothing. A graph that has shrunk to at most `small` edges, counted
first, is finished by one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .durable import drop_table, write_table


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges (hi, lo), hi > lo. Large star: each vertex sends its larger neighbours to its least one; small star: the smaller ones and itself."""
    if large:
        both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(edges.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
    else:
        both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = both.join(least, "u")
    if large:
        moved = joined.filter("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo"))
    else:
        moved = joined.select(F.col("v").alias("hi"), F.col("m").alias("lo")).union(least.select(F.col("u").alias("hi"), F.col("m").alias("lo")))
    return moved.filter("hi > lo").distinct()


def hook_roots(root: np.ndarray, hi: np.ndarray, lo: np.ndarray) -> None:
    """Join the trees of edges between places; each place's root is the least place of its tree."""
    while (root[hi] != root[lo]).any():
        x, y = root[hi], root[lo]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root[:] = root[root]


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The components of all edges of one task, by hooking roots to the least neighbour and halving paths."""
    parts = [np.stack([b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)]) for b in batches if b.num_rows]
    if not parts:
        return
    ids, place = np.unique(np.concatenate(parts, axis=1), return_inverse=True)
    hi, lo = place.reshape(2, -1)
    root = np.arange(len(ids))
    hook_roots(root, hi, lo)
    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(ids[root])], ["id", "component"])


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60, small: int = 200_000) -> DataFrame:
    """(id, component) for every vertex of an edge that joins two different ones; component is the least id reachable.

    Null ends and self loops are ignored; an empty edge table gives an empty result.
    """
    spark = edges.sparkSession
    now = edges.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("hi") > F.col("lo"))).distinct()
    now, path = write_table(now)
    seen = None
    for _ in range(max_rounds):
        sign = tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first())
        if 0 < sign[0] <= small:
            return write_table(now.select(F.col("hi").cast("long"), F.col("lo").cast("long")).coalesce(1).mapInArrow(_finish, "id long, component long"))[0]
        if sign == seen or not sign[0]:
            return now.select(F.col("hi").alias("id"), F.col("lo").alias("component")).union(now.select(F.col("lo").alias("id"), F.col("lo").alias("component")).distinct())
        seen = sign
        after, new_path = write_table(_star(_star(now, large=True), large=False))
        drop_table(spark, path)
        now, path = after, new_path
    raise RuntimeError(f"connected components did not settle in {max_rounds} rounds")
