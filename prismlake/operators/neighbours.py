"""Exact nearest neighbours of vectors by inner product, with blocks that cannot meet left out.

Rows are dealt to the nearest of a few pivots, and a pivot's rows are packed into blocks of bounded size. With a pivot p and the largest distance r of a block's rows from it,
no product of rows of two blocks exceeds p.q + |p| s + |q| r + r s. Pairs of blocks of one pivot are multiplied first; then a pair is only multiplied if this bound reaches what all rows of the one block
already have as their k-th, or the least similarity asked for. A task reads a range of blocks against another, two blocks at a time in tiles, without a shuffle; it keeps the k best of each row in its range, and these lists meet by row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.durable import durable, size_in_bytes
from ..plans.tiles import product

#: Rows of a block, rows of a tile of products, pivots at most, rows for each pivot at least, rows of the sample that pivots are chosen from.
BLOCK, TILE, PIVOTS, PER_PIVOT, SAMPLE = 8192, 512, 256, 512, 4096
BLOCKS = "block long, cell int, n int, radius double, ids binary, vectors binary"
FOUND = "face_id long, neighbor long, similarity double"
#: Bytes of a range of blocks that a task reads against a range of others.
RANGE = 64 << 20
#: What rounding may add to a bound, for each unit of norms.
SLACK = 1e-9


def top_k(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("face_id").orderBy(F.desc("similarity"), "neighbor")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def _matrix(column: pa.Array) -> np.ndarray:
    return np.stack(column.to_numpy(zero_copy_only=False)).astype(np.float64)


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for b in batches:
        if b.num_rows:
            yield b.column(0).to_numpy(), _matrix(b.column(1))


def choose_pivots(vectors: DataFrame, n: int) -> np.ndarray:
    """Up to PIVOTS vectors of a bounded sample that lie far apart; they decide what is skipped, never what is found."""
    share = min(1.0, SAMPLE / max(n, 1))
    rows = vectors.filter(F.pmod(F.xxhash64("face_id"), F.lit(1 << 20)) <= int(share * (1 << 20))).select("vector").limit(2 * SAMPLE).collect()
    x = np.array([r.vector for r in rows], float)
    if not len(x):
        return np.empty((0, 0))
    chosen = [int(np.argmin(x @ x.mean(0)))]
    far = ((x - x[chosen[0]]) ** 2).sum(1)
    while len(chosen) < min(PIVOTS, n // PER_PIVOT) and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, ((x - x[chosen[-1]]) ** 2).sum(1))
    return x[chosen]


def _nearest_pivot(x: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    d = (x * x).sum(1)[:, None] + (pivots * pivots).sum(1) - 2 * (x @ pivots.T)
    cell = d.argmin(1)
    return cell, np.sqrt(((x - pivots[cell]) ** 2).sum(1))


def blocks_of(vectors: DataFrame, pivots: np.ndarray, block: int | None = None) -> DataFrame:
    """(block, cell, n, radius, ids, vectors): the rows (face_id, vector) by pivot, in blocks of about `block` rows; large cells are cut by a hash of the id."""
    block = block or BLOCK
    rows = vectors.select(F.col("face_id").cast("long").alias("face_id"), F.col("vector").cast("array<double>").alias("vector"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(len(pivots), np.int64)
        for _, x in _batches(batches):
            n += np.bincount(_nearest_pivot(x, pivots)[0], minlength=len(pivots))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(pivots), dtype=np.int32)), pa.array(n)], ["cell", "n"])

    sizes = dict(rows.mapInArrow(count, "cell int, n long").groupBy("cell").agg(F.sum("n")).collect())  # a row a pivot
    pieces = np.array([max(1, -(-sizes.get(c, 0) // block)) for c in range(len(pivots))])
    first = np.cumsum(pieces) - pieces

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, x in _batches(batches):
            cell, radius = _nearest_pivot(x, pivots)
            h = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            to = first[cell] + ((h >> np.uint64(33)).astype(np.int64) % pieces[cell])
            order = np.argsort(to, kind="stable")
            out = []
            for part in np.split(order, np.flatnonzero(np.diff(to[order])) + 1):
                out.append((int(to[part[0]]), int(cell[part[0]]), len(part), float(radius[part].max()), ids[part].astype("<i8").tobytes(), x[part].tobytes()))
            yield _rows(out)

    def pack(table: pa.Table) -> pa.Table:
        ids, x = (b"".join(v.as_py() for v in table.column(c)) for c in ("ids", "vectors"))
        row = (table.column("block")[0].as_py(), table.column("cell")[0].as_py(), sum(table.column("n").to_pylist()), max(table.column("radius").to_pylist()), ids, x)
        return pa.Table.from_batches([_rows([row])])

    if not len(pivots):
        return vectors.sparkSession.createDataFrame([], BLOCKS)
    return durable(rows.mapInArrow(deal, BLOCKS).repartition(int(pieces.sum()), "block").groupBy("block").applyInArrow(pack, BLOCKS))


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.float64(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [c.split()[0] for c in BLOCKS.split(", ")])


def bounded_pairs(left: DataFrame, right: DataFrame, pivots: np.ndarray) -> DataFrame:
    """(i, j, bound, own): every pair of a left and a right block with the most that a product of their rows can be, and whether they have one pivot."""
    norm, dot = np.linalg.norm(pivots, axis=1), pivots @ pivots.T
    cells = [(a, b, float(dot[a, b]), float(norm[a]), float(norm[b])) for a in range(len(pivots)) for b in range(len(pivots))]  # at most PIVOTS * PIVOTS
    cells = left.sparkSession.createDataFrame(cells, "cell_i int, cell_j int, dot double, norm_i double, norm_j double")
    i = left.select(F.col("block").alias("i"), F.col("cell").alias("cell_i"), F.col("radius").alias("r"))
    j = right.select(F.col("block").alias("j"), F.col("cell").alias("cell_j"), F.col("radius").alias("s"))
    reach = (F.col("norm_i") + F.col("r")) * (F.col("norm_j") + F.col("s"))
    bound = F.col("dot") + F.col("norm_i") * F.col("s") + F.col("norm_j") * F.col("r") + F.col("r") * F.col("s") + SLACK * (1 + reach)
    return i.join(F.broadcast(cells), "cell_i").join(j, "cell_j").select("i", "j", bound.alias("bound"), (F.col("cell_i") == F.col("cell_j")).alias("own"))


def _multiplied(pairs: DataFrame, left: DataFrame, right: DataFrame, k: int, least: float) -> DataFrame:
    """The k best of each left row among the rows of the right blocks that its block is paired with: k for each range of right blocks, which a task reads one after the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, ids, x, best = None, None, None, []
        for b in batches:
            for at, own_ids, own, other_ids, other in zip(*b.columns, strict=True):
                if at.as_py() != block:
                    yield from _lists(ids, best)
                    block, ids = at.as_py(), np.frombuffer(own_ids.as_py(), "<i8")
                    x = np.frombuffer(own.as_py()).reshape(len(ids), -1)
                    best = [_Best(s, len(ids[s : s + TILE]), k, least) for s in range(0, len(ids), TILE)]
                others = np.frombuffer(other_ids.as_py(), "<i8")
                y = np.frombuffer(other.as_py()).reshape(len(others), -1)
                for tile in best:
                    rows = slice(tile.first, tile.first + len(tile.floor))
                    sim = x[rows] @ y.T
                    sim[ids[rows, None] == others[None, :]] = -np.inf
                    tile.add(sim, others)
        yield from _lists(ids, best)

    wanted = pairs.groupBy("i").agg(F.collect_list("j").alias("js"))  # a number for each pair of blocks
    x = left.select(F.col("block").alias("i"), F.col("ids").alias("own_ids"), F.col("vectors").alias("own")).join(F.broadcast(wanted), "i")
    y = right.select(F.col("block").alias("j"), F.col("ids").alias("other_ids"), F.col("vectors").alias("other"))
    both = product(x, y.coalesce(max(1, size_in_bytes(y) // RANGE)), "array_contains(js, j)").select("i", "own_ids", "own", "other_ids", "other")
    return both.mapInArrow(run, FOUND)


class _Best:
    """The k best so far of a block's rows from `first` on, those of at least a similarity; of equal ones the least ids."""

    def __init__(self, first: int, rows: int, k: int, least: float):
        self.first, self.k, self.floor = first, k, np.full(rows, float(least))
        self.row, self.id, self.sim = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)

    def add(self, sim: np.ndarray, ids: np.ndarray) -> None:
        reach = sim >= self.floor[:, None]
        if reach.sum() > 4 * self.k * len(sim) and sim.shape[1] > self.k:
            reach = sim >= np.maximum(self.floor, np.partition(sim, -self.k, axis=1)[:, -self.k])[:, None]
        row, place = np.nonzero(reach)
        if not len(row):
            return
        row, of, sim = np.concatenate([self.row, row]), np.concatenate([self.id, ids[place]]), np.concatenate([self.sim, sim[row, place]])
        order = np.lexsort((of, -sim, row))
        row, of, sim = row[order], of[order], sim[order]
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        self.row, self.id, self.sim = (c[rank < self.k] for c in (row, of, sim))
        last = rank == self.k - 1
        self.floor[row[last]] = sim[last]


def _lists(ids: np.ndarray | None, best: list[_Best]) -> Iterator[pa.RecordBatch]:
    for tile in best:
        if len(tile.row):
            yield pa.RecordBatch.from_arrays([pa.array(ids[tile.first + tile.row]), pa.array(tile.id), pa.array(tile.sim)], ["face_id", "neighbor", "similarity"])


def between(left: DataFrame, right: DataFrame, k: int, least: float, block: int | None = None) -> DataFrame:
    """(face_id, neighbor, similarity, rank): for each row of left (face_id, vector) its k best among the other ids of right with at least that similarity, exactly; ties go to the least id.

    Either may be empty; vectors have one length and no nulls.
    """
    pivots = choose_pivots(right, right.count())
    if not len(pivots):
        return top_k(left.sparkSession.createDataFrame([], FOUND), k)
    y = blocks_of(right, pivots, block)
    x = y if left is right else blocks_of(left, pivots, block)
    pairs = durable(bounded_pairs(x, y, pivots).filter(F.col("bound") >= least))
    near = durable(_multiplied(pairs.filter("own"), x, y, k, least))
    far = durable(_multiplied(_open_pairs(pairs, near, x, k, least), x, y, k, least))
    return top_k(near.union(far), k)


def _open_pairs(pairs: DataFrame, near: DataFrame, left: DataFrame, k: int, least: float) -> DataFrame:
    """Pairs of different pivots whose bound reaches the worst k-th similarity that the left block's rows have found."""

    def ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, raw in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                own = np.frombuffer(raw.as_py(), "<i8")
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), block)), pa.array(own)], ["i", "face_id"])

    kth = top_k(near, k).filter(F.col("rank") == k).select("face_id", F.col("similarity").alias("kth"))
    floor = left.select("block", "ids").mapInArrow(ids, "i long, face_id long").join(kth, "face_id", "left").groupBy("i").agg(F.min(F.coalesce("kth", F.lit(least))).alias("floor"))
    return pairs.filter(~F.col("own")).join(floor, "i").filter(F.col("bound") >= F.col("floor"))


def nearest(vectors: DataFrame, k: int, least: float = 0.2, block: int | None = None) -> DataFrame:
    """(face_id, neighbor, similarity, rank): the k most similar others of each row of (face_id, vector) with at least that similarity."""
    vectors = durable(vectors.select("face_id", "vector"))
    return between(vectors, vectors, k, least, block)


def nearest_added(old: DataFrame, vectors: DataFrame, added: DataFrame, removed: DataFrame, k: int, least: float = 0.2, made_for: int | None = None) -> DataFrame:
    """The neighbour lists after adding and removing faces: lists that lost a member are made anew, the others learn only the new faces.

    added and removed: face_id; vectors holds all faces that remain. Where more than a third of the old faces go, or the lists were made for vectors of another length (made_for),
    all lists are made anew.
    """
    gone = removed.select("face_id").distinct()
    n_gone, n_added, n = gone.count(), added.count(), vectors.count()
    first = vectors.select(F.size("vector").alias("d")).first()
    if n_gone * 3 > max(n - n_added + n_gone, 1) or (made_for is not None and first is not None and first.d != made_for):
        return nearest(vectors, k, least)
    torn = old.join(gone.select(F.col("face_id").alias("neighbor")), "neighbor", "left_semi").select("face_id").union(added.select("face_id")).distinct().join(gone, "face_id", "left_anti")
    torn = durable(torn)
    kept = old.join(gone, "face_id", "left_anti").join(torn, "face_id", "left_anti").select("face_id", "neighbor", "similarity")
    columns = ["face_id", "neighbor", "similarity"]
    remade = between(vectors.join(torn, "face_id", "left_semi"), vectors, k, least).select(*columns)
    learnt = between(vectors.join(torn, "face_id", "left_anti"), vectors.join(added.select("face_id"), "face_id", "left_semi"), k, least).select(*columns)
    return top_k(kept.union(learnt).union(remade), k)
