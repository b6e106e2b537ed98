"""Hard negatives by vantage-point trees over norm-augmented vectors.

With a further component sqrt(M^2 - |x|^2) every row x lies at distance M from the origin, and an anchor q with 0 there has
|q - x|^2 = |q|^2 + M^2 - 2 q.x: inner products fall as distances grow, and a window of scores is an annulus of distances.

A tree over a bounded sample deals all rows to its leaves by distance to vantage points; every row is indexed, and large leaves are split by a
hash of the id, so equal or very close vectors never make one large part. A part's task builds the tree of its own rows down to small nodes and
writes it as one row. Blocks of anchors visit the parts that the triangle inequality leaves them; in a part
each anchor takes nodes nearest first inside its annulus, all anchors of a block at once, until the next node lies beyond its k-th
row. Anchors begin with the bounds that the sample gives them. Scores are exact integers, ties go to the smaller id, and nothing is approximate.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.durable import durable
from .textkit import mix

#: Rows of the sample that the top tree is fitted on (at most), rows of a node, rows of a part (at most about so many), anchors of a block.
SAMPLE, NODE, PART, BLOCK = 4096, 128, 1 << 16, 256
#: The sum of |x| * |y| over components that 64-bit floats hold exactly.
EXACT = float(1 << 53)
SLACK = 1e-6
PARTS = "part int, n long, payload binary"
FOUND = "vec_id long, same long, target long, score long, other long"


def _pack(*values: np.ndarray) -> bytes:
    out = pa.BufferOutputStream()
    for a in values:
        a = np.ascontiguousarray(a)
        out.write(np.array([ord(a.dtype.kind), a.dtype.itemsize, a.ndim, *a.shape], "<i8").tobytes())
        out.write(a.tobytes())
    return out.getvalue().to_pybytes()


def _unpack(raw: bytes) -> list[np.ndarray]:
    out, at = [], 0
    while at < len(raw):
        kind, width, ndim = np.frombuffer(raw, "<i8", 3, at).tolist()
        shape = np.frombuffer(raw, "<i8", ndim, at + 24).tolist()
        at += 24 + 8 * ndim
        n = int(np.prod(shape))
        out.append(np.frombuffer(raw, f"{chr(kind)}{width}", n, at).reshape(shape))
        at += n * width
    return out


class Rows:
    """Ids, labels and integer vectors; `same` tells apart different rows of one id."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, same: np.ndarray, x: np.ndarray):
        self.ids, self.labels, self.same, self.x = ids, labels, same, x

    def __len__(self) -> int:
        return len(self.ids)

    def take(self, at: np.ndarray) -> Rows:
        return Rows(self.ids[at], self.labels[at], self.same[at], self.x[at])

    def fields(self) -> tuple[np.ndarray, ...]:
        return self.ids, self.labels, self.same, self.x

    @classmethod
    def of(cls, b: pa.RecordBatch | pa.Table, width: int) -> Rows:
        """From columns vec_id, label, same and the vector; shorter vectors end in zeros."""
        x = b.column(b.schema.get_field_index("x"))
        x = x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x
        length = np.diff(x.offsets.to_numpy())
        flat = np.floor(256.0 * x.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
        out = np.zeros((len(length), width))
        out[np.repeat(np.arange(len(length)), length), np.arange(len(flat)) - np.repeat(np.cumsum(length) - length, length)] = flat
        return cls(*(b.column(b.schema.get_field_index(c)).to_numpy(**({} if isinstance(b, pa.Table) else {"zero_copy_only": False})).astype(np.int64) for c in ("vec_id", "label", "same")), out)

    def distinct(self) -> Rows:
        order = np.lexsort((self.same, self.ids))
        new = np.ones(len(order), bool)
        new[1:] = (np.diff(self.ids[order]) != 0) | (np.diff(self.same[order]) != 0)
        return self.take(order[new])


class Space:
    """The augmented space of norm `most`: distances between rows, and between anchors and rows."""

    def __init__(self, most: float):
        self.most = most

    def lift(self, x: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(self.most - (x * x).sum(1), 0.0))

    def apart(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Distances of rows x from rows y."""
        return np.sqrt(np.maximum(2 * (self.most - x @ y.T - np.outer(self.lift(x), self.lift(y))), 0.0))

    def of_scores(self, norm: np.ndarray, score: np.ndarray) -> np.ndarray:
        """The distance at which an anchor of squared norm `norm` scores so much."""
        return np.sqrt(np.maximum(norm + self.most - 2.0 * score, 0.0))

    @property
    def slack(self) -> float:
        return SLACK * max(np.sqrt(self.most), 1.0)


class Tree:
    """Vantage points and, for each leaf, those on its path with the least and largest distance of its rows from each."""

    def __init__(self, vantage: np.ndarray, path: np.ndarray, low: np.ndarray, high: np.ndarray):
        self.vantage, self.path, self.low, self.high = vantage, path, low, high

    def bounds(self, to_vantage: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """[anchor, leaf]: no row of the leaf is nearer, none is farther."""
        near, far = np.zeros((len(to_vantage), len(self.path))), np.full((len(to_vantage), len(self.path)), np.inf)
        for level in range(self.path.shape[1]):
            d = to_vantage[:, self.path[:, level]]
            near = np.maximum(near, np.maximum(d - self.high[:, level], self.low[:, level] - d))
            far = np.minimum(far, d + self.high[:, level])
        return near, far


def grow(x: np.ndarray, space: Space, depth: int, seed: int = 7) -> tuple[Tree, np.ndarray, np.ndarray]:
    """A tree of the given depth over rows x, the order that puts leaf after leaf, and where each leaf begins. Halves differ in size by one row at most, however many distances are equal."""
    rng, order, edges = np.random.default_rng(seed), np.arange(len(x)), np.array([0, len(x)])
    vantage, path = [], np.zeros((1, 0), np.int64)
    distance = np.zeros((len(x), 0))
    for _ in range(depth):
        new, own = [0], np.zeros(len(edges) - 1, np.int64)
        column = np.zeros(len(x))
        for k, (a, b) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)):
            own[k] = len(vantage)
            some = order[a:b]
            if b > a:
                tried = x[some[rng.integers(0, b - a, 3)]]
                d = space.apart(x[some], tried)
                best = int(d.std(0).argmax())
                vantage.append(tried[best])
                column[some] = d[:, best]
                order[a:b] = some[np.argsort(d[:, best], kind="stable")]
            else:
                vantage.append(np.zeros(x.shape[1]))
            new += [a + (b - a + 1) // 2, b]
        distance = np.concatenate([distance, column[:, None]], axis=1)
        path = np.concatenate([np.repeat(path, 2, axis=0), np.repeat(own, 2)[:, None]], axis=1)
        edges = np.array(new)
    low, high = np.full(path.shape, np.inf), np.full(path.shape, -np.inf)
    for k, (a, b) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)):
        if b > a:
            low[k], high[k] = distance[order[a:b]].min(0), distance[order[a:b]].max(0)
    return Tree(np.array(vantage).reshape(-1, x.shape[1]), path, low, high), order, edges


class Router:
    """The top tree: vantage points and radii, by which a row finds its leaf."""

    def __init__(self, x: np.ndarray, space: Space, depth: int):
        tree, order, edges = grow(x, space, depth)
        self.space, self.depth, self.vantage, self.leaves = space, depth, tree.vantage, 1 << depth
        self.radius = np.zeros(len(tree.vantage))
        for level in range(depth):
            for k in range(1 << level):
                a, b = (edges[j << (depth - level)] for j in (k, k + 1))
                mid = int(edges[(2 * k + 1) << (depth - level - 1)])
                node = (1 << level) - 1 + k
                if b > a:
                    d = space.apart(x[order[a:mid]], self.vantage[node : node + 1])
                    self.radius[node] = d.max() if mid > a else 0.0

    def route(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(leaf, distance from the vantage point at each level)."""
        at, distance = np.zeros(len(x), np.int64), np.zeros((len(x), self.depth))
        lift = self.space.lift(x)
        lifted = self.space.lift(self.vantage)
        for level in range(self.depth):
            node = (1 << level) - 1 + at
            d = np.sqrt(np.maximum(2 * (self.space.most - np.einsum("ij,ij->i", x, self.vantage[node]) - lift * lifted[node]), 0.0))
            distance[:, level] = d
            at = 2 * at + (d > self.radius[node])
        return at, distance


class Targets:
    """What a block of anchors looks for: each target is an anchor, a window of scores and how good a row must be at least."""

    def __init__(self, anchors: Rows, anchor: np.ndarray, ident: np.ndarray, low: np.ndarray, high: np.ndarray):
        self.anchors, self.anchor, self.ident, self.low, self.high = anchors, anchor, ident, low, high


def _best(target: np.ndarray, score: np.ndarray, other: np.ndarray, same: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """The k best rows of each target: higher scores, then smaller ids."""
    order = np.lexsort((same, other, -score, target))
    target, score, other, same = target[order], score[order], other[order], same[order]
    first = np.flatnonzero(np.diff(target, prepend=-1))
    keep = np.arange(len(target)) - np.repeat(first, np.diff(first, append=len(target))) < k
    return target[keep], score[keep], other[keep], same[keep]


def _products(q: np.ndarray, x: np.ndarray, exact: bool) -> np.ndarray:
    if exact:
        return (q @ x.T).astype(np.int64)
    return q.astype(np.int64) @ x.astype(np.int64).T


def search(rows: Rows, tree: Tree, edges: np.ndarray, t: Targets, space: Space, k: int, alike: bool, exact: bool) -> tuple[np.ndarray, ...]:
    """(target, score, id): the k best rows of each target with an equal (alike) or a different label, the anchor itself never."""
    a = t.anchors
    norm = (a.x * a.x).sum(1)
    to_vantage = np.sqrt(np.maximum(norm[:, None] + space.most - 2 * (a.x @ tree.vantage.T), 0.0))
    near, far = tree.bounds(to_vantage)
    inner, outer = space.of_scores(norm[t.anchor], t.high) - space.slack, space.of_scores(norm[t.anchor], t.low) + space.slack
    # An anchor's annulus: from its targets' least inner to their largest outer radius. Nodes come in order of the nearest point inside it.
    hole = np.full(len(a), np.inf)
    np.minimum.at(hole, t.anchor, inner)
    turn = np.where(far + space.slack < hole[:, None], np.inf, np.maximum(near - space.slack, hole[:, None]))
    order = np.argsort(turn, axis=1, kind="stable")
    ranked = np.take_along_axis(turn, order, axis=1)
    none = np.empty(0, np.int64)
    kept = (none, none, none, none)
    floor, limit = t.low.copy(), outer
    by_anchor = np.argsort(t.anchor, kind="stable")
    first = np.searchsorted(t.anchor[by_anchor], np.arange(len(a) + 1))
    for step in range(order.shape[1]):
        reach = np.full(len(a), -np.inf)
        np.maximum.at(reach, t.anchor, limit)
        live = np.flatnonzero(ranked[:, step] <= reach)
        if not len(live):
            break
        nodes, new = order[live, step], []
        for node in np.unique(nodes).tolist():
            who = live[nodes == node]
            lo, hi = int(edges[node]), int(edges[node + 1])
            if hi == lo:
                continue
            score = _products(a.x[who], rows.x[lo:hi], exact)
            fits = (a.labels[who][:, None] == rows.labels[lo:hi]) == alike
            fits &= (a.ids[who][:, None] != rows.ids[lo:hi]) | (a.same[who][:, None] != rows.same[lo:hi])
            size = first[who + 1] - first[who]
            target = by_anchor[np.repeat(first[who], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)]
            line = np.repeat(np.arange(len(who)), size)
            hit = fits[line] & (score[line] >= floor[target][:, None]) & (score[line] <= t.high[target][:, None])
            i, j = np.nonzero(hit)
            new.append((target[i], score[line[i], j], rows.ids[lo + j], rows.same[lo + j]))
        if new and sum(len(n[0]) for n in new):
            kept = _best(*map(np.concatenate, zip(kept, *new, strict=True)), k)
            count = np.bincount(kept[0], minlength=len(t.anchor))
            last = np.cumsum(count) - 1
            full = np.flatnonzero(count >= k)
            floor[full] = np.maximum(floor[full], kept[1][last[full]])
            limit = space.of_scores(norm[t.anchor], floor) + space.slack
    return kept[:3]


def _clean(df: DataFrame, vec_id: str, vector: str, label: str) -> DataFrame:
    """(vec_id, label, same, x) of the rows that take part."""
    odd = F.exists(F.col(vector), lambda v: v.isNull() | F.isnan(v.cast("double")) | (F.abs(v.cast("double")) == float("inf")))
    rows = df.filter(F.col(vec_id).isNotNull() & F.col(label).isNotNull() & F.col(vector).isNotNull() & ~odd)
    return rows.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).cast("long").alias("label"), F.xxhash64(label, vector).alias("same"), F.col(vector).cast("array<double>").alias("x"))


def _visits(parts: DataFrame, blocks: DataFrame, leaves: Tree, part_leaf: np.ndarray, space: Space, top: np.ndarray, k: int, alike: bool, exact: bool) -> DataFrame:
    """(vec_id, same, target, score, other): what each part has for the anchors that visit it."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for raw in b.column(0):
                raw = raw.as_py()
                t = _targets(raw)
                norm = (t.anchors.x**2).sum(1)
                near, far = leaves.bounds(np.sqrt(np.maximum(norm[:, None] + space.most - 2 * (t.anchors.x @ top.T), 0.0)))
                inner, outer = space.of_scores(norm[t.anchor], t.high), space.of_scores(norm[t.anchor], t.low)
                open_ = ((near[t.anchor] <= outer[:, None] + 2 * space.slack) & (far[t.anchor] >= inner[:, None] - 2 * space.slack)).any(0)
                to = np.flatnonzero(open_[part_leaf])
                for some in np.array_split(to, max(1, len(to) * len(raw) >> 23)):
                    yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array([raw] * len(some), pa.binary())], ["part", "block"])

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, payload in zip(b.column(0), b.column(1), strict=True):
                *fields, vantage, path, low, high, edges = _unpack(payload.as_py())
                t = _targets(block.as_py())
                target, score, other = search(Rows(*fields), Tree(vantage, path, low, high), edges, t, space, k, alike, exact)
                who = t.anchor[target]
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in (t.anchors.ids[who], t.anchors.same[who], t.ident[target], score, other)], ["vec_id", "same", "target", "score", "other"])

    visits = blocks.mapInArrow(deal, "part int, block binary")
    return visits.join(parts.hint("merge"), "part").select("block", "payload").mapInArrow(look, FOUND)


def _targets(raw: bytes) -> Targets:
    *fields, anchor, ident, low, high = _unpack(raw)
    return Targets(Rows(*fields), anchor, ident, low, high)


def mine(df: DataFrame, anchor: str, *, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", positives: int = 5, negatives: int = 10, window: tuple[int, int] = (30, 90)) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): hard negatives of the anchors' nearest rows of their label.

    df: an integer id, an array of numbers and an integer label; other columns are ignored. anchor: SQL over vec_id that is true for anchors. Components count as
    floor(256 * x), a score is an inner product of these. An anchor's positives are the first rows of its label by score, then id; each positive's negatives the first rows of other labels
    whose score lies within `window` percent of the positive's, which for a negative score is no row. Rows with a null id, label, vector or component, or one that is not finite, take no
    part. Repeats of a whole row (id, label, vector) count once; different rows of one id are rows of their own, and all of them anchors. Shorter vectors end in zeros. An empty table, or one
    without anchors, gives an empty result. Scores that could leave 62 bits raise an error.
    """
    spark = df.sparkSession
    rows = _clean(df, vec_id, vector, label)
    square = F.aggregate("x", F.lit(0.0), lambda s, v: s + F.floor(256.0 * v).cast("double") * F.floor(256.0 * v).cast("double"))
    n, most, width = rows.agg(F.count(F.lit(1)), F.max(square), F.max(F.size("x"))).first()
    result = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not n:
        return spark.createDataFrame([], result)
    if most >= 2.0**62:
        raise ValueError("inner products of these vectors do not fit 62 bits")
    space, exact = Space(float(most)), most < EXACT
    share = min(1.0, SAMPLE / n)
    sample = rows.filter(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).limit(2 * SAMPLE).toArrow()
    sample = Rows.of(sample, width).distinct()
    per_part = int(min(PART, max(8 * NODE, n // (2 * int(spark.conf.get("spark.sql.shuffle.partitions"))))))
    depth = int(np.ceil(np.log2(max(1, min(n / per_part, SAMPLE / 4, len(sample))))))
    router = Router(sample.x, space, depth)

    def summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of each leaf and the range of their distances."""
        count, low, high = np.zeros(router.leaves, np.int64), np.full((router.leaves, depth), np.inf), np.full((router.leaves, depth), -np.inf)
        for b in batches:
            leaf, d = router.route(Rows.of(b, width).x)
            count += np.bincount(leaf, minlength=router.leaves)
            np.minimum.at(low, leaf, d)
            np.maximum.at(high, leaf, d)
        some = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(count[some]), pa.array([_pack(low[k], high[k]) for k in some], pa.binary())], ["part", "n", "payload"])

    def merge(table: pa.Table) -> pa.Table:
        low, high = zip(*(_unpack(x.as_py()) for x in table.column("payload")), strict=True)
        return pa.table({"part": pa.array([table.column("part")[0].as_py()], pa.int32()), "n": pa.array([sum(table.column("n").to_pylist())], pa.int64()), "payload": pa.array([_pack(np.min(low, axis=0), np.max(high, axis=0))], pa.binary())})

    leaves = rows.mapInArrow(summary, PARTS).groupBy("part").applyInArrow(merge, PARTS).collect()  # at most SAMPLE rows
    count, low, high = np.zeros(router.leaves, np.int64), np.full((router.leaves, depth), np.inf), np.full((router.leaves, depth), -np.inf)
    for r in leaves:
        count[r.part] = r.n
        low[r.part], high[r.part] = _unpack(bytes(r.payload))
    pieces = -(-count // per_part)
    first_part = np.cumsum(pieces) - pieces
    part_leaf = np.repeat(np.arange(router.leaves), pieces)
    path = np.array([[(1 << level) - 1 + (leaf >> (depth - level)) for level in range(depth)] for leaf in range(router.leaves)], np.int64).reshape(router.leaves, depth)
    top = Tree(router.vantage, path, low, high)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            r = Rows.of(b, width).distinct()
            leaf, _ = router.route(r.x)
            part = first_part[leaf] + (mix(r.ids.astype(np.uint64) + np.uint64(1)) >> np.uint64(8)).astype(np.int64) % np.maximum(pieces[leaf], 1)
            order = np.argsort(part, kind="stable")
            for some in np.split(order, np.flatnonzero(np.diff(part[order])) + 1):
                yield pa.RecordBatch.from_arrays([pa.array([int(part[some[0]])], pa.int32()), pa.array([len(some)], pa.int64()), pa.array([_pack(*_narrow(r.take(some)))], pa.binary())], ["part", "n", "payload"])

    def build(table: pa.Table) -> pa.Table:
        fields = [_unpack(x.as_py()) for x in table.column("payload")]
        r = Rows(*map(np.concatenate, zip(*fields, strict=True)))
        r.x = r.x.astype(np.float64)
        r = r.distinct()
        tree, order, edges = grow(r.x, space, int(np.ceil(np.log2(max(1, len(r) / NODE)))))
        payload = _pack(*_narrow(r.take(order)), tree.vantage, tree.path, tree.low, tree.high, edges)
        return pa.table({"part": pa.array([table.column("part")[0].as_py()], pa.int32()), "n": pa.array([len(r)], pa.int64()), "payload": pa.array([payload], pa.binary())})

    n_parts = int(pieces.sum())
    parts = durable(rows.mapInArrow(assign, PARTS).repartition(n_parts, "part").groupBy("part").applyInArrow(build, PARTS))

    def start(t: Targets, k: int, alike: bool) -> np.ndarray:
        """The targets' least scores, raised to what the sample shows them to have."""
        tree = Tree(np.zeros((0, width)), np.zeros((1, 0), np.int64), np.zeros((1, 0)), np.zeros((1, 0)))
        target, score, _ = search(sample, tree, np.array([0, len(sample)]), t, space, k, alike, exact)
        low = t.low.copy()
        number = np.bincount(target, minlength=len(low))
        full = np.flatnonzero(number >= k)
        low[full] = np.maximum(low[full], score[(np.cumsum(number) - 1)[full]])
        return low

    def positive_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            r = Rows.of(b, width)
            order = np.argsort(router.route(r.x)[0], kind="stable")
            for at in range(0, len(r), BLOCK):
                a = r.take(order[at : at + BLOCK])
                every = np.arange(len(a))
                t = Targets(a, every, np.zeros(len(a), np.int64), np.full(len(a), -(1 << 62)), np.full(len(a), 1 << 62))
                yield pa.RecordBatch.from_arrays([pa.array([_pack(*a.fields(), every, t.ident, start(t, positives, True), t.high)], pa.binary())], ["block"])

    anchors = durable(rows.filter(anchor).dropDuplicates(["vec_id", "same"]))
    tasks = max(1, -(-anchors.count() // BLOCK))
    best = Window.partitionBy("vec_id", "same", "target").orderBy(F.desc("score"), "other")
    near = _visits(parts, durable(anchors.coalesce(tasks).mapInArrow(positive_blocks, "block binary")), top, part_leaf, space, router.vantage, positives, True, exact)
    near = near.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= positives)
    near = durable(near.select("vec_id", "same", F.col("place").alias("target"), "score", "other"))

    def negative_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            r = Rows.of(b, width)
            wanted = b.column(b.schema.get_field_index("wanted"))
            order = np.argsort(router.route(r.x)[0], kind="stable")
            for at in range(0, len(r), BLOCK):
                some = order[at : at + BLOCK]
                a = r.take(some)
                each = [wanted[int(k)].as_py() for k in some]
                anchor_of = np.repeat(np.arange(len(a)), [len(x) for x in each])
                ident, score = (np.array([x[c] for w in each for x in w], np.int64) for c in ("target", "score"))
                low, high = -(-window[0] * score // 100), window[1] * score // 100
                fit = low <= high
                t = Targets(a, anchor_of[fit], ident[fit], low[fit], high[fit])
                yield pa.RecordBatch.from_arrays([pa.array([_pack(*a.fields(), t.anchor, t.ident, start(t, negatives, False), t.high)], pa.binary())], ["block"])

    wanted = near.groupBy("vec_id", "same").agg(F.collect_list(F.struct("target", "score")).alias("wanted"))  # at most `positives` a row
    blocks = durable(anchors.join(wanted, ["vec_id", "same"]).coalesce(tasks).mapInArrow(negative_blocks, "block binary"))
    far = _visits(parts, blocks, top, part_leaf, space, router.vantage, negatives, False, exact)
    far = far.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= negatives)
    far = far.select("vec_id", "same", "target", "rank", F.col("other").alias("negative_id"), F.col("score").alias("negative_score"))
    return near.join(far, ["vec_id", "same", "target"]).select(F.col("vec_id").alias("anchor_id"), F.col("other").alias("positive_id"), "rank", "negative_id", F.col("score").alias("positive_score"), "negative_score")


def _narrow(r: Rows) -> tuple[np.ndarray, ...]:
    """The fields with components in the narrowest floats that hold them."""
    small = not r.x.size or np.abs(r.x).max() < 1 << 24
    return r.ids, r.labels, r.same, r.x.astype(np.float32) if small else r.x
