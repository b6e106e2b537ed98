"""Duplicate grouping in tiers: exact, near, burst, similar; each asset ends in at most one group.

Tiers depend on each other through anti-joins on asset_id; a tier's members are a table in the shared folder before the next reads
them. Groups are (tier, group_id, asset_id, similarity); group_id is the least member.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import combinations, islice, pairwise
from math import comb, inf

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import media
from ..plans.components import connected_components, hook_roots
from ..plans.durable import drop_table, durable, new_folder, write_table
from ..plans.tiles import block_pairs, packed

TIERS = ("exact", "near", "burst", "similar")
#: Below this many different hashes every pair is tried, with one side sent to all workers; above it parts are joined.
NESTED_LOOP_ROWS = 20_000
#: Where the best cut lets through more than this share of all pairs, comparing all of them block by block is cheaper than joining the candidates.
WIDE = 0.01
#: Hashes of a block; assets of a block, with their vectors.
HASH_BLOCK, ASSET_BLOCK = 16_384, 32_768
#: Up to so many timed items are sorted by the few tasks that libraries make.
FEW_ROWS = 20_000


@dataclass(frozen=True)
class Thresholds:
    near: int = 6
    loose: int = 12
    dhash: int = 10
    near_cosine: float = 0.95
    burst_seconds: float = 4.0
    burst_cosine: float = 0.85
    similar_seconds: float = 900.0
    similar_cosine: float = 0.90


def exact_groups(assets: DataFrame) -> DataFrame:
    """Same hash and size (an unknown size is one of its own)."""
    key = [F.col("file_hash"), F.coalesce("file_size", F.lit(-1)).alias("size")]
    a = assets.filter("file_hash is not null").select(*key, "asset_id")
    n = a.groupBy("file_hash", "size").agg(F.count(F.lit(1)).alias("n"), F.min("asset_id").alias("group_id")).filter("n > 1")
    return a.join(n, ["file_hash", "size"]).select("group_id", "asset_id", F.lit(1.0).alias("similarity"))


def hash_pairs(hashes: DataFrame, radius: int, col: str = "phash") -> DataFrame:
    """(a, b, distance), a < b as signed numbers: different hashes within `radius` bits."""
    d = durable(hashes.select(F.col(col).alias("h")).filter("h is not null").distinct())
    distance = F.bit_count(F.col("x.a").bitwiseXOR(F.col("y.b")))
    left, right = d.select(F.col("h").alias("a")), d.select(F.col("h").alias("b"))
    if d.count() <= NESTED_LOOP_ROWS:
        near = left.alias("x").join(F.broadcast(right).alias("y"), F.expr("a < b") & (distance <= radius))
        return near.select("a", "b", distance.alias("distance"))
    share, plan = best_parts(d, radius)
    if share > WIDE:
        return block_pairs(packed(left, "a", HASH_BLOCK), near_hashes(radius), "a long, b long, distance int")
    near = _probes(left, "a", plan, True).join(_probes(right, "b", plan, False), ["part", "value"])
    near = near.select("a", "b", F.bit_count(F.col("a").bitwiseXOR(F.col("b"))).alias("distance"))
    return near.filter((F.col("a") < F.col("b")) & (F.col("distance") <= radius)).distinct()


def _close(x: np.ndarray, y: np.ndarray, radius: int, same: bool, rows: int = 64) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(places in x, places in y, distances) of hashes within the radius, for some rows of x at a time; of one block each pair once."""
    for at in range(0, len(x), rows):
        past = at if same else 0
        d = np.bitwise_count((x[at : at + rows, None] ^ y[None, past:]).view(np.uint64))
        i, j = np.nonzero(d <= radius)
        far, i, j = d[i, j].astype(np.int32), i + at, j + past
        if same:
            once = i < j
            i, j, far = i[once], j[once], far[once]
        if len(i):
            yield i, j, far


def near_hashes(radius: int):
    """Different hashes (a) of two blocks within the radius, each pair once with a < b."""

    def run(rows: pa.Table, others: pa.Table, same: bool) -> Iterator[pa.RecordBatch]:
        x, y = (t.column("a").to_numpy() for t in (rows, others))
        for i, j, far in _close(x, y, radius, same):
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x[i], y[j])), pa.array(np.maximum(x[i], y[j])), pa.array(far)], ["a", "b", "distance"])

    return run


@dataclass(frozen=True)
class Part:
    """Bits [offset, offset + width) of a hash, and the errors looked for in them: the one side flips up to half of these (rounded up), the other the rest."""

    offset: int
    width: int
    errors: int

    def masks(self, first: bool) -> list[int]:
        return [sum(1 << k for k in c) for n in range((self.errors + first) // 2 + 1) for c in combinations(range(self.width), n)]


def _ball(width: int, errors: int) -> int:
    return sum(comb(width, n) for n in range(min(errors, width) + 1))


def _split(parts: int) -> list[tuple[int, int]]:
    """(offset, width) of 64 bits in so many parts that differ by one bit at most."""
    edges = [64 * k // parts for k in range(parts + 1)]
    return [(a, b - a) for a, b in pairwise(edges)]


def _shared(parts: list[tuple[int, int]], same: list[float], radius: int, most: int) -> tuple[float, list[Part]] | None:
    """The errors of each part that let fewest pairs through with at most `most` probes a hash, and the share of pairs that they let through.

    If two hashes differ in `radius` bits and the errors and one for each part add up to more than that, some part has no more than its errors; a part may be left out
    for the price of its one. same: the share of pairs that are equal in each part.
    """
    need = radius - len(parts) + 1
    best: dict[tuple[int, int], tuple[float, tuple[int, ...]]] = {(0, 0): (0.0, ())}  # (errors given, probes) -> share, errors
    for (_, width), p in zip(parts, same, strict=True):
        after: dict[tuple[int, int], tuple[float, tuple[int, ...]]] = {}
        for (given, probes), (share, errors) in best.items():
            for e in range(-1, min(need + len(parts), width) + 1):
                cost = 0 if e < 0 else _ball(width, (e + 1) // 2) + _ball(width, e // 2)
                if probes + cost > most:
                    break
                key, new = (given + e, probes + cost), (share + (0.0 if e < 0 else min(1.0, p * _ball(width, e))), (*errors, e))
                if key not in after or new < after[key]:
                    after[key] = new
        # What gives as many errors with no more probes and no larger share is enough.
        best, lowest = {}, {}
        for (given, probes), new in sorted(after.items()):
            if new[0] < lowest.get(given, inf):
                lowest[given] = new[0]
                best[given, probes] = new
    found = [v for (given, _), v in best.items() if given >= need]
    if not found:
        return None
    share, errors = min(found)
    return share, [Part(o, w, e) for (o, w), e in zip(parts, errors, strict=True) if e >= 0]


def _cuts(radius: int, most: int) -> list[list[tuple[int, int]]]:
    """The three coarsest cuts that the bound of probes allows."""
    cuts = list(islice((c for c in map(_split, range(1, 65)) if _shared(c, [2.0**-w for _, w in c], radius, most)), 3))
    if not cuts:
        raise ValueError(f"a radius of {radius} bits needs more than {most} probes a hash")
    return cuts


def even_parts(radius: int, most: int = 500) -> list[Part]:
    """hamming_parts() for hashes whose bits are even and independent, without counting any."""
    plans = [_shared(c, [2.0**-w for _, w in c], radius, most) for c in _cuts(radius, most)]
    return min((p for p in plans if p), key=lambda p: p[0])[1]


def hamming_parts(hashes: DataFrame, radius: int, most: int = 500) -> list[Part]:
    """How to cut 64-bit hashes (h) so that pairs within the radius meet, as best_parts() finds it."""
    return best_parts(hashes, radius, most)[1]


def best_parts(hashes: DataFrame, radius: int, most: int = 500) -> tuple[float, list[Part]]:
    """The share of pairs that are candidates, and how to cut 64-bit hashes (h) so that pairs within the radius meet: the cut with the fewest expected candidates among those with at most `most` probes a hash, both sides together.

    The parts' frequencies are counted for the three coarsest cuts that the bound allows, so bits that many hashes share are probed with fewer errors or not at all.
    """
    cuts = _cuts(radius, most)
    values = F.array(*[F.struct(F.lit(k).alias("cut"), F.lit(o).alias("offset"), _bits(F.col("h"), o, w).alias("value")) for k, c in enumerate(cuts) for o, w in c])
    often = hashes.select(F.explode(values).alias("v")).groupBy("v.cut", "v.offset", "v.value").agg(F.count(F.lit(1)).cast("double").alias("n"))
    same = {(r.cut, r.offset): r.same / max(r.all, 1.0) ** 2 for r in often.groupBy("cut", "offset").agg(F.sum(F.col("n") * F.col("n")).alias("same"), F.sum("n").alias("all")).collect()}  # a row a part
    plans = [_shared(c, [same.get((k, o), 0.0) for o, _ in c], radius, most) for k, c in enumerate(cuts)]
    return min((p for p in plans if p), key=lambda p: p[0])


def _bits(h: Column, offset: int, width: int) -> Column:
    return F.shiftrightunsigned(h, offset).bitwiseAND(F.lit((1 << width) - 1 if width < 64 else -1).cast("long"))


def _probes(df: DataFrame, h: str, plan: list[Part], first: bool) -> DataFrame:
    """(h, part, value): what a hash is looked for, or found, by."""

    def values(p: Part) -> Column:
        own = _bits(F.col(h), p.offset, p.width)
        return F.transform(F.array(*[F.lit(m).cast("long") for m in p.masks(first)]), lambda m: m.bitwiseXOR(own))

    rows = [df.select(h, F.lit(k).alias("part"), F.explode(values(p)).alias("value")) for k, p in enumerate(plan)]
    return reduce(DataFrame.union, rows)


def near_pairs(features: DataFrame, blocked: DataFrame, t: Thresholds) -> DataFrame:
    """(a, b, distance) of assets (asset_id, phash, dhash, vector) that look alike and are not blocked (asset_a, asset_b).

    Within the near radius and the difference hashes agree, or within the loose radius and the vectors do.
    """
    # A hash computed on the way would be computed again in every join condition below.
    f = durable(features.filter("phash is not null"))
    if _all_pairs(f, t):
        rows = f.withColumn("n", F.lit(1.0)).withColumn("own", F.lit(True))
        return block_pairs(packed(rows, "asset_id", ASSET_BLOCK), _looks(t), LOOKS).select("a", "b", "distance").join(_blocked(blocked), ["a", "b"], "left_anti")
    by_hash = hash_pairs(f, max(t.loose, t.near))
    same = f.select("phash").distinct().select(F.col("phash").alias("a"), F.col("phash").alias("b"), F.lit(0).alias("distance"))
    x, y = f.select([F.col(c).alias(f"x_{c}") for c in f.columns]), f.select([F.col(c).alias(f"y_{c}") for c in f.columns])
    j = by_hash.union(same).join(x, F.col("a") == F.col("x_phash")).join(y, F.col("b") == F.col("y_phash")).filter((F.col("a") != F.col("b")) | (F.col("x_asset_id") < F.col("y_asset_id")))
    dh = F.coalesce(media.hamming(F.col("x_dhash"), F.col("y_dhash")), F.lit(0))
    cosine = media.dot(F.col("x_vector"), F.col("y_vector"))
    alike = ((F.col("distance") <= t.near) & (dh <= t.dhash)) | ((F.col("distance") <= t.loose) & (cosine >= t.near_cosine))
    pairs = j.filter(alike).select(F.least("x_asset_id", "y_asset_id").alias("a"), F.greatest("x_asset_id", "y_asset_id").alias("b"), "distance")
    return pairs.join(_blocked(blocked), ["a", "b"], "left_anti")


def _blocked(blocked: DataFrame) -> DataFrame:
    return blocked.select(F.least("asset_a", "asset_b").alias("a"), F.greatest("asset_a", "asset_b").alias("b"))


def _all_pairs(f: DataFrame, t: Thresholds) -> bool:
    """Whether near_pairs compares all assets with a hash block by block: so many hashes that a cut would let too many candidates through."""
    d = durable(f.select(F.col("phash").alias("h")).distinct())
    return d.count() > NESTED_LOOP_ROWS and best_parts(d, max(t.loose, t.near))[0] > WIDE


#: Links of pairs of blocks: a pair with its distance, its weight w and s = w (64 - distance); a link between assets that are already in one group of the two blocks has no row, and its weight is in a row without b.
LOOKS = "a long, b long, distance int, w double, s double"


def _vectors(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of one length, filled up with zeros, and their own lengths (-1 for null, or with a null inside)."""
    column = column.combine_chunks()
    n = column.value_lengths().fill_null(-1).to_numpy().astype(np.int64)
    out, holes = np.zeros((len(n), max(int(n.max(initial=0)), 0)), order="F"), np.zeros((len(n), max(int(n.max(initial=0)), 0)), bool)
    filled, flat = np.arange(out.shape[1])[None, :] < n[:, None], column.flatten()
    out[filled], holes[filled] = flat.to_numpy(zero_copy_only=False), flat.is_null().to_numpy(zero_copy_only=False)
    return out, np.where(holes.any(1), -1, n)


def _looks(t: Thresholds):
    """Links between rows (asset_id, phash, dhash, vector, n, own) of two blocks that look alike as near_pairs has it, with n copies each."""

    def run(rows: pa.Table, others: pa.Table, same: bool) -> Iterator[pa.RecordBatch]:
        def out(*columns: np.ndarray | None) -> pa.RecordBatch:
            n = len(columns[0])
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.float64(), pa.float64())
            return pa.RecordBatch.from_arrays([pa.nulls(n, k) if c is None else pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [c.split()[0] for c in LOOKS.split(", ")])

        (x, u, v, size), (y, p, q, sizes) = ((r.column("asset_id").to_numpy(), r.column("phash").to_numpy(), *_vectors(r.column("vector"))) for r in (rows, others))
        (n, own, dx), (m, there, dy) = ((r.column("n").to_numpy(), r.column("own").to_numpy(), r.column("dhash").combine_chunks()) for r in (rows, others))
        (dx, known), (dy, knows) = ((d.fill_null(0).to_numpy(), d.is_valid().to_numpy(zero_copy_only=False)) for d in (dx, dy))
        ids, first = (x, 0) if same else (np.concatenate([x, y]), len(x))
        root, weight, score = np.arange(len(ids)), np.zeros(len(x)), np.zeros(len(x))
        waiting, waits = [], 0

        def hook() -> None:
            if waiting:
                hook_roots(root, *(np.concatenate(c) for c in zip(*waiting, strict=True)))
                waiting.clear()

        for i, j, far in _close(u, p, max(t.loose, t.near), same):
            apart = np.where(known[i] & knows[j], np.bitwise_count((dx[i] ^ dy[j]).view(np.uint64)), 0)
            alike = (far <= t.near) & (apart <= t.dhash)
            more = np.flatnonzero(~alike & (far <= t.loose) & (size[i] == sizes[j]) & (size[i] >= 0))
            k, l, cosine = i[more], j[more], np.zeros(len(more))
            for d in range(min(v.shape[1], q.shape[1])):  # in the order in which SQL adds
                cosine += v[k, d] * q[l, d]
            alike[more] = ~(cosine < t.near_cosine)
            i, j, far = i[alike], j[alike], far[alike]
            w = n[i] * m[j]
            s = w * (64 - far)
            told = own[i] & there[j]
            if told.any():
                a, b = x[i[told]], y[j[told]]
                yield out(np.minimum(a, b), np.maximum(a, b), far[told], w[told], s[told])
            i, j = i[~told], j[~told]
            weight += np.bincount(i, w[~told], len(x))
            score += np.bincount(i, s[~told], len(x))
            waiting.append((i, first + j))
            waits += len(i)
            if waits > 1 << 20:
                hook()
                waits = 0
        hook()
        member, heavy = np.flatnonzero(root != np.arange(len(ids))), np.flatnonzero(weight)
        yield out(ids[root[member]], ids[member], None, np.zeros(len(member)), np.zeros(len(member)))
        yield out(x[heavy], None, None, weight[heavy], score[heavy])

    return run


def near_groups(features: DataFrame, blocked: DataFrame, t: Thresholds) -> DataFrame:
    """Transitive closure of near_pairs; a group's similarity is the mean of its pairs'.

    Assets with the same hashes and vector are one vertex with a weight, so k copies make no pairs; those that are blocked with
    another stay on their own.
    """
    f = durable(features.filter("phash is not null").select("asset_id", "phash", "dhash", "vector"))
    named = blocked.select(F.explode(F.array("asset_a", "asset_b")).alias("asset_id")).filter("asset_id is not null").distinct().withColumn("own", F.lit(True))
    marked = f.join(named, "asset_id", "left").withColumn("own", F.when(F.col("own"), F.col("asset_id")))
    keyed = marked.withColumn("look", F.xxhash64("phash", "dhash", "vector", "own"))
    classes = durable(keyed.groupBy("look", "phash", "dhash", "vector", F.col("own").isNotNull().alias("own")).agg(F.min("asset_id").alias("rep"), F.count(F.lit(1)).cast("double").alias("n")))
    rows = classes.select(F.col("rep").alias("asset_id"), "phash", "dhash", "vector", "n", "own")
    if _all_pairs(rows, t):
        found = durable(block_pairs(packed(rows, "asset_id", ASSET_BLOCK), _looks(t), LOOKS))
        told = found.filter("distance is not null").join(_blocked(blocked), ["a", "b"], "left_anti")
        of = connected_components(told.select("a", "b").union(found.filter("distance is null and b is not null").select("a", "b")))
        scored = told.select(F.col("a").alias("rep"), "w", "s").union(found.filter("b is null").select("a", "w", "s"))
    else:
        pairs, weight = durable(near_pairs(rows.drop("n", "own"), blocked, t)), classes.select("rep", "n")
        of = connected_components(pairs)
        w = F.col("na") * F.col("nb")
        scored = pairs.join(weight.toDF("a", "na"), "a").join(weight.toDF("b", "nb"), "b").select(F.col("a").alias("rep"), w.alias("w"), (w * (64 - F.col("distance"))).alias("s"))
    copies = classes.filter("n > 1").select("rep", (F.col("n") * (F.col("n") - 1) / 2).alias("w"), (F.col("n") * (F.col("n") - 1) * 32).alias("s"))
    part = scored.union(copies).join(of.toDF("rep", "component"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    score = part.groupBy("component").agg((F.sum("s") / 64 / F.sum("w")).alias("similarity"))
    member = keyed.join(classes.select("look", "phash", "rep"), ["look", "phash"]).join(of.toDF("rep", "component"), "rep", "left").select(F.coalesce("component", "rep").alias("component"), "asset_id")
    found = member.join(score, "component")
    least = found.groupBy("component").agg(F.min("asset_id").alias("group_id"))
    return found.join(least, "component").select("group_id", "asset_id", "similarity")


def burst_id_groups(assets: DataFrame) -> DataFrame:
    a = assets.filter("burst_id is not null").select("library_id", "burst_id", "asset_id")
    n = a.groupBy("library_id", "burst_id").agg(F.count(F.lit(1)).alias("n"), F.min("asset_id").alias("group_id")).filter("n > 1")
    return a.join(n, ["library_id", "burst_id"]).select("group_id", "asset_id", F.lit(1.0).alias("similarity"))


def time_sessions(items: DataFrame, seconds: float, by: str = "library_id", few: bool = False) -> DataFrame:
    """items (.., at) plus session and _cell: no star can span a gap above `seconds`, so sessions are independent; items without company may be left out.

    Time is cut into cells of that width. An item can only be joined to one in its own or the next cell, so sessions are the connected
    components of cells whose items are close enough: no task sorts a library's rows. `few` rows are sorted, which is the same.
    """
    df = items.withColumn("_cell", F.floor(F.col("at") / seconds).cast("long"))
    if few:
        w = Window.partitionBy(by).orderBy("at", "asset_id")
        new = F.when(F.col("at") - F.lag("at").over(w) <= seconds, 0).otherwise(1)
        return df.withColumn("_new", new).withColumn("session", F.sum("_new").over(w)).drop("_new")
    cells = durable(df.groupBy(by, "_cell").agg(F.min("at").alias("first"), F.max("at").alias("last"), F.count(F.lit(1)).alias("n")))
    key = F.xxhash64(F.col(by), F.col("_cell"))
    after = cells.select(by, (F.col("_cell") - 1).alias("_cell"), F.col("first").alias("then"), F.xxhash64(F.col(by), F.col("_cell")).alias("b"))
    edges = cells.join(after, [by, "_cell"]).filter(F.col("then") - F.col("last") <= seconds).select(key.alias("a"), "b")
    of = connected_components(edges)
    known = cells.select(by, "_cell", "n", key.alias("id")).join(of, "id", "left").filter(F.col("component").isNotNull() | (F.col("n") > 1))
    return df.join(known.select(by, "_cell", F.coalesce("component", "id").alias("session")), [by, "_cell"])


def star_groups(items: DataFrame, blocked: DataFrame, seconds: float, cosine: float, by: str = "library_id", large: int = 20_000, chunk: int = 250_000) -> DataFrame:
    """Greedy stars: in order of (at, asset_id) an unused item seeds a group and takes the later unused ones within `seconds` whose
    vectors agree with its own and that are not blocked with it. items: `by`, asset_id, at (seconds), vector.

    Sessions of at most `large` items are walked by a task each, larger ones in chunks of about `chunk` items that take turns (chunked_stars), those with more items than that
    within `seconds` all at once in rounds (spread_stars), with the same result.
    """
    known = durable(items.filter("at is not null and vector is not null").select(by, "asset_id", "at", "vector"))
    few = known.count() <= min(large, FEW_ROWS)
    s = time_sessions(known, seconds, by, few)
    pairs = blocked.select(F.col("asset_a").alias("asset_id"), "asset_b").union(blocked.select(F.col("asset_b").alias("asset_id"), "asset_a"))
    pairs = pairs.filter("asset_id is not null and asset_b is not null")
    no = durable(pairs.groupBy("asset_id").agg(F.collect_set("asset_b").alias("blocked")))
    cells = None if few else durable(s.groupBy(by, "session", "_cell").agg(F.count(F.lit(1)).alias("n")))
    wide = None if few else durable(cells.groupBy(by, "session").agg(F.sum("n").alias("n"), F.max("n").alias("most")).filter(F.col("n") > large))
    alone = (s if few else s.join(wide, [by, "session"], "left_anti")).join(no, "asset_id", "left").select("asset_id", "at", "vector", "blocked", F.lit(False).alias("ahead"), F.lit(False).alias("used"), by, "session")
    out = alone.groupBy(by, "session").applyInArrow(_walk(seconds, cosine), STARS)
    if few or wide.isEmpty():
        return out
    dense = wide.filter(F.col("most") > chunk).select(by, "session")
    if not dense.isEmpty():
        out = out.union(spread_stars(s.join(dense, [by, "session"], "left_semi"), pairs, seconds, cosine, by))
    rest = cells.join(wide.filter(F.col("most") <= chunk).select(by, "session"), [by, "session"], "left_semi")
    return out if rest.isEmpty() else out.union(chunked_stars(s.join(no, "asset_id", "left"), rest, seconds, cosine, by, chunk))


STARS = "group_id long, asset_id long, similarity double"


def _walk(seconds: float, cosine: float):
    """The stars of rows (asset_id, at, vector, blocked, ahead, used): those ahead can be taken and seed none, the used can do neither."""

    def run(table: pa.Table) -> pa.Table:
        ids, at = table.column("asset_id").to_numpy(), table.column("at").to_numpy().astype(float)
        order = np.lexsort((ids, at))
        ids, at = ids[order], at[order]
        v = table.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(ids), -1)[order]
        v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
        told = table.column("blocked").combine_chunks().take(pa.array(order))
        barred = {k: set(told[k].as_py()) for k in np.flatnonzero(told.is_valid().to_numpy(zero_copy_only=False)).tolist()}
        ahead, used = (table.column(c).fill_null(False).to_numpy()[order] for c in ("ahead", "used"))
        ends, found = np.searchsorted(at, at + seconds, "right"), []
        for k in range(len(ids)):
            if used[k] or ahead[k]:
                continue
            near = v[k + 1 : ends[k]] @ v[k]
            take = np.flatnonzero((near >= cosine) & ~used[k + 1 : ends[k]])
            if k in barred:
                take = take[[ids[k + 1 + j] not in barred[k] for j in take.tolist()]] if len(take) else take
            if len(take):
                own = np.concatenate([[k], k + 1 + take])
                used[own] = True
                found.append((ids[own], np.full(len(own), ids[own].min()), np.full(len(own), near[take].mean())))
        of, group, score = (np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
        return pa.table({"group_id": group, "asset_id": of, "similarity": score})

    return run


def chunked_stars(items: DataFrame, cells: DataFrame, seconds: float, cosine: float, by: str, chunk: int) -> DataFrame:
    """star_groups() of the sessions of cells (by, session, _cell, n), none with more than `chunk` items in a cell; items: by, session, _cell, asset_id, at, vector, blocked.

    A session is cut between cells into chunks that follow each other: a task walks one and the cell after it, whose items it may take, and the next chunk is told which it took.
    In a turn all sessions walk a chunk. No task sorts a session's cells: their running sums are those of 4,096 cells each, and of cells inside them.
    """
    spark, key = items.sparkSession, [by, "session"]
    far = cells.withColumn("far", F.floor(F.col("_cell") / 4096).cast("long"))
    upto = far.groupBy(*key, "far").agg(F.sum("n").alias("all")).withColumn("start", F.sum("all").over(Window.partitionBy(*key).orderBy("far")) - F.col("all"))
    inside = F.sum("n").over(Window.partitionBy(*key, "far").orderBy("_cell")) - F.col("n")
    turn = far.withColumn("inside", inside).join(upto, [*key, "far"]).select(*key, "_cell", F.floor((F.col("start") + F.col("inside")) / chunk).cast("int").alias("turn"))
    turn = durable(turn)
    before = turn.select(*key, (F.col("_cell") + 1).alias("_cell"), F.col("turn").alias("was"))
    # A chunk's first cell is also walked with the chunk before.
    turns = turn.join(before, [*key, "_cell"], "left").select(*key, "_cell", F.explode(F.when(F.col("was") < F.col("turn"), F.array("turn", "was")).otherwise(F.array("turn"))).alias("now"), "turn")
    placed = items.join(turns, [*key, "_cell"]).select("asset_id", "at", "vector", "blocked", (F.col("now") < F.col("turn")).alias("ahead"), *key, F.col("now").alias("turn"))
    path = new_folder(spark, "chunks")
    placed.repartition("turn", *key).write.partitionBy("turn").parquet(path)
    schema, out, last = placed.drop("turn").schema, None, None
    for k in range(turn.agg(F.max("turn")).first()[0] + 1):
        now = spark.read.schema(schema).parquet(f"{path}/turn={k}")
        now = now.withColumn("used", F.lit(False)) if last is None else now.join(last.select("asset_id", F.lit(True).alias("used")), "asset_id", "left")
        last = durable(now.select("asset_id", "at", "vector", "blocked", "ahead", "used", *key).groupBy(*key).applyInArrow(_walk(seconds, cosine), STARS))
        out = last if out is None else out.union(last)
    return out


def spread_stars(items: DataFrame, barred: DataFrame, seconds: float, cosine: float, by: str) -> DataFrame:
    """star_groups() over an edge table: in a round an item whose earlier neighbours are all taken becomes a seed, and one whose
    earliest neighbour that is not taken is a seed belongs to it. Rounds follow the time that a session spans in windows, not its items.
    """
    spark = items.sparkSession
    v = durable(items.select(by, "_cell", "asset_id", "at", media.scaled(F.transform("vector", lambda x: x.cast("double"))).alias("v")))
    x = v.select(by, F.explode(F.array("_cell", F.col("_cell") + 1)).alias("_cell"), F.col("asset_id").alias("i"), F.col("at").alias("at_i"), F.col("v").alias("v_i"))
    y = v.select(by, "_cell", F.col("asset_id").alias("j"), F.col("at").alias("at_j"), F.col("v").alias("v_j"))
    near = x.join(y, [by, "_cell"]).filter((F.struct("at_i", "i") < F.struct("at_j", "j")) & (F.col("at_j") - F.col("at_i") <= seconds)).withColumn("s", media.dot(F.col("v_i"), F.col("v_j"))).filter(F.col("s") >= cosine)
    edges = durable(near.join(barred.toDF("i", "j"), ["i", "j"], "left_anti").select("i", "j", "at_i", "s"))
    state, path = write_table(v.select("asset_id", F.lit(None).cast("long").alias("seed")))  # its own id: a seed; another: taken by it
    while True:
        of_i = state.select(F.col("asset_id").alias("i"), F.col("seed").alias("seed_i"))
        open_ = state.filter("seed is null").select(F.col("asset_id").alias("j"))
        first = edges.join(open_, "j", "left_semi").join(of_i, "i").filter("seed_i is null or seed_i = i").groupBy("j").agg(F.min_by(F.struct("i", "seed_i"), F.struct("at_i", "i")).alias("f"))
        told = open_.join(first, "j", "left").select(F.col("j").alias("asset_id"), F.when(F.col("f").isNull(), F.col("j")).otherwise(F.col("f.seed_i")).alias("new"))
        after, new_path = write_table(state.join(told, "asset_id", "left").select("asset_id", F.coalesce("seed", "new").alias("seed")))
        drop_table(spark, path)
        state, path = after, new_path
        if state.filter("seed is null").isEmpty():
            break
    took = state.filter("seed <> asset_id").select("seed", F.col("asset_id").alias("j")).join(edges.withColumnRenamed("i", "seed"), ["seed", "j"])
    groups = took.groupBy("seed").agg(F.least("seed", F.min("j")).alias("group_id"), F.avg("s").alias("similarity"))
    members = took.select("seed", F.col("j").alias("asset_id")).union(groups.select("seed", F.col("seed").alias("asset_id")))
    return members.join(groups, "seed").select("group_id", "asset_id", "similarity")


def duplicate_groups(features: DataFrame, exclusions: DataFrame, t: Thresholds) -> DataFrame:
    """All tiers over features (asset_id, library_id, file_hash, file_size, phash, dhash, vector, at, burst_id)."""
    blocked = exclusions.filter("asset_b is not null")
    left = durable(features.join(exclusions.filter("asset_b is null").select(F.col("asset_a").alias("asset_id")), "asset_id", "left_anti"))
    stages = (
        ("exact", exact_groups), ("near", lambda f: near_groups(f, blocked, t)), ("burst", burst_id_groups),
        ("burst", lambda f: star_groups(f, blocked, t.burst_seconds, t.burst_cosine)), ("similar", lambda f: star_groups(f, blocked, t.similar_seconds, t.similar_cosine)),
    )
    out = None
    for tier, stage in stages:
        found = durable(stage(left).withColumn("tier", F.lit(tier)))
        left = left.join(found.select("asset_id"), "asset_id", "left_anti")
        out = found if out is None else out.unionByName(found)
    return out.select("tier", "group_id", "asset_id", "similarity")


# Factor, weight and phrase, in the order that breaks ties.
FACTORS = (
    ("technical", 0.30, "the sharpest, cleanest detail"), ("face_quality", 0.20, "the best face-capture quality"), ("aesthetic", 0.15, "the strongest composition score"),
    ("resolution", 0.15, "more usable resolution"), ("exposure", 0.10, "the most balanced exposure"), ("preference", 0.10, "your favourite/edit history"),
)


def rank_best(members: DataFrame, group: str = "group_id") -> DataFrame:
    """members (group, asset_id, one column a factor, null where unknown) plus n_<factor>, score and rank.

    A factor is scaled to 0..1 in its group; where all tie it adds nothing but keeps its weight; where nobody has it, it drops out.
    """
    w = Window.partitionBy(group)
    df = members
    for f, _, _ in FACTORS:
        lo, hi = F.min(f).over(w), F.max(f).over(w)
        df = df.withColumn(f"n_{f}", F.when(lo.isNotNull(), F.when(hi > lo, F.coalesce((F.col(f) - lo) / (hi - lo), F.lit(0.0))).otherwise(0.0)))
    total = sum((F.when(F.col(f"n_{f}").isNotNull(), weight).otherwise(0.0) for f, weight, _ in FACTORS), F.lit(0.0))
    score = sum((weight * F.coalesce(f"n_{f}", F.lit(0.0)) for f, weight, _ in FACTORS), F.lit(0.0))
    df = df.withColumn("score", F.when(total > 0, score / total).otherwise(0.0))
    return df.withColumn("rank", F.row_number().over(w.orderBy(F.desc(F.round("score", 9)), "asset_id")))


def explain_best(ranked: DataFrame, group: str = "group_id") -> DataFrame:
    """(group, recommended, explanation) from rank_best's result: up to three factors that lead all others by more than 0.1."""
    best = F.col("rank") == 1
    aggs = [F.max(F.when(best, F.col("asset_id"))).alias("recommended"), F.count(F.lit(1)).alias("n")]
    for f, _, _ in FACTORS:
        aggs += [F.max(F.when(best, F.col(f"n_{f}"))).alias(f"b_{f}"), F.max(F.when(~best, F.coalesce(f"n_{f}", F.lit(0.0)))).alias(f"o_{f}")]
    lead = [F.when(F.col(f"b_{f}") > F.coalesce(f"o_{f}", F.lit(0.0)) + 0.1, F.struct((-weight * F.col(f"b_{f}")).alias("v"), F.lit(k).alias("k"), F.lit(phrase).alias("p"))) for k, (f, weight, phrase) in enumerate(FACTORS)]
    top = F.transform(F.slice(F.array_sort(F.array_compact(F.array(*lead))), 1, 3), lambda s: s["p"])
    return ranked.groupBy(group).agg(*aggs).withColumn("top", top).select(group, "recommended", _sentence(F.col("top"), F.col("n")).alias("explanation"))


def _sentence(top: Column, n: Column) -> Column:
    listed = F.when(F.size(top) == 1, top[0]).otherwise(F.concat(F.array_join(F.slice(top, F.lit(1), F.size(top) - 1), ", "), F.lit(", and "), F.element_at(top, -1)))
    return F.when(n < 2, "").when(F.size(top) == 0, "Recommended as the best overall balance; differences are small.").otherwise(F.concat(F.lit("Recommended because it has "), listed, F.lit(".")))


def not_similar_pairs(groups: DataFrame) -> DataFrame:
    """Feedback 'not similar' for a group a user looked at: all pairs of its members."""
    m = groups.groupBy("group_id").agg(F.sort_array(F.collect_list("asset_id")).alias("m"))
    a = m.select("group_id", F.posexplode("m").alias("k", "asset_a"), "m")
    return a.select("asset_a", F.explode(F.slice("m", F.col("k") + 2, F.size("m"))).alias("asset_b"))
