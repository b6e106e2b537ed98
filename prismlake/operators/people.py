"""People: constrained graph clustering, and the review queue."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import media
from ..plans.components import connected_components
from ..plans.durable import drop_table, durable, write_table
from ..plans.tiles import packed, task_pairs

BLOCK = 8192
#: Faces of dependent clusters that take turns in one task, with their vectors as they are.
TURNS = 500_000


def pair_scores(labelled: DataFrame, block: int = BLOCK) -> DataFrame:
    """(same, similarity, k): over all pairs of rows (face_id, label, vector), how many with equal or different labels have a similarity, to six places.

    A task multiplies pairs of blocks and adds up counts over all of them: what it sends is at most a row for each similarity of at most one, however many pairs it has.
    """

    def score(pairs: Iterator[tuple[pa.Table, pa.Table, bool]]) -> Iterator[pa.RecordBatch]:
        half, tile = 1 << 21, 512
        counts = np.zeros(2 * half, np.int64)

        def rows(key: np.ndarray, k: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(key % 2 == 1), pa.array((key >> 1) / 1e6), pa.array(k)], ["same", "similarity", "k"])

        for a, b, same in pairs:
            (x, v), (y, t) = ((q.column("face_id").to_numpy(), np.stack(q.column("vector").to_numpy()).astype(np.float64)) for q in (a, b))
            labels = pa.chunked_array([*a.column("label").chunks, *b.column("label").chunks]).combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy()
            u, s = labels[: len(x)], labels[len(x) :]
            for at in range(0, len(x), tile):
                key = np.rint((v[at : at + tile] @ t.T) * 1e6).astype(np.int64) * 2 + (u[at : at + tile, None] == s[None, :])
                key = key[x[at : at + tile, None] < y[None, :]] if same else key.ravel()
                if len(key) and key.min() >= -half and key.max() < half:
                    counts += np.bincount(key + half, minlength=2 * half)
                elif len(key):
                    yield rows(*np.unique(key, return_counts=True))
        found = np.flatnonzero(counts)
        yield rows(found - half, counts[found])

    blocks = packed(labelled.select("face_id", "label", "vector"), "face_id", block)
    return task_pairs(blocks, score, "same boolean, similarity double, k long").groupBy("same", "similarity").agg(F.sum("k").alias("k"))


def must_link_roots(faces: DataFrame, constraints: DataFrame, members: DataFrame) -> DataFrame:
    """(face_id, root): super-nodes of must-links and of faces confirmed for one person; the least face is the root."""
    must = constraints.filter("kind = 'must_link'").select(F.col("face_a").alias("a"), F.col("face_b").alias("b"))
    sure = members.filter("confirmed").select("face_id", "person_id").join(faces.select("face_id"), "face_id", "left_semi")
    anchor = sure.groupBy("person_id").agg(F.min("face_id").alias("a"))
    chain = sure.join(anchor, "person_id").select("a", F.col("face_id").alias("b"))
    known = faces.select("face_id")
    edges = must.union(chain).join(known.select(F.col("face_id").alias("a")), "a", "left_semi").join(known.select(F.col("face_id").alias("b")), "b", "left_semi")
    return known.join(connected_components(edges).withColumnRenamed("id", "face_id"), "face_id", "left").select("face_id", F.coalesce("component", "face_id").alias("root"))


def cannot_link_told(roots: DataFrame, constraints: DataFrame) -> DataFrame:
    """(a, b), a < b: super-nodes that may not meet by constraint."""
    no = constraints.filter("kind = 'cannot_link'").select("face_a", "face_b")
    ra, rb = roots.select(F.col("face_id").alias("face_a"), F.col("root").alias("x")), roots.select(F.col("face_id").alias("face_b"), F.col("root").alias("y"))
    return no.join(ra, "face_a").join(rb, "face_b").filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def root_persons(roots: DataFrame, members: DataFrame) -> DataFrame:
    """(root, person_id): the super-node of each person's confirmed faces. Different persons' ones may not meet: a label says so without a pair."""
    return members.filter("confirmed").join(roots, "face_id").groupBy("person_id").agg(F.min("root").alias("root")).groupBy("root").agg(F.min("person_id").alias("person_id"))


def cannot_link_roots(roots: DataFrame, constraints: DataFrame, members: DataFrame) -> DataFrame:
    """All pairs (a, b), a < b, that may not meet, those of different persons included: a report for few persons; clustering uses the labels."""
    told = cannot_link_told(roots, constraints)
    persons = members.filter("confirmed").join(roots, "face_id").groupBy("person_id").agg(F.min("root").alias("r"))
    p = persons.alias("p").join(persons.alias("q"), F.expr("p.person_id < q.person_id")).select(F.col("p.r").alias("x"), F.col("q.r").alias("y"))
    return told.union(p.filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))).distinct()


def graph_edges(neighbors: DataFrame, faces: DataFrame, roots: DataFrame, told: DataFrame, persons: DataFrame, base: float) -> DataFrame:
    """(a, b, weight), a < b: summed similarities of neighbours above their adaptive threshold; mutual neighbours count twice.

    told: pairs (a, b) that may not meet; persons: (root, person_id), of which no two different ones may.
    """
    f = faces.join(roots, "face_id").join(persons, "root", "left")
    a = f.select("face_id", F.col("root").alias("ra"), F.col("quality").alias("qa"), F.col("pixel_size").alias("pa"), F.col("yaw").alias("ya"), F.col("person_id").alias("person_a"))
    b = f.select(F.col("face_id").alias("neighbor"), F.col("root").alias("rb"), F.col("quality").alias("qb"), F.col("pixel_size").alias("pb"), F.col("yaw").alias("yb"), F.col("person_id").alias("person_b"))
    j = neighbors.join(a, "face_id").join(b, "neighbor").filter("ra <> rb and not coalesce(person_a <> person_b, false)")
    t = media.adaptive_threshold(base, F.col("qa"), F.col("qb"), F.col("pa"), F.col("pb"), F.col("ya"), F.col("yb"))
    e = j.filter(F.col("similarity") >= t).select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b"), "similarity")
    return e.join(told, ["a", "b"], "left_anti").groupBy("a", "b").agg(F.sum("similarity").alias("weight"))


#: Votes are summed as whole numbers of this part, so their order does not matter.
_VOTE = 1e-9


def _draw(node: Column, seed: int, sweep: int) -> Column:
    """A node's place in the visiting order of a sweep; ties go to the least node."""
    return F.xxhash64(node.cast("long"), F.lit(seed).cast("long"), F.lit(sweep).cast("long"))


def draw(node: int, seed: int, sweep: int) -> int:
    """The same outside Spark."""
    h = 42
    for x in (node, seed, sweep):
        h = xxhash.xxh64_intdigest(int(x).to_bytes(8, "little", signed=True), h)
    return h - (1 << 64) if h >> 63 else h


def whispers(edges: DataFrame, told: DataFrame, persons: DataFrame, rounds: int = 40, seed: int = 0x5EED, small: int = 10_000_000) -> DataFrame:
    """(root, label) by Chinese Whispers; a label is forbidden to a node while one that may not meet it carries it: one told, or one of another person.

    In each of at most `rounds` sweeps every node, in an order drawn anew by hash, takes the label with the largest summed weight among its neighbours, ties to the least, and
    sees the labels that nodes before it took in this sweep; it ends with a sweep that changes nothing. Labels never leave a component. Components of at most `small` edges (some 60 bytes each) run in a task each;
    larger ones run in Spark, where a node moves once all nodes before it that it depends on have moved. Both give the same labels.
    """
    edges = durable(edges.withColumn("weight", F.round(F.col("weight") / _VOTE).cast("long")))
    of = durable(connected_components(edges))
    e = durable(edges.join(of, edges.a == of.id).select("component", "a", "b", "weight"))
    large = durable(e.groupBy("component").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > small).select("component"))
    c = told.join(of, told.a == of.id).select("component", "a", "b", F.lit("told").alias("kind"), F.lit(0).cast("long").alias("weight"))
    p = persons.join(of, persons.root == of.id).select("component", F.col("root").alias("a"), F.col("person_id").alias("b"), F.lit("person").alias("kind"), F.lit(0).cast("long").alias("weight"))
    all_ = e.withColumn("kind", F.lit("edge")).unionByName(c).unionByName(p)
    out = all_.join(large, "component", "left_anti").select("component", "a", "b", "kind", "weight").groupBy("component").applyInArrow(_whispers_alone(rounds, seed), "root long, label long")
    if large.isEmpty():
        return out
    rest = durable(all_.join(large, "component", "left_semi"))
    return out.union(_whispers_spread(rest, rounds, seed))


def draws(nodes: np.ndarray, seed: int, sweep: int) -> np.ndarray:
    """draw() of many nodes: XXH64 of eight bytes, chained."""
    one, two, three, four, five = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    turned = lambda x, n: (x << np.uint64(n)) | (x >> np.uint64(64 - n))
    h = np.full(len(nodes), 42, np.uint64)
    for x in (nodes.astype(np.int64).view(np.uint64), np.full(len(nodes), seed, np.int64).view(np.uint64), np.full(len(nodes), sweep, np.int64).view(np.uint64)):
        h = turned((h + five + np.uint64(8)) ^ (turned(x * two, 31) * one), 27) * one + four
        h = (h ^ (h >> np.uint64(33))) * two
        h = (h ^ (h >> np.uint64(29))) * three
        h ^= h >> np.uint64(32)
    return h.view(np.int64)


def _adjacent(n: int, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[list[int], np.ndarray, np.ndarray]:
    """Links both ways: each node's first place, and at the places the other nodes and the weights."""
    mine, other = np.concatenate([x, y]), np.concatenate([y, x])
    order = np.argsort(mine, kind="stable")
    return np.searchsorted(mine[order], np.arange(n + 1)).tolist(), other[order], np.concatenate([weight, weight])[order]


def _whispers_alone(rounds: int, seed: int):
    """The sweeps over one component, in arrays; a node whose neighbours kept their labels since its last turn keeps its own, unless it has a person."""

    def run(table: pa.Table) -> pa.Table:
        a, b, w = (table.column(c).to_numpy() for c in ("a", "b", "weight"))
        edge, told, named = (pc.equal(table.column("kind"), k).to_numpy() for k in ("edge", "told", "person"))
        nodes = np.unique(np.concatenate([a, b[~named]]))
        x, y = np.searchsorted(nodes, a), np.searchsorted(nodes, np.where(named, nodes[0], b))
        first, other, weight = _adjacent(len(nodes), x[edge], y[edge], w[edge])
        bar, barred, _ = _adjacent(len(nodes), x[told], y[told], w[told])
        person = dict(zip(x[named].tolist(), b[named].tolist(), strict=True))
        voters = np.flatnonzero(np.diff(first))
        label, open_ = list(range(len(nodes))), bytearray(b"\1" * len(nodes))  # a label is a node's place, and places are in the order of ids
        carried: dict[int, dict[int, int]] = {k: {q: 1} for k, q in person.items()}  # label -> person -> nodes
        for sweep in range(rounds):
            changed = False
            for k in voters[np.lexsort((voters, draws(nodes[voters], seed, sweep)))].tolist():
                q = person.get(k)
                if q is None and not open_[k]:
                    continue
                open_[k] = 0
                at, end = first[k], first[k + 1]
                near, score = other[at:end].tolist(), {}
                for v, s in zip(near, weight[at:end].tolist(), strict=True):
                    v = label[v]
                    score[v] = score.get(v, 0) + s
                against = barred[bar[k] : bar[k + 1]].tolist()
                bad = {label[v] for v in against}
                ok = [(-s, v) for v, s in score.items() if v not in bad and (q is None or not carried.get(v, {}).keys() - {q})]
                if ok and (new := min(ok)[1]) != label[k]:
                    if q is not None:
                        was = carried[label[k]]
                        was[q] -= 1
                        if not was[q]:
                            del was[q]
                        now = carried.setdefault(new, {})
                        now[q] = now.get(q, 0) + 1
                    label[k], changed = new, True
                    for v in (*near, *against):
                        open_[v] = 1
            if not changed:
                break
        return pa.table({"root": nodes[voters], "label": nodes[np.array(label, np.int64)[voters]]})

    return run


def _whispers_spread(graph: DataFrame, rounds: int, seed: int) -> DataFrame:
    """The sweeps as rounds over tables (component, a, b, kind, weight).

    In a round those nodes move that no node before them in the sweep keeps waiting: a neighbour or one told apart that has not moved, or, for a node with a person, one of another person
    that could still take or leave a label that it might take. Votes are grouped sums and waiting is a grouped minimum, so no component and no hub is in one task.
    """
    spark = graph.sparkSession
    two_ways = lambda kind: graph.filter(F.col("kind") == kind).select(F.col("a").alias("root"), F.col("b").alias("other"), "weight").union(graph.filter(F.col("kind") == kind).select("b", "a", "weight"))
    votes_of, barred = durable(two_ways("edge")), durable(two_ways("told").select("root", "other"))
    person = graph.filter("kind = 'person'").select(F.col("a").alias("root"), F.col("b").alias("person_id"))
    ends = graph.filter("kind <> 'person'").select("component", F.col("a").alias("root")).union(graph.filter("kind <> 'person'").select("component", "b")).union(graph.filter("kind = 'person'").select("component", "a"))
    nodes = ends.distinct().join(person, "root", "left").join(votes_of.select("root").distinct().withColumn("votes", F.lit(True)), "root", "left")
    labels, path = write_table(nodes.select("root", "component", "person_id", F.col("votes").isNotNull().alias("votes"), F.col("root").alias("label"), F.lit(False).alias("done")))
    tied = durable(votes_of.select("root", "other").union(barred))
    for sweep in range(rounds):
        before = labels.select("root", F.col("label").alias("was"))
        kept_path, path, first = path, None, True
        labels = labels.withColumn("done", ~F.col("votes")).withColumn("at", F.struct(_draw(F.col("root"), seed, sweep), "root"))
        while True:
            waiting = labels.filter("not done").select("root", "at")
            late = tied.join(waiting, "root").join(waiting.select(F.col("root").alias("other"), F.col("at").alias("other_at")), "other").filter("other_at < at").select("root").distinct()
            ready = labels.filter("not done").join(late, "root", "left_anti").select("root", "component", "person_id", "at", F.col("label").alias("own"))
            votes = votes_of.join(ready, "root").join(labels.select(F.col("root").alias("other"), "label"), "other").groupBy("root", "component", "person_id", "at", "own", "label").agg(F.sum("weight").alias("score"))
            bad = barred.join(labels.select(F.col("root").alias("other"), "label"), "other").select("root", "label").distinct()
            votes = durable(votes.join(bad, ["root", "label"], "left_anti"))
            named = votes.filter("person_id is not null")
            might = named.select("component", "label", "at").union(ready.filter("person_id is not null").select("component", "own", "at")).groupBy("component", "label").agg(F.min("at").alias("first"))
            unready = labels.filter("not done and person_id is not null").join(ready.select("root"), "root", "left_anti").groupBy("component").agg(F.min("at").alias("first"))
            held = named.join(might, ["component", "label"]).filter("first < at").select("root").union(named.join(unready, "component").filter("first < at").select("root")).distinct()
            taken = labels.filter("person_id is not null").groupBy("label").agg(F.min("person_id").alias("least"), F.max("person_id").alias("most"))
            free = votes.join(taken, "label", "left").filter("person_id is null or least is null or (least = person_id and most = person_id)")
            new = free.groupBy("root").agg(F.max_by("label", F.struct("score", -F.col("label"))).alias("new"))
            go = ready.select("root").join(held, "root", "left_anti").join(new, "root", "left").withColumn("go", F.lit(True))
            after, own = write_table(labels.join(go, "root", "left").select("root", "component", "person_id", "votes", F.when(F.col("go"), F.coalesce("new", "label")).otherwise(F.col("label")).alias("label"), (F.col("done") | F.coalesce("go", F.lit(False))).alias("done"), "at"))
            if path:
                drop_table(spark, path)
            labels, path, first = after, own, False
            if labels.filter("not done").isEmpty():
                break
        changed = not labels.join(before, "root").filter("label <> was").isEmpty()
        drop_table(spark, kept_path)
        if not changed:
            break
        labels = labels.drop("at")
    return labels.filter("votes").select("root", "label")


def build_clusters(faces: DataFrame, roots: DataFrame, labels: DataFrame, members: DataFrame, min_size: int) -> DataFrame:
    """(cluster, face_id, person_id): clusters of enough faces or with a confirmed person; the person only where there is just one."""
    f = faces.select("face_id").join(roots, "face_id").join(labels, "root", "left").select("face_id", F.coalesce("label", "root").alias("cluster"))
    f = f.join(members.filter("confirmed").select("face_id", "person_id"), "face_id", "left")
    n = f.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("person_id").alias("p"), F.max("person_id").alias("one"))
    kept = n.filter((F.col("n") >= min_size) | (F.col("p") > 0)).select("cluster", F.when(F.col("p") == 1, F.col("one")).alias("person"))
    return f.join(kept, "cluster").select("cluster", "face_id", F.col("person").alias("person_id"))


def verify_clusters(clusters: DataFrame, faces: DataFrame, constraints: DataFrame, members: DataFrame, base: float, named_margin: float = 0.05) -> DataFrame:
    """(cluster, face_id, similarity, verdict): keep, conflict or below, in the order protected first, then most central.

    A face must reach max(base, mean - 3 deviations) of its cluster, and for a named person the confirmed faces' centroid. Confirmed and must-linked faces are protected.
    Of faces that may not meet the first in order stays: only they are ordered, in rounds in which those are settled whose earlier opponents are. No cluster is in one task.
    """
    sure = members.filter("confirmed").select("face_id").distinct().withColumn("sure", F.lit(True))
    f = clusters.select("cluster", "face_id", "person_id").join(faces.select("face_id", "quality", "vector"), "face_id").join(sure, "face_id", "left").join(_linked(constraints), "face_id", "left")
    f = durable(f.withColumn("safe", F.col("sure").isNotNull() | F.col("linked").isNotNull()))
    named = cluster_stats(f.filter("sure and person_id is not null").select("cluster", "face_id"), faces).select("cluster", F.col("centroid").alias("known"))
    stats = cluster_stats(clusters, faces).select("cluster", "centroid", F.greatest(F.lit(base), F.col("mean_similarity") - 3 * F.col("deviation")).alias("floor"))
    scored = f.join(stats, "cluster").join(named, "cluster", "left").withColumn("similarity", media.dot(F.col("vector"), F.col("centroid")))
    stranger = F.coalesce(media.dot(F.col("vector"), F.col("known")) < base + named_margin, F.lit(False))
    scored = durable(scored.select("cluster", "face_id", "safe", "similarity", (~F.col("safe") & ((F.col("similarity") < F.col("floor")) | stranger)).alias("below"), F.struct(~F.col("safe"), -F.col("similarity"), "face_id").alias("at")))
    no = constraints.filter("kind = 'cannot_link'")
    no = no.select(F.col("face_a").alias("face_id"), F.col("face_b").alias("other")).union(no.select("face_b", "face_a")).distinct()
    mine = scored.select("cluster", "face_id", "safe", "at", "below")
    there = mine.select("cluster", F.col("face_id").alias("other"), F.col("safe").alias("other_safe"), F.col("below").alias("other_below"), F.col("at").alias("other_at"))
    # Who an unprotected face would have to give way to: an earlier one that can stay.
    before = durable(no.join(mine, "face_id").join(there, ["cluster", "other"]).filter("not safe and not other_below and other_at < at").select("cluster", "face_id", "other", "other_safe"))
    lost, settled = _give_way(before)
    lost = lost.withColumn("conflict", F.lit(True))
    found = scored.join(lost, ["cluster", "face_id"], "left")
    return found.select("cluster", "face_id", "similarity", F.when(F.col("conflict"), "conflict").when(F.col("below"), "below").otherwise("keep").alias("verdict"))


def _linked(constraints: DataFrame) -> DataFrame:
    return constraints.filter("kind = 'must_link'").select(F.explode(F.array("face_a", "face_b")).alias("face_id")).distinct().withColumn("linked", F.lit(True))


def _give_way(before: DataFrame) -> tuple[DataFrame, int]:
    """(cluster, face_id) of the faces that meet an earlier one that stays, over pairs (cluster, face_id, other, other_safe) with other earlier, and the number of rounds.

    A face stays if none before it does; what has no pair of its own stays.
    """
    key, rounds = ["cluster", "face_id"], 0
    lost = durable(before.filter("other_safe").select(*key).distinct())
    left = durable(before.join(lost, key, "left_anti"))
    while not left.isEmpty():
        rounds += 1
        gone = left.join(lost.select("cluster", F.col("face_id").alias("other")), ["cluster", "other"], "left_anti")  # who lost no longer counts
        open_ = gone.join(left.select("cluster", F.col("face_id").alias("other")).distinct().withColumn("waits", F.lit(True)), ["cluster", "other"], "left")
        more = durable(open_.filter("waits is null").select(*key).distinct())  # an opponent that waits for nobody stays
        if more.isEmpty():
            # Those whose opponents all lost stay; the first of what is left always belongs to them.
            left = durable(open_.select("cluster", "face_id", "other", "other_safe"))
            continue
        lost = durable(lost.union(more))
        left = durable(open_.join(more, key, "left_anti").select("cluster", "face_id", "other", "other_safe"))
    return lost, rounds


def _centroid(v: np.ndarray, q: np.ndarray) -> np.ndarray:
    c = q @ v
    n = np.linalg.norm(c)
    return c / n if n > 0 else c


def cluster_stats(clusters: DataFrame, faces: DataFrame) -> DataFrame:
    """(cluster, n, mean_similarity, deviation, centroid): quality-weighted unit centroid; sums by dimension, no group is collected."""
    f = clusters.select("cluster", "face_id").join(faces.select("face_id", "quality", "vector"), "face_id")
    dims = f.select("cluster", F.posexplode("vector").alias("d", "x"), "quality").groupBy("cluster", "d").agg(F.sum(F.col("quality") * F.col("x").cast("double")).alias("x"))
    raw = dims.groupBy("cluster").agg(F.transform(F.sort_array(F.collect_list(F.struct("d", "x"))), lambda s: s["x"]).alias("c"))
    centre = raw.select("cluster", media.scaled(F.col("c")).alias("centroid"))
    s = f.join(centre, "cluster").withColumn("s", media.dot(F.col("vector"), F.col("centroid")))
    return s.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.avg("s").alias("mean_similarity"), F.stddev_pop("s").alias("deviation")).join(centre, "cluster")


def confidence_label(existing: Column, mean: Column, n: Column) -> Column:
    return F.when(existing, "confirmed").when((mean >= 0.70) & (n >= 5), "likely").when(mean >= 0.55, "needs_review").otherwise("low_confidence")


def ambiguous(clusters: DataFrame, faces: DataFrame, neighbors: DataFrame, constraints: DataFrame, members: DataFrame, margin: float = 0.05, small: int | None = None) -> DataFrame:
    """(cluster, face_id, own, evicted) of all faces of (cluster, face_id): those whose best other cluster, among those of their neighbours, is within the margin of their own go.

    Clusters take their turn in order of their ids; one that loses faces gets a new centroid, which later clusters see. Protected faces stay. A cluster depends on the earlier ones
    that its faces' neighbours belong to: groups of dependent clusters of up to `small` faces (TURNS) take turns in one task, larger ones in rounds of all clusters whose earlier ones are done. Both give the same.
    """
    spark, small = clusters.sparkSession, TURNS if small is None else small
    safe = members.filter("confirmed").select("face_id").union(_linked(constraints).select("face_id")).distinct().withColumn("safe", F.lit(True))
    f = durable(clusters.select("cluster", "face_id").join(faces.select("face_id", "quality", "vector"), "face_id").join(safe, "face_id", "left").withColumn("safe", F.col("safe").isNotNull()))
    where = f.select(F.col("face_id").alias("neighbor"), F.col("cluster").alias("there"))
    near = durable(neighbors.select("face_id", "neighbor").join(f.filter("not safe").select("face_id", "cluster"), "face_id").join(where, "neighbor").filter("there <> cluster").select("cluster", "face_id", "there").distinct())
    links = durable(near.select("cluster", "there").distinct())
    of = durable(connected_components(links, "cluster", "there").select(F.col("id").alias("cluster"), F.col("component").alias("group")))
    f = f.join(of, "cluster", "left")
    large = durable(f.filter(F.col("group").isNotNull()).groupBy("group").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > small).select("group"))
    own = f.filter(F.col("group").isNull()).join(cluster_stats(f.filter(F.col("group").isNull()), faces).select("cluster", "centroid"), "cluster")
    out = own.select("cluster", "face_id", media.dot(F.col("vector"), F.col("centroid")).alias("own"), F.lit(False).alias("evicted"))
    told = near.groupBy("face_id").agg(F.collect_set("there").alias("there"))  # at most as many as a face has neighbours
    alone = f.filter(F.col("group").isNotNull()).join(large, "group", "left_anti").join(told, "face_id", "left")
    out = out.union(alone.select("cluster", "face_id", "quality", "vector", "there", "group").groupBy("group").applyInArrow(_turns_alone(margin), "cluster long, face_id long, own double, evicted boolean"))
    if large.isEmpty():
        return out
    f = durable(f.join(large, "group", "left_semi").drop("group"))
    near, links = (durable(x.join(f.select("cluster").distinct(), "cluster", "left_semi")) for x in (near, links))
    centres, path = write_table(cluster_stats(f, faces).select("cluster", "centroid", F.lit(False).alias("done")))
    while True:
        open_ = centres.filter("not done").select("cluster")
        held = links.filter("there < cluster").join(open_, "cluster").join(open_.withColumnRenamed("cluster", "there"), "there").select("cluster").distinct()
        turn = durable(open_.join(held, "cluster", "left_anti"))
        mine = f.join(turn, "cluster").join(centres.select("cluster", "centroid"), "cluster").select("cluster", "face_id", "vector", "quality", media.dot(F.col("vector"), F.col("centroid")).alias("own"))
        others = mine.join(near.drop("cluster"), "face_id").join(centres.select(F.col("cluster").alias("there"), F.col("centroid").alias("their")), "there")
        best = others.groupBy("face_id").agg(F.max(media.dot(F.col("vector"), F.col("their"))).alias("other"))
        seen = durable(mine.join(best, "face_id", "left").select("cluster", "face_id", "own", F.coalesce(F.col("other") > F.col("own") - margin, F.lit(False)).alias("evicted")))
        out = out.union(seen)
        torn = seen.filter("evicted").select("cluster").distinct()
        rebuilt = cluster_stats(seen.filter("not evicted").join(torn, "cluster", "left_semi").select("cluster", "face_id"), faces).select("cluster", F.col("centroid").alias("fresh"))
        empty = torn.join(rebuilt, "cluster", "left_anti").withColumn("fresh", F.array().cast("array<double>"))
        after, new_path = write_table(centres.join(turn.withColumn("now", F.lit(True)), "cluster", "left").join(rebuilt.union(empty), "cluster", "left").select("cluster", F.coalesce("fresh", "centroid").alias("centroid"), (F.col("done") | F.col("now").isNotNull()).alias("done")))
        drop_table(spark, path)
        centres, path = after, new_path
        if centres.filter("not done").isEmpty():
            return out


def _turns_alone(margin: float):
    def run(table: pa.Table) -> pa.Table:
        order = np.lexsort((table.column("face_id").to_numpy(), table.column("cluster").to_numpy()))
        cluster, ids, q = (table.column(c).to_numpy()[order] for c in ("cluster", "face_id", "quality"))
        vectors = table.column("vector").combine_chunks()
        v = vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)
        q, there, own = q.astype(float), table.column("there").combine_chunks(), np.empty(len(ids))
        starts = np.flatnonzero(np.diff(cluster, prepend=cluster[0] - 1)).tolist()
        rows = {int(cluster[at]): range(at, end) for at, end in zip(starts, [*starts[1:], len(ids)], strict=True)}
        of = lambda at: v[order[at]].astype(float)
        centre = {c: _centroid(of(list(at)), q[at.start : at.stop]) for c, at in rows.items()}
        evicted = np.zeros(len(ids), bool)
        for c, at in rows.items():
            for k, x in zip(at, of(list(at)), strict=True):
                others = there[int(order[k])].as_py() or ()
                own[k] = x @ centre[c]
                other = max((float(x @ centre[o]) if len(centre[o]) else 0.0 for o in others), default=-1.0)
                evicted[k] = bool(others) and other > own[k] - margin
            if evicted[at.start : at.stop].any():
                left = [k for k in at if not evicted[k]]
                centre[c] = _centroid(of(left), q[left]) if left else np.empty(0)
        return pa.table({"cluster": cluster, "face_id": ids, "own": own, "evicted": evicted})

    return run


def cluster_faces(
    faces: DataFrame, neighbors: DataFrame, constraints: DataFrame, members: DataFrame, *, base: float = 0.45, min_quality: float = 0.15, min_size: int = 3, margin: float = 0.05, named_margin: float = 0.05, rounds: int = 40, seed: int = 0x5EED, small: int = 10_000_000
) -> tuple[DataFrame, DataFrame]:
    """(clusters, review) of all faces (face_id, quality, pixel_size, yaw, vector), from their neighbours to the review queue.

    clusters: (cluster, face_id, person_id, mean_similarity, confidence), the last two of the faces that stay. review: (face_id, cluster, similarity, reason): low_quality,
    below_cluster_threshold (small groups, without a cluster, and faces below their cluster's threshold), constraint_conflict, ambiguous_between_clusters. Every face is in just one of the two.
    neighbors: (face_id, neighbor, similarity); null qualities count as low; faces that are not there are ignored. `small` bounds what one task takes, never what comes out.
    """
    usable = durable(faces.filter(F.col("quality") >= min_quality))
    low = faces.join(usable.select("face_id"), "face_id", "left_anti")
    roots = durable(must_link_roots(usable, constraints, members))
    told, persons = durable(cannot_link_told(roots, constraints)), durable(root_persons(roots, members))
    labels = durable(whispers(graph_edges(neighbors, usable, roots, told, persons, base), told, persons, rounds, seed, small))
    built = durable(build_clusters(usable, roots, labels, members, min_size))
    verdicts = durable(verify_clusters(built, usable, constraints, members, base, named_margin))
    kept = durable(built.join(verdicts.filter("verdict = 'keep'").select("cluster", "face_id"), ["cluster", "face_id"]))
    turns = durable(ambiguous(kept, usable, neighbors, constraints, members, margin, min(small, TURNS)))
    final = kept.join(turns.filter("not evicted").select("cluster", "face_id"), ["cluster", "face_id"])
    stats = cluster_stats(final, usable).select("cluster", "n", "mean_similarity")
    clusters = final.join(stats, "cluster").select("cluster", "face_id", "person_id", "mean_similarity", confidence_label(F.col("person_id").isNotNull(), F.col("mean_similarity"), F.col("n")).alias("confidence"))
    none, below = F.lit(None), "below_cluster_threshold"
    review = low.select("face_id", none.cast("long").alias("cluster"), none.cast("double").alias("similarity"), F.lit("low_quality").alias("reason"))
    review = review.union(usable.join(built, "face_id", "left_anti").select("face_id", none.cast("long"), none.cast("double"), F.lit(below)))
    review = review.union(verdicts.filter("verdict <> 'keep'").select("face_id", "cluster", "similarity", F.when(F.col("verdict") == "conflict", "constraint_conflict").otherwise(below)))
    return clusters, review.union(turns.filter("evicted").select("face_id", "cluster", "own", F.lit("ambiguous_between_clusters")))


def confirm(members: DataFrame, constraints: DataFrame, person_id: int, faces: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Memberships with the faces confirmed for the person, and constraints with must-links to its least face."""
    new = faces.select("face_id", F.lit(person_id).cast("long").alias("person_id"), F.lit(True).alias("confirmed"))
    out = members.join(new.select("face_id"), "face_id", "left_anti").unionByName(new)
    anchor = out.filter(F.col("person_id") == person_id).agg(F.min("face_id").alias("anchor"))
    links = new.crossJoin(anchor).filter("face_id <> anchor").select(F.least("face_id", "anchor").alias("face_a"), F.greatest("face_id", "anchor").alias("face_b"), F.lit("must_link").alias("kind"))  # anchor is one row
    return out, constraints.join(links.select("face_a", "face_b"), ["face_a", "face_b"], "left_anti").unionByName(links)


def merge_persons(members: DataFrame, constraints: DataFrame, source: int, target: int) -> tuple[DataFrame, DataFrame]:
    """Moves the source's faces to the target and drops cannot-links inside the union."""
    out = members.withColumn("person_id", F.when(F.col("person_id") == source, F.lit(target).cast("long")).otherwise(F.col("person_id")))
    mine = out.filter(F.col("person_id") == target).select("face_id")
    inside = constraints.filter("kind = 'cannot_link'").join(mine.withColumnRenamed("face_id", "face_a"), "face_a", "left_semi").join(mine.withColumnRenamed("face_id", "face_b"), "face_b", "left_semi").select("face_a", "face_b", "kind")
    return out, constraints.join(inside, ["face_a", "face_b", "kind"], "left_anti")


def reject(members: DataFrame, constraints: DataFrame, face_id: int, person_id: int) -> tuple[DataFrame, DataFrame]:
    """Takes a face from a person: its membership goes, and its constraints with the person's faces become cannot-links."""
    others = members.filter((F.col("person_id") == person_id) & (F.col("face_id") != face_id)).select("face_id")
    f = F.lit(face_id).cast("long")
    new = others.select(F.least(F.col("face_id"), f).alias("face_a"), F.greatest(F.col("face_id"), f).alias("face_b"), F.lit("cannot_link").alias("kind"))
    return members.filter(~((F.col("face_id") == face_id) & (F.col("person_id") == person_id))), constraints.join(new.select("face_a", "face_b"), ["face_a", "face_b"], "left_anti").unionByName(new)


def suggestions(faces: DataFrame, members: DataFrame, persons: DataFrame, constraints: DataFrame, person_id: int, least: float, limit: int = 60) -> DataFrame:
    """(face_id, similarity): faces most like the mean of a person's, without its own, rejected ones and those of other named persons."""
    mine = members.filter(F.col("person_id") == person_id).select("face_id")
    dims = faces.join(mine, "face_id", "left_semi").select(F.posexplode("vector").alias("d", "x")).groupBy("d").agg(F.avg(F.col("x").cast("double")).alias("x"))
    mean = dims.agg(F.transform(F.sort_array(F.collect_list(F.struct("d", "x"))), lambda s: s["x"]).alias("c")).select(media.scaled(F.col("c")).alias("c"))
    named = members.join(persons.filter("name is not null").select("person_id"), "person_id", "left_semi").filter(F.col("person_id") != person_id).select("face_id")
    no = constraints.filter("kind = 'cannot_link'")
    rejected = no.join(mine.withColumnRenamed("face_id", "face_a"), "face_a", "left_semi").select(F.col("face_b").alias("face_id")).union(no.join(mine.withColumnRenamed("face_id", "face_b"), "face_b", "left_semi").select("face_a"))
    rest = faces.join(mine.union(named).union(rejected), "face_id", "left_anti")
    scored = rest.crossJoin(F.broadcast(mean)).select("face_id", media.dot(F.col("vector"), F.col("c")).alias("similarity"))  # mean is one row
    return scored.filter(F.col("similarity") >= least - 0.05).orderBy(F.desc("similarity"), "face_id").limit(limit)


def calibration(pairs: DataFrame) -> DataFrame:
    """(threshold, tp, fp, fn, tn, balanced) for thresholds -0.20, -0.19, .. 0.99 over counts of pairs (similarity, same, k).

    They are summed by hundredths first, so the sweep runs over 121 rows whatever their number.
    """
    hundredth = F.floor(F.round(F.col("similarity") * 100, 6)).cast("int")
    bins = pairs.groupBy(F.least(F.greatest(hundredth, F.lit(-21)), F.lit(99)).alias("h")).agg(F.sum(F.when(F.col("same"), F.col("k")).otherwise(0)).alias("s"), F.sum(F.when(~F.col("same"), F.col("k")).otherwise(0)).alias("d"))
    steps = pairs.sparkSession.range(-20, 100).select(F.col("id").cast("int").alias("k"))
    n = steps.join(bins).groupBy("k").agg(*[F.sum(F.when(c, F.col(x)).otherwise(0)).alias(a) for a, x, c in (("tp", "s", F.expr("h >= k")), ("fp", "d", F.expr("h >= k")), ("fn", "s", F.expr("h < k")), ("tn", "d", F.expr("h < k")))])
    balanced = (F.try_divide(F.col("tp"), F.col("tp") + F.col("fn")) + F.try_divide(F.col("tn"), F.col("tn") + F.col("fp"))) / 2
    return n.select((F.col("k") / 100).alias("threshold"), "tp", "fp", "fn", "tn", F.round(balanced, 6).alias("balanced"))
