"""Clustering end to end against a sequential version, and as rounds."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from prismlake.operators import people
from prismlake.plans.catalog_queries import QUERIES

FACE = "face_id long, vector array<double>, quality double, pixel_size double, yaw double"


@pytest.fixture
def few_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def slow_whispers(edges, told, persons, rounds, seed=0x5EED):
    """Every node in order of its draw; different persons' nodes may not meet."""
    linked, barred = {}, {}
    for a, b, w in edges:
        w = round(w / 1e-9)
        linked.setdefault(a, []).append((b, w))
        linked.setdefault(b, []).append((a, w))
    roots = dict(persons)
    for a, b in [*told, *((x, y) for x in roots for y in roots if roots[x] != roots[y])]:
        barred.setdefault(a, set()).add(b)
        barred.setdefault(b, set()).add(a)
    label = {x: x for x in (*linked, *barred)}
    for sweep in range(rounds):
        changed = False
        for x in sorted(linked, key=lambda x: (people.draw(x, seed, sweep), x)):
            score = {}
            for y, w in linked[x]:
                score[label[y]] = score.get(label[y], 0) + w
            ok = [(-s, v) for v, s in score.items() if not any(label[y] == v for y in barred.get(x, ()))]
            if ok and min(ok)[1] != label[x]:
                label[x], changed = min(ok)[1], True
        if not changed:
            break
    return {x: label[x] for x in linked}


def test_draw_is_the_same_in_spark(spark):
    got = spark.range(-3, 50).select("id", people._draw(F.col("id"), 0x5EED, 7).alias("x")).collect()
    assert all(people.draw(r.id, 0x5EED, 7) == r.x for r in got)


def random_graph(seed, n, m):
    rng = np.random.default_rng(seed)
    pairs = {tuple(sorted(rng.choice(n, 2, replace=False).tolist())) for _ in range(m)}
    edges = [(a, b, float(rng.choice([0.5, 0.6, 0.7]))) for a, b in sorted(pairs)]
    told = sorted({tuple(sorted(rng.choice(n, 2, replace=False).tolist())) for _ in range(n // 6)} - pairs)
    return edges, told, [(int(x), 100 + k) for k, x in enumerate(rng.choice(n, n // 6, replace=False))]


def frames(spark, edges, told, persons):
    return (spark.createDataFrame(edges, "a long, b long, weight double"), spark.createDataFrame(told, "a long, b long"), spark.createDataFrame(persons, "root long, person_id long"))


def test_a_component_above_a_hundred_thousand_edges_needs_no_rounds(spark, monkeypatch):
    monkeypatch.setattr(people, "_whispers_spread", None)  # each of its rounds is several jobs, and a sweep takes many
    ids = np.arange(-5, 40)
    assert people.draws(ids, 0x5EED, 3).tolist() == [people.draw(k, 0x5EED, 3) for k in ids.tolist()]
    edges = spark.range(30_000).selectExpr("id", "explode(sequence(1, 4)) k").selectExpr("id a", "(id + k * k) % 30000 b", "1D + id % 7 weight")
    edges = edges.selectExpr("least(a, b) a", "greatest(a, b) b", "weight")
    persons = spark.createDataFrame([(5, 1), (900, 2), (904, 3)], "root long, person_id long")
    told = spark.createDataFrame([(10, 14)], "a long, b long")
    got = {r.root: r.label for r in people.whispers(edges, told, persons).collect()}
    assert len(got) == 30_000 and got[10] != got[14] and len({got[5], got[900], got[904]}) == 3


@pytest.mark.parametrize("seed,n,m,small,rounds", [(1, 60, 110, 10**6, 40), (2, 60, 80, 100, 40), (3, 18, 26, 1, 2)])
def test_whispers_do_not_depend_on_size(spark, few_partitions, seed, n, m, small, rounds):
    graph = random_graph(seed, n, m)
    got = {r.root: r.label for r in people.whispers(*frames(spark, *graph), rounds=rounds, small=small).collect()}
    assert got == slow_whispers(*graph, rounds)


# The whole of it


def unit(x):
    n = np.linalg.norm(x)
    return x / n if n > 0 else x


def centre(v, q, rows):
    return unit(sum(q[k] * v[k] for k in rows))


def slow_cluster(faces, near, constraints, members, base, min_quality, min_size, margin, named_margin, rounds):
    """Sequential: faces (id, vector, quality, pixel_size, yaw) -> ({face: cluster}, {face: (cluster, reason)})."""
    v, q = {f[0]: np.array(f[1], float) for f in faces}, {f[0]: f[2] for f in faces}
    px, yaw = {f[0]: f[3] for f in faces}, {f[0]: f[4] for f in faces}
    review = {f: (None, "low_quality") for f in v if q[f] is None or q[f] < min_quality}
    usable = sorted(set(v) - set(review))
    sure = {f: p for f, p, c in members if c}
    root = {f: f for f in usable}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    first = {}
    musts = [(a, b) for a, b, k in constraints if k == "must_link"]
    for f in sorted(sure):
        if f in root:
            musts.append((first.setdefault(sure[f], f), f))
    for a, b in musts:
        if a in root and b in root and find(a) != find(b):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    at = {f: find(f) for f in usable}
    told = {tuple(sorted((at[a], at[b]))) for a, b, k in constraints if k == "cannot_link" and a in at and b in at and at[a] != at[b]}
    person = {}
    for p, f in sorted(first.items()):
        person.setdefault(at[f], p)
    weight = {}
    for f, n, s in near:
        if f not in at or n not in at or at[f] == at[n]:
            continue
        pair = tuple(sorted((at[f], at[n])))
        pa, pb = person.get(at[f]), person.get(at[n])
        if pair in told or (pa is not None and pb is not None and pa != pb):
            continue
        t = base + 0.10 * (1 - min(q[f], q[n])) + (0.05 if min(px[f], px[n]) < 64 else 0)
        if yaw[f] is not None and yaw[n] is not None and (abs(yaw[f]) > 0.6) != (abs(yaw[n]) > 0.6):
            t += 0.04
        if s >= t:
            weight[pair] = weight.get(pair, 0.0) + s
    label = slow_whispers([(a, b, w) for (a, b), w in weight.items()], told, list(person.items()), rounds)
    groups = {}
    for f in usable:
        groups.setdefault(label.get(at[f], at[f]), []).append(f)
    clusters = {}
    for c, fs in sorted(groups.items()):
        names = {sure[f] for f in fs if f in sure}
        if len(fs) < min_size and not names:
            review.update({f: (None, "below_cluster_threshold") for f in fs})
        else:
            clusters[c] = (fs, names.pop() if len(names) == 1 else None)
    safe = set(sure) | {f for a, b, k in constraints if k == "must_link" for f in (a, b)}
    barred = {}
    for a, b, k in constraints:
        if k == "cannot_link":
            barred.setdefault(a, set()).add(b)
            barred.setdefault(b, set()).add(a)
    for c, (fs, p) in clusters.items():
        mid = centre(v, q, fs)
        sim = {f: float(v[f] @ mid) for f in fs}
        floor = max(base, np.mean(list(sim.values())) - 3 * np.std(list(sim.values())))
        known = centre(v, q, [f for f in fs if f in sure]) if p is not None and any(f in sure for f in fs) else None
        keep = []
        for f in sorted(fs, key=lambda f: (f not in safe, -sim[f], f)):
            if barred.get(f, set()) & set(keep) and f not in safe:
                review[f] = (c, "constraint_conflict")
            elif f not in safe and (sim[f] < floor or (known is not None and v[f] @ known < base + named_margin)):
                review[f] = (c, "below_cluster_threshold")
            else:
                keep.append(f)
        clusters[c] = (keep, p)
    where = {f: c for c, (fs, _) in clusters.items() for f in fs}
    mids = {c: centre(v, q, fs) for c, (fs, _) in clusters.items() if fs}
    neighbours = {}
    for f, n, _ in near:
        neighbours.setdefault(f, []).append(n)
    for c, (fs, p) in sorted(clusters.items()):
        keep = []
        for f in fs:
            others = {where[n] for n in neighbours.get(f, ()) if n in where and where[n] != c}
            best = max((float(v[f] @ mids[o]) for o in others), default=-1)
            if f not in safe and others and best > float(v[f] @ mids[c]) - margin:
                review[f] = (c, "ambiguous_between_clusters")
            else:
                keep.append(f)
        if len(keep) != len(fs):
            clusters[c] = (keep, p)
            mids[c] = centre(v, q, keep) if keep else np.zeros_like(mids[c])
    return {f: c for c, (fs, _) in clusters.items() for f in fs}, review


def whole(spark, faces, near, constraints, members, **options):
    f = spark.createDataFrame(faces, FACE)
    n = spark.createDataFrame(near, "face_id long, neighbor long, similarity double")
    c = spark.createDataFrame(constraints, "face_a long, face_b long, kind string")
    m = spark.createDataFrame(members, "face_id long, person_id long, confirmed boolean")
    clusters, review = people.cluster_faces(f, n, c, m, **options)
    found = {r.face_id: r for r in clusters.collect()}
    return found, {r.face_id: (r.cluster, r.reason) for r in review.collect()}


def people_and_strangers(seed, groups=6, each=9, noise=1.1):
    rng = np.random.default_rng(seed)
    mids = rng.normal(size=(groups, 12))
    mids[1::2] += 1.6 * mids[::2]  # pairs of people that look alike
    faces, k = [], 0
    for g in range(groups):
        for _ in range(each):
            k += 1
            x = unit(unit(mids[g]) + noise * rng.normal(size=12) / np.sqrt(12))
            faces.append((k, x.tolist(), float(rng.choice([0.05, 0.4, 0.9], p=[0.06, 0.3, 0.64])), float(rng.choice([40, 150])), None if k % 7 == 0 else float(rng.uniform(-1, 1))))
    v = np.array([f[1] for f in faces])
    sim = v @ v.T
    near = [(a + 1, int(b) + 1, float(sim[a, b])) for a in range(k) for b in np.argsort(-sim[a], kind="stable")[:9] if b != a]
    constraints = [(1, 2, "cannot_link"), (3, 4, "cannot_link"), (10, 11, "cannot_link"), (4, 5, "must_link"), (20, 29, "must_link"), (11, 12, "cannot_link")]
    members = [(1, 501, True), (6, 501, True), (19, 777, True), (30, 777, False), (46, 888, True)]
    return faces, near, constraints, members


OPTIONS = {"base": 0.35, "min_quality": 0.15, "min_size": 3, "margin": 0.1, "named_margin": 0.05, "rounds": 40}


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_sequential_clustering(spark, few_partitions, seed):
    data = people_and_strangers(seed)
    found, review = whole(spark, *data, **OPTIONS)
    want, want_review = slow_cluster(*data, **OPTIONS)
    assert {f: r.cluster for f, r in found.items()} == want
    assert review == want_review
    assert set(found) | set(review) == {f[0] for f in data[0]} and not set(found) & set(review)
    assert len({r[1] for r in want_review.values()}) >= 3


def test_turns_in_rounds_equal_turns_in_a_task(spark, few_partitions):
    """The ambiguity pass over a chain of clusters that look alike: later ones see what earlier ones lost."""
    faces, near, constraints, members = people_and_strangers(11, groups=6, each=6, noise=1.3)
    f = spark.createDataFrame(faces, FACE)
    n = spark.createDataFrame(near, "face_id long, neighbor long, similarity double")
    c = spark.createDataFrame(constraints, "face_a long, face_b long, kind string")
    m = spark.createDataFrame(members, "face_id long, person_id long, confirmed boolean")
    clusters = f.select(F.expr("(face_id - 1) div 6").alias("cluster"), "face_id")
    got = [{(r.cluster, r.face_id): (round(r.own, 9), r.evicted) for r in people.ambiguous(clusters, f, n, c, m, 0.3, small).collect()} for small in (0, 10**6)]
    assert got[0] == got[1] and len(got[0]) == len(faces) and 3 < sum(e for _, e in got[0].values()) < len(faces)


def test_conflicts_are_settled_in_order(spark):
    """A chain of faces that may not meet in pairs: the first stays, the second goes, the third stays again; who is below the threshold drives nobody out."""
    pairs = [(1, k, k - 1, False) for k in range(2, 9)] + [(2, 5, 4, False), (2, 6, 4, True), (2, 6, 5, False)]
    lost, rounds = people._give_way(spark.createDataFrame(pairs, "cluster long, face_id long, other long, other_safe boolean"))
    assert {(r.cluster, r.face_id) for r in lost.collect()} == {(1, 2), (1, 4), (1, 6), (1, 8), (2, 5), (2, 6)} and rounds < 8


def test_query_covers_all_faces(spark):
    sf = "/root/testdata/sf0.001"
    got = QUERIES["face_clustering"](spark, sf)
    rows = got.collect()
    faces = spark.read.parquet(f"{sf}/embeddings.parquet").filter("vec_id % 31 <> 0").count()
    assert len(rows) == len({r.face_id for r in rows}) == faces
    assert {r.state for r in rows} >= {"low_quality", "below_cluster_threshold"}


def test_nothing(spark):
    found, review = whole(spark, [], [], [], [])
    assert not found and not review
