"""Exact neighbours with skipped blocks, and lists kept up to date."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pytest

from prismlake.operators import neighbours, people

SCHEMA = "face_id long, vector array<double>"


@pytest.fixture
def small_blocks(monkeypatch):
    for name, value in (("BLOCK", 32), ("TILE", 10), ("PER_PIVOT", 16)):
        monkeypatch.setattr(neighbours, name, value)


def clustered(seed, n, groups, noise):
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(groups, 12))[np.arange(n) % groups] + noise * rng.normal(size=(n, 12))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    v[n // 2 : n // 2 + n // 6] = v[0]  # copies, more than a block holds
    return {3 * k + 1: x for k, x in enumerate(v)}


def frame(spark, rows):
    return spark.createDataFrame([(k, x.tolist()) for k, x in rows.items()], SCHEMA)


def slow(rows, k, least, wanted=None):
    ids = np.array(sorted(rows))
    m = np.array([rows[i] for i in ids.tolist()])
    out = {}
    for i in wanted if wanted is not None else ids.tolist():
        s = m @ rows[i]
        order = [j for j in np.lexsort((ids, -np.round(s, 12))) if ids[j] != i][:k]
        out[i] = [(int(ids[j]), round(float(s[j]), 9)) for j in order if s[j] >= least]
    return {i: x for i, x in out.items() if x}


def lists(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.face_id, r.rank)):
        out.setdefault(r.face_id, []).append((r.neighbor, round(r.similarity, 9)))
    return out


def alike(got, want):
    """Equal lists; equal similarities may come in either order of ids, as rounding decides."""
    assert {k: [s for _, s in x] for k, x in got.items()} == {k: [s for _, s in x] for k, x in want.items()}
    for k, x in got.items():
        last = x[-1][1]
        assert {i for i, s in x if s > last + 1e-9} == {i for i, s in want[k] if s > last + 1e-9}


@pytest.mark.parametrize("noise", [0.1, 3.0])
def test_nearest_with_pruning_is_exact(spark, small_blocks, noise):
    rows = clustered(2, 300, 9, noise)
    alike(lists(neighbours.nearest(frame(spark, rows), 7, 0.1)), slow(rows, 7, 0.1))


def test_blocks_that_cannot_meet_are_skipped(spark, small_blocks):
    df = frame(spark, clustered(5, 600, 8, 0.05))
    pivots = neighbours.choose_pivots(df, 600)
    blocks = neighbours.blocks_of(df, pivots)
    pairs = neighbours.bounded_pairs(blocks, blocks, pivots)
    all_pairs, n = pairs.count(), blocks.count()
    assert all_pairs == n * n and sum(r.n for r in blocks.select("n").collect()) == 600
    near = neighbours._multiplied(pairs.filter("own"), blocks, blocks, 5, 0.2)
    visited = pairs.filter("own").count() + neighbours._open_pairs(pairs, near, blocks, 5, 0.2).count()
    assert visited < 0.3 * all_pairs


def test_nothing_and_one(spark):
    none = spark.createDataFrame([], SCHEMA)
    one = spark.createDataFrame([(1, [1.0, 0.0])], SCHEMA)
    assert neighbours.nearest(none, 3).count() == neighbours.nearest(one, 3).count() == neighbours.between(one, none, 3, 0.1).count() == 0
    assert lists(neighbours.between(one, spark.createDataFrame([(2, [0.5, 0.0]), (3, [0.1, 1.0])], SCHEMA), 3, 0.2)) == {1: [(2, 0.5)]}


@pytest.mark.parametrize("gone_share", [10, 2])
def test_lists_after_changes_equal_new_ones(spark, small_blocks, gone_share):
    """Few faces go: lists are mended; more than a third: they are made anew."""
    rows = clustered(7, 200, 6, 0.6)
    ids = sorted(rows)
    added, removed = set(ids[::9]), set(ids[5::gone_share]) - set(ids[::9])
    old = neighbours.nearest(frame(spark, {i: rows[i] for i in ids if i not in added}), 6, 0.1)
    left = {i: rows[i] for i in ids if i not in removed}
    ids_of = lambda s: spark.createDataFrame([(i,) for i in sorted(s)], "face_id long")
    got = neighbours.nearest_added(old, frame(spark, left), ids_of(added), ids_of(removed), 6, 0.1)
    alike(lists(got), slow(left, 6, 0.1))


def test_lists_of_another_length_are_made_anew(spark):
    rows = {k: np.eye(3)[k % 3] for k in range(9)}
    wrong = spark.createDataFrame([(0, 99, 1.0, 1)], "face_id long, neighbor long, similarity double, rank int")
    nobody = spark.createDataFrame([], "face_id long")
    alike(lists(neighbours.nearest_added(wrong, frame(spark, rows), nobody, nobody, 2, 0.1, made_for=5)), slow(rows, 2, 0.1))


def test_products_of_blocks_are_read_and_not_shuffled(spark, small_blocks):
    rows = clustered(7, 300, 9, 3.0)
    df = frame(spark, rows)
    pivots = neighbours.choose_pivots(df, 300)
    blocks = neighbours.blocks_of(df, pivots)
    found = neighbours._multiplied(neighbours.bounded_pairs(blocks, blocks, pivots), blocks, blocks, 5, 0.1)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "SortMergeJoin" not in plan
    alike(lists(neighbours.top_k(found, 5)), slow(rows, 5, 0.1))
    assert blocks.count() > 4 and found.count() <= 300 * 5, "a row has k for each range of blocks, not for each block"


@pytest.mark.parametrize("scale", [1.0, 9.0])
def test_pair_scores_count_every_pair_once(spark, scale):
    rng = np.random.default_rng(3)
    rows = [(int(k), None if k % 10 == 0 else int(k % 3), (scale * rng.normal(size=4) / 4).tolist()) for k in range(90)]
    found = people.pair_scores(spark.createDataFrame(rows, "face_id long, label int, vector array<double>"), 16)
    assert "FlatMapCoGroups" not in found._jdf.queryExecution().executedPlan().toString()
    got = sum(r.k for r in found.collect()), {(r.same, round(r.similarity, 6)): r.k for r in found.collect()}
    want = Counter((u == s, round(float(np.rint(np.dot(v, w) * 1e6)) / 1e6, 6)) for a, u, v in rows for b, s, w in rows if a < b)
    assert got == (90 * 89 // 2, dict(want))
