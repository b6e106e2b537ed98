"""Hard negatives against a version that scores every pair."""

from __future__ import annotations

import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from prismlake.llm import negatives, queries

SCHEMA = "vec_id long, embedding array<float>, label int, same string, part int, score double"


def slow(rows, is_anchor):
    """rows: (id, vector, label); whole repeats count once."""
    good = {(i, tuple(v), y) for i, v, y in rows if i is not None and y is not None and v is not None and all(c is not None and math.isfinite(c) for c in v)}
    good = sorted(good)
    width = max((len(v) for _, v, _ in good), default=0)
    x = [[math.floor(256 * float(np.float32(c))) for c in v] + [0] * (width - len(v)) for _, v, _ in good]
    out = []
    for a, (i, _, y) in enumerate(good):
        if not is_anchor(i):
            continue
        score = [(-sum(p * q for p, q in zip(x[a], z, strict=True)), r[0]) for z, r in zip(x, good, strict=True)]
        for ps, p in sorted(s for b, s in enumerate(score) if b != a and good[b][2] == y)[:5]:
            fit = sorted(s for b, s in enumerate(score) if good[b][2] != y and 30 * -ps <= 100 * -s[0] <= 90 * -ps)[:10]
            out += [(i, p, k, n, -ps, -ns) for k, (ns, n) in enumerate(fit, 1)]
    return sorted(out)


def found(df):
    return sorted(tuple(r) for r in df.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


def frame(spark, rows):
    return spark.createDataFrame([(i, v, y, "s", 3, 0.5) for i, v, y in rows], SCHEMA).repartition(3)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_equals_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '/root/testdata/{sf}/embeddings.parquet'")
    want = con.sql(f"select anchor_id, positive_id, rank, negative_id, positive_score, negative_score from ({queries.ORACLES['op11_hard_negatives']})").fetchall()
    assert found(queries.op11_hard_negatives(spark, f"/root/testdata/{sf}")) == sorted(want) and want


@pytest.fixture
def tiny_nodes(monkeypatch):
    """Many parts and nodes even for a few hundred rows."""
    for name, value in (("NODE", 8), ("SAMPLE", 64), ("BLOCK", 5), ("PART", 40)):
        monkeypatch.setattr(negatives, name, value)


def test_clusters_ties_and_copies(spark, tiny_nodes):
    """Clustered rows, a third of them copies of one vector, zero vectors, and few rows of a label: pruned, split and exact."""
    rng = np.random.default_rng(1)
    centre = rng.normal(size=(6, 8))
    rows = [(k, (centre[k % 6] * (1 + k % 3) + rng.normal(size=8) / 9).round(2).tolist(), int(rng.integers(0, 4))) for k in range(400)]
    rows += [(1000 + k, [1.0, 0.5] + [0.0] * 6, k % 3) for k in range(200)] + [(2000 + k, [0.0] * 8, k % 2) for k in range(20)] + [(3000, [2.0] * 8, 77), (3010, [2.0] * 8, 78)]
    got = found(negatives.mine(frame(spark, rows), "vec_id % 10 = 0"))
    assert got == slow(rows, lambda i: i % 10 == 0) and len(got) > 500


def test_awkward_rows(spark, tiny_nodes):
    """Nulls in any column, infinite and empty vectors, shorter ones, repeated rows, ids that repeat with other labels, large numbers, an empty table."""
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0], 1), (0, [1.0, 2.0], 1), (0, [2.0, 1.0], 1), (0, [1.0, 2.0], 2), (None, [1.0, 1.0], 1), (1, None, 1), (2, [1.0, 1.0], None), (3, [None, 1.0], 1), (4, [nan, 1.0], 1), (5, [inf, 1.0], 2)]
    rows += [(6, [], 1), (7, [3.0], 2), (8, [0.5, 0.5], 1), (9, [0.3, 1.0], 2), (9, [0.3, 1.0], 2), (10, [-1.0, -2.0], 1), (11, [0.4, 0.9], 3), (20, [-0.5, 0.001], 3), (-10, [1.0, 0.25], 2)]
    got = negatives.mine(frame(spark, rows), "vec_id % 10 = 0")
    assert found(got) == slow(rows, lambda i: i % 10 == 0)
    empty = negatives.mine(frame(spark, rows).limit(0), "vec_id % 10 = 0")
    assert empty.dtypes == got.dtypes and empty.count() == 0
    assert negatives.mine(frame(spark, rows), "vec_id = 12345").count() == 0
    large = [(k, [float(np.float32(x)) for x in v], y) for k, (v, y) in enumerate([([3e5, 1.0], 1), ([2e5, 2e5], 1), ([1e5, 1e5], 2), ([5e4, 3.0], 2), ([9e4, -1e5], 3)])]
    assert found(negatives.mine(frame(spark, large), "true")) == slow(large, lambda i: True)
    with pytest.raises(ValueError):
        negatives.mine(frame(spark, [(1, [1e30], 1)]), "true")


def test_nodes_are_skipped():
    """In clustered rows most nodes lie outside the annuli, and what is skipped holds nothing."""
    rng = np.random.default_rng(3)
    n, k = 4096, 5
    x = np.floor(256 * (rng.normal(size=(32, 16))[np.arange(n) % 32] + rng.normal(size=(n, 16)) / 50))
    rows = negatives.Rows(np.arange(n), np.arange(n) % 7, np.zeros(n, np.int64), x)
    space = negatives.Space(float((x * x).sum(1).max()))
    tree, order, edges = negatives.grow(x, space, 6)
    rows = rows.take(order)
    seen = []
    t = negatives.Targets(rows.take(np.arange(0, n, 64)), np.arange(64), np.arange(64), np.full(64, -(1 << 62)), np.full(64, 1 << 62))
    products = negatives._products
    negatives._products = lambda q, y, exact: seen.append(len(q) * len(y)) or products(q, y, exact)
    try:
        target, score, other = negatives.search(rows, tree, edges, t, space, k, True, True)
    finally:
        negatives._products = products
    for a in range(64):
        s = (rows.x @ t.anchors.x[a]).astype(int)
        want = sorted((-s[b], rows.ids[b]) for b in range(n) if rows.labels[b] == t.anchors.labels[a] and rows.ids[b] != t.anchors.ids[a])[:k]
        assert [(-p, i) for p, i in zip(score[target == a], other[target == a], strict=True)] == want
    assert sum(seen) < 0.5 * 64 * n


def test_null_free_schema(spark):
    got = queries.op11_hard_negatives(spark, "/root/testdata/sf0.001")
    assert [t for _, t in got.dtypes] == ["bigint", "bigint", "int", "bigint", "bigint", "bigint"]
    assert got.filter(F.col("negative_score") * 100 > F.col("positive_score") * 90).count() == 0
