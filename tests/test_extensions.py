"""The table function and the aggregate that SQL users get."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from prismlake.operators import duplicates, extensions


def near(rng: random.Random, n: int) -> list[int]:
    """Hashes in families whose members differ in some bits, extremes included."""
    out = [0, -1, 1 << 62, -(1 << 63)]
    while len(out) < n:
        h = rng.getrandbits(64)
        for _ in range(4):
            for bit in rng.sample(range(64), rng.randrange(0, 20)):
                h ^= 1 << bit
            out.append(h - (1 << 64) if h >> 63 else h)
    return out


@pytest.mark.parametrize("radius", [0, 6, 12, 19, 40])
def test_probes_find_all_within_a_radius(spark, radius):
    hs = near(random.Random(radius), 240)
    df = spark.createDataFrame([(h,) for h in set(hs)] + [(None,)], "h long")
    extensions.register(spark, {12: duplicates.hamming_parts(df.filter("h is not null"), 12)})
    sql = f"""SELECT DISTINCT x.h AS a, y.h AS b FROM (SELECT h, p.* FROM {{d}}, LATERAL hash_probes(h, {radius}, TRUE) p) x
        JOIN (SELECT h, p.* FROM {{d}}, LATERAL hash_probes(h, {radius}, FALSE) p) y USING (part, value) WHERE bit_count(x.h ^ y.h) <= {radius}"""
    got = {tuple(r) for r in spark.sql(sql, d=df).collect()}
    want = {(a, b) for a in set(hs) for b in set(hs) if ((a ^ b) & (2**64 - 1)).bit_count() <= radius}
    assert got == want
    most = spark.sql("SELECT max(n) AS n FROM (SELECT h, count(*) AS n FROM {d}, LATERAL hash_probes(h, 19, TRUE) p GROUP BY h)", d=df).first().n
    assert most < 500


def test_probes_of_nulls(spark):
    extensions.register(spark)
    none = "SELECT p.* FROM VALUES (CAST(NULL AS BIGINT)) t(h), LATERAL hash_probes(h, 6, TRUE) p"
    assert spark.sql(none).count() == 0


@pytest.mark.parametrize("per_task", [3, 7, 100_000])
def test_centroids(spark, per_task):
    rng = np.random.default_rng(1)
    rows = [(k, int(g) if g < 4 else None, rng.normal(size=5).tolist() if k % 11 else None, float(k % 3) if k % 13 else None) for k, g in enumerate(rng.choice([0, 0, 0, 1, 2, 3, 4], 300))]
    # A group whose weights add up to zero, and one without any vector.
    rows += [(900, 8, [1.0] * 5, 0.0), (901, 9, None, 1.0)]
    got = {r.g: r for r in extensions.centroids(spark.createDataFrame(rows, "id long, g long, v array<double>, w double"), "g", "v", "w", "id", per_task).collect()}
    assert set(got) == {0, 1, 2, 3, None, 8, 9}
    for g, r in got.items():
        own = [(np.array(v), w) for _, k, v, w in rows if k == g and v is not None and w is not None]
        total = sum(w for _, w in own)
        if total:
            assert np.allclose(r.centroid, sum(v * w for v, w in own) / total) and r.weight == pytest.approx(total)
        else:
            assert r.centroid is None
    assert (got[8].weight, got[9].weight) == (0.0, None)


def test_centroids_of_nothing_and_of_mixed_lengths(spark):
    empty = spark.createDataFrame([], "id long, g long, v array<float>, w int")
    assert extensions.centroids(empty, "g", "v", "w", "id").collect() == []
    mixed = spark.createDataFrame([(1, 1, [1.0], 1), (2, 1, [1.0, 2.0], 1)], "id long, g long, v array<float>, w int")
    with pytest.raises(Exception, match="one length"):
        extensions.centroids(mixed, "g", "v", "w", "id").collect()


def test_vector_sum_in_sql(spark):
    extensions.register(spark)
    r = spark.sql("SELECT vector_sum(array(CAST(id AS DOUBLE), 1D), 2D) AS s FROM range(5)").first()
    assert r.s == [20.0, 10.0]
    assert spark.range(3).select(F.array(F.lit(None).cast("double")).alias("v"), F.lit(1.0).alias("w")).agg(extensions.vector_sum("v", "w").alias("s")).first().s is not None


def test_sql_radius_compares_blocks_above_a_number_of_hashes(spark, tmp_path, monkeypatch):
    from prismlake.plans.catalog_queries import QUERIES

    rng = np.random.default_rng(6)
    v = rng.normal(size=(50, 64))
    rows = [(k, x.tolist()) for k, x in enumerate(np.concatenate([v, 2 * v, v + rng.normal(size=v.shape) / 6]).round(3))]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    want = sorted(tuple(r) for r in QUERIES["sql_radius"](spark, str(tmp_path)).collect())
    monkeypatch.setattr(duplicates, "NESTED_LOOP_ROWS", 0)
    monkeypatch.setattr(duplicates, "HASH_BLOCK", 20)
    found = QUERIES["sql_radius"](spark, str(tmp_path))
    assert "CartesianProduct" in found._jdf.queryExecution().executedPlan().toString()
    assert sorted(tuple(r) for r in found.collect()) == want and len(want) > 20
