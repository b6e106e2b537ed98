"""A kept index against one made anew."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from prismlake.operators.textindex import TextIndex
from prismlake.plans.durable import new_folder

WORDS = ["the", "then", "thé", "clown", "clow", "a", "ab", "zebra", ""]


def frame(spark, docs):
    return spark.createDataFrame([(i, t) for i, ts in docs.items() for t in ts], "asset_id long, token string").repartition(3)


def ids(spark, some):
    return spark.createDataFrame([(i,) for i in some], "asset_id long")


def held(index):
    return sorted(tuple(r) for r in index.postings().collect())


def test_index_after_changes_equals_a_new_one(spark):
    rng = random.Random(1)
    path, docs = new_folder(spark, "index"), {}
    index = TextIndex.open(spark, path)
    assert held(index) == [] and index.search(["a"]).count() == 0 and index.dictionary().count() == 0
    for step in range(5):
        new = {rng.randrange(12): rng.sample(WORDS, rng.randrange(0, 5)) for _ in range(5)}
        index = index.add(frame(spark, {**new, None: ["lost"]}), ids(spark, new))
        docs |= new
        if step % 2:
            gone = rng.sample(range(12), 3)
            index = index.remove(ids(spark, gone))
            docs = {i: t for i, t in docs.items() if i not in gone}
        want = sorted((t, i) for i, ts in docs.items() for t in set(ts))
        assert held(index) == want
    assert held(TextIndex.open(spark, path)) == want
    merged = index.merged()
    assert held(merged) == want and len(merged.segments) == 1
    counts = {t: sum(t in ts for ts in docs.values()) for t in WORDS}
    for x in (index, merged):
        assert {r.token: r.n for r in x.dictionary().collect()} == {t: n for t, n in counts.items() if n}
        for terms in (["th"], ["the", "clow"], ["thé"], ["", "z"], ["nowhere"]):
            found = {r.asset_id for r in x.search(terms).collect()}
            assert found == {i for i, ts in docs.items() if all(any(t.startswith(q) for t in ts) for q in terms)}
    merged.clear_older(index)
    assert held(TextIndex.open(spark, path)) == want
    with pytest.raises(Exception):
        held(index)


def test_a_prefix_reads_a_range(spark):
    """The condition reaches every segment's scan, and postings are sorted by token in their files."""
    index = TextIndex.open(spark, new_folder(spark, "index"))
    docs = spark.range(2000).select(F.col("id").alias("asset_id"), F.concat(F.lit("t"), F.lpad(F.col("id").cast("string"), 5, "0")).alias("token"))
    index = index.add(docs).add(docs.filter("asset_id % 100 = 0"))
    plan = index.postings(F.startswith("token", F.lit("t0000")))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("StringStartsWith(token,t0000)") == 2
    name = index.segments[0][0]
    files = [r.tokens for r in spark.read.parquet(f"{index.path}/{name}/postings").withColumn("file", F.input_file_name()).groupBy("file").agg(F.struct(F.min("token").alias("a"), F.max("token").alias("b")).alias("tokens")).collect()]
    files.sort()
    assert len(files) > 1 and all(x.b <= y.a for x, y in zip(files[:-1], files[1:], strict=True))
    assert index.prefix("t0000").count() == 10


def test_postings_are_shuffled_once_and_not_sorted_by_asset(spark, tmp_path, monkeypatch):
    from prismlake.operators import textindex

    rows = spark.createDataFrame([("a", 1), ("b", 1), ("a", 1), ("a", 2), ("c", 3)], "token string, asset_id long")
    sorted_ = textindex.ranged(rows, 3)
    got = [tuple(r) for r in sorted_.collect()]
    assert got == [("a", 1), ("a", 2), ("b", 1), ("c", 3)]
    assert sorted_._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].count("Exchange") == 1
    monkeypatch.setattr(textindex, "BROADCAST", -1)
    index = textindex.TextIndex.open(spark, str(tmp_path / "index")).add(rows).add(rows.filter("asset_id = 1 and token = 'b'"))
    alive = index.postings()
    assert sorted(tuple(r) for r in alive.collect()) == [("a", 2), ("b", 1), ("c", 3)]
    assert "SortMergeJoin" not in alive._jdf.queryExecution().executedPlan().toString()
