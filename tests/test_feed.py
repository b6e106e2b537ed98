"""The change feed with state: any order, repeats, restarts, forgotten tombstones and lost history."""

from __future__ import annotations

import datetime
import decimal
import random
import time
from types import SimpleNamespace

import pytest
from pyspark.sql import Row
from pyspark.sql import types as T
from pyspark.sql.types import LongType, StructType

from prismlake.streaming.feed import ChangeFeed, Newest

PAYLOAD = StructType().add("value", LongType())
SCHEMA = "id string, seq long, op string, value long"


class Source:
    def __init__(self, spark, path):
        self.spark, self.path, self.n = spark, str(path), 0

    def put(self, rows):
        self.spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{self.path}/{self.n}")
        self.n += 1


def state_of(changes) -> dict:
    best = {}
    for k, seq, op, v in changes:
        if k is not None and seq is not None and (k not in best or (seq, op == "delete") > best[k][:2]):
            best[k] = (seq, op == "delete", v)
    return {k: (s, v) for k, (s, gone, v) in best.items() if not gone}


def table(feed) -> dict:
    return {r.id: (r.seq, r.value) for r in feed.table().collect()}


def test_any_order_repeats_and_restarts(spark, tmp_path):
    rng = random.Random(5)
    changes = [(f"k{rng.randrange(12)}", s, rng.choice(["upsert", "upsert", "delete"]), s * 10) for s in range(1, 90)]
    changes += [("hot", s, "upsert", s) for s in range(90, 140)] + [(None, 3, "upsert", 1), ("k1", None, "delete", None), ("odd", 7, "upsert", None)]
    rng.shuffle(changes)
    source, seen = Source(spark, tmp_path / "in"), []
    for k in range(0, len(changes), 50):
        part = changes[k : k + 50] + rng.sample(changes[: k + 1], min(k, 9))
        source.put(part)
        seen += part
        # Each run is a new feed object over the same folder.
        feed = ChangeFeed(spark, str(tmp_path / "feed"), "id", PAYLOAD)
        assert feed.apply(source.path) is True
        assert table(feed) == state_of(seen)
    assert feed.token() == 139
    n = feed.log().count()
    source.put(changes)
    assert feed.apply(source.path) is True and feed.log().count() == n, "a repeat was let through"


def test_delta_nets_out(spark, tmp_path):
    source, feed = Source(spark, tmp_path / "in"), ChangeFeed(spark, str(tmp_path / "feed"), "id", PAYLOAD)
    assert feed.position() == (-1, -1) and feed.token() is None
    source.put([("a", 1, "upsert", 1), ("b", 2, "upsert", 1), ("c", 3, "upsert", 1)])
    assert feed.apply(source.path)
    at = feed.position()
    source.put([("b", 4, "upsert", 2), ("c", 5, "delete", None), ("d", 6, "upsert", 1)])
    assert feed.apply(source.path)
    source.put([("d", 7, "delete", None), ("e", 8, "upsert", 1)])
    assert feed.apply(source.path)
    assert {r.id: r.change for r in feed.delta(at).collect()} == {"b": "updated", "c": "deleted", "e": "inserted"}
    assert feed.delta(feed.position()).count() == 0


def test_lost_history_needs_a_reconcile(spark, tmp_path):
    source, feed = Source(spark, tmp_path / "in"), ChangeFeed(spark, str(tmp_path / "feed"), "id", PAYLOAD)
    source.put([("a", 1, "upsert", 1), ("b", 2, "upsert", 2), ("c", 3, "upsert", 3)])
    assert feed.apply(source.path, first=1)
    at = feed.position()
    assert feed.apply(source.path, first=4) is True, "the next change is still there"
    source.put([("a", 9, "delete", None)])
    assert feed.apply(source.path, first=9) is False
    assert table(feed) == {"a": (1, 1), "b": (2, 2), "c": (3, 3)}
    with pytest.raises(ValueError):
        feed.reconcile(spark.createDataFrame([("a", 1)], "id string, value long"), 2)
    feed.reconcile(spark.createDataFrame([("a", 1), ("b", 7), ("d", 4)], "id string, value long"), 8)
    assert table(feed) == {"a": (1, 1), "b": (8, 7), "d": (8, 4)}
    assert {r.id: r.change for r in feed.delta(at).collect()} == {"b": "updated", "c": "deleted", "d": "inserted"}
    # What the snapshot had is not taken in again, what came after it is, a delete of a key that the state has not seen included.
    source.put([("c", 7, "upsert", 1), ("d", 10, "upsert", 5)])
    assert feed.apply(source.path, first=9) is True
    assert table(feed) == {"b": (8, 7), "d": (10, 5)} and feed.token() == 10


def test_forgotten_tombstones(spark, tmp_path):
    """A change that a forgotten tombstone might have forbidden is not let through, but asks for a reconcile."""
    source, feed = Source(spark, tmp_path / "in"), ChangeFeed(spark, str(tmp_path / "feed"), "id", PAYLOAD, keep_seconds=1.0)
    source.put([("a", 1, "upsert", 1), ("a", 5, "delete", None), ("b", 2, "upsert", 2)])
    assert feed.apply(source.path)
    time.sleep(1.5)
    source.put([("b", 1, "upsert", 0), ("c", 6, "upsert", 3)])
    assert feed.apply(source.path) is True, "an old change of a living key is harmless"
    source.put([("a", 3, "upsert", 9)])
    assert feed.apply(source.path) is False
    assert set(table(feed)) == {"b", "c"}
    feed.reconcile(spark.createDataFrame([("b", 2), ("c", 3)], "id string, value long"), 6)
    assert feed.apply(source.path) is True and set(table(feed)) == {"b", "c"}


def test_empty_source(spark, tmp_path):
    source, feed = Source(spark, tmp_path / "in"), ChangeFeed(spark, str(tmp_path / "feed"), "id", PAYLOAD)
    source.put([])
    assert feed.apply(source.path) is True and table(feed) == {}


class Kept:
    """A state variable that counts its calls."""

    def __init__(self):
        self.value, self.calls = None, 0

    def get(self):
        self.calls += 1
        return self.value

    def update(self, value):
        self.calls, self.value = self.calls + 1, value

    def clear(self):
        self.update(None)


def test_state_is_called_once_a_bucket_not_once_a_key():
    kept = {"live": Kept(), "gone": Kept()}
    newest = Newest(1000, -1)
    newest.init(SimpleNamespace(getValueState=lambda name, schema, ttl=None: kept[name]))

    def run(now, *changes):
        rows = [Row(id=k, seq=s, op=op, __name=k) for k, s, op in changes]
        return {(r.id, r.seq, r.op) for r in newest.handleInputRows((1,), iter(rows), SimpleNamespace(getCurrentProcessingTimeInMs=lambda: now))}

    many = [(f"k{i}", i % 3, "upsert") for i in range(3000)]
    assert run(0, *many, *[(k, 0, "upsert") for k, _, _ in many]) == set(many)
    assert sum(k.calls for k in kept.values()) <= 4
    assert run(5, ("k1", 5, "delete"), ("k2", 2, "delete"), ("k4", 9, "delete")) == {("k1", 5, "delete"), ("k4", 9, "delete")}
    assert run(900, ("k1", 4, "upsert"), ("k4", 10, "upsert"), ("k7", 6, "delete")) == {("k4", 10, "upsert"), ("k7", 6, "delete")}
    # Tombstones go one by one: that of k1 has been forgotten, that of k7 in the same bucket has not.
    assert run(1005, ("k1", 3, "upsert"), ("k7", 5, "upsert")) == {("k1", 3, "upsert")}
    newest.horizon = 7
    assert run(1900, ("k7", 6, "upsert")) == {("k7", 6, "late")}


@pytest.mark.parametrize(
    "kind, make",
    [
        (T.LongType(), lambda i: i - 300), (T.BinaryType(), lambda i: bytes([255 - i % 256, i // 256])), (T.DecimalType(20, 3), lambda i: decimal.Decimal(i) / 8),
        (T.TimestampType(), lambda i: datetime.datetime(2026, 10, 25, tzinfo=datetime.UTC) + datetime.timedelta(minutes=i)), (T.DateType(), lambda i: datetime.date(2020, 1, 1) + datetime.timedelta(i)),
        (T.DoubleType(), lambda i: float("nan") if i == 7 else -0.0 if i == 0 else i / 7),
    ],
)
def test_keys_of_any_type(spark, tmp_path, kind, make):
    """What a second run lets through shows that it met each key's state of the first, where buckets hold several keys or none."""
    schema = StructType().add("id", kind).add("seq", LongType()).add("op", "string").add("value", LongType())
    feed, n = ChangeFeed(spark, str(tmp_path / "feed"), "id", PAYLOAD, key_type=kind), 600
    spark.createDataFrame([(make(i), 2, "upsert", (1 << 60) + i if i % 2 else None) for i in range(n)], schema).write.parquet(str(tmp_path / "in/0"))
    assert feed.apply(str(tmp_path / "in"))
    second = [(0.0 if make(i) == 0 and kind == T.DoubleType() else make(i), 1 + i % 3, "delete" if i % 2 else "upsert", -i) for i in range(n)]
    spark.createDataFrame(second, schema).write.parquet(str(tmp_path / "in/1"))
    assert feed.apply(str(tmp_path / "in"))
    assert feed.log().count() == n + n // 3
    got = sorted((r.seq, r.value if r.value is not None else 0) for r in feed.table().collect())
    assert got == sorted((3, -i) if i % 3 == 2 else (2, (1 << 60) + i if i % 2 else 0) for i in range(n) if i % 3 != 2 or i % 2 == 0)
