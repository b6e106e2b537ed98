"""Resumable batches: stops, kills, retries and their ledger."""

from __future__ import annotations

import subprocess
import sys
import time
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType

from prismlake.operators.batches import Batches

ROOT = str(Path(__file__).resolve().parent.parent)
RESULT = StructType().add("value", DoubleType())


def worker(log: str):
    def work(row):
        (Path(log) / f"{row['id']}-{row['_attempt']}-{time.time_ns()}").touch()
        if row["id"] is not None and row["id"] % 7 == 0 and row["_attempt"] == 1:
            raise OSError
        return (10.0 / (row["id"] % 5),) if row["id"] is not None else (None,)

    return work


def calls(log) -> Counter:
    return Counter(tuple(f.name.split("-")[:2]) for f in Path(log).iterdir())


def want(n: int) -> list[tuple]:
    rows = [(i, 3 if i % 5 == 0 else 2 if i % 7 == 0 else 1, i % 5 != 0, 10.0 / (i % 5) if i % 5 else None) for i in range(n)]
    return sorted(rows)


def found(job, items) -> list[tuple]:
    return sorted((r.id, r.attempts, r.done, r.result.value if r.result else None) for r in job.results(items).collect())


def test_stopped_run_goes_on(spark, tmp_path):
    log, items = tmp_path / "log", spark.range(200).withColumn("text", F.lit("x"))
    log.mkdir()
    job = Batches(spark, str(tmp_path / "ledger"), "id", RESULT, chunk_rows=40)
    assert job.run(items, worker(str(log)), lambda done, of: done < 2) is False
    first = calls(log)
    assert 0 < len(first) < 200
    left = job.progress(items).first()
    assert (left.total, left.failed, left.left) == (200, 0, 200 - left.done)
    assert Batches(spark, str(tmp_path / "ledger"), "id", RESULT, chunk_rows=40).run(items, worker(str(log))) is True
    assert found(job, items) == want(200)
    assert set(calls(log).values()) == {1}, "an attempt was made twice"
    assert tuple(job.progress(items).first()) == (200, 160, 40, 0)
    # Nothing is left: a further run calls nothing, and new items are taken up.
    n = sum(calls(log).values())
    assert job.run(items, worker(str(log))) is True and sum(calls(log).values()) == n
    assert job.run(spark.range(210).withColumn("text", F.lit("x")), worker(str(log))) is True
    assert found(job, items) == want(210)


def test_killed_run_goes_on(spark, tmp_path):
    """The driver is killed in the middle of a chunk: finished chunks are not worked on again."""
    log, ledger = tmp_path / "log", tmp_path / "ledger"
    log.mkdir()
    code = f"""
import sys, time
sys.path.insert(0, {ROOT!r})
from pyspark.sql import SparkSession
from tests.test_batches import Batches, RESULT, worker
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").config("spark.checkpoint.dir", {str(tmp_path / "shared")!r}).getOrCreate()
inner = worker({str(log)!r})
def slow(row):
    time.sleep(0.05)
    return inner(row)
Batches(spark, {str(ledger)!r}, "id", RESULT, chunk_rows=25).run(spark.range(100), slow)
"""
    run = subprocess.Popen([sys.executable, "-c", code], cwd=ROOT, stdout=subprocess.DEVNULL, stderr=subprocess.DEVNULL)
    end = time.time() + 120
    while len(list(log.iterdir())) < 60 and time.time() < end and run.poll() is None:
        time.sleep(0.05)
    assert run.poll() is None
    run.kill()
    run.wait()
    time.sleep(3)  # its JVM and workers end
    items, job = spark.range(100), Batches(spark, str(ledger), "id", RESULT, chunk_rows=25)
    finished = {r.id for r in job.ledger(items).collect()}
    assert 0 < len(finished) < 100
    assert job.run(items, worker(str(log))) is True
    assert found(job, items) == want(100)
    again = {int(k[0]) for k, n in calls(log).items() if n > 1}
    assert not again & finished, "an item in the ledger was worked on again"
    assert max(calls(log).values()) <= 2


def test_edge_cases(spark, tmp_path):
    log = tmp_path / "log"
    log.mkdir()
    job = Batches(spark, str(tmp_path / "a"), "id", RESULT)
    empty = spark.createDataFrame([], "id long, result string")
    assert job.run(empty, worker(str(log))) is True and job.results(empty).count() == 0
    assert tuple(job.progress(empty).first()) == (0, 0, 0, 0)
    # A null id, a repeated id and columns that the ledger also has.
    odd = spark.createDataFrame([(None, "x"), (3, "a"), (3, "b"), (5, None)], "id long, result string")
    assert job.run(odd, worker(str(log))) is True
    rows = {r.id: (r.attempts, r.done) for r in job.results(odd).collect()}
    assert rows == {None: (1, True), 3: (1, True), 5: (3, False)}
    # A value that does not fit the type is that item's failure.
    job = Batches(spark, str(tmp_path / "b"), "id", RESULT, attempts=1)
    assert job.run(spark.range(2), lambda r: ("no number",) if r["id"] else (1.0,)) is True
    assert {r.id: r.done for r in job.results(spark.range(2)).collect()} == {0: True, 1: False}
    with pytest.raises(ValueError):
        Batches(spark, str(tmp_path / "c"), "id", RESULT, chunk_rows=0)
