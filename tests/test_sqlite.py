"""SQLite files through Spark: partitions, pushed conditions, missing columns and tables, files that only Spark reads."""

from __future__ import annotations

import sqlite3
from contextlib import closing

import pytest
from pyspark.sql import functions as F

from prismlake.sources import foreign, sqlite


@pytest.fixture
def folder(tmp_path):
    for k, columns in enumerate(("id, name, size", "id, name", "other")):
        with closing(sqlite3.connect(tmp_path / f"{k}.sqlite")) as db:
            db.execute(f"create table {'item' if k < 2 else 'else_'} ({columns})")
            if k < 2:
                db.executemany(f"insert into item values ({', '.join('?' * (3 - k))})", [(1000 * k + j, f"n{j}" if j % 10 else None, j * 1.5)[: 3 - k] for j in range(250)])
            db.execute("delete from item where id % 100 between 40 and 90" if k < 2 else "delete from else_")
            db.commit()
    return str(tmp_path)


def want():
    return sorted((1000 * k + j, f"n{j}" if j % 10 else None, None if k else j * 1.5) for k in range(2) for j in range(250) if not 40 <= j % 100 <= 90)


def got(df):
    return sorted(tuple(r) for r in df.collect())


SCHEMA = "id long, name string, size double"


def test_partitions_are_ranges_of_rows(spark, folder):
    df = sqlite.read_table(spark, folder, "item", SCHEMA, rows=40)
    assert got(df) == want() and df.rdd.getNumPartitions() > 8
    assert df.select("id").count() == len(want())
    one = sqlite.read_table(spark, f"{folder}/1.sqlite", "item", SCHEMA)
    assert got(one) == [r for r in want() if r[0] >= 1000]
    assert sqlite.read_table(spark, folder, "nowhere", SCHEMA).count() == 0
    assert foreign.columns(spark, folder).keys() == {"item", "else_"} and set(foreign.columns(spark, folder)["item"]) == {"id", "name", "size"}


def test_conditions_are_part_of_the_query(spark, folder):
    some = [("id", ">=", 1010), ("id", "<", 1200), ("name", "is not null", None), ("name", "<>", "n11")]
    df = sqlite.read_table(spark, folder, "item", SCHEMA, rows=100, where=some)
    assert got(df) == [r for r in want() if 1010 <= r[0] < 1200 and r[1] not in (None, "n11")] and df.count() > 50
    assert got(sqlite.read_table(spark, folder, "item", SCHEMA, where=[("size", "is null", None)])) == [r for r in want() if r[2] is None]
    with pytest.raises(Exception):
        sqlite.read_table(spark, folder, "item", SCHEMA, where=[("id", "; drop", 1)]).count()


def test_written_files_come_back(spark, tmp_path):
    df = spark.range(500).select("id", F.when(F.col("id") % 3 > 0, F.concat(F.lit("é'\""), F.col("id").cast("string"))).alias("name"), (F.col("id") / 7).alias("size")).repartition(3)
    sqlite.write_tables(df, f"{tmp_path}/out", "a table")
    assert len(list((tmp_path / "out").glob("*.sqlite"))) == 3
    assert got(sqlite.read_table(spark, f"{tmp_path}/out", "a table", SCHEMA)) == got(df)
    sqlite.write_tables(df.limit(0).coalesce(1), f"{tmp_path}/none", "a")
    assert sqlite.read_table(spark, f"{tmp_path}/none", "a", SCHEMA).count() == 0
