"""Deletes and copies that follow declared foreign keys over all tables of a catalog.

A delete runs down the keys in an order in which parents come before children: a table's dead rows are those named, and those whose
parents are dead; only ids of dead rows travel. A copy runs down the same keys: a child is copied if all it points to was copied, under new ids throughout.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.durable import durable


@dataclass(frozen=True)
class ForeignKey:
    """child.column points to parent's id. action: what becomes of a child whose parent goes: cascade, set_null or restrict. where: SQL over the child's columns, for
    references that only some rows hold, such as those of a type column. needed: the parent is copied only because a copied child points to it."""

    child: str
    column: str
    parent: str
    action: str = "cascade"
    where: str = "true"
    needed: bool = False


def in_order(keys: Sequence[ForeignKey], copying: bool = False) -> list[str]:
    """Tables with parents before children; keys of a table to itself are no obstacle. Copying, a needed parent comes after all else that its children point to."""
    names = list(dict.fromkeys(n for k in keys for n in (k.parent, k.child)))
    first = {n: {k.parent for k in keys if k.child == n} - {n} for n in names}
    for k in keys if copying else ():
        if k.needed:
            first[k.parent] |= {o.parent for o in keys if o.child == k.child} - {k.parent}
    out: list[str] = []
    while len(out) < len(names):
        free = [n for n in names if n not in out and first[n] <= set(out)]
        if not free:
            raise ValueError(f"the keys of {sorted(set(names) - set(out))} form a circle")
        out += free
    return out


def _points_to(df: DataFrame, key: ForeignKey, ids: DataFrame, flag: str) -> DataFrame:
    """df with a flag: whether the row holds the reference and its id is among ids."""
    found = ids.select(F.col(ids.columns[0]).alias("_id")).filter("_id is not null").distinct().withColumn("_hit", F.lit(True))
    return df.join(found, F.col(key.column) == F.col("_id"), "left").withColumn(flag, F.coalesce(F.col("_hit") & F.expr(key.where), F.lit(False))).drop("_id", "_hit")


def delete(tables: Mapping[str, DataFrame], ids: Mapping[str, str], keys: Sequence[ForeignKey], gone: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """The tables without the rows whose ids `gone` names (one column each) and all that cascades from them.

    ids: the id column of each table that is pointed to. Null references point to nothing. A restricting reference of a row that stays to a row that goes raises an error and
    nothing is deleted; set_null empties such references.
    """
    out, dead = dict(tables), {}
    for name in in_order(keys):
        df, mine = tables[name], [k for k in keys if k.child == name]
        flags = {k: f"_to_{i}" for i, k in enumerate(mine) if k.parent in dead}
        for k, flag in flags.items():
            df = _points_to(df, k, dead[k.parent], flag)
        end = F.lit(False)
        for k, flag in flags.items():
            if k.action == "cascade":
                end |= F.col(flag)
        if name in gone:
            df = _points_to(df, ForeignKey(name, ids[name], name), gone[name], "_named")
            end |= F.col("_named")
        if not flags and name not in gone:
            continue
        df = durable(df.withColumn("_dead", end))
        lost = df.filter("_dead").select(ids[name]).distinct() if name in ids else None
        for own in (k for k in mine if k.parent == name and k.action == "cascade"):
            lost = _closed(df, ids[name], own, lost)
            df = durable(_points_to(df.drop("_dead"), ForeignKey(name, ids[name], name), lost, "_dead"))
        stays = df.filter(~F.col("_dead"))
        for k, flag in flags.items():
            if k.action == "restrict" and not stays.filter(flag).isEmpty():
                raise ValueError(f"{k.child}.{k.column} restricts deletes from {k.parent}")
            if k.action == "set_null":
                stays = stays.withColumn(k.column, F.when(~F.col(flag), F.col(k.column)))
        for own in (k for k in mine if k.parent == name and k.action != "cascade" and lost is not None):
            stays = _points_to(stays, own, lost, "_own")
            if own.action == "restrict" and not stays.filter("_own").isEmpty():
                raise ValueError(f"{own.child}.{own.column} restricts deletes from {own.parent}")
            stays = stays.withColumn(own.column, F.when(~F.col("_own"), F.col(own.column)))
        out[name] = stays.select(*tables[name].columns)
        if lost is not None:
            dead[name] = durable(lost)
    return out


def _closed(df: DataFrame, id_column: str, key: ForeignKey, lost: DataFrame) -> DataFrame:
    """lost and all rows below them in their own table; each round looks at what the last one found."""
    all_, new = durable(lost), lost
    while True:
        below = df.filter(F.expr(key.where)).join(new.select(F.col(id_column).alias("_up")), F.col(key.column) == F.col("_up")).select(id_column).distinct()
        new = durable(below.join(all_, id_column, "left_anti"))
        if new.isEmpty():
            return all_
        all_ = durable(all_.union(new))


def sweep(tables: Mapping[str, DataFrame], ids: Mapping[str, str], keys: Sequence[ForeignKey]) -> dict[str, DataFrame]:
    """The tables without orphans: rows that hold a reference by one of these keys to an id that its parent does not have."""
    out = dict(tables)
    for name in in_order(keys):
        for i, k in enumerate(k for k in keys if k.child == name):
            df = _points_to(out[name], k, out[k.parent].select(ids[k.parent]), f"_there_{i}")
            holds = F.col(k.column).isNotNull() & F.coalesce(F.expr(k.where), F.lit(False))
            out[name] = df.filter(~holds | F.col(f"_there_{i}")).drop(f"_there_{i}")
        if name in ids:
            out[name] = durable(out[name])
    return out


def copy(tables: Mapping[str, DataFrame], ids: Mapping[str, str], keys: Sequence[ForeignKey], seeds: Mapping[str, DataFrame], new_id: Mapping[str, Column], constants: Mapping[str, Mapping[str, Column]] | None = None) -> dict[str, DataFrame]:
    """The rows to add: those of seeds (old, new) under their new ids, and of all tables below what hangs on them.

    A row is copied if every reference that it holds by one of the keys leads to a copied row, and it holds one at all. new_id: the new id of a table's row, as a column over it. A table that is only
    `needed` (people) is copied where a child points to it whose other references were all copied. constants: columns that copies get, such as the new library. Tables without a new_id keep no id of their own.
    """
    out: dict[str, DataFrame] = {}
    maps = {n: durable(s.toDF("_old", "_new").distinct()) for n, s in seeds.items()}
    for name in in_order(keys, copying=True):
        df = tables[name]
        if name in seeds:
            df = df.join(maps[name], F.col(ids[name]) == F.col("_old")).withColumn(ids[name], F.col("_new")).drop("_old", "_new")
        elif any(k.needed and k.parent == name for k in keys):
            wanted = []
            for k in (k for k in keys if k.needed and k.parent == name):
                child = tables[k.child].filter(F.expr(k.where))
                for o in (o for o in keys if o.child == k.child and o is not k and o.parent in maps):
                    child = child.join(maps[o.parent].select(F.col("_old").alias(o.column)), o.column, "left_semi")
                wanted.append(child.select(F.col(k.column).alias("_want")))
            for w in wanted:
                df = df.join(w.distinct(), F.col(ids[name]) == F.col("_want"), "left_semi")
            df, maps[name] = _renamed(df, ids[name], new_id[name])
        else:
            mine = [k for k in keys if k.child == name and k.parent != name]
            held = F.lit(False)
            for i, k in enumerate(mine):
                m = maps.get(k.parent, df.sparkSession.createDataFrame([], "_old long, _new long"))
                holds = F.col(k.column).isNotNull() & F.coalesce(F.expr(k.where), F.lit(False))
                df = df.withColumn(f"_holds_{i}", holds).join(m, F.col(k.column) == F.col("_old"), "left").filter(~F.col(f"_holds_{i}") | F.col("_new").isNotNull())
                df = df.withColumn(f"_key_{i}", F.when(F.col(f"_holds_{i}"), F.col("_new")).otherwise(F.col(k.column))).drop("_old", "_new")
                held |= F.col(f"_holds_{i}")
            df = df.filter(held)
            for i, k in enumerate(mine):  # one column may hold several kinds of reference
                df = df.withColumn(k.column, F.when(F.col(f"_holds_{i}"), F.col(f"_key_{i}")).otherwise(F.col(k.column)))
            if name in new_id:
                df, maps[name] = _renamed(df, ids[name], new_id[name])
        for column, value in (constants or {}).get(name, {}).items():
            df = df.withColumn(column, value)
        out[name] = df.select(*tables[name].columns)
    return out


def _renamed(df: DataFrame, id_column: str, new: Column) -> tuple[DataFrame, DataFrame]:
    """df under new ids, and the map (old, new)."""
    df = durable(df.withColumn("_new", new))
    return df.withColumn(id_column, F.col("_new")).drop("_new"), df.select(F.col(id_column).alias("_old"), "_new").distinct()
