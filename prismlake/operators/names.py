"""Free names and numbers in order, without bringing the rows of one name or group into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.durable import durable

#: Names that a row which has to move looks at in a round, and moves of one family that a round takes in; what is left is the next round's.
AHEAD, AT_ONCE = 64, 1000


def ranked(df: DataFrame, by: list[str], order: str, chunk: int = 100_000) -> DataFrame:
    """df plus _rank: the place of each row among those of its group, by `order` (numbers, different in a group), from 1.

    Rows are cut into ranges of the order of about `chunk` rows; places in a group's part of a range and the counts of the ranges before it add up, so a group is in as many tasks
    as it has ranges.
    """
    n = df.count()
    pieces = max(1, -(-n // chunk))
    cuts = df.agg(F.percentile_approx(order, [k / pieces for k in range(1, pieces)], 10 * pieces)).first()[0] if pieces > 1 else []  # a number a range
    # Ranges are numbers of cut points below, found by halving.
    here = F.lit(0) if not cuts else F.aggregate(F.array(*map(F.lit, cuts)), F.lit(0), lambda s, c: s + (F.col(order) > c).cast("int"))
    df = df.withColumn("_range", here)
    counts = df.groupBy(*by, "_range").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inside = df.withColumn("_at", F.row_number().over(Window.partitionBy(*by, "_range").orderBy(order)))
    same = [F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}")) for c in (*by, "_range")]
    joined = inside.alias("x").join(before.alias("y"), [*same])
    return joined.select("x.*", (F.col("x._at") + F.col("y._before")).alias("_rank")).drop("_range", "_at")


def free_names(df: DataFrame, name: str, order: str, taken: DataFrame | None = None) -> DataFrame:
    """df plus free_name: in `order` every row takes the first name that no row before it has, in any case: its own, then 'stem 2.ext', 'stem 3.ext', ...

    taken: names (one column) that are there already. order: different numbers; null names count as empty.

    Rows with the same stem and extension are a family, whose n-th row asks for the n-th name at first. A row that asks for a name which an earlier row of another family (or a taken
    name) has, moves up to the first name without such a row, and all later ones of its family stay behind it. A name that a row had to leave stays with earlier rows, so it never asks
    for it again, and rounds settle everything exactly as one by one would. A round is a grouped minimum over names; of a family only the first row at each distance from its place has to be told.
    """
    whole = F.coalesce(F.col(name), F.lit(""))
    dot = F.length(whole) - F.instr(F.reverse(whole), ".")
    has = (F.instr(F.reverse(whole), ".") > 1) & (dot > 0)  # neither at the end nor at the beginning
    stem, ext = F.when(has, F.substring(whole, F.lit(1), dot)).otherwise(whole), F.when(has, F.substring(whole, dot + 1, F.length(whole))).otherwise("")
    rows = df.withColumns({"_stem": stem, "_ext": ext, "_s": F.lower(stem), "_e": F.lower(ext)})
    rows = durable(ranked(rows, ["_s", "_e"], order).withColumnRenamed("_rank", "_slot"))
    there = taken.select(F.lower(F.col(taken.columns[0])).alias("_name")).filter("_name is not null").distinct().withColumn("_first", F.lit(None).cast(dict(df.dtypes)[order])) if taken is not None else None

    def asked(s: str, e: str, slot: str = "_slot") -> Column:
        return F.concat(s, F.when(F.col(slot) > 1, F.concat(F.lit(" "), F.col(slot).cast("string"))).otherwise(""), e)

    state = rows.select(order, "_s", "_e", "_slot", F.lit(0).cast("long").alias("_moved"))
    while True:
        now = state.withColumn("_name", asked("_s", "_e"))
        first = now.groupBy("_name").agg(F.min(order).alias("_first"), F.lit(False).alias("_there"))
        if there is not None:
            first = first.join(there.select("_name"), "_name", "left_anti").union(there.select("_name", "_first", F.lit(True)))
        first = durable(first)
        lost = now.join(first, "_name").filter(F.col("_there") | (F.col("_first") < F.col(order)))
        lost = durable(lost.groupBy("_s", "_e", "_moved").agg(F.min(F.struct("_slot", F.col(order).alias("_order"))).alias("m")).select("_s", "_e", "_moved", "m._slot", "m._order"))
        if lost.isEmpty():
            break
        # How far the first of them has to go: past every name that an earlier row has.
        ahead = lost.withColumn("_far", F.explode(F.sequence(F.lit(1), F.lit(AHEAD)))).withColumn("_to", F.col("_slot") + F.col("_far")).withColumn("_name", asked("_s", "_e", "_to"))
        free = ahead.join(first, "_name", "left").filter(F.col("_first").isNull() & ~F.coalesce("_there", F.lit(False)) | (F.col("_first") >= F.col("_order")))
        free = free.groupBy("_s", "_e", "_moved").agg(F.min("_far").alias("_far"))
        steps = lost.join(free, ["_s", "_e", "_moved"], "left").select("_s", "_e", "_slot", (F.col("_moved") + F.coalesce("_far", F.lit(AHEAD + 1))).alias("_least"))
        steps = steps.withColumn("_k", F.row_number().over(Window.partitionBy("_s", "_e").orderBy("_slot"))).filter(F.col("_k") <= AT_ONCE)
        steps = steps.groupBy("_s", "_e").agg(F.collect_list(F.struct("_slot", "_least")).alias("_steps"))  # at most AT_ONCE a family
        least = F.array_max(F.transform(F.filter("_steps", lambda x: x["_slot"] <= F.col("_slot")), lambda x: x["_least"]))
        moved = state.join(steps, ["_s", "_e"], "left").withColumn("_now", F.greatest("_moved", least))
        state = durable(moved.select(order, "_s", "_e", (F.col("_slot") + F.col("_now") - F.col("_moved")).alias("_slot"), F.col("_now").alias("_moved")))
    settled = state.select(order, "_slot")
    out = rows.drop("_slot").join(settled, order).withColumn("free_name", asked("_stem", "_ext"))
    return out.drop("_stem", "_ext", "_s", "_e", "_slot")
