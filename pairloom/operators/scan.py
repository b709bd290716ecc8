"""Running totals over positions, without a window that holds a whole group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import Scratch

#: positions of a node have this many bits less than those of the nodes below it
FAN = 12


def running_total(rows: DataFrame, group: str, position: str, amount: Column, name: str = "total") -> DataFrame:
    """Adds the sum of ``amount`` over the group's rows up to and with this one, in order of ``position``.

    Positions are numbers that are unique in their group. Rows are taken in blocks of 4096
    positions, blocks by the 4096, and so on: a window holds one block, or the sums of 4096
    blocks, so a group that is much of the table is spread over tasks like any other. Three
    levels serve groups of 6 * 10**10 positions with 4096 rows or sums a window. A null
    group is a group.
    """
    tmp = Scratch(rows.sparkSession, "running-total")
    rows = tmp.save(rows.withColumns({"__block": F.shiftright(F.col(position).cast("long"), FAN), "__amount": F.coalesce(amount.cast("long"), F.lit(0))}), "rows")
    sums = rows.groupBy(F.col(group).alias("g"), F.col("__block").alias("node")).agg(F.sum("__amount").alias("amount"))
    before = _before(tmp.save(sums, "blocks"), 2, tmp)
    within = Window.partitionBy(group, "__block").orderBy(position).rowsBetween(Window.unboundedPreceding, 0)
    own = rows.withColumn("__own", F.sum("__amount").over(within))
    joined = own.join(before, F.col(group).eqNullSafe(F.col("g")) & (F.col("__block") == F.col("node")))
    return joined.withColumn(name, F.col("__own") + F.col("before")).drop("g", "node", "before", "__own", "__block", "__amount")


def _before(sums: DataFrame, levels: int, tmp: Scratch) -> DataFrame:
    """g, node, before: the sums of the nodes of a group that come before."""
    up = F.shiftright("node", FAN) if levels > 1 else F.lit(0).cast("long")
    x = sums.withColumn("up", up)
    siblings = Window.partitionBy("g", "up").orderBy("node").rowsBetween(Window.unboundedPreceding, -1)
    x = x.withColumn("before", F.coalesce(F.sum("amount").over(siblings), F.lit(0)))
    if levels == 1:
        return x.select("g", "node", "before")
    above = _before(tmp.save(x.groupBy("g", F.col("up").alias("node")).agg(F.sum("amount").alias("amount")), f"level{levels}"), levels - 1, tmp)
    a = above.select(F.col("g").alias("ag"), F.col("node").alias("an"), F.col("before").alias("ab"))
    return x.join(a, F.col("g").eqNullSafe(F.col("ag")) & (F.col("up") == F.col("an"))).select("g", "node", (F.col("before") + F.col("ab")).alias("before"))
