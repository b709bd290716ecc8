"""Global positions without a one-task window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import Scratch

_LOW = (1 << 33) - 1


def with_ordinal(df: DataFrame, *order: str | Column, name: str = "ordinal") -> DataFrame:
    """Adds the 0-based position in ``order`` (which must be total).

    Rows are range-partitioned and sorted within partitions; a position is the row's index
    in its partition plus the sizes of the partitions before it, a table of one row each.
    Range bounds come from a sample that differs from run to run, so the placed rows are
    written once and both sides read that table.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    placed = Scratch(df.sparkSession, "ordinal").save(placed, "placed")
    part = F.shiftright("__at", 33)
    sizes = placed.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("__size"))
    before = F.sum("__size").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("__part", F.coalesce(before, F.lit(0)).alias("__start"))
    out = placed.withColumn("__part", part).join(F.broadcast(starts), "__part")  # one row for each partition
    return out.withColumn(name, (F.col("__start") + F.col("__at").bitwiseAND(F.lit(_LOW))).cast("long")).drop("__at", "__part", "__start")


def seeded(seed: int, *columns: str | Column) -> Column:
    """A portable pseudo-random order: md5 of the seed and the columns."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *columns))


def seeded_int(seed: int, *columns: str | Column) -> Column:
    """A portable non-negative number under 2**32."""
    return F.conv(F.substring(seeded(seed, *columns), 1, 8), 16, 10).cast("long")
