"""Joins of 64-bit fingerprints by Hamming distance.

Two fingerprints within ``within`` bits agree on all but ``within`` of any set of bit
blocks (pigeonhole), so they share a bucket in at least one of the tables that leave
``within`` blocks out; no pair is lost. A bucket of more than ``FULL`` fingerprints is split
again the same way over the bits it leaves open, until it is small or no bits are open. So
the rows that are compared stay few where a large part of the fingerprints lie close
together. The exact distance is a condition of the join; pairs too far apart are no rows.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import Scratch

#: fingerprints of a bucket that are compared with each other
FULL = 1000
#: the most copies of a fingerprint that the first tables may make
TABLES = 60


def distance(a: Column, b: Column) -> Column:
    """Bits in which two longs differ."""
    return F.bit_count(a.bitwiseXOR(b))


def _signed(bits: int) -> int:
    return bits - (1 << 64) if bits >> 63 else bits


def _blocks(bits: list[int], n: int) -> list[int]:
    """The bits dealt to n blocks of about one size, as masks."""
    cuts = [len(bits) * k // n for k in range(n + 1)]
    return [sum(1 << b for b in bits[lo:hi]) for lo, hi in zip(cuts, cuts[1:], strict=False)]


def first_masks(within: int, rows: int) -> list[int]:
    """Masks of the tables: with more rows more of the bits are in a key, so that buckets stay small."""
    chosen: list[int] = []
    for n in range(within + 1, 65):
        masks = [sum(m) for m in combinations(_blocks(list(range(64)), n), n - within)]
        if chosen and len(masks) > TABLES:
            break
        chosen = masks
        if 64 * (n - within) // n >= max(1, rows).bit_length():
            break
    return chosen


def _finer(mask: int, within: int) -> list[int]:
    """Masks that fix one more block of the open bits; empty blocks fix nothing more."""
    open_bits = [b for b in range(64) if not mask >> b & 1]
    return [mask | block for block in _blocks(open_bits, within + 1)]


def close_fingerprints(prints: DataFrame, column: str, within: int = 3, full: int = FULL) -> DataFrame:
    """Pairs of different fingerprints at most ``within`` bits apart: a, b (a < b, as signed numbers), distance.

    Equal fingerprints are one, so copies are not paired. Nulls match nothing; an empty
    table gives no pairs.
    """
    if not 0 <= within < 64:
        raise ValueError("a distance of 64-bit fingerprints is from 0 to 64")
    tmp = Scratch(prints.sparkSession, "hamming")
    h = F.col(column).cast("long").alias("h")
    distinct = tmp.save(prints.where(F.col(column).isNotNull()).select(h).distinct(), "prints")
    masks = first_masks(within, distinct.count())
    found = None
    level, rows = 0, distinct
    while masks:
        keys = F.array(*(F.struct(F.lit(i).alias("table"), F.lit(_signed(m)).alias("mask")) for i, m in enumerate(masks)))
        if level:
            # a full bucket is split over its own open bits only
            finer = F.array(*(F.array(*(F.lit(_signed(x)) for x in _finer(m, within))) for m in masks))
            rows = rows.select("h", F.explode(F.get(finer, F.col("table"))).alias("mask"))
        else:
            rows = rows.select("h", F.explode(F.transform(keys, lambda k: k.mask)).alias("mask"))
        rows = rows.withColumn("key", F.col("h").bitwiseAND(F.col("mask")))
        rows = tmp.save(rows.distinct() if level else rows, f"rows{level}")
        sizes = tmp.save(rows.groupBy("mask", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), f"sizes{level}")
        small = rows.join(sizes.where(F.col("n") <= full).select("mask", "key"), ["mask", "key"], "left_semi")
        small = tmp.save(small, f"small{level}")
        a, b = (small.select("mask", "key", F.col("h").alias(side)) for side in "ab")
        pairs = a.join(b, (a["mask"] == b["mask"]) & (a["key"] == b["key"]) & (a["a"] < b["b"]) & (distance(a["a"], b["b"]) <= within)).select("a", "b")
        found = pairs if found is None else found.unionByName(pairs)
        crowded = sizes.where(F.col("n") > full)
        # the masks of full buckets: at most as many as masks of this level
        left = sorted(r.mask for r in crowded.select("mask").distinct().collect())
        rows = rows.join(crowded.select("mask", "key"), ["mask", "key"], "left_semi")
        table = F.array_position(F.array(*(F.lit(m) for m in left)), F.col("mask")).cast("int") - 1 if left else F.lit(0)
        rows = rows.select("h", table.alias("table"))
        masks = [m % (1 << 64) for m in left]
        level += 1
    return found.distinct().withColumn("distance", distance(F.col("a"), F.col("b")))


def near_classes(rows: DataFrame, id_col: str, column: str, within: int = 3) -> DataFrame:
    """id, class_id (the smallest id of the same fingerprint) and n_near: how many other classes are within the distance.

    A row without fingerprint has neither class nor neighbours (null, 0).
    """
    tmp = Scratch(rows.sparkSession, "near-classes")
    narrow = tmp.save(rows.select(F.col(id_col), F.col(column).cast("long").alias("__h")), "rows")
    pairs = close_fingerprints(narrow, "__h", within)
    links = pairs.select(F.explode(F.array("a", "b")).alias("__h")).groupBy("__h").agg(F.count(F.lit(1)).alias("n_near"))
    classes = narrow.where("__h IS NOT NULL").groupBy("__h").agg(F.min(id_col).alias("class_id")).join(links, "__h", "left")
    classes = tmp.save(classes, "classes")
    return narrow.join(classes, "__h", "left").select(id_col, "class_id", F.coalesce("n_near", F.lit(0)).alias("n_near"))


def class_pairs(rows: DataFrame, id_col: str, column: str, within: int = 3) -> DataFrame:
    """left_id, right_id, distance: classes (by their smallest ids) within the distance, the smaller id first."""
    tmp = Scratch(rows.sparkSession, "class-pairs")
    # written first: a condition on a fingerprint would have it computed once more
    narrow = tmp.save(rows.select(F.col(id_col).alias("id"), F.col(column).cast("long").alias("h")), "rows")
    classes = narrow.where("h IS NOT NULL").groupBy("h").agg(F.min("id").alias("id"))
    classes = tmp.save(classes, "classes")
    pairs = close_fingerprints(classes, "h", within)
    x = classes.select(F.col("h").alias("a"), F.col("id").alias("x"))
    y = classes.select(F.col("h").alias("b"), F.col("id").alias("y"))
    both = pairs.join(x, "a").join(y, "b")
    return both.select(F.least("x", "y").alias("left_id"), F.greatest("x", "y").alias("right_id"), "distance")
