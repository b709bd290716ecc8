"""Building the paired corpus: dedup, first-match join, interleaving, splits, negatives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import Scratch
from .ordinal import seeded, seeded_int, with_ordinal


def keep_first(df: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key in ``order``; null keys are one key, as in a data frame's duplicates."""
    # keys may be whole texts: what is grouped is their hash of 128 bits
    hashed = F.coalesce(F.md5(F.col(key).cast("string")), F.lit("null"))
    least = df.groupBy(hashed.alias("__key")).agg(F.min(order).alias("__first"))
    return df.join(least, (hashed == F.col("__key")) & (df[order] == F.col("__first")), "left_semi")


def distinct_stats(df: DataFrame, column: str) -> DataFrame:
    """Rows and distinct values, a null counted as a value."""
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        (F.countDistinct(column) + F.max(F.col(column).isNull().cast("int"))).alias("n_distinct"),
    )


def first_match_join(left: DataFrame, right: DataFrame, key: str, right_order: str, *ties: str) -> DataFrame:
    """Inner join N:1: each left row meets the first right row of its key.

    Nulls of ``right_order`` come last. Rows that are equal in it are in the order of ``ties``,
    which are not returned, or without them of the other columns. The right side is reduced
    by an aggregate (partial sums before the shuffle), so a hot key costs one right row; the
    join side is left to the optimizer.
    """
    others = [c for c in right.columns if c not in (key, *ties)]
    order = F.struct(F.col(right_order).isNull(), right_order, *(ties or others))
    first = right.groupBy(key).agg(F.min_by(F.struct(*others), order).alias("__r"))
    return left.join(first.select(key, "__r.*"), key)


def common_keys(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    return left.select(key).intersect(right.select(key))


def interleave(df: DataFrame, group: str, order: str, seed: int = 42) -> DataFrame:
    """One row of each group per round: new_group_id (round), original_group_rank, position key.

    Rounds come in order, rows within a round in seeded order; null groups are dropped. A
    row's round is its position in the order (group, order) less that of its group's first
    row, so a hot group is spread over tasks like any other rows.
    """
    placed = with_ordinal(df.where(F.col(group).isNotNull()), group, order, name="__pos")
    firsts = with_ordinal(placed.groupBy(group).agg(F.min("__pos").alias("__first_pos")), group, name="original_group_rank")
    out = placed.join(firsts, group).withColumn("new_group_id", (F.col("__pos") - F.col("__first_pos")).cast("int"))
    return out.drop("__pos", "__first_pos").withColumn("shuffle_key", seeded(seed, order))


def ordered_splits(df: DataFrame, *order: str, train: float = 0.7, eval_: float = 0.2) -> DataFrame:
    """Adds split: the first floor(n * train) rows, the next floor(n * eval), the rest test."""
    placed = with_ordinal(df, *order)
    n = df.agg(F.count(F.lit(1)).alias("__n"))
    cuts = n.select(F.floor(F.col("__n") * F.lit(train)).alias("__a"), F.floor(F.col("__n") * F.lit(eval_)).alias("__b"))
    at = F.col("ordinal")
    split = F.when(at < F.col("__a"), "train").when(at < F.col("__a") + F.col("__b"), "eval").otherwise("test")
    return placed.join(F.broadcast(cuts)).withColumn("split", split).drop("__a", "__b")  # one row


def group_splits(df: DataFrame, group: str, test: float = 0.2, eval_: float = 0.125, seed: int = 42) -> DataFrame:
    """Adds split by whole groups: ceil(test * G) groups, then ceil(eval * rest), in seeded order."""
    keys = df.where(F.col(group).isNotNull()).select(group).distinct().withColumn("__h", seeded(seed, group))
    placed = with_ordinal(keys, "__h", group, name="__nth")
    g = keys.agg(F.count(F.lit(1)).alias("__g")).select(F.ceil(F.col("__g") * F.lit(test)).alias("__t"), "__g")
    g = g.select("__t", F.ceil((F.col("__g") - F.col("__t")) * F.lit(eval_)).alias("__e"))
    split = F.when(F.col("__nth") < F.col("__t"), "test").when(F.col("__nth") < F.col("__t") + F.col("__e"), "eval").otherwise("train")
    return df.join(placed.join(F.broadcast(g)).select(group, split.alias("split")), group)  # one row


def split_stats(df: DataFrame, group: str) -> DataFrame:
    return df.groupBy("split").agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct(group).alias("n_groups"))


def verify_split(before: DataFrame, after: DataFrame, id_col: str) -> DataFrame:
    """One row: totals, rows lost and rows made up, and whether the parts keep the order."""
    lost = before.select(id_col).exceptAll(after.select(id_col)).agg(F.count(F.lit(1)).alias("n_lost"))
    made = after.select(id_col).exceptAll(before.select(id_col)).agg(F.count(F.lit(1)).alias("n_made"))
    ends = after.groupBy("split").agg(F.min("ordinal").alias("lo"), F.max("ordinal").alias("hi"), F.count(F.lit(1)).alias("n"))
    whole = ends.agg(F.sum("n").alias("n_after"), F.coalesce(F.bool_and(F.col("hi") - F.col("lo") + 1 == F.col("n")), F.lit(True)).alias("contiguous"))
    total = before.agg(F.count(F.lit(1)).alias("n_before"))
    return total.join(F.broadcast(whole)).join(F.broadcast(lost)).join(F.broadcast(made))  # one row each


def negative_pairs(df: DataFrame, id_col: str, key: str, attempts: int = 3, seed: int = 42) -> DataFrame:
    """For each row a partner of another key: id, partner, attempt.

    Partner ordinals are (i + hashed offset in 1..n-1) mod n, so never i; of the attempts
    the first with another key counts. A row left over gets its partner as attempt number
    ``attempts`` without a miss: in key order, the row at (place in own key + hash) mod the
    number of rows of other keys, own rows left out. So only a table of one key has rows
    without a partner. Row joins are on the ordinal; bounds of keys join on the key, those
    of 1/1000 of the rows or more as a broadcast. Rows are put in key order only if some are left over.
    """
    placed = with_ordinal(df.select(F.col(id_col).alias("id"), F.col(key).alias("k")), "id")
    n = df.agg(F.count(F.lit(1)).alias("n"))
    tries = placed.join(F.broadcast(n)).where("n > 1").withColumn("attempt", F.explode(F.sequence(F.lit(0), F.lit(attempts - 1))))  # one row
    offset = seeded_int(seed, F.col("id").cast("string"), F.col("attempt").cast("string")) % (F.col("n") - 1) + 1
    tries = tries.select("id", "k", "attempt", ((F.col("ordinal") + offset) % F.col("n")).alias("j"))
    other = placed.select(F.col("ordinal").alias("j"), F.col("id").alias("partner"), F.col("k").alias("kj"))
    found = tries.join(other, "j").where(~F.col("k").eqNullSafe(F.col("kj")))
    found = found.groupBy("id").agg(F.min(F.struct("attempt", "partner")).alias("m")).select("id", "m.partner", "m.attempt")
    found = Scratch(df.sparkSession, "negatives").save(found, "found")

    if placed.join(found, "id", "left_anti").isEmpty():
        return found
    keyed = with_ordinal(placed.select("id", "k"), "k", "id", name="at")
    bounds = keyed.groupBy(F.col("k").alias("kb")).agg(F.min("at").alias("lo"), F.count(F.lit(1)).alias("own")).join(F.broadcast(n))  # one row
    left = keyed.join(found.select("id"), "id", "left_anti")
    own = F.col("k").eqNullSafe(F.col("kb"))
    left = left.join(F.broadcast(bounds.where("own * 1000 >= n")), own, "left")  # 1000 rows at most
    rare = left.where("lo is null").select("id", "k", "at").join(bounds.where("own * 1000 < n"), own)
    left = left.where("lo is not null").unionByName(rare).where("own < n")
    place = (F.col("at") - F.col("lo") + seeded_int(seed, F.col("id").cast("string"), F.lit(str(attempts)))) % (F.col("n") - F.col("own"))
    left = left.select("id", (place + F.when(place >= F.col("lo"), F.col("own")).otherwise(0)).alias("j"))
    last = left.join(keyed.select(F.col("at").alias("j"), F.col("id").alias("partner")), "j")
    return found.unionByName(last.select("id", "partner", F.lit(attempts).alias("attempt")))


def labelled_pairs(df: DataFrame, id_col: str, key: str, left: str, right: str, seed: int = 42) -> DataFrame:
    """Positives (label 1) and, for each partner pair, both crossed negatives (label 0): one to two."""
    rows = df.select(F.col(id_col).alias("id"), F.col(left).alias("asm_func"), F.col(right).alias("src_func"))
    partners = negative_pairs(df, id_col, key, seed=seed)
    other = rows.select(F.col("id").alias("partner"), F.col("asm_func").alias("a2"), F.col("src_func").alias("s2"))
    both = partners.join(rows, "id").join(other, "partner")
    crossed = F.array(F.struct(F.col("asm_func").alias("a"), F.col("s2").alias("s"), F.lit(1).alias("way")), F.struct(F.col("a2").alias("a"), F.col("src_func").alias("s"), F.lit(2).alias("way")))
    negatives = both.select("id", F.explode(crossed).alias("x")).select("id", F.col("x.a").alias("asm_func"), F.col("x.s").alias("src_func"), F.col("x.way").alias("way"), F.lit(0).alias("label"))
    positives = rows.withColumns({"way": F.lit(0), "label": F.lit(1)})
    return positives.unionByName(negatives, allowMissingColumns=True)


def batches(ordinal: Column, size: int) -> Column:
    """Mini-batch number; the last batch may be short."""
    return F.floor(ordinal / size).cast("long")


def locate(counts: DataFrame, wanted: DataFrame, order: str, size: str) -> DataFrame:
    """Global index to (file, local index): prefix sums, then an equi-join on index buckets.

    Files are cut at bucket borders (buckets as long as the mean file), so a wanted index
    meets only the files of its own bucket. Indices outside the corpus get no row.
    """
    placed = with_ordinal(counts.select(F.col(order).alias("file"), F.col(size).alias("n")), "file", name="file_no")
    n = int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    chunk = F.floor(F.col("file_no") / 100_000)
    sums = placed.groupBy(chunk.alias("c")).agg(F.sum("n").alias("t"))
    before = sums.select("c", F.coalesce(F.sum("t").over(Window.orderBy("c").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    own = F.coalesce(F.sum("n").over(Window.partitionBy("c").orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = placed.withColumn("c", chunk).withColumn("own", own).join(before, "c").select("file", "n", (F.col("base") + F.col("own")).alias("lo"))
    width = counts.agg(F.greatest(F.lit(1), F.ceil(F.avg(size))).cast("long").alias("w"))
    ranges = ranges.where("n > 0").join(F.broadcast(width))  # one row
    ranges = ranges.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("lo") / F.col("w")), F.floor((F.col("lo") + F.col("n") - 1) / F.col("w")))))
    asked = wanted.join(F.broadcast(width)).withColumn("bucket", F.floor(F.col("idx") / F.col("w"))).drop("w")
    hit = asked.repartition(n, "bucket").join(ranges, "bucket").where("idx >= lo and idx < lo + n")
    return hit.select("idx", "file", (F.col("idx") - F.col("lo")).alias("local_idx"))
