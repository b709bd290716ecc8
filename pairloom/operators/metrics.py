"""Evaluation operators over ranks, similarities and answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordinal import with_ordinal


def retrieval_report(ranks: DataFrame, cuts: tuple[int, ...] = (1, 5, 10, 100)) -> DataFrame:
    """One row: mrr, recall_at_k, mean_rank, median_rank, n_queries from column rank."""
    rank = F.col("rank")
    recalls = [F.round(F.avg((rank <= k).cast("double")), 6).alias(f"recall_at_{k}") for k in cuts]
    return ranks.agg(
        F.round(F.avg(1 / rank), 6).alias("mrr"), *recalls, F.round(F.avg(rank), 6).alias("mean_rank"),
        F.round(F.median(rank), 6).alias("median_rank"), F.count(F.lit(1)).alias("n_queries"),
    )


def batch_ranks(sims: DataFrame) -> DataFrame:
    """Ranks of the diagonal within a batch: sims has batch, i, j, sim."""
    own = sims.where("i = j").select("batch", "i", F.col("sim").alias("own"))
    ahead = (F.col("sim") > F.col("own")) | ((F.col("sim") == F.col("own")) & (F.col("j") < F.col("i")))
    return sims.join(own, ["batch", "i"]).groupBy("batch", "i").agg((F.sum(ahead.cast("int")) + 1).alias("rank"))


def macro_mean(df: DataFrame, batch: str, value: Column) -> DataFrame:
    """Mean of batch means; a short batch weighs like any other."""
    per = df.groupBy(batch).agg(F.avg(value).alias("__m"))
    return per.agg(F.round(F.avg("__m"), 6).alias("macro_mean"), F.count(F.lit(1)).alias("n_batches"))


def threshold_sweep(sims: DataFrame, points: int = 100) -> DataFrame:
    """Best accuracy over evenly spaced thresholds, first best wins; with precision, recall, F1 and moments.

    sims: sim, label. Similarities are first counted by how many thresholds they reach, so
    the sweep works on ``points`` + 1 rows whatever the input.
    """
    ends = sims.agg(F.min("sim").alias("mn"), F.max("sim").alias("mx"))
    grid = ends.select(F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("i"), "mn", "mx")
    at = F.when(F.col("i") == points - 1, F.col("mx")).otherwise(F.col("mn") + F.col("i") * (F.col("mx") - F.col("mn")) / (points - 1))
    grid = grid.select("i", at.alias("t"))
    levels = grid.agg(F.array_sort(F.collect_list("t")).alias("levels"))  # ``points`` numbers
    reached = sims.join(F.broadcast(levels)).select("label", F.size(F.filter("levels", lambda t: t <= F.col("sim"))).alias("reach"))
    counts = reached.groupBy("reach").agg(F.sum("label").alias("p"), F.sum(1 - F.col("label")).alias("n"))
    total = counts.agg(F.sum("p").alias("tp_all"), F.sum("n").alias("n_all"))
    hit = grid.join(F.broadcast(counts), F.col("reach") > F.col("i"), "left").groupBy("i", "t").agg(F.coalesce(F.sum("p"), F.lit(0)).alias("tp"), F.coalesce(F.sum("n"), F.lit(0)).alias("fp"))
    hit = hit.join(F.broadcast(total)).withColumn("accuracy", (F.col("tp") + F.col("n_all") - F.col("fp")) / (F.col("tp_all") + F.col("n_all")))
    best = hit.orderBy(F.desc("accuracy"), "i").limit(1)
    precision = F.when(F.col("tp") + F.col("fp") > 0, F.col("tp") / (F.col("tp") + F.col("fp"))).otherwise(0.0)
    recall = F.when(F.col("tp_all") > 0, F.col("tp") / F.col("tp_all")).otherwise(0.0)
    best = best.withColumns({"precision": precision, "recall": recall})
    f1 = F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0)
    out = best.join(F.broadcast(sim_moments(sims)))
    return out.select(
        F.round("accuracy", 6).alias("accuracy"), F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"), F.round(f1, 6).alias("f1"),
        F.round("t", 6).alias("best_threshold"), *sim_moments(sims).columns,
    )


def sim_moments(sims: DataFrame) -> DataFrame:
    pos, neg = F.when(F.col("label") == 1, F.col("sim")), F.when(F.col("label") == 0, F.col("sim"))
    return sims.agg(
        F.round(F.avg(pos), 6).alias("pos_sim_mean"), F.round(F.stddev_pop(pos), 6).alias("pos_sim_std"),
        F.round(F.avg(neg), 6).alias("neg_sim_mean"), F.round(F.stddev_pop(neg), 6).alias("neg_sim_std"),
        F.round(F.avg(pos) - F.avg(neg), 6).alias("sim_gap"),
    )


def fixed_threshold_accuracy(sims: DataFrame, threshold: float = 0.5) -> DataFrame:
    return sims.agg(F.round(F.avg(((F.col("sim") > threshold).cast("int") == F.col("label")).cast("double")), 6).alias("accuracy"))


def dynamic_threshold_accuracy(sims: DataFrame) -> DataFrame:
    """Accuracy at the midpoint of the two mean similarities (0.5 if a class is missing)."""
    mid = sims.agg(((F.avg(F.when(F.col("label") == 1, F.col("sim"))) + F.avg(F.when(F.col("label") == 0, F.col("sim")))) / 2).alias("m"))
    mid = mid.select(F.coalesce("m", F.lit(0.5)).alias("threshold"))
    both = sims.join(F.broadcast(mid))  # one row
    return both.agg(F.round(F.first("threshold"), 6).alias("threshold"), F.round(F.avg(((F.col("sim") > F.col("threshold")).cast("int") == F.col("label")).cast("double")), 6).alias("accuracy"))


def pairwise_accuracy(sims: DataFrame) -> DataFrame:
    """Share of (positive, negative) pairs with the positive strictly above; from counts by value, not pairs."""
    by = sims.groupBy("sim").agg(F.sum("label").alias("p"), F.sum(1 - F.col("label")).alias("n"))
    placed = with_ordinal(by, "sim")
    chunk = F.floor(F.col("ordinal") / 100_000)
    sums = placed.groupBy(chunk.alias("c")).agg(F.sum("n").alias("t"))
    base = sums.select("c", F.coalesce(F.sum("t").over(Window.orderBy("c").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    own = F.coalesce(F.sum("n").over(Window.partitionBy("c").orderBy("sim").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    below = placed.withColumn("c", chunk).withColumn("own", own).join(base, "c").select("p", "n", (F.col("own") + F.col("base")).alias("below"))
    return below.agg(F.round(F.sum(F.col("p") * F.col("below")) / (F.sum("p") * F.sum("n")), 6).alias("pairwise_accuracy"))


def confusion(df: DataFrame, truth: str, predicted: str, eps: float = 1e-8) -> DataFrame:
    """Binary report with ``eps`` in the denominators; rows without a 0/1 prediction are counted apart."""
    t, p = F.col(truth), F.col(predicted)
    usable = p.isin(0, 1) & t.isin(0, 1)
    n = lambda a, b: F.count_if(usable & (t == a) & (p == b))
    c = df.agg(n(1, 1).alias("tp"), n(0, 1).alias("fp"), n(1, 0).alias("fn"), n(0, 0).alias("tn"), F.count_if(~F.coalesce(usable, F.lit(False))).alias("skipped"))
    precision, recall = F.col("tp") / (F.col("tp") + F.col("fp") + eps), F.col("tp") / (F.col("tp") + F.col("fn") + eps)
    total = F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")
    return c.select(
        "tp", "fp", "fn", "tn", "skipped", F.round((F.col("tp") + F.col("tn")) / (total + eps), 6).alias("accuracy"), F.round(precision, 6).alias("precision"),
        F.round(recall, 6).alias("recall"), F.round(2 * precision * recall / (precision + recall + eps), 6).alias("f1"),
    )


def ranking_answers(df: DataFrame, response: str, idx: str, batch: str) -> DataFrame:
    """Mean reciprocal place of idx in the answer's first line (parts joined by $): both denominators.

    A missing index leaves the query out of ``mrr`` and counts 0 in ``mrr_all``.
    """
    line = F.element_at(F.split(F.coalesce(F.col(response), F.lit("")), "\n"), 1)
    parts = F.transform(F.split(line, r"\$"), lambda x: F.trim(x))
    place = F.array_position(parts, F.col(idx).cast("string"))
    rr = df.select(F.col(batch).alias("batch"), F.when(place > 0, 1 / place).alias("rr"))
    per = rr.groupBy("batch").agg(F.coalesce(F.avg("rr"), F.lit(0.0)).alias("m"), F.avg(F.coalesce("rr", F.lit(0.0))).alias("a"))
    return per.agg(F.round(F.avg("m"), 6).alias("mrr"), F.round(F.avg("a"), 6).alias("mrr_all"), F.count(F.lit(1)).alias("n_batches"))


def best_epoch(df: DataFrame, epoch: str, metric: str) -> DataFrame:
    """The earliest epoch with the highest metric."""
    return df.agg(F.max_by(F.col(epoch), F.struct(F.col(metric), -F.col(epoch))).alias("best_epoch"), F.max(metric).alias("best_metric"))
