"""Forward values of contrastive losses, one row per batch.

Input ``pairs``: batch, i (unique), a, s (vectors), label (1: a and s belong together).
Similarities are joined within a batch only, so a batch of B pairs makes B * B rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .momentum import momentum, momentum_accuracy  # noqa: F401
from .ordinal import seeded_int
from .vectors import dot, normalize


def unit(pairs: DataFrame) -> DataFrame:
    return pairs.withColumns({"a": normalize(F.col("a")), "s": normalize(F.col("s"))})


def batch_sims(pairs: DataFrame, left: str = "a", right: str = "s") -> DataFrame:
    """batch, i, j, sim, li, lj of all pairs of rows of a batch; vectors are unit vectors."""
    x = pairs.select("batch", "i", F.col(left).alias("x"), F.col("label").alias("li"))
    y = pairs.select("batch", F.col("i").alias("j"), F.col(right).alias("y"), F.col("label").alias("lj"))
    return x.join(y, "batch").select("batch", "i", "j", dot(F.col("x"), F.col("y")).alias("sim"), "li", "lj")


def log_sum_exp(logits: DataFrame, by: list[str], x: str = "x") -> DataFrame:
    """by, lse: the maximum is taken out first, so large logits do not overflow."""
    top = F.max(x).over(Window.partitionBy(*by))
    shifted = logits.withColumn("__m", top)
    return shifted.groupBy(*by).agg((F.first("__m") + F.log(F.sum(F.exp(F.col(x) - F.col("__m"))))).alias("lse"))


def _relu(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0))


def _row_terms(sims: DataFrame, scale: float, side: str = "i") -> DataFrame:
    """batch, row, label, own logit, cross entropy of the diagonal along rows (i) or columns (j)."""
    x = sims.withColumn("x", F.col("sim") * scale)
    lse = log_sum_exp(x, ["batch", side])
    own = x.where("i = j").select("batch", F.col(side), F.col("li").alias("label"), F.col("x").alias("own"))
    return own.join(lse, ["batch", side]).withColumn("ce", F.col("lse") - F.col("own"))


def _rounded(df: DataFrame, **columns: Column) -> DataFrame:
    return df.select("batch", *[F.round(c, 6).alias(n) for n, c in columns.items()])


def infonce(pairs: DataFrame, tau: float = 0.05) -> DataFrame:
    """Mean of the row-wise and the column-wise cross entropy of the diagonal."""
    sims = batch_sims(unit(pairs))
    rows, cols = (_row_terms(sims, 1 / tau, side).groupBy("batch").agg(F.avg("ce").alias(side)) for side in "ij")
    return _rounded(rows.join(cols, "batch"), loss=(F.col("i") + F.col("j")) / 2)


def hard_infonce(pairs: DataFrame, tau: float = 0.05, weight: float = 1.0, margin: float = 0.2) -> DataFrame:
    """infonce plus the hinge on each row's hardest negative."""
    sims = batch_sims(unit(pairs))
    hardest = sims.groupBy("batch", "i").agg(F.max(F.when(F.col("i") != F.col("j"), F.col("sim"))).alias("neg"), F.max(F.when(F.col("i") == F.col("j"), F.col("sim"))).alias("pos"))
    hinge = hardest.groupBy("batch").agg(
        F.avg(_relu((F.col("neg") - F.col("pos") + margin) / tau)).alias("pen"), F.avg("pos").alias("mean_pos_sim"), F.avg((F.col("pos") > F.col("neg")).cast("double")).alias("acc")
    )
    both = infonce_terms(sims, tau).join(hinge, "batch")
    return _rounded(both, loss=F.col("base") + weight * F.coalesce("pen", F.lit(0.0)), hard_neg_penalty=F.coalesce("pen", F.lit(0.0)), mean_pos_sim=F.col("mean_pos_sim"))


def infonce_terms(sims: DataFrame, tau: float) -> DataFrame:
    rows, cols = (_row_terms(sims, 1 / tau, side).groupBy("batch").agg(F.avg("ce").alias(side)) for side in "ij")
    return rows.join(cols, "batch").select("batch", ((F.col("i") + F.col("j")) / 2).alias("base"))


def labeled_infonce(pairs: DataFrame, tau: float = 0.05) -> DataFrame:
    """Row cross entropy over positives; all columns stand in the denominator; 0 without positives."""
    terms = _row_terms(batch_sims(unit(pairs)), 1 / tau)
    return _rounded(terms.groupBy("batch").agg(F.avg(F.when(F.col("label") == 1, F.col("ce"))).alias("m")), loss=F.coalesce("m", F.lit(0.0)))


def weighted_infonce(pairs: DataFrame, tau: float = 0.05, negative_weight: float = 2.0, weight: float = 1.0, margin: float = 0.2) -> DataFrame:
    """labeled_infonce with explicit negatives' columns weighted, plus a hinge on scaled similarities."""
    sims = batch_sims(unit(pairs))
    heavy = (F.col("lj") == 0) & (F.col("i") != F.col("j"))
    x = sims.withColumn("x", F.col("sim") / tau + F.when(heavy, F.log(F.lit(negative_weight))).otherwise(0.0))
    own = sims.where("i = j").select("batch", "i", F.col("li").alias("label"), (F.col("sim") / tau).alias("own"))
    terms = own.join(log_sum_exp(x, ["batch", "i"]), ["batch", "i"])
    pos, neg = F.when(F.col("label") == 1, F.col("own")), F.when(F.col("label") == 0, F.col("own"))
    per = terms.groupBy("batch").agg(F.avg(F.when(F.col("label") == 1, F.col("lse") - F.col("own"))).alias("ce"), F.avg(pos).alias("p"), F.max(neg).alias("n"))
    hinge = F.coalesce(_relu_null(F.col("n") - F.col("p") + margin), F.lit(0.0))
    return _rounded(per, loss=F.when(F.col("ce").isNull(), 0.0).otherwise(F.col("ce") + weight * hinge))


def _relu_null(x: Column) -> Column:
    return F.when(x.isNotNull(), _relu(x))


def _diagonal(pairs: DataFrame) -> DataFrame:
    return unit(pairs).select("batch", "i", "label", dot(F.col("a"), F.col("s")).alias("sim"))


def cosine_embedding(pairs: DataFrame, margin: float = 0.2) -> DataFrame:
    d = _diagonal(pairs)
    term = F.when(F.col("label") == 1, 1 - F.col("sim")).otherwise(_relu(F.col("sim") - margin))
    right = ((F.col("sim") > margin).cast("int") == F.col("label")).cast("double")
    return _rounded(d.groupBy("batch").agg(F.avg(term).alias("l"), F.avg(right).alias("r")), loss=F.col("l"), accuracy=F.col("r"))


def labeled_contrastive(pairs: DataFrame, margin: float = 0.3, negative_weight: float = 1.0) -> DataFrame:
    """Mean of 1 - s over positives plus the weighted mean hinge of s over negatives."""
    d = _diagonal(pairs).groupBy("batch").agg(F.avg(F.when(F.col("label") == 1, 1 - F.col("sim"))).alias("p"), F.avg(F.when(F.col("label") == 0, _relu(F.col("sim") + margin))).alias("n"))
    return _rounded(d, loss=F.coalesce("p", F.lit(0.0)) + negative_weight * F.coalesce("n", F.lit(0.0)))


def simple_contrastive(pairs: DataFrame, margin: float = 0.3, tau: float = 0.05, weights: tuple[float, float, float] = (1.0, 1.0, 0.5)) -> DataFrame:
    """Pairwise, cross-entropy and margin-ranking terms; a missing class drops its terms."""
    u = unit(pairs)
    sims = batch_sims(u)
    ce = _row_terms(sims, 1 / tau).groupBy("batch").agg(F.avg(F.when(F.col("label") == 1, F.col("ce"))).alias("ce"))
    d = u.select("batch", "label", dot(F.col("a"), F.col("s")).alias("sim"))
    each = d.groupBy("batch").agg(F.avg(F.when(F.col("label") == 1, 1 - F.col("sim"))).alias("p"), F.avg(F.when(F.col("label") == 0, _relu(F.col("sim") + margin))).alias("n"))
    pos, neg = d.where("label = 1").select("batch", F.col("sim").alias("sp")), d.where("label = 0").select("batch", F.col("sim").alias("sn"))
    rank = pos.join(neg, "batch").groupBy("batch").agg(F.avg(_relu(F.col("sn") - F.col("sp") + margin)).alias("r"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    return _rounded(each.join(ce, "batch").join(rank, "batch", "left"), loss=weights[0] * (zero("p") + zero("n")) + weights[1] * zero("ce") + weights[2] * zero("r"))


def _explicit(u: DataFrame, negatives: DataFrame) -> DataFrame:
    """batch, i, sim of each row's anchor with its explicit negatives (batch, i, n); u: unit vectors."""
    rows = negatives.select("batch", "i", normalize(F.col("n")).alias("n"))
    return u.select("batch", "i", "a").join(rows, ["batch", "i"]).select("batch", "i", dot(F.col("a"), F.col("n")).alias("sim"))


def multiple_negatives(pairs: DataFrame, scale: float = 20.0, negatives: DataFrame | None = None) -> DataFrame:
    """Row cross entropy; explicit negatives (batch, i, n) are further logits of their row."""
    u = unit(pairs)
    sims = batch_sims(u)
    logits = sims.select("batch", "i", (F.col("sim") * scale).alias("x"))
    if negatives is not None:
        logits = logits.unionByName(_explicit(u, negatives).select("batch", "i", (F.col("sim") * scale).alias("x")))
    own = sims.where("i = j").select("batch", "i", (F.col("sim") * scale).alias("own"))
    terms = own.join(log_sum_exp(logits, ["batch", "i"]), ["batch", "i"])
    return _rounded(terms.groupBy("batch").agg(F.avg(F.col("lse") - F.col("own")).alias("l")), loss=F.col("l"))


def _with_negative(pairs: DataFrame, seed: int, negatives_only: bool) -> DataFrame:
    """Each (positive) row with one row of its batch, picked by hash: a negative, or any other row."""
    u = unit(pairs)
    pool = u.where("label = 0") if negatives_only else u
    w = Window.partitionBy("batch").orderBy("i")
    pool = pool.select("batch", F.col("i").alias("j"), F.col("s").alias("n"), (F.row_number().over(w) - 1).alias("at"))
    sizes = pool.groupBy("batch").agg(F.count(F.lit(1)).alias("size"))
    if negatives_only:
        rows = u.where("label = 1").join(sizes, "batch").withColumn("at", (seeded_int(seed, F.col("i").cast("string")) % F.col("size")).cast("int"))
    else:
        own = u.withColumn("own", F.row_number().over(w) - 1).join(sizes, "batch").where("size > 1")
        off = seeded_int(seed, F.col("i").cast("string")) % (F.col("size") - 1) + 1
        rows = own.withColumn("at", ((F.col("own") + off) % F.col("size")).cast("int"))
    return rows.join(pool, ["batch", "at"])


def labeled_triplet(pairs: DataFrame, margin: float = 0.3, seed: int = 42) -> DataFrame:
    """Euclidean triplet loss of each positive with one hashed negative; no row without both classes."""
    t = _with_negative(pairs, seed, True)
    d = lambda x, y: F.sqrt(F.aggregate(F.zip_with(x, y, lambda p, q: (p - q + 1e-6) * (p - q + 1e-6)), F.lit(0.0), lambda s, v: s + v))
    term = _relu(d(F.col("a"), F.col("s")) - d(F.col("a"), F.col("n")) + margin)
    return _rounded(t.groupBy("batch").agg(F.avg(term).alias("l"), F.count(F.lit(1)).alias("k")), loss=F.col("l"), n_triplets=F.col("k"))


def triplet(pairs: DataFrame, margin: float = 0.5, distance: str = "cosine", seed: int = 42) -> DataFrame:
    """Triplets (a, s, s of another row of the batch)."""
    t = _with_negative(pairs, seed, False)
    ap, an = dot(F.col("a"), F.col("s")), dot(F.col("a"), F.col("n"))
    if distance == "cosine":
        term = _relu(an - ap + margin)
    elif distance == "euclidean":
        term = _relu(F.sqrt(F.greatest(2 - 2 * ap, F.lit(0.0))) - F.sqrt(F.greatest(2 - 2 * an, F.lit(0.0))) + margin)
    else:
        raise ValueError(f"unknown distance {distance!r}")
    return _rounded(t.groupBy("batch").agg(F.avg(term).alias("l")), loss=F.col("l"))


def gist(pairs: DataFrame, tau: float = 0.05, contrast_anchors: bool = True, contrast_positives: bool = True, negatives: DataFrame | None = None) -> DataFrame:
    """Row cross entropy over anchor-positive, anchor-anchor and positive-positive logits, own ones left out.

    Explicit negatives (batch, i, n) count unless they are closer to the anchor than its
    own positive, which marks a false negative.
    """
    u = unit(pairs)
    ap = batch_sims(u)
    parts = [ap]
    if contrast_anchors:
        parts.append(batch_sims(u, "a", "a").where("i <> j"))
    if contrast_positives:
        parts.append(batch_sims(u, "s", "s").where("i <> j"))
    x = parts[0]
    for p in parts[1:]:
        x = x.unionByName(p)
    x = x.select("batch", "i", "sim")
    if negatives is not None:
        positive = ap.where("i = j").select("batch", "i", F.col("sim").alias("positive"))
        x = x.unionByName(_explicit(u, negatives).join(positive, ["batch", "i"]).where("sim <= positive").select("batch", "i", "sim"))
    lse = log_sum_exp(x.withColumn("x", F.col("sim") / tau), ["batch", "i"])
    own = ap.where("i = j").select("batch", "i", (F.col("sim") / tau).alias("own"))
    return _rounded(own.join(lse, ["batch", "i"]).groupBy("batch").agg(F.avg(F.col("lse") - F.col("own")).alias("l")), loss=F.col("l"))


LOSSES = {
    "infonce": infonce, "hard_infonce": hard_infonce, "labeled_infonce": labeled_infonce, "weighted_infonce": weighted_infonce,
    "cosine_embedding": cosine_embedding, "labeled_contrastive": labeled_contrastive, "simple_contrastive": simple_contrastive,
    "labeled_triplet": labeled_triplet, "triplet": triplet, "multiple_negatives": multiple_negatives, "gist": gist, "momentum": momentum,
}


def loss(name: str, pairs: DataFrame, **options) -> DataFrame:
    if name not in LOSSES:
        raise ValueError(f"unknown loss {name!r}; there are {', '.join(LOSSES)}")
    return LOSSES[name](pairs, **options)
