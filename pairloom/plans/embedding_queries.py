"""Registered queries over embeddings, with their SQL.

Even vec_ids are queries (assembly side), the next odd ids their keys (source side); a pair
is labelled 1 when both labels agree. Batches hold 32 pairs in order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import losses, metrics, mining, vectors
from ..session import table

BATCH = 32


def sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    e = table(spark, sf_dir, "embeddings")
    return e.where("vec_id % 2 = 0"), e.where("vec_id % 2 = 1")


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """batch, i, a, s, label."""
    q, k = sides(spark, sf_dir)
    i = F.floor(F.col("vec_id") / 2).cast("long")
    a = q.select(i.alias("i"), F.col("embedding").alias("a"), F.col("label").alias("la"))
    s = k.select(i.alias("i"), F.col("embedding").alias("s"), F.col("label").alias("ls"))
    return a.join(s, "i").select(F.floor(F.col("i") / BATCH).cast("long").alias("batch"), "i", "a", "s", (F.col("la") == F.col("ls")).cast("int").alias("label"))


def diagonal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sim (6 digits), label of each pair."""
    return pairs(spark, sf_dir).select("i", F.round(vectors.cosine(F.col("a"), F.col("s")), 6).alias("sim"), "label")


def all_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, k = sides(spark, sf_dir)
    truth = q.select(F.col("vec_id").alias("q_id"), (F.col("vec_id") + 1).alias("k_id"))
    return vectors.target_ranks(q, k, truth, "vec_id", "vec_id", "embedding")


def retrieval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.retrieval_report(all_ranks(spark, sf_dir))


def retrieval_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return all_ranks(spark, sf_dir)


def topk_similar(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, k = sides(spark, sf_dir)
    return vectors.top_k(q, k, 10, "vec_id", "vec_id", "embedding")


def topk_within_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three most similar pairs of each label."""
    d = pairs(spark, sf_dir).select("i", "label", F.round(vectors.cosine(F.col("a"), F.col("s")), 6).alias("sim"))
    return mining.top_per_group(d, "label", [F.desc("sim"), F.asc("i")], 3)


def hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return mining.hard_negatives(e, e, 5, "vec_id", "vec_id", "embedding")


def similarity_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean cosine between labels, from the sums of unit vectors: no pair of rows is formed."""
    e = table(spark, sf_dir, "embeddings").select("label", F.posexplode(vectors.normalize(F.col("embedding"))).alias("d", "x"))
    sums = e.groupBy("label", "d").agg(F.sum("x").alias("x"), F.count(F.lit(1)).alias("n"))
    other = sums.select(F.col("label").alias("label_b"), "d", F.col("x").alias("y"), F.col("n").alias("m"))
    out = sums.withColumnRenamed("label", "label_a").join(other, "d").groupBy("label_a", "label_b")
    return out.agg(F.round(F.sum(F.col("x") * F.col("y")) / (F.first("n") * F.first("m")), 6).alias("mean_sim"))


def difficulty_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mining.difficulty(pairs(spark, sf_dir))


def curriculum_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = mining.difficulty(pairs(spark, sf_dir)).select("i", "score")
    return mining.curriculum_prefix(scored, 0.25, "i", "score")


def batch_mrr(spark: SparkSession, sf_dir: str) -> DataFrame:
    sims = losses.batch_sims(losses.unit(pairs(spark, sf_dir))).withColumn("sim", F.round("sim", 6))
    ranks = metrics.batch_ranks(sims.select("batch", "i", "j", "sim"))
    return metrics.macro_mean(ranks, "batch", 1 / F.col("rank"))


def threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.threshold_sweep(diagonal(spark, sf_dir).select("sim", "label"))


def pairwise_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.pairwise_accuracy(diagonal(spark, sf_dir).select("sim", "label"))


def dynamic_threshold_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.dynamic_threshold_accuracy(diagonal(spark, sf_dir).select("sim", "label"))


def fixed_threshold_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.fixed_threshold_accuracy(diagonal(spark, sf_dir).select("sim", "label"))


def similarity_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.sim_moments(diagonal(spark, sf_dir).select("sim", "label"))


def normalized_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("vec_id", vectors.normalize(F.col("embedding")).alias("v"))
    return e.select("vec_id", F.round(F.element_at("v", 1), 6).alias("first"), F.round(F.element_at("v", -1), 6).alias("last"), F.round(vectors.norm(F.col("v")), 6).alias("norm"))


def ring_buffer_last_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    return mining.ring_buffer(e, "vec_id", 100)


def _loss(name: str, **options):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return losses.loss(name, pairs(spark, sf_dir), **options)

    query.__name__ = name
    return query


QUERIES = {
    "retrieval_metrics": retrieval_metrics, "retrieval_ranks": retrieval_ranks, "topk_similar": topk_similar, "topk_within_label": topk_within_label,
    "hard_negatives": hard_negatives, "similarity_report": similarity_report, "difficulty_scores": difficulty_scores, "curriculum_prefix": curriculum_prefix,
    "batch_mrr": batch_mrr, "threshold_sweep": threshold_sweep, "pairwise_accuracy": pairwise_accuracy,
    "dynamic_threshold_accuracy": dynamic_threshold_accuracy, "fixed_threshold_accuracy": fixed_threshold_accuracy,
    "similarity_moments": similarity_moments, "normalized_vectors": normalized_vectors, "ring_buffer_last_k": ring_buffer_last_k,
    "loss_infonce": _loss("infonce"), "loss_hard_infonce": _loss("hard_infonce"), "loss_labeled_infonce": _loss("labeled_infonce"),
    "loss_weighted_infonce": _loss("weighted_infonce"), "loss_cosine_embedding": _loss("cosine_embedding"),
    "loss_labeled_contrastive": _loss("labeled_contrastive"), "loss_simple_contrastive": _loss("simple_contrastive"),
    "loss_labeled_triplet": _loss("labeled_triplet"), "loss_multiple_negatives": _loss("multiple_negatives"), "loss_triplet": _loss("triplet"),
    "loss_triplet_euclidean": _loss("triplet", distance="euclidean"), "loss_gist": _loss("gist"), "loss_momentum": _loss("momentum", batch_size=BATCH, queue=128),
}

_P = """
WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings),
p AS (SELECT q.vec_id // 2 AS i, (q.vec_id // 2) // 32 AS batch, q.v AS a, k.v AS s, (q.label = k.label)::INT AS label
      FROM e q JOIN e k ON k.vec_id = q.vec_id + 1 WHERE q.vec_id % 2 = 0),
d AS (SELECT i, batch, label, list_cosine_similarity(a, s) AS sim FROM p),
m AS (SELECT x.batch, x.i, y.i AS j, x.label AS li, y.label AS lj, list_cosine_similarity(x.a, y.s) AS sim FROM p x JOIN p y USING (batch))
"""
_RANKS = """
WITH q AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 2 = 0),
k AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 2 = 1),
s AS (SELECT q.vec_id AS q_id, k.vec_id AS k_id, round(list_cosine_similarity(q.v, k.v), 6) AS sim FROM q, k),
r AS (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY sim DESC, k_id) AS rank FROM s)
"""
#: cross entropy of the diagonal by rows and by columns at the scale given
_CE = """, x AS (SELECT *, sim * {scale} AS x FROM m),
r AS (SELECT batch, i, any_value(li) AS label, max(x) FILTER (i = j) AS own, ln(sum(exp(x))) AS lse FROM x GROUP BY batch, i),
c AS (SELECT batch, j, max(x) FILTER (i = j) AS own, ln(sum(exp(x))) AS lse FROM x GROUP BY batch, j)
"""
_CE20 = _CE.format(scale="(1/0.05::DOUBLE)")
_PICK = "('0x' || substr(md5('42|' || i), 1, 8))::BIGINT"

ORACLE_SQL = {
    "retrieval_metrics": _RANKS + """, t AS (SELECT rank FROM r WHERE k_id = q_id + 1)
SELECT round(avg(1.0 / rank), 6) AS mrr, round(avg((rank <= 1)::INT), 6) AS recall_at_1, round(avg((rank <= 5)::INT), 6) AS recall_at_5,
 round(avg((rank <= 10)::INT), 6) AS recall_at_10, round(avg((rank <= 100)::INT), 6) AS recall_at_100, round(avg(rank), 6) AS mean_rank,
 round(median(rank), 6) AS median_rank, count(*) AS n_queries FROM t""",
    "retrieval_ranks": _RANKS + "SELECT q_id, rank FROM r WHERE k_id = q_id + 1",
    "topk_similar": _RANKS + "SELECT q_id, k_id, sim, rank::INT AS rank FROM r WHERE rank <= 10",
    "topk_within_label": _P + "SELECT i, label, sim, rank::INT AS rank FROM (SELECT i, label, round(sim, 6) AS sim, row_number() OVER (PARTITION BY label ORDER BY round(sim, 6) DESC, i) AS rank FROM d) WHERE rank <= 3",
    "hard_negatives": """
WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
s AS (SELECT q.vec_id AS q_id, k.vec_id AS k_id, round(list_cosine_similarity(q.v, k.v), 6) AS sim FROM e q, e k WHERE q.vec_id <> k.vec_id)
SELECT * FROM (SELECT q_id, k_id, sim, (row_number() OVER (PARTITION BY q_id ORDER BY sim DESC, k_id))::INT AS rank FROM s) WHERE rank <= 5""",
    "similarity_report": """
WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings)
SELECT a.label AS label_a, b.label AS label_b, round(avg(list_cosine_similarity(a.v, b.v)), 6) AS mean_sim FROM e a, e b GROUP BY 1, 2""",
    "difficulty_scores": _P + """SELECT batch, i, round(CASE WHEN max(sim) FILTER (i <> j) IS NULL THEN 1.0 ELSE max(sim) FILTER (i = j) - max(sim) FILTER (i <> j) END, 6) AS score FROM m GROUP BY batch, i""",
    "curriculum_prefix": _P + """, s AS (SELECT i, round(CASE WHEN max(sim) FILTER (i <> j) IS NULL THEN 1.0 ELSE max(sim) FILTER (i = j) - max(sim) FILTER (i <> j) END, 6) AS score FROM m GROUP BY i),
o AS (SELECT i, score, row_number() OVER (ORDER BY score DESC, i) - 1 AS ordinal, count(*) OVER () AS n FROM s)
SELECT i, score, ordinal, md5('42|' || i) AS shuffle_key FROM o WHERE ordinal < greatest(1, floor(n * 0.25::DOUBLE))""",
    "batch_mrr": _P + """, r AS (SELECT batch, i, j, row_number() OVER (PARTITION BY batch, i ORDER BY round(sim, 6) DESC, j) AS rank FROM m),
b AS (SELECT batch, avg(1.0 / rank) AS mean FROM r WHERE i = j GROUP BY batch) SELECT round(avg(mean), 6) AS macro_mean, count(*) AS n_batches FROM b""",
    "threshold_sweep": _P + """, s AS (SELECT round(sim, 6) AS sim, label FROM d),
g AS (SELECT i, CASE WHEN i = 99 THEN mx ELSE mn + i * (mx - mn) / 99 END AS t FROM (SELECT min(sim) AS mn, max(sim) AS mx FROM s), (SELECT unnest(range(100)) AS i)),
h AS (SELECT i, t, count(*) FILTER (sim >= t AND label = 1) AS tp, count(*) FILTER (sim >= t AND label = 0) AS fp, count(*) FILTER (label = 1) AS p, count(*) FILTER (label = 0) AS n FROM g, s GROUP BY i, t),
b AS (SELECT *, (tp + n - fp) / (p + n)::DOUBLE AS acc FROM h ORDER BY acc DESC, i LIMIT 1),
x AS (SELECT acc, t, CASE WHEN tp + fp > 0 THEN tp / (tp + fp)::DOUBLE ELSE 0 END AS pr, CASE WHEN p > 0 THEN tp / p::DOUBLE ELSE 0 END AS re FROM b),
y AS (SELECT round(avg(sim) FILTER (label = 1), 6) AS pos_sim_mean, round(stddev_pop(sim) FILTER (label = 1), 6) AS pos_sim_std, round(avg(sim) FILTER (label = 0), 6) AS neg_sim_mean,
 round(stddev_pop(sim) FILTER (label = 0), 6) AS neg_sim_std, round(avg(sim) FILTER (label = 1) - avg(sim) FILTER (label = 0), 6) AS sim_gap FROM s)
SELECT round(acc, 6) AS accuracy, round(pr, 6) AS precision, round(re, 6) AS recall, round(CASE WHEN pr + re > 0 THEN 2 * pr * re / (pr + re) ELSE 0 END, 6) AS f1, round(t, 6) AS best_threshold, y.* FROM x, y""",
    "pairwise_accuracy": _P + "SELECT round(avg((p.sim > n.sim)::INT), 6) AS pairwise_accuracy FROM (SELECT round(sim, 6) AS sim FROM d WHERE label = 1) p, (SELECT round(sim, 6) AS sim FROM d WHERE label = 0) n",
    "dynamic_threshold_accuracy": _P + """, s AS (SELECT round(sim, 6) AS sim, label FROM d), t AS (SELECT coalesce((avg(sim) FILTER (label = 1) + avg(sim) FILTER (label = 0)) / 2, 0.5) AS t FROM s)
SELECT round(any_value(t), 6) AS threshold, round(avg(((sim > t)::INT = label)::INT), 6) AS accuracy FROM s, t""",
    "fixed_threshold_accuracy": _P + "SELECT round(avg(((round(sim, 6) > 0.5)::INT = label)::INT), 6) AS accuracy FROM d",
    "similarity_moments": _P + """, s AS (SELECT round(sim, 6) AS sim, label FROM d) SELECT round(avg(sim) FILTER (label = 1), 6) AS pos_sim_mean, round(stddev_pop(sim) FILTER (label = 1), 6) AS pos_sim_std,
 round(avg(sim) FILTER (label = 0), 6) AS neg_sim_mean, round(stddev_pop(sim) FILTER (label = 0), 6) AS neg_sim_std, round(avg(sim) FILTER (label = 1) - avg(sim) FILTER (label = 0), 6) AS sim_gap FROM s""",
    "normalized_vectors": """WITH n AS (SELECT vec_id, embedding::DOUBLE[] AS v, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS l FROM embeddings)
SELECT vec_id, round(v[1] / l, 6) AS first, round(v[-1] / l, 6) AS last, round(1.0::DOUBLE, 6) AS norm FROM n""",
    "ring_buffer_last_k": "SELECT * FROM (SELECT vec_id, label, row_number() OVER (ORDER BY vec_id) - 1 AS position, (row_number() OVER (ORDER BY vec_id) - 1) % 100 AS slot FROM embeddings) QUALIFY row_number() OVER (ORDER BY position DESC) <= 100",
    "loss_infonce": _P + _CE20 + "SELECT batch, round((a + b) / 2, 6) AS loss FROM (SELECT batch, avg(lse - own) AS a FROM r GROUP BY batch) JOIN (SELECT batch, avg(lse - own) AS b FROM c GROUP BY batch) USING (batch)",
    "loss_hard_infonce": _P + _CE20 + """, h AS (SELECT batch, i, max(sim) FILTER (i <> j) AS neg, max(sim) FILTER (i = j) AS pos FROM m GROUP BY batch, i),
g AS (SELECT batch, coalesce(avg(greatest((neg - pos + 0.2) / 0.05, 0)), 0) AS pen, avg(pos) AS mp FROM h GROUP BY batch)
SELECT batch, round((a + b) / 2 + pen, 6) AS loss, round(pen, 6) AS hard_neg_penalty, round(mp, 6) AS mean_pos_sim FROM (SELECT batch, avg(lse - own) AS a FROM r GROUP BY batch) JOIN (SELECT batch, avg(lse - own) AS b FROM c GROUP BY batch) USING (batch) JOIN g USING (batch)""",
    "loss_labeled_infonce": _P + _CE20 + "SELECT batch, round(coalesce(avg(lse - own) FILTER (label = 1), 0), 6) AS loss FROM r GROUP BY batch",
    "loss_weighted_infonce": _P + """, x AS (SELECT *, sim / 0.05 + CASE WHEN lj = 0 AND i <> j THEN ln(2) ELSE 0 END AS x FROM m),
r AS (SELECT batch, i, any_value(li) AS label, max(sim / 0.05) FILTER (i = j) AS own, ln(sum(exp(x))) AS lse FROM x GROUP BY batch, i),
t AS (SELECT batch, avg(lse - own) FILTER (label = 1) AS ce, avg(own) FILTER (label = 1) AS p, max(own) FILTER (label = 0) AS n FROM r GROUP BY batch)
SELECT batch, round(CASE WHEN ce IS NULL THEN 0 ELSE ce + CASE WHEN n IS NULL THEN 0 ELSE greatest(n - p + 0.2, 0) END END, 6) AS loss FROM t""",
    "loss_cosine_embedding": _P + "SELECT batch, round(avg(CASE WHEN label = 1 THEN 1 - sim ELSE greatest(sim - 0.2, 0) END), 6) AS loss, round(avg(((sim > 0.2)::INT = label)::INT), 6) AS accuracy FROM d GROUP BY batch",
    "loss_labeled_contrastive": _P + "SELECT batch, round(coalesce(avg(1 - sim) FILTER (label = 1), 0) + coalesce(avg(greatest(sim + 0.3, 0)) FILTER (label = 0), 0), 6) AS loss FROM d GROUP BY batch",
    "loss_simple_contrastive": _P + _CE20 + """, ce AS (SELECT batch, avg(lse - own) FILTER (label = 1) AS ce FROM r GROUP BY batch),
z AS (SELECT batch, avg(1 - sim) FILTER (label = 1) AS p, avg(greatest(sim + 0.3, 0)) FILTER (label = 0) AS n FROM d GROUP BY batch),
k AS (SELECT x.batch, avg(greatest(y.sim - x.sim + 0.3, 0)) AS r FROM d x JOIN d y USING (batch) WHERE x.label = 1 AND y.label = 0 GROUP BY x.batch)
SELECT batch, round(coalesce(p, 0) + coalesce(n, 0) + coalesce(ce, 0) + 0.5 * coalesce(r, 0), 6) AS loss FROM z JOIN ce USING (batch) LEFT JOIN k USING (batch)""",
    "loss_multiple_negatives": _P + _CE.format(scale="20") + "SELECT batch, round(avg(lse - own), 6) AS loss FROM r GROUP BY batch",
    "loss_labeled_triplet": _P + f""", u AS (SELECT i, batch, label, list_transform(a, lambda x: x / sqrt(list_dot_product(a, a))) AS a, list_transform(s, lambda x: x / sqrt(list_dot_product(s, s))) AS s FROM p),
g AS (SELECT batch, s AS n, row_number() OVER (PARTITION BY batch ORDER BY i) - 1 AS at, count(*) OVER (PARTITION BY batch) AS size FROM u WHERE label = 0),
t AS (SELECT u.batch, sqrt(list_sum(list_transform(range(1, 65), lambda k: pow(u.a[k] - u.s[k] + 1e-6, 2)))) AS ap, sqrt(list_sum(list_transform(range(1, 65), lambda k: pow(u.a[k] - g.n[k] + 1e-6, 2)))) AS an
 FROM u JOIN g ON g.batch = u.batch AND g.at = {_PICK.replace('|| i', '|| u.i')} % g.size WHERE u.label = 1)
SELECT batch, round(avg(greatest(ap - an + 0.3, 0)), 6) AS loss, count(*) AS n_triplets FROM t GROUP BY batch""",
    "loss_triplet": _P + f""", o AS (SELECT i, batch, a, s, row_number() OVER (PARTITION BY batch ORDER BY i) - 1 AS own, count(*) OVER (PARTITION BY batch) AS size FROM p)
SELECT x.batch, round(avg(greatest(list_cosine_similarity(x.a, y.s) - list_cosine_similarity(x.a, x.s) + 0.5, 0)), 6) AS loss
FROM o x JOIN o y ON y.batch = x.batch AND y.own = (x.own + {_PICK.replace('|| i', '|| x.i')} % (x.size - 1) + 1) % x.size WHERE x.size > 1 GROUP BY x.batch""",
    "loss_triplet_euclidean": _P + f""", o AS (SELECT i, batch, a, s, row_number() OVER (PARTITION BY batch ORDER BY i) - 1 AS own, count(*) OVER (PARTITION BY batch) AS size FROM p)
SELECT x.batch, round(avg(greatest(sqrt(greatest(2 - 2 * list_cosine_similarity(x.a, x.s), 0)) - sqrt(greatest(2 - 2 * list_cosine_similarity(x.a, y.s), 0)) + 0.5, 0)), 6) AS loss
FROM o x JOIN o y ON y.batch = x.batch AND y.own = (x.own + {_PICK.replace('|| i', '|| x.i')} % (x.size - 1) + 1) % x.size WHERE x.size > 1 GROUP BY x.batch""",
    "loss_gist": _P + """, z AS (SELECT batch, i, sim / 0.05 AS x FROM m
 UNION ALL SELECT x.batch, x.i, list_cosine_similarity(x.a, y.a) / 0.05 FROM p x JOIN p y USING (batch) WHERE x.i <> y.i
 UNION ALL SELECT x.batch, x.i, list_cosine_similarity(x.s, y.s) / 0.05 FROM p x JOIN p y USING (batch) WHERE x.i <> y.i),
l AS (SELECT batch, i, ln(sum(exp(x))) AS lse FROM z GROUP BY batch, i)
SELECT batch, round(avg(lse - sim / 0.05), 6) AS loss FROM l JOIN d USING (batch, i) GROUP BY batch""",
    "loss_momentum": _P + """, z AS (SELECT x.batch, x.i, list_cosine_similarity(x.a, y.s) / 0.07 AS f, list_cosine_similarity(x.s, y.a) / 0.07 AS g
 FROM p x JOIN p y ON y.i < x.batch * 32 AND y.i >= x.batch * 32 - 128),
l AS (SELECT d.batch, d.i, any_value(sim) / 0.07 AS own, ln(coalesce(sum(exp(f)), 0) + exp(any_value(sim) / 0.07)) AS lf, ln(coalesce(sum(exp(g)), 0) + exp(any_value(sim) / 0.07)) AS lg
 FROM d LEFT JOIN z ON z.batch = d.batch AND z.i = d.i GROUP BY d.batch, d.i)
SELECT batch, round((avg(lf - own) + avg(lg - own)) / 2, 6) AS loss, round(avg(lf - own), 6) AS loss_a2s, round(avg(lg - own), 6) AS loss_s2a FROM l GROUP BY batch""",
}
