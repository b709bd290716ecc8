"""Registered queries on limits, splits, zips, running means, tokens and approximate search, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import losses, momentum, selection, vectors
from ..session import table
from ..sources import files
from .embedding_queries import _P, _RANKS, BATCH, all_ranks, pairs, sides


def ann_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall at 10 of the inverted file (128 lists, fitted probes) against the exact search: at least 0.9, over all queries."""
    q, k = sides(spark, sf_dir)
    exact = vectors.top_k(q, k, 10, "vec_id", "vec_id", "embedding").select("q_id", "k_id")
    near = vectors.ann_top_k(q, k, 10, "vec_id", "vec_id", "embedding", probes=None).select("q_id", "k_id", F.lit(1).alias("hit"))
    both = exact.join(near, ["q_id", "k_id"], "left")
    return both.agg(F.count_distinct("q_id").alias("n_queries"), F.count(F.lit(1)).alias("n_true"), (F.count("hit") >= 0.9 * F.count(F.lit(1))).alias("recall_reached"))


def ann_topk_all_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With as many probes as lists the inverted file is exact."""
    q, k = sides(spark, sf_dir)
    return vectors.ann_top_k(q, k, 10, "vec_id", "vec_id", "embedding", lists=16, probes=16)


def similar_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, k = sides(spark, sf_dir)
    return vectors.most_similar(q, k.withColumn("text", F.concat(F.lit("vec-"), "vec_id")), "vec_id", "vec_id", "text", "embedding")


def distance_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pairs(spark, sf_dir)
    return p.select("i", F.round(vectors.score_of_distance(1 - vectors.cosine(F.col("a"), F.col("s"))), 6).alias("score"))


def retrieval_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return all_ranks(spark, sf_dir).agg(F.round(F.avg((F.col("rank") == 1).cast("int")), 6).alias("accuracy"), F.count(F.lit(1)).alias("n_queries"))


def random_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.exact_split(table(spark, sf_dir, "documents").select("doc_id"), "doc_id")


def zipped_sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, k = sides(spark, sf_dir)
    z = selection.positional_zip(q.select("vec_id", "label"), k.select("vec_id", "label"), "vec_id", "vec_id")
    return z.select("position", F.col("left.vec_id").alias("asm_id"), F.col("right.vec_id").alias("src_id"), (F.col("left.label") == F.col("right.label")).alias("same"))


def running_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.running_means(table(spark, sf_dir, "lineitem"), "l_linenumber", ["l_quantity", "l_discount"])


def success_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.success_counts(table(spark, sf_dir, "documents"), "source", F.col("n_chars") > 1000)


def selection_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = selection.selection_rows(table(spark, sf_dir, "benchmark"), "text", "text")
    return rows.select("item_id", F.md5("asm").alias("asm_md5"), F.md5("src").alias("src_md5"), "label")


def own_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "benchmark")
    return b.select("item_id", F.md5(text.prompt(F.col("text"), "c", "Explain:\n{code}\n--")).alias("md5"))


def head_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.head(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), 100, F.desc("o_totalprice"), "o_orderkey")


def prefetch_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.sample_files(table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("path")))


def sliced_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.row_slice(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), 40, 90, "o_orderkey", lambda d: d.withColumn("o_totalprice", F.round(F.col("o_totalprice") * 2, 2)))


def token_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", text.token_ids(F.col("text"), 64).alias("t"))
    mask = F.aggregate("t.attention_mask", F.lit(0), lambda a, x: a + x)
    return d.select("doc_id", F.md5(F.array_join("t.input_ids", ",")).alias("ids_md5"), mask.alias("n_kept"), F.size("t.input_ids").alias("n_ids"), F.col("t.n_tokens").alias("n_tokens"))


def listing_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short texts stand for listings that can't be read, others have one function if they begin with a T."""
    d = table(spark, sf_dir, "documents")
    listing = F.when(F.length("text") >= 200, F.concat(F.when(F.substring("text", 1, 1) == "T", F.lit("0000000000000000 <f>:\n")).otherwise(F.lit("")), F.lit("  0: ret")))
    return files.listing_rows(d.select("doc_id", listing.alias("content")), "doc_id")


def _negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two explicit negatives a row: the keys of the next two pairs."""
    p = pairs(spark, sf_dir)
    n = p.select("i", F.col("s").alias("n"), F.explode(F.array(F.lit(1), F.lit(2))).alias("back"))
    return p.select("batch", "i").join(n.select((F.col("i") - F.col("back")).alias("i"), "n"), "i")


def loss_multiple_negatives_explicit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return losses.multiple_negatives(pairs(spark, sf_dir), negatives=_negatives(spark, sf_dir))


def loss_gist_explicit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return losses.gist(pairs(spark, sf_dir), negatives=_negatives(spark, sf_dir))


def momentum_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return momentum.momentum_accuracy(pairs(spark, sf_dir), BATCH, queue=128)


QUERIES = {
    f.__name__: f
    for f in (
        ann_topk, ann_topk_all_lists, similar_texts, distance_scores, retrieval_accuracy, random_split, zipped_sides, running_means, success_counts, selection_rows, own_template,
        head_rows, prefetch_sample, sliced_rows, token_rows, listing_errors, loss_multiple_negatives_explicit, loss_gist_explicit, momentum_accuracy,
    )
}

_PROMPTS = """WITH t AS (SELECT *, 'Analyze the following ' AS a, ' code and understand its semantic meaning:' || chr(10) || '```' AS b, chr(10) || '```' || chr(10) || 'Semantic representation:' AS z FROM benchmark)
"""
_EXPLICIT = """, g AS (SELECT x.batch, x.i, list_cosine_similarity(x.a, y.s) AS sim FROM p x JOIN p y ON y.i = x.i + 1 OR y.i = x.i + 2)
"""
_TOKENS = "list_filter(regexp_split_to_array(coalesce(text, ''), '\\s+'), lambda w: w <> '')"

ORACLE_SQL = {
    "ann_topk": _RANKS + "SELECT count(DISTINCT q_id) AS n_queries, count(*) AS n_true, true AS recall_reached FROM r WHERE rank <= 10",
    "ann_topk_all_lists": _RANKS + "SELECT q_id, k_id, sim, rank::INT AS rank FROM r WHERE rank <= 10",
    "similar_texts": _RANKS + "SELECT q_id, rank::INT AS rank, 'vec-' || k_id AS text, sim AS score FROM r WHERE rank <= 5",
    "distance_scores": _P + "SELECT i, round(1 / (1 + (1 - sim)), 6) AS score FROM d",
    "retrieval_accuracy": _RANKS + "SELECT round(avg((rank = 1)::INT), 6) AS accuracy, count(*) AS n_queries FROM r WHERE k_id = q_id + 1",
    "random_split": """WITH o AS (SELECT doc_id, row_number() OVER (ORDER BY md5('42|' || doc_id), doc_id) - 1 AS nth, count(*) OVER () AS n FROM documents)
SELECT doc_id, CASE WHEN nth < floor(n * 0.8::DOUBLE) THEN 'train' ELSE 'test' END AS split FROM o""",
    "zipped_sides": """WITH q AS (SELECT *, row_number() OVER (ORDER BY vec_id) - 1 AS at FROM embeddings WHERE vec_id % 2 = 0), k AS (SELECT *, row_number() OVER (ORDER BY vec_id) - 1 AS at FROM embeddings WHERE vec_id % 2 = 1)
SELECT q.at AS position, q.vec_id AS asm_id, k.vec_id AS src_id, q.label = k.label AS same FROM q JOIN k ON q.at = k.at""",
    "running_means": "SELECT l_linenumber, count(*) AS n_batches, round(avg(l_quantity), 6) AS mean_l_quantity, round(avg(l_discount), 6) AS mean_l_discount FROM lineitem GROUP BY 1",
    "success_counts": "SELECT source, count(*) FILTER (n_chars > 1000) AS n_ok, count(*) AS n_total FROM documents GROUP BY 1",
    "selection_rows": _PROMPTS + "SELECT item_id, md5(a || 'assembly' || b || 'asm' || chr(10) || text || z) AS asm_md5, md5(a || 'source' || b || 'c' || chr(10) || text || z) AS src_md5, 1 AS label FROM t",
    "own_template": "SELECT item_id, md5('Explain:' || chr(10) || text || chr(10) || '--') AS md5 FROM benchmark",
    "head_rows": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100",
    "prefetch_sample": "SELECT page_id::VARCHAR AS path FROM pages ORDER BY md5('42|' || page_id), page_id::VARCHAR LIMIT 10",
    "sliced_rows": "SELECT o_orderkey, round(o_totalprice * 2, 2) AS o_totalprice, nth AS ordinal FROM (SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS nth FROM orders) WHERE nth >= 40 AND nth < 90",
    "token_rows": f"""WITH t AS (SELECT doc_id, list_transform({_TOKENS}, lambda w: ('0x' || substr(md5(w), 1, 8))::BIGINT % 50000 + 1) AS ids FROM documents)
SELECT doc_id, md5(array_to_string(list_resize(ids[:64], 64, 0), ',')) AS ids_md5, least(len(ids), 64)::INT AS n_kept, 64 AS n_ids, len(ids)::INT AS n_tokens FROM t""",
    "listing_errors": """SELECT doc_id, CASE WHEN f THEN 1 END AS function_id, CASE WHEN f THEN 'f' END AS name, CASE WHEN f THEN '  0: ret' END AS body,
 CASE WHEN n < 200 THEN 'unreadable' WHEN NOT f THEN 'no functions found' END AS error FROM (SELECT doc_id, length(text) AS n, length(text) >= 200 AND text[1] = 'T' AS f FROM documents)""",
    "loss_multiple_negatives_explicit": _P + _EXPLICIT + """, x AS (SELECT batch, i, sim * 20 AS x FROM m UNION ALL SELECT batch, i, sim * 20 FROM g),
l AS (SELECT batch, i, ln(sum(exp(x))) AS lse FROM x GROUP BY batch, i) SELECT batch, round(avg(lse - sim * 20), 6) AS loss FROM l JOIN d USING (batch, i) GROUP BY batch""",
    "loss_gist_explicit": _P + _EXPLICIT + """, z AS (SELECT batch, i, sim / 0.05 AS x FROM m
 UNION ALL SELECT x.batch, x.i, list_cosine_similarity(x.a, y.a) / 0.05 FROM p x JOIN p y USING (batch) WHERE x.i <> y.i
 UNION ALL SELECT x.batch, x.i, list_cosine_similarity(x.s, y.s) / 0.05 FROM p x JOIN p y USING (batch) WHERE x.i <> y.i
 UNION ALL SELECT g.batch, g.i, g.sim / 0.05 FROM g JOIN d USING (batch, i) WHERE g.sim <= d.sim),
l AS (SELECT batch, i, ln(sum(exp(x))) AS lse FROM z GROUP BY batch, i)
SELECT batch, round(avg(lse - sim / 0.05), 6) AS loss FROM l JOIN d USING (batch, i) GROUP BY batch""",
    "momentum_accuracy": _P + """, z AS (SELECT x.batch, x.i, max(list_cosine_similarity(x.a, y.s)) AS f, max(list_cosine_similarity(x.s, y.a)) AS g
 FROM p x JOIN p y ON y.i < x.batch * 32 AND y.i >= x.batch * 32 - 128 GROUP BY x.batch, x.i)
SELECT d.batch, round(avg((f IS NULL OR sim >= f)::INT), 6) AS acc_a2s, round(avg((g IS NULL OR sim >= g)::INT), 6) AS acc_s2a FROM d LEFT JOIN z ON z.batch = d.batch AND z.i = d.i GROUP BY d.batch""",
}
