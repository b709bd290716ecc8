"""Registered queries: the queue at its real size, fingerprints, the stored index, includes, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import parsing
from ..operators import encoding, hamming, includes, momentum, sketches
from ..scratch import Scratch
from ..session import table
from ..sources import files
from ..sources.vector_store import VectorStore
from ..sql import register
from ..streaming import progress
from .corpus_queries import SIMHASH_CTE
from .embedding_queries import _P, _RANKS, BATCH, pairs, sides

QUEUE = 65_536


def _started(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Pairs, and a queue that held them with their sides exchanged before the first batch."""
    p = pairs(spark, sf_dir)
    return p, p.select(F.col("i").alias("slot"), F.col("s").alias("a"), F.col("a").alias("s"))


def loss_momentum_full_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, initial = _started(spark, sf_dir)
    return momentum.momentum(p, BATCH, queue=QUEUE, initial=initial)


def momentum_accuracy_full_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, initial = _started(spark, sf_dir)
    return momentum.momentum_accuracy(p, BATCH, queue=QUEUE, initial=initial)


def _fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", parsing.simhash64(F.col("text")).alias("h"))


def simhash_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's class of equal fingerprints, and the number of classes within 3 bits."""
    return hamming.near_classes(_fingerprints(spark, sf_dir), "doc_id", "h")


def simhash_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of classes within 3 bits."""
    return hamming.class_pairs(_fingerprints(spark, sf_dir), "doc_id", "h")


def stored_index_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys inserted in two parts, then one search that looks into all lists."""
    q, k = sides(spark, sf_dir)
    store = VectorStore(spark, Scratch(spark, "stored-index").path("collection"), 64, lists=32)
    rows = k.select(F.col("label").cast("string").alias("project_name"), F.lit("f").alias("file_name"), F.col("vec_id").cast("string").alias("function_name"), F.concat(F.lit("code "), "vec_id").alias("function_code"), "embedding")
    store.insert(rows.where("function_name % 4 = 1"))
    store.insert(rows.where("function_name % 4 = 3"))
    hits = store.search(q, 5, "vec_id", "embedding", probes=32)
    return hits.select("q_id", "rank", "sim", "project_name", "function_name", "function_code")


#: path segments of urls that serve as directories
_LANGS = ("en", "de", "fr", "es")


def include_dirs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Urls as files of their host; their language folders as include directories."""
    bare = F.regexp_replace("url", "[?#].*$", "")
    p = table(spark, sf_dir, "pages").select("page_id", F.element_at(F.split(bare, "/"), 3).alias("project"), F.regexp_replace(bare, "^[^/]*//[^/]*/", "").alias("path"))
    found = includes.include_dirs(p, _LANGS)
    return p.join(found, ["project", "path"]).select("page_id", F.array_join("dirs", ",").alias("dirs"))


def include_reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents include an earlier one, chosen by their length; one in a hundred also a later one, which makes cycles."""
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    n = d.agg(F.count(F.lit(1)).alias("n"))
    e = d.join(F.broadcast(n)).select("doc_id", F.explode(F.array(F.col("n_chars") % (F.col("doc_id") + 1), F.when(F.col("n_chars") % 100 == 0, (F.col("doc_id") + F.col("n_chars")) % F.col("n")))).alias("included"))  # one row
    return includes.reach(e, "doc_id", "included")


def _sentence_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents of a source as one listing, a row per sentence; sentences with a digit begin a function."""
    d = table(spark, sf_dir, "documents").select("source", "doc_id", F.posexplode(F.split("text", r"\. ")).alias("at", "sentence"))
    head = F.concat(F.lower(F.hex("doc_id")), F.lit(" <f"), F.col("doc_id").cast("string"), F.lit("_"), F.col("at").cast("string"), F.lit(">:"))
    return d.select("source", (F.col("doc_id") * 100_000 + F.col("at")).alias("n"), F.when(F.col("sentence").rlike("[0-9]"), head).otherwise(F.md5("sentence")).alias("line"))


def listing_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listings read line by line, spread over blocks of lines."""
    found = files.functions_of_lines(_sentence_lines(spark, sf_dir), "source")
    return found.select("source", "function_id", "name", "start_addr", F.md5("body").alias("body_md5"))


def listing_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by the table function."""
    register(spark)
    lines = _sentence_lines(spark, sf_dir)
    return spark.sql("SELECT listing AS source, function_id, name, start_addr, md5(body) AS body_md5 FROM listing_functions(TABLE({lines}) PARTITION BY source ORDER BY n)", lines=lines)


def best_so_far(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as measurements of their user's run, streamed in two starts of one query; its state at the end."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("run"), F.col("event_id").alias("step"), F.col("value").alias("metric"))
    tmp = Scratch(spark, "best-so-far")
    half = F.lit(e.agg(F.floor((F.min("step") + F.max("step")) / 2)).first()[0])
    for part in (F.col("step") <= half, F.col("step") > half):
        e.where(part).write.mode("append").parquet(tmp.path("in"))
        stream = spark.readStream.schema(e.schema).parquet(tmp.path("in"))
        progress.follow(stream, tmp.path("state"), tmp.path("out")).awaitTermination()
    return progress.current(spark, tmp.path("state"))


def batch_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders in twelve batches, by priority: exact sums, and whether merged sketches are within their error of exact ones."""
    o = table(spark, sf_dir, "orders")
    group = "o_orderpriority"
    stats = sketches.BatchStatistics(spark, Scratch(spark, "batch-sketches").path("stats"), [group], ["o_custkey"], ["o_totalprice"])
    for k in range(12):
        stats.add(o.where(F.pmod("o_orderkey", F.lit(12)) == k), k)
    merged = stats.merged((0.5,)).withColumn("median", F.col("quantiles_o_totalprice")[0])
    exact = o.groupBy(group).agg(F.count_distinct("o_custkey").alias("exact_distinct"))
    below = o.join(merged.select(group, "median"), group).groupBy(group).agg(F.avg((F.col("o_totalprice") <= F.col("median")).cast("int")).alias("rank"))
    both = merged.join(exact, group).join(below, group)
    near = F.abs(F.col("distinct_o_custkey") - F.col("exact_distinct")) <= F.greatest(F.lit(1.0), sketches.DISTINCT_ERROR * F.col("exact_distinct"))
    # the rank of a value among few is a multiple of one over their number
    middle = F.abs(F.col("rank") - 0.5) <= sketches.RANK_ERROR + 1 / F.col("n_rows")
    return both.select(group, "n_batches", "n_rows", "exact_distinct", F.round("min_o_totalprice", 2).alias("least"), F.round("max_o_totalprice", 2).alias("most"), near.alias("distinct_near"), middle.alias("median_near"))


def encoded_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents encoded by the stand-in model, cut to 512 tokens."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    made = encoding.encode(d, "text", encoding.Loader("hashed-words-64", encoding.HashedWords, 64))
    return made.select("doc_id", "n_tokens", "truncated", "encode_error", F.size(F.filter("embedding", lambda x: x > 0)).alias("n_filled"), F.round(F.array_max("embedding").cast("double"), 4).alias("largest"))


QUERIES = {f.__name__: f for f in (loss_momentum_full_queue, momentum_accuracy_full_queue, simhash_near, simhash_pairs, stored_index_search, include_dirs, include_reach, listing_lines, listing_sql, best_so_far, batch_sketches, encoded_documents)}

_QUEUE = _P + f""", k AS (SELECT i AS j, a AS ka, s AS ks FROM p UNION ALL SELECT i - {QUEUE}, s, a FROM p),
z AS (SELECT x.batch, x.i, list_cosine_similarity(x.a, y.ks) / 0.07 AS f, list_cosine_similarity(x.s, y.ka) / 0.07 AS g FROM p x JOIN k y ON y.j < x.batch * {BATCH} AND y.j >= x.batch * {BATCH} - {QUEUE}),
l AS (SELECT d.batch, d.i, any_value(sim) / 0.07 AS own, max(f) AS mf, max(g) AS mg, ln(coalesce(sum(exp(f)), 0) + exp(any_value(sim) / 0.07)) AS lf, ln(coalesce(sum(exp(g)), 0) + exp(any_value(sim) / 0.07)) AS lg
 FROM d LEFT JOIN z ON z.batch = d.batch AND z.i = d.i GROUP BY d.batch, d.i)
"""
_CLASSES = SIMHASH_CTE + """, prints AS (SELECT doc_id, simhash AS h FROM fingerprints WHERE simhash IS NOT NULL), classes AS (SELECT h, min(doc_id) AS id FROM prints GROUP BY h),
near AS (SELECT least(x.id, y.id) AS left_id, greatest(x.id, y.id) AS right_id, bit_count(xor(x.h, y.h))::INT AS distance FROM classes x JOIN classes y ON x.h < y.h AND bit_count(xor(x.h, y.h)) <= 3)
"""

_LISTING = r"""WITH d AS (SELECT source, doc_id, string_split(text, '. ') AS parts FROM documents),
l AS (SELECT source, doc_id, i - 1 AS nth, parts[i] AS sentence FROM d, unnest(range(1, len(parts) + 1)) AS t(i)),
f AS (SELECT source, doc_id * 100000 + nth AS n, doc_id, nth, sentence, regexp_matches(sentence, '[0-9]') AS head FROM l),
k AS (SELECT *, sum(head::INT) OVER (PARTITION BY source ORDER BY n) AS function_id FROM f)
SELECT source, function_id::INT AS function_id, max(CASE WHEN head THEN 'f' || doc_id || '_' || nth END) AS name, max(CASE WHEN head THEN printf('%x', doc_id) END) AS start_addr,
 md5(coalesce(string_agg(md5(sentence), chr(10) ORDER BY n) FILTER (NOT head), '')) AS body_md5 FROM k WHERE function_id > 0 GROUP BY source, function_id"""

ORACLE_SQL = {
    "loss_momentum_full_queue": _QUEUE + "SELECT batch, round((avg(lf - own) + avg(lg - own)) / 2, 6) AS loss, round(avg(lf - own), 6) AS loss_a2s, round(avg(lg - own), 6) AS loss_s2a FROM l GROUP BY batch",
    "momentum_accuracy_full_queue": _QUEUE + "SELECT batch, round(avg((mf IS NULL OR own >= mf)::INT), 6) AS acc_a2s, round(avg((mg IS NULL OR own >= mg)::INT), 6) AS acc_s2a FROM l GROUP BY batch",
    "simhash_near": _CLASSES + """, links AS (SELECT id, count(*) AS n FROM (SELECT left_id AS id FROM near UNION ALL SELECT right_id FROM near) GROUP BY id)
SELECT d.doc_id, c.id AS class_id, coalesce(l.n, 0)::BIGINT AS n_near FROM fingerprints d LEFT JOIN classes c ON c.h = d.simhash LEFT JOIN links l ON l.id = c.id""",
    "simhash_pairs": _CLASSES + "SELECT left_id, right_id, distance FROM near",
    "stored_index_search": _RANKS + """SELECT q_id, rank::INT AS rank, sim, k.label::VARCHAR AS project_name, k_id::VARCHAR AS function_name, 'code ' || k_id AS function_code
 FROM r JOIN embeddings k ON k.vec_id = k_id WHERE rank <= 5""",
    "include_dirs": f"""WITH p AS (SELECT page_id, string_split(regexp_replace(url, '[?#].*$', ''), '/') AS u FROM pages),
f AS (SELECT page_id, u[3] AS host, u[4:] AS parts FROM p),
a AS (SELECT page_id, host, parts[:k] AS dir, len(parts) - 1 - k AS level FROM f, unnest(range(len(parts))) AS t(k)),
x AS (SELECT DISTINCT host, dir FROM a WHERE len(dir) > 0 AND list_contains({list(_LANGS)}, dir[-1])),
m AS (SELECT a.page_id, array_to_string(x.dir, '/') AS dir, level, list_position({list(_LANGS)}, x.dir[-1]) AS nth FROM a JOIN x ON x.host = a.host AND x.dir[:len(x.dir) - 1] = a.dir)
SELECT f.page_id, coalesce(string_agg(dir, ',' ORDER BY level, nth, dir), '') AS dirs FROM f LEFT JOIN m USING (page_id) GROUP BY f.page_id""",
    "include_reach": """WITH RECURSIVE e AS (SELECT doc_id, n_chars % (doc_id + 1) AS included FROM documents
  UNION SELECT doc_id, (doc_id + n_chars) % (SELECT count(*) FROM documents) FROM documents WHERE n_chars % 100 = 0),
r AS (SELECT doc_id, included FROM e WHERE included IS NOT NULL UNION SELECT r.doc_id, e.included FROM r JOIN e ON e.doc_id = r.included)
SELECT doc_id, included FROM r""",
    "listing_lines": _LISTING,
    "listing_sql": _LISTING,
    "best_so_far": """WITH e AS (SELECT user_id::VARCHAR AS run, event_id AS step, value AS metric FROM events WHERE user_id IS NOT NULL AND event_id IS NOT NULL AND value IS NOT NULL AND NOT isnan(value)),
b AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY metric DESC, step) AS r, row_number() OVER (PARTITION BY run ORDER BY step) AS nth, count(*) OVER (PARTITION BY run) AS n FROM e)
SELECT run, step AS best_step, metric AS best_metric, n AS n_seen, n - nth AS since_best FROM b WHERE r = 1""",
    "batch_sketches": """SELECT o_orderpriority, count(DISTINCT o_orderkey % 12) AS n_batches, count(*) AS n_rows, count(DISTINCT o_custkey) AS exact_distinct,
 round(min(o_totalprice), 2) AS least, round(max(o_totalprice), 2) AS most, true AS distinct_near, true AS median_near FROM orders GROUP BY o_orderpriority""",
    "encoded_documents": r"""WITH w AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(text, '[^\s]+') AS ws FROM documents WHERE text IS NOT NULL),
b AS (SELECT r, ('0x' || substr(md5(unnest(ws[:512])), 1, 8))::BIGINT % 64 AS b FROM w), c AS (SELECT r, b, count(*) AS n FROM b GROUP BY r, b),
v AS (SELECT r, count(*)::INT AS n_filled, round((max(n) / sqrt(sum(n * n)))::FLOAT::DOUBLE, 4) AS largest FROM c GROUP BY r)
SELECT doc_id, least(len(ws), 512)::INT AS n_tokens, len(ws) > 512 AS truncated, NULL::VARCHAR AS encode_error, coalesce(n_filled, 0) AS n_filled, coalesce(largest, 0) AS largest FROM w LEFT JOIN v USING (r)""",
}
