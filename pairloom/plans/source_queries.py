"""Registered queries that write given tables through the sinks and read them back, with their SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions import text
from ..operators import vectors
from ..scratch import Scratch
from ..session import table
from ..sources import files
from ..streaming import ingest


def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written as CSV in two parts, the second appended, and read back."""
    path = Scratch(spark, "csv").path("documents")
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", F.when(F.col("doc_id") % 5 != 0, F.col("source")).alias("source"))
    files.write_csv(d.where("doc_id % 2 = 0"), path)
    files.write_csv(d.where("doc_id % 2 <> 0"), path, append=True)
    got = files.read_csv(spark, path, "doc_id long, text string, lang string, source string")
    return got.select("doc_id", F.md5(F.regexp_replace("text", "\r\n?", "\n")).alias("text_md5"), "lang", "source")


def _projects(spark: SparkSession, sf_dir: str, root: str, part: str = "true") -> None:
    """Benchmark items as documents, one a file, two levels deep; sentences are their functions."""
    functions = F.transform(F.split("text", r"\. "), lambda s, i: F.struct((i + 1).alias("function_id"), F.when(i != 1, F.concat(F.lit("f"), i.cast("string"))).alias("function_name"), F.lit("").alias("signature"), s.alias("body")))
    meta = F.struct(F.col("item_id").cast("string").alias("source_file"), F.lit(None).cast("string").alias("extraction_timestamp"), F.size(functions).alias("total_functions"), F.lit("t").alias("extractor"))
    d = table(spark, sf_dir, "benchmark").where(part).select(F.concat(F.lit("p"), F.col("item_id") % 5).alias("project"), meta.alias("metadata"), functions.alias("functions"))
    d.write.option("maxRecordsPerFile", 1).partitionBy("project").mode("append").json(root)


def project_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of projects, their function counts, and functions that have a name and a body."""
    root = Scratch(spark, "projects").path("root")
    _projects(spark, sf_dir, root)
    docs = files.read_project_documents(spark, root).cache()
    counts = files.function_counts(docs).withColumnRenamed("n_functions", "n")
    named = files.explode_functions(docs.select("path", "functions")).groupBy("path").agg(F.count(F.lit(1)).alias("named"), F.md5(F.array_join(F.array_sort(F.collect_list("body")), "|")).alias("bodies"))
    rows = docs.select("path", F.regexp_replace("project", "^project=", "").alias("project"), F.col("metadata.source_file").cast("long").alias("item_id"))
    return rows.join(counts, "path").join(named, "path", "left").select("item_id", "project", F.col("n").cast("int").alias("n"), F.coalesce("named", F.lit(0)).alias("named"), "bodies")


def ingested_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same documents ingested as a stream in two starts, a few files a batch, each once."""
    tmp = Scratch(spark, "ingest")
    for part in ("item_id % 3 = 0", "item_id % 3 <> 0"):
        _projects(spark, sf_dir, tmp.path("root"), part)
        ingest.ingest_documents(spark, tmp.path("root"), tmp.path("sink"), tmp.path("state"), schemas.SRC_DOC, files_per_batch=50).awaitTermination()
    got = spark.read.schema(schemas.SRC_DOC).parquet(tmp.path("sink"))
    return got.select(F.col("metadata.source_file").cast("long").alias("item_id"), F.col("metadata.total_functions").alias("n"), F.md5(F.array_join(F.transform("functions", lambda f: f.body), "|")).alias("bodies"))


def _as_files(spark: SparkSession, sf_dir: str, name: str) -> str:
    path = Scratch(spark, name).path("files")
    table(spark, sf_dir, "benchmark").select(F.concat(F.lit("g"), F.col("item_id") % 3).alias("g"), "text").write.option("maxRecordsPerFile", 1).partitionBy("g").text(path)
    return path


def file_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items as files below folders, read as sources by their extension (in another case)."""
    got = files.read_files(spark, _as_files(spark, sf_dir, "file-scan"), (".TXT", ".c"))
    return got.select(F.md5(F.regexp_replace("content", "\n$", "")).alias("content_md5"), F.char_length("content").alias("n"))


def listing_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same files as listings: whole, and line by line."""
    path = _as_files(spark, sf_dir, "listing-scan")
    whole = files.read_listings(spark, path, "*.txt", "ignore").select("path", F.md5(F.regexp_replace("content", "\n$", "")).alias("content_md5"))
    lines = files.read_lines(spark, path, "*.txt").groupBy("path").agg(F.count(F.lit(1)).alias("n_lines"))
    # whole files and lines spell a local path with more or fewer slashes; folder and name tell files apart
    name = F.array_join(F.slice(F.split("path", "/"), F.lit(-2), F.lit(2)), "/").alias("name")
    return whole.select(name, "content_md5").join(lines.select(name, "n_lines"), "name").select("content_md5", "n_lines")


def rows_not_done(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that the labels do not name."""
    return files.not_done(table(spark, sf_dir, "documents").select("doc_id", "lang"), table(spark, sf_dir, "labels"), "doc_id")


def assembly_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as assembly of functions: null and short bodies are left out."""
    d = table(spark, sf_dir, "documents")
    code = F.when(F.col("n_chars") % 7 != 0, F.array_join(F.slice(F.split("text", " "), F.lit(1), (F.col("n_chars") % 12 + 1).cast("int")), " | "))
    path = F.concat(F.lit("/ida/"), "source", F.lit("/-O"), (F.col("doc_id") % 4).cast("string"), F.lit("/"), "lang", F.lit(".csv"))
    raw = d.select(F.concat(F.lit("f"), "doc_id").alias("function_name"), code.alias("full_define"), path.alias("path"))
    return files.assembly_rows(raw, F.col("path")).select("key", "signature", "function_name", F.md5("assembly_code").alias("assembly_md5"), "opti_level")


def merged_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two maps of each turn, the second on top."""
    c = table(spark, sf_dir, "conversations")
    base = F.create_map(F.lit("conv"), F.col("conv_id"), F.lit("turn"), F.col("turn"))
    over = F.create_map(F.lit("turn"), F.col("turn") + 1000, F.col("role"), F.length("text").cast("long"))
    m = text.right_wins(base, over)
    return c.select("conv_id", "turn", F.array_join(F.array_sort(F.transform(F.map_entries(m), lambda e: F.concat_ws("=", e.key, e.value))), ",").alias("merged"))


def instruction_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of documents as instructions at addresses 16 apart."""
    words = F.split("text", " ")
    first = F.col("doc_id") * 65_536
    addresses = F.transform(words, lambda _, i: first + i * 16)
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.md5(text.join_instructions(addresses, words)).alias("lines_md5"), text.address(first).alias("address"), text.address(first, padded=True).alias("padded"))


def source_stamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of sources made from benchmark items: number of functions, and a time of extraction."""
    words = F.filter(F.split(F.regexp_replace("text", "[^a-zA-Z ]", ""), " "), lambda w: w != "")
    source = F.array_join(F.transform(words, lambda w: F.concat(F.lit("void f_"), w, F.lit("(void) { return; }"))), "\n")
    d = files.source_documents(table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("path"), source.alias("content")))
    m = F.col("metadata")
    stamp = F.to_timestamp(m["extraction_timestamp"], "yyyy-MM-dd'T'HH:mm:ss")
    return d.select(m["source_file"].cast("long").alias("item_id"), m["total_functions"].alias("n"), stamp.isNotNull().alias("stamped"), m["extractor"].alias("extractor"))


def ring_buffer_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events streamed in two starts of one query; the last five of each user in its state."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "value").where("user_id IS NOT NULL")
    tmp = Scratch(spark, "ring")
    half = e.agg(F.floor((F.min("event_id") + F.max("event_id")) / 2)).first()[0] or 0
    for part in (F.col("event_id") <= half, F.col("event_id") > half):
        e.where(part).write.mode("append").parquet(tmp.path("in"))
        rows = ingest.ring_buffer_stream(spark.readStream.schema(e.schema).parquet(tmp.path("in")), "user_id", "event_id", "value", 5)
        rows.writeStream.outputMode("update").format("noop").trigger(availableNow=True).option("checkpointLocation", tmp.path("state")).start().awaitTermination()
    held = spark.read.format("statestore").load(tmp.path("state")).select("key.*", "value.groupState.orders")
    return held.toDF("user_id", "orders").select("user_id", F.posexplode("orders").alias("slot", "event_id"))


#: a projection head of 64 to 8 to 4 numbers, filled by rule
_WEIGHTS = {
    "w1": (np.add.outer(np.arange(8) * 7, np.arange(64) * 3) % 11 - 5) / 10, "b1": (np.arange(8) % 3 - 1) / 10,
    "w2": (np.add.outer(np.arange(4) * 5, np.arange(8) * 2) % 7 - 3) / 5, "b2": (np.arange(4) % 2) / 10, "gamma": 1 + np.arange(4) / 4, "beta": np.arange(4) / 10,
}


def projected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings through a projection head."""
    out = vectors.project(_WEIGHTS)(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    return out.select("vec_id", *(F.round(F.col("embedding")[i], 4).alias(f"y{i}") for i in range(4)))


QUERIES = {
    f.__name__: f
    for f in (csv_round_trip, project_documents, ingested_documents, file_scan, listing_scan, rows_not_done, assembly_rows, merged_settings, instruction_lines, source_stamps, ring_buffer_state, projected)
}

#: distribution function of the normal distribution, by the rational approximation of erfc that the operator states
_POLY = "0.17087277"
for _c in (-0.82215223, 1.48851587, -1.13520398, 0.27886807, -0.18628806, 0.09678418, 0.37409196, 1.00002368, -1.26551223):
    _POLY = f"({_POLY}) * t + {_c}"

ORACLE_SQL = {
    "csv_round_trip": "SELECT doc_id, md5(regexp_replace(text, '\\r\\n?', chr(10), 'g')) AS text_md5, lang, CASE WHEN doc_id % 5 <> 0 THEN source END AS source FROM documents",
    "project_documents": """WITH b AS (SELECT item_id, string_split(text, '. ') AS parts FROM benchmark),
f AS (SELECT item_id, i, parts[i] AS body FROM b, unnest(range(1, len(parts) + 1)) AS t(i) WHERE i <> 2 AND parts[i] <> ''),
n AS (SELECT item_id, count(*) AS named, md5(string_agg(body, '|' ORDER BY body)) AS bodies FROM f GROUP BY item_id)
SELECT b.item_id, 'p' || b.item_id % 5 AS project, len(parts)::INT AS n, coalesce(named, 0) AS named, bodies FROM b LEFT JOIN n USING (item_id)""",
    "ingested_documents": "SELECT item_id, len(string_split(text, '. '))::INT AS n, md5(array_to_string(string_split(text, '. '), '|')) AS bodies FROM benchmark",
    "file_scan": "SELECT md5(text) AS content_md5, (length(text) + 1)::INT AS n FROM benchmark",
    "listing_scan": "SELECT md5(text) AS content_md5, len(string_split(text, chr(10))) AS n_lines FROM benchmark",
    "rows_not_done": "SELECT doc_id, lang FROM documents ANTI JOIN labels USING (doc_id)",
    "assembly_rows": """WITH c AS (SELECT *, string_split(text, ' ')[:n_chars % 12 + 1] AS w, 'O' || doc_id % 4 AS o FROM documents WHERE n_chars % 7 <> 0)
SELECT source || '$' || lang || '$f' || doc_id AS key, 'f' || doc_id || '$' || o AS signature, 'f' || doc_id AS function_name, md5(array_to_string(w, ' | ')) AS assembly_md5, o AS opti_level
FROM c WHERE len(string_split(array_to_string(w, ' | '), '|')) >= 7""",
    "merged_settings": """SELECT conv_id, turn, array_to_string(list_sort(['conv=' || conv_id, 'turn=' || (turn + 1000), role || '=' || length(text)]), ',') AS merged FROM conversations""",
    "instruction_lines": """SELECT doc_id, md5(array_to_string(list_transform(string_split(text, ' '), lambda w, i: '0x' || printf('%x', doc_id * 65536 + (i - 1) * 16) || ' ' || w), ' | ')) AS lines_md5,
 '0x' || printf('%x', doc_id * 65536) AS address, printf('%08X', doc_id * 65536) AS padded FROM documents""",
    "source_stamps": """SELECT item_id, len(list_filter(string_split(regexp_replace(text, '[^a-zA-Z ]', '', 'g'), ' '), lambda w: w <> ''))::INT AS n, true AS stamped, 'scanner' AS extractor FROM benchmark""",
    "ring_buffer_state": """WITH l AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events WHERE user_id IS NOT NULL)
SELECT user_id, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1)::INT AS slot, event_id FROM l WHERE r <= 5""",
    "projected": f"""WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
a AS (SELECT vec_id, list_transform(range(8), lambda i: list_sum(list_transform(range(64), lambda j: ((i * 7 + j * 3) % 11 - 5) / 10.0::DOUBLE * v[j + 1])) + (i % 3 - 1) / 10.0::DOUBLE) AS h FROM e),
u AS (SELECT vec_id, generate_subscripts(h, 1) - 1 AS j, unnest(h) AS x FROM a), t AS (SELECT *, abs(x) / sqrt(2) AS z, 1 / (1 + 0.5 * abs(x) / sqrt(2)) AS t FROM u),
p AS (SELECT *, 0.5 * t * exp(-z * z + {_POLY}) AS half FROM t), g AS (SELECT vec_id, j, x * CASE WHEN x >= 0 THEN 1 - half ELSE half END AS x FROM p),
y AS (SELECT vec_id, i, sum(((i * 5 + j * 2) % 7 - 3) / 5.0::DOUBLE * x) + (i % 2) / 10.0::DOUBLE AS y FROM g, (SELECT unnest(range(4)) AS i) GROUP BY vec_id, i),
m AS (SELECT vec_id, avg(y) AS mean, var_pop(y) AS var FROM y GROUP BY vec_id),
n AS (SELECT vec_id, i, (y - mean) / sqrt(var + 1e-5) * (1 + i / 4.0::DOUBLE) + i / 10.0::DOUBLE AS y FROM y JOIN m USING (vec_id))
SELECT vec_id, {', '.join(f'round(max(y) FILTER (i = {i}), 4) AS y{i}' for i in range(4))} FROM n GROUP BY vec_id""",
}
