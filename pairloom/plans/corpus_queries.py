"""Registered queries over documents, orders, pages, labels, conversations and events, with their SQL.

Documents stand in for functions (source: project, lang: file), lineitem for compiled
versions of the functions in orders, page urls for paths, conversations for answers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import parsing, text
from ..operators import integrate, metrics, mining
from ..operators.ordinal import seeded, with_ordinal
from ..operators.vectors import hashed_embedding, norm, pool
from ..providers import ExtractiveAnswers, HashedEmbedding, OverlapJudge, generate_and_judge
from ..session import table
from ..sources import files
from ..streaming import ingest


#: a row's place in its table's files: of rows that an order leaves equal the first one counts
_PLACE = ("_metadata.file_path", "_metadata.row_index")


def dedup_keep_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return integrate.keep_first(table(spark, sf_dir, "documents"), "text", "doc_id").select("doc_id", "lang", "source")


def distinct_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return integrate.distinct_stats(table(spark, sf_dir, "documents"), "text")


def merge_first_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line item with the first order of its key."""
    left = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("key"), "l_linenumber", "l_quantity")
    right = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), "o_custkey", "o_totalprice", *_PLACE)
    return integrate.first_match_join(left, right, "key", "o_totalprice", "file_path", "row_index")


def merge_first_match_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part with the first of its many line items: the right side repeats keys."""
    left = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), "p_name")
    right = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("key"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("ord"), "l_suppkey", *_PLACE)
    return integrate.first_match_join(left, right, "key", "ord", "file_path", "row_index")


def common_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return integrate.common_keys(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key")), table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("key")), "key")


def interleave_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", "source")
    return integrate.interleave(rows, "source", "doc_id")


def interleaved_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Final positions of orders interleaved by customer."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return with_ordinal(integrate.interleave(rows, "o_custkey", "o_orderkey"), "new_group_id", "shuffle_key", "o_orderkey", name="position").select("o_orderkey", "new_group_id", "position")


def largest_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").where("o_custkey is not null").groupBy("o_custkey").count().agg(F.max("count").alias("max_group_size"), F.count(F.lit(1)).alias("n_groups"))


def split_preserve_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return integrate.ordered_splits(table(spark, sf_dir, "documents").select("doc_id"), "doc_id").select("doc_id", "ordinal", "split")


def split_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return integrate.group_splits(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_custkey").select("o_orderkey", "split")


def split_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return integrate.split_stats(integrate.group_splits(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_custkey"), "o_custkey")


def verify_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id")
    return integrate.verify_split(docs, integrate.ordered_splits(docs, "doc_id"), "doc_id")


def negative_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return integrate.negative_pairs(table(spark, sf_dir, "documents"), "doc_id", "source").select("id", "partner", F.col("attempt").cast("int").alias("attempt"))


def labelled_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", F.concat_ws("$", "source", "lang").alias("l"), F.col("doc_id").cast("string").alias("r"))
    return integrate.labelled_pairs(docs, "doc_id", "source", "l", "r").groupBy("label", "way").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("id").alias("n_ids"), F.countDistinct("src_func").alias("n_src"))


def matching_pairs_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return mining.pairs_by_ratio(docs, integrate.negative_pairs(docs, "doc_id", "source"), "doc_id", 0.5)


def seeded_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_orderkey").withColumn("h", seeded(42, F.col("o_orderkey").cast("string")))
    return with_ordinal(rows, "h", "o_orderkey", name="position").select("o_orderkey", "position")


def mini_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = with_ordinal(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey")
    return rows.groupBy(integrate.batches(F.col("ordinal"), 32).alias("batch_id")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("o_totalprice"), 4).alias("mean_price"))


def macro_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = with_ordinal(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey")
    return metrics.macro_mean(rows.withColumn("batch_id", integrate.batches(F.col("ordinal"), 64)), "batch_id", F.col("o_totalprice") / 1000)


def union_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled rows with and without an optimization level in one relation."""
    x = table(spark, sf_dir, "labels")
    pos = x.where("quality = 1").select("doc_id", F.lit(1).alias("label"), F.lit("O0").alias("opti"))
    neg = x.where("quality = 0").select("doc_id", F.lit(0).alias("label"))
    return pos.unionByName(neg, allowMissingColumns=True)


def locate_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn by global number, and 20 numbers beyond, as (conversation, turn within it)."""
    turns = table(spark, sf_dir, "conversations")
    counts = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_turns"))
    total = turns.count()
    wanted = spark.range(0, total + 20).select(F.col("id").alias("idx"))
    return integrate.locate(counts, wanted, "conv_id", "n_turns")


def confusion_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality predicted by a length rule against the labels."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    rows = table(spark, sf_dir, "labels").join(docs, "doc_id").withColumn("predicted", F.when(F.col("n_chars") % 17 == 0, F.lit(None)).otherwise((F.col("n_chars") > 1000).cast("int")))
    return metrics.confusion(rows, "quality", "predicted")


def llm_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers whose first line is a label, sometimes not a number."""
    c = table(spark, sf_dir, "conversations")
    answer = F.when(F.col("turn") % 4 == 3, F.concat(F.lit("yes\n"), "text")).otherwise(F.concat(F.lit(" "), (F.col("conv_id") * 7 % 3).cast("string"), F.lit(" \n"), "text"))
    return c.select("conv_id", "turn", text.answer_label(answer).alias("label"))


def llm_rank_mrr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers that list three candidate turns; some do not name the right one."""
    c = table(spark, sf_dir, "conversations").withColumn("response", F.concat((F.col("turn") + F.col("conv_id") % 2).cast("string"), F.lit(" $"), F.col("turn").cast("string"), F.lit("$9\nbecause")))
    c = c.withColumn("response", F.when(F.col("conv_id") % 5 == 0, F.lit("7$8")).otherwise(F.col("response")))
    return metrics.ranking_answers(c.withColumn("batch", F.floor(F.col("conv_id") / 8)), "response", "turn", "batch")


def judge_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Structured answers with missing fields set to their defaults."""
    e = table(spark, sf_dir, "events")
    answer = F.when(F.col("event_id") % 3 == 0, F.format_string('{"score": %d, "reason": "r", "is_grounded": true}', F.col("event_id") % 6)).when(F.col("event_id") % 3 == 1, F.lit("{}")).otherwise(F.lit('{"function_code": "f()"}'))
    j = e.select("event_id", text.judge_fields(answer).alias("j"))
    return j.select("event_id", "j.function_code", "j.score", "j.reason", "j.is_grounded", F.size("j.citations").alias("n_citations"))


def best_epoch(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", F.col("p_retailprice").cast("int").alias("m"))
    return metrics.best_epoch(p.withColumn("m", F.col("m") % 97), "p_partkey", "m")


def compose_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    key = text.compose_key(F.col("source"), F.col("lang"), F.col("doc_id").cast("string"))
    return d.select("doc_id", key.alias("key"), text.function_of_key(key).alias("func_name"))


def path_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stem, extension, language and project of page urls taken as paths."""
    path = F.regexp_replace("url", r"[?#].*$", "")
    return table(spark, sf_dir, "pages").select(
        "page_id", text.file_stem(path).alias("stem"), text.extension(path).alias("ext"), text.language_of(path).alias("lang"), text.project(path).alias("project"), text.last_part(path, 3).alias("third")
    )


def opt_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    levels = F.array(*map(F.lit, ("-O0", "-O1", "-O2", "-O3", "-Ofast", "-Os", "src")))
    path = F.concat(F.lit("out/x-Os/"), F.get(levels, (F.col("page_id") % 7).cast("int")), F.lit("/"), F.col("page_id").cast("string"), F.lit(".a.csv"))
    return table(spark, sf_dir, "pages").select("page_id", text.opt_level(path).alias("level"), text.opt_level(path, whole_path=True).alias("level_anywhere"), text.project(path).alias("project"), text.file_stem(path).alias("stem"))


def mangled_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    prefix = F.get(F.array(*map(F.lit, ("_Z", "__Z", "?", "_z", "a_Z", ""))), (F.col("doc_id") % 6).cast("int"))
    name = F.concat(prefix, F.col("source"))
    return table(spark, sf_dir, "documents").select("doc_id", text.is_mangled(name).alias("mangled"))


def path_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct directories below the host of each url."""
    path = F.regexp_replace("url", r"[?#].*$", "")
    host = F.element_at(F.split("url", "/"), 3)
    return table(spark, sf_dir, "pages").select("page_id", F.array_join(text.path_keywords(path, host), ",").alias("key_words"))


def path_exclusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.get(F.array(*map(F.lit, ("src/", "test/", "src/.git/", "testing/", "a/examples/b/", "build/"))), (F.col("page_id") % 6).cast("int"))
    name = F.get(F.array(*map(F.lit, ("x.c", "test_x.c", "y.HPP", "z.txt", "main.cc"))), (F.col("page_id") % 5).cast("int"))
    path = F.concat(d, name)
    return table(spark, sf_dir, "pages").select("page_id", text.not_excluded(path).alias("inside"), text.is_source(path).alias("is_source"))


def output_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    rel = F.concat("source", F.lit("/"), "lang", F.lit("/f"), F.col("doc_id").cast("string"), F.lit(".oo.o"))
    return table(spark, sf_dir, "documents").select(
        "doc_id", text.output_path(rel, "out").alias("out"), text.swap_extension(rel, "o", "csv").alias("csv"), text.json_name(rel).alias("json"), text.object_paths(rel, "arm")["asm"].alias("asm")
    )


def short_body_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    name = F.when(F.col("doc_id") % 10 == 0, F.lit("main")).otherwise(F.col("source"))
    return d.select("doc_id", text.worth_keeping(name, F.col("text"), 5).alias("kept"), text.enough_chars(F.col("text"), 200).alias("long_enough"), text.enough_instructions(F.replace("text", F.lit(" "), F.lit("|")), 100).alias("enough"))


def prompt_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "benchmark")
    return b.select("item_id", F.md5(text.prompt(F.col("text"), "asm")).alias("asm_md5"), F.md5(text.prompt(F.col("text"), "c")).alias("c_md5"), text.preview(F.col("text"), 50).alias("preview"), F.md5(text.name_and_code(F.col("item_id").cast("string"), F.col("text"))).alias("named_md5"))


def rag_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Context of each conversation from its first five turns in order."""
    c = table(spark, sf_dir, "conversations").where("turn < 5")
    d = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.when(F.col("turn") % 2 == 0, F.concat_ws("-", "conv_id", "turn")).alias("id"), "text"))).alias("d"))
    return d.select("conv_id", F.md5(text.join_docs(F.col("d"))).alias("context_md5"), F.size("d").alias("n_docs"))


def rag_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The retrieve, generate, judge chain with offline providers: one row per question, each benchmark item being one."""
    from ..operators.vectors import top_k

    embed = HashedEmbedding(32)
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), "text").withColumn("embedding", embed.embed(F.col("text")))
    questions = items.withColumnRenamed("id", "q")
    retriever = lambda q: top_k(q, items, 5, "q", "id", "embedding")
    out = generate_and_judge(questions, items, retriever, ExtractiveAnswers(), OverlapJudge())
    cited = F.array_join(F.transform("citations", lambda c: F.concat_ws(":", c.source_id, c.why)), ",")
    return out.withColumn("cited", cited).withColumn("context_md5", F.md5("context")).drop("context", "citations")


def json_field_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k int").alias("p"))
    return e.select("event_id", "p.k")


def function_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of each benchmark item, numbered from 1."""
    b = table(spark, sf_dir, "benchmark")
    return b.select("item_id", F.posexplode(F.split("text", r"\. ", -1)).alias("pos", "part")).select("item_id", (F.col("pos") + 1).alias("function_id"), F.length("part").alias("n_chars"))


def ring_buffer_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mining.ring_buffer(table(spark, sf_dir, "events").select("event_id", "user_id"), "event_id", 256)


def tumbling_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.tumbling_counts(table(spark, sf_dir, "events")).withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss"))


def sliding_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.sliding_counts(table(spark, sf_dir, "events")).withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss"))


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.sessions(table(spark, sf_dir, "events")).withColumn("session_start", F.date_format("session_start", "yyyy-MM-dd HH:mm:ss"))


def schedules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Curriculum shares and temperature over 20 epochs."""
    e = F.col("id")
    shares = [F.round(mining.curriculum_ratio(e, 20, k), 6).alias(k) for k in ("linear", "sqrt", "step", "all")]
    return spark.range(20).select(e.alias("epoch"), *shares, F.round(mining.temperature(e, 20), 6).alias("temperature"))


def learning_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    total = mining.effective_steps(100, 8, 4)
    return spark.range(total).select(F.col("id").alias("step"), F.round(mining.learning_rate(F.col("id"), total) * 1e6, 6).alias("lr_millionths"))


def adapter_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mining.adapter_targets(spark, 28, 14, ("q_proj", "k_proj", "v_proj", "o_proj", "gate_proj", "up_proj", "down_proj"))


def model_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.range(1, 31).select(F.col("id").alias("billions"), F.explode(F.array(*map(F.lit, ("4bit", "8bit", "bf16")))).alias("quant"))
    return rows.withColumn("memory_gb", text.model_memory_gb(F.col("billions"), F.col("quant")))


def durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", text.duration(F.col("event_id") * 3.7).alias("d"))
    return e.select("event_id", "d.hours", "d.minutes", "d.seconds")


def pooling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as eight tokens of eight values, the tail masked."""
    v = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.slice("embedding", i * 8 + 1, 8))
    mask = F.transform(F.sequence(F.lit(1), F.lit(8)), lambda i: (i <= 3 + F.col("label") % 5).cast("int"))
    e = table(spark, sf_dir, "embeddings").select("vec_id", v.alias("h"), mask.alias("m"))
    return e.select("vec_id", *[F.round(F.element_at(pool(F.col("h"), F.col("m"), s), 1).cast("double"), 6).alias(s) for s in ("last", "end", "mean", "weighted")])


def hashed_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "benchmark").select("item_id", hashed_embedding(F.col("text"), 16).alias("v"))
    return b.select("item_id", F.round(norm(F.col("v")), 6).alias("norm"), F.size(F.filter("v", lambda x: x > 0)).alias("n_filled"))


def simhash_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", parsing.simhash64(F.col("text")).alias("h"))
    return d.select("doc_id", text.unsigned(F.col("h")).cast("string").alias("simhash"))


def objdump_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listings made from benchmark items: a header for each sentence, its words as lines."""
    body = F.transform(F.split("text", r"\. "), lambda s, i: F.concat(F.format_string("%016x", i), F.lit(" <f"), i.cast("string"), F.lit(">:\n"), F.replace(s, F.lit(" "), F.lit("\n")), F.lit("\n\n")))
    listing = F.concat(F.lit("Disassembly of section .text:\n"), F.array_join(body, ""))
    b = table(spark, sf_dir, "benchmark").select("item_id", F.explode(parsing.listing_functions(listing)).alias("f"))
    return b.select("item_id", "f.function_id", "f.name", "f.start_addr", F.md5("f.body").alias("body_md5"))


def c_function_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C sources made from benchmark items: each word of letters becomes a function."""
    words = F.filter(F.split(F.regexp_replace("text", "[^a-zA-Z ]", ""), " "), lambda w: w != "")
    source = F.array_join(F.transform(words, lambda w, i: F.concat(F.lit("/* { */\nstatic int f_"), w, F.lit("(int a)\n{\n  if (a) { return "), i.cast("string"), F.lit("; }\n  return '}';\n}\n"))), "\n")
    b = table(spark, sf_dir, "benchmark").select("item_id", F.explode(parsing.source_functions(source)).alias("f"))
    return b.select("item_id", "f.function_id", "f.name", F.md5("f.body").alias("body_md5"))


def demangle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names made of a namespace, a function and an int argument, mangled and read back."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    mangled = F.concat(F.lit("_ZN"), F.length("source").cast("string"), "source", F.length("lang").cast("string"), "lang", F.lit("Ei"))
    return d.select("doc_id", parsing.demangled(mangled).alias("demangled"), parsing.readable_name(F.col("source")).alias("kept"))


def source_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as parsed source files, flattened to keyed rows."""
    body = F.transform(F.split("text", "\n\n"), lambda s, i: F.struct(i.alias("function_id"), F.concat(F.lit("f"), i.cast("string")).alias("function_name"), F.lit("").alias("signature"), s.alias("body")))
    d = table(spark, sf_dir, "documents").select(F.concat(F.lit("/src/"), "source", F.lit("/"), "lang", F.lit("/d"), F.col("doc_id").cast("string"), F.lit(".x.c")).alias("path"), body.alias("functions"))
    return files.source_rows(d, text.last_part(F.col("path"), 3)).select("key", F.array_join("key_words", ",").alias("key_words"), "signature", "function_name")


QUERIES = {
    f.__name__: f
    for f in (
        dedup_keep_first, distinct_stats, merge_first_match, merge_first_match_many, common_keys, interleave_groups, interleaved_order, largest_group, split_preserve_order,
        split_by_group, split_stats, verify_split, negative_pairs, labelled_pairs, matching_pairs_ratio, seeded_shuffle, mini_batches, macro_mean, union_missing, locate_slice,
        confusion_report, llm_parse, llm_rank_mrr, judge_answers, best_epoch, compose_key, path_parts, opt_level, mangled_flag, path_keywords, path_exclusion, output_names,
        short_body_filter, prompt_format, rag_context, rag_answers, json_field_flatten, function_numbers, ring_buffer_events, tumbling_counts, sliding_counts, sessions, schedules,
        learning_rates, adapter_targets, model_memory, durations, pooling, hashed_embeddings, simhash_documents, objdump_parse, c_function_scan, demangle, source_rows,
    )
}

_HASH = "('0x' || substr(md5('42|' || {id} || '|' || {t}), 1, 8))::BIGINT"
_NEGATIVES = f"""
WITH o AS (SELECT doc_id AS id, source AS k, row_number() OVER (ORDER BY doc_id) - 1 AS ord, count(*) OVER () AS n FROM documents),
t AS (SELECT id, k, a AS attempt, (ord + {_HASH.format(id='id', t='a')} % (n - 1) + 1) % n AS j FROM o, (SELECT unnest(range(3)) AS a) WHERE n > 1),
m AS (SELECT t.id, t.attempt, o.id AS partner FROM t JOIN o ON o.ord = t.j WHERE t.k IS DISTINCT FROM o.k),
tried AS (SELECT id, partner, attempt FROM m QUALIFY row_number() OVER (PARTITION BY id ORDER BY attempt) = 1),
keyed AS (SELECT id, k, n, row_number() OVER (ORDER BY k NULLS FIRST, id) - 1 AS pos FROM o),
bounds AS (SELECT k AS kb, min(pos) AS lo, count(*) AS own FROM keyed GROUP BY k),
lost AS (SELECT id, lo, own, (pos - lo + {_HASH.format(id='id', t='3')}) % (n - own) AS place FROM keyed JOIN bounds ON k IS NOT DISTINCT FROM kb WHERE own < n AND id NOT IN (SELECT id FROM tried)),
neg AS (SELECT id, partner, attempt FROM tried UNION ALL SELECT lost.id, keyed.id, 3 FROM lost JOIN keyed ON keyed.pos = place + CASE WHEN place >= lo THEN own ELSE 0 END)
"""
_GROUPS = """
WITH k AS (SELECT DISTINCT o_custkey AS g FROM orders WHERE o_custkey IS NOT NULL),
r AS (SELECT g, row_number() OVER (ORDER BY md5('42|' || g), g) - 1 AS nth, count(*) OVER () AS n FROM k),
s AS (SELECT g, CASE WHEN nth < ceil(n * 0.2::DOUBLE) THEN 'test' WHEN nth < ceil(n * 0.2::DOUBLE) + ceil((n - ceil(n * 0.2::DOUBLE)) * 0.125::DOUBLE) THEN 'eval' ELSE 'train' END AS split FROM r)
"""
_URL = "regexp_replace(url, '[?#].*$', '')"
_WORDS = "list_filter(regexp_split_to_array(lower(text), '\\W+'), lambda w: w <> '')"
# the sum of all bits that more than half of the shingles set
_SIMHASH_BITS = " + ".join(f"CASE WHEN 2 * sum(n * (h >> {k} & 1)) > sum(n) THEN {1 << k}::HUGEINT ELSE 0 END" for k in range(64))
#: fingerprints: doc_id, simhash (null for a null text)
SIMHASH_CTE = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_replace(lower(text), '[^\\p{{L}}\\p{{N}}_]', '', 'g') AS c FROM documents),
g AS (SELECT r, substr(c, i, 4) AS gram FROM d, unnest(range(1, greatest(length(c) - 3, 1) + 1)) AS t(i)), n AS (SELECT r, gram, count(*) AS n FROM g GROUP BY r, gram),
h AS (SELECT r, n, ('0x' || right(md5(gram), 16))::UBIGINT AS h FROM n),
s AS (SELECT r, ({_SIMHASH_BITS})::UBIGINT AS simhash FROM h GROUP BY r),
fingerprints AS (SELECT doc_id, CASE WHEN c IS NOT NULL THEN simhash END AS simhash FROM d LEFT JOIN s USING (r))
"""

ORACLE_SQL = {
    "dedup_keep_first": "SELECT doc_id, lang, source FROM documents QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1",
    "distinct_stats": "SELECT count(*) AS n_rows, count(DISTINCT text) + max((text IS NULL)::INT) AS n_distinct FROM documents",
    "merge_first_match": """SELECT l_orderkey AS key, l_linenumber, l_quantity, o_custkey, o_totalprice FROM lineitem JOIN
 (SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_orderkey ORDER BY o_totalprice) = 1) ON o_orderkey = l_orderkey""",
    "merge_first_match_many": """SELECT p_partkey AS key, p_name, ord, l_suppkey FROM part JOIN (SELECT l_partkey, l_orderkey * 8 + l_linenumber AS ord, l_suppkey FROM lineitem
 QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey * 8 + l_linenumber) = 1) ON l_partkey = p_partkey""",
    "common_keys": "SELECT p_partkey AS key FROM part INTERSECT SELECT l_partkey FROM lineitem",
    "interleave_groups": """SELECT doc_id, source, (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1)::INT AS new_group_id, dense_rank() OVER (ORDER BY source) - 1 AS original_group_rank,
 md5('42|' || doc_id) AS shuffle_key FROM documents WHERE source IS NOT NULL""",
    "interleaved_order": """WITH g AS (SELECT o_orderkey, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1)::INT AS new_group_id FROM orders WHERE o_custkey IS NOT NULL)
SELECT o_orderkey, new_group_id, row_number() OVER (ORDER BY new_group_id, md5('42|' || o_orderkey), o_orderkey) - 1 AS position FROM g""",
    "largest_group": "SELECT max(c) AS max_group_size, count(*) AS n_groups FROM (SELECT count(*) AS c FROM orders WHERE o_custkey IS NOT NULL GROUP BY o_custkey)",
    "split_preserve_order": """WITH o AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS ordinal, count(*) OVER () AS n FROM documents)
SELECT doc_id, ordinal, CASE WHEN ordinal < floor(n * 0.7::DOUBLE) THEN 'train' WHEN ordinal < floor(n * 0.7::DOUBLE) + floor(n * 0.2::DOUBLE) THEN 'eval' ELSE 'test' END AS split FROM o""",
    "split_by_group": _GROUPS + "SELECT o_orderkey, split FROM orders JOIN s ON g = o_custkey",
    "split_stats": _GROUPS + "SELECT split, count(*) AS n_rows, count(DISTINCT o_custkey) AS n_groups FROM orders JOIN s ON g = o_custkey GROUP BY split",
    "verify_split": """WITH o AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS ordinal, count(*) OVER () AS n FROM documents),
s AS (SELECT *, CASE WHEN ordinal < floor(n * 0.7::DOUBLE) THEN 'train' WHEN ordinal < floor(n * 0.7::DOUBLE) + floor(n * 0.2::DOUBLE) THEN 'eval' ELSE 'test' END AS split FROM o),
e AS (SELECT max(ordinal) - min(ordinal) + 1 = count(*) AS whole FROM s GROUP BY split)
SELECT (SELECT count(*) FROM documents) AS n_before, (SELECT count(*) FROM s) AS n_after, (SELECT bool_and(whole) FROM e) AS contiguous,
 (SELECT count(*) FROM documents d ANTI JOIN s ON s.doc_id = d.doc_id) AS n_lost, (SELECT count(*) FROM s ANTI JOIN documents d ON s.doc_id = d.doc_id) AS n_made""",
    "negative_pairs": _NEGATIVES + "SELECT id, partner, attempt::INT AS attempt FROM neg",
    "labelled_pairs": _NEGATIVES + """, p AS (SELECT doc_id AS id, 1 AS label, 0 AS way, doc_id::VARCHAR AS src FROM documents
 UNION ALL SELECT id, 0, 1, partner::VARCHAR FROM neg UNION ALL SELECT id, 0, 2, id::VARCHAR FROM neg)
SELECT label, way, count(*) AS n, count(DISTINCT id) AS n_ids, count(DISTINCT src) AS n_src FROM p GROUP BY label, way""",
    "matching_pairs_ratio": _NEGATIVES + """SELECT doc_id AS id, 'positive' AS kind, doc_id AS asm_id, doc_id AS src_id, 1 AS label FROM documents
UNION ALL SELECT id, 'negative', id, partner, 0 FROM neg UNION ALL SELECT id, 'swapped', partner, id, 0 FROM neg""",
    "seeded_shuffle": "SELECT o_orderkey, row_number() OVER (ORDER BY md5('42|' || o_orderkey), o_orderkey) - 1 AS position FROM orders",
    "mini_batches": "SELECT batch_id, count(*) AS n, round(avg(o_totalprice), 4) AS mean_price FROM (SELECT (row_number() OVER (ORDER BY o_orderkey) - 1) // 32 AS batch_id, o_totalprice FROM orders) GROUP BY batch_id",
    "macro_mean": """SELECT round(avg(m), 6) AS macro_mean, count(*) AS n_batches FROM (SELECT avg(o_totalprice / 1000) AS m FROM
 (SELECT (row_number() OVER (ORDER BY o_orderkey) - 1) // 64 AS b, o_totalprice FROM orders) GROUP BY b)""",
    "union_missing": "SELECT doc_id, quality AS label, CASE WHEN quality = 1 THEN 'O0' END AS opti FROM labels WHERE quality IN (0, 1)",
    "locate_slice": """WITH c AS (SELECT conv_id, count(*) AS n FROM conversations GROUP BY 1), s AS (SELECT conv_id, n, sum(n) OVER (ORDER BY conv_id) - n AS lo FROM c),
w AS (SELECT unnest(range(0, (SELECT count(*) FROM conversations) + 20)) AS idx)
SELECT idx, conv_id AS file, (idx - lo)::BIGINT AS local_idx FROM w JOIN s ON idx >= lo AND idx < lo + n""",
    "confusion_report": """WITH r AS (SELECT quality AS t, CASE WHEN n_chars % 17 = 0 THEN NULL ELSE (n_chars > 1000)::INT END AS p FROM labels JOIN documents USING (doc_id)),
c AS (SELECT count(*) FILTER (t = 1 AND p = 1) AS tp, count(*) FILTER (t = 0 AND p = 1) AS fp, count(*) FILTER (t = 1 AND p = 0) AS fn, count(*) FILTER (t = 0 AND p = 0) AS tn,
 count(*) FILTER (p IS NULL OR t IS NULL OR t NOT IN (0, 1)) AS skipped FROM r),
x AS (SELECT *, tp / (tp + fp + 1e-8::DOUBLE) AS pr, tp / (tp + fn + 1e-8::DOUBLE) AS re FROM c)
SELECT tp, fp, fn, tn, skipped, round((tp + tn) / (tp + fp + fn + tn + 1e-8::DOUBLE), 6) AS accuracy, round(pr, 6) AS precision, round(re, 6) AS recall, round(2 * pr * re / (pr + re + 1e-8::DOUBLE), 6) AS f1 FROM x""",
    "llm_parse": """WITH a AS (SELECT conv_id, turn, CASE WHEN turn % 4 = 3 THEN 'yes' || chr(10) || text ELSE ' ' || (conv_id * 7 % 3) || ' ' || chr(10) || text END AS answer FROM conversations)
SELECT conv_id, turn, TRY_CAST(trim(split_part(answer, chr(10), 1)) AS INT) AS label FROM a""",
    "llm_rank_mrr": """WITH r AS (SELECT conv_id // 8 AS batch, CASE WHEN conv_id % 5 = 0 THEN CASE turn WHEN 7 THEN 1.0 WHEN 8 THEN 0.5 END
 WHEN conv_id % 2 = 0 THEN 1.0 WHEN turn = 9 THEN 0.5 ELSE 0.5 END AS rr FROM conversations), b AS (SELECT batch, coalesce(avg(rr), 0) AS m, avg(coalesce(rr, 0)) AS a FROM r GROUP BY batch)
SELECT round(avg(m), 6) AS mrr, round(avg(a), 6) AS mrr_all, count(*) AS n_batches FROM b""",
    "judge_answers": """WITH a AS (SELECT event_id, CASE event_id % 3 WHEN 0 THEN '{"score": ' || event_id % 6 || ', "reason": "r", "is_grounded": true}' WHEN 1 THEN '{}' ELSE '{"function_code": "f()"}' END::JSON AS j FROM events)
SELECT event_id, coalesce(j->>'$.function_code', '') AS function_code, coalesce((j->>'$.score')::INT, 0) AS score, coalesce(j->>'$.reason', '') AS reason,
 coalesce((j->>'$.is_grounded')::BOOL, false) AS is_grounded, coalesce(json_array_length(j, '$.citations'), 0)::INT AS n_citations FROM a""",
    "best_epoch": "SELECT p_partkey AS best_epoch, m AS best_metric FROM (SELECT p_partkey, trunc(p_retailprice)::INT % 97 AS m FROM part) ORDER BY m DESC, p_partkey LIMIT 1",
    "compose_key": "SELECT doc_id, source || '$' || lang || '$' || doc_id AS key, doc_id::VARCHAR AS func_name FROM documents",
    "path_parts": f"""WITH p AS (SELECT page_id, {_URL} AS path, string_split({_URL}, '/') AS parts FROM pages)
SELECT page_id, split_part(parts[-1], '.', 1) AS stem, regexp_extract(parts[-1], '^.+(\\.[^.]*)$', 1) AS ext,
 CASE WHEN lower(regexp_extract(parts[-1], '^.+(\\.[^.]*)$', 1)) IN ('.c', '.h') THEN 'c' ELSE 'cpp' END AS lang,
 CASE WHEN regexp_matches(path, '-(O[\\dsfastgz]+)') THEN parts[-3] ELSE parts[-2] END AS project, parts[-3] AS third FROM p""",
    "opt_level": """WITH l AS (SELECT page_id, 'out/x-Os/' || (['-O0', '-O1', '-O2', '-O3', '-Ofast', '-Os', 'src'])[page_id % 7 + 1] || '/' || page_id || '.a.csv' AS path FROM pages)
SELECT page_id, coalesce(nullif(regexp_extract(path, '/-(O(fast|[0-3sgz]))/', 1), ''), 'O0') AS level, coalesce(nullif(regexp_extract(path, '-(O(fast|[0-3sgz]))', 1), ''), 'O0') AS level_anywhere,
 string_split(path, '/')[CASE WHEN regexp_matches(path, '-O(fast|[0-3sgz])') THEN -3 ELSE -2 END] AS project, split_part(string_split(path, '/')[-1], '.', 1) AS stem FROM l""",
    "mangled_flag": """SELECT doc_id, regexp_matches((['_Z', '__Z', '?', '_z', 'a_Z', ''])[doc_id % 6 + 1] || source, '^(_Z|__Z|\\?)') AS mangled FROM documents""",
    "path_keywords": f"SELECT page_id, array_to_string(list_sort(list_distinct(string_split({_URL}, '/')[4:])), ',') AS key_words FROM pages",
    "path_exclusion": f"""WITH p AS (SELECT page_id, (['src/', 'test/', 'src/.git/', 'testing/', 'a/examples/b/', 'build/'])[page_id % 6 + 1] AS d, (['x.c', 'test_x.c', 'y.HPP', 'z.txt', 'main.cc'])[page_id % 5 + 1] AS f FROM pages)
SELECT page_id, NOT list_has_any(string_split(d, '/'), {list(text.EXCLUDED_DIRS)}) AS inside, NOT starts_with(f, 'test_') AND list_contains({list(text.SOURCE_EXTENSIONS)}, lower(regexp_extract(f, '^.+(\\.[^.]*)$', 1))) AS is_source FROM p""",
    "output_names": """SELECT doc_id, 'out/' || source || '/' || lang || '/f' || doc_id || '.oo.json' AS out, source || '/' || lang || '/f' || doc_id || '.oo.csv' AS csv,
 source || '_' || lang || '_f' || doc_id || '.oo.o.json' AS json, 'arm/' || source || '/' || lang || '/f' || doc_id || '.oo.s' AS asm FROM documents""",
    "short_body_filter": """SELECT doc_id, doc_id % 10 <> 0 AND len(string_split(text, chr(10))) >= 5 AS kept, length(text) >= 200 AS long_enough, len(string_split(replace(text, ' ', '|'), '|')) >= 100 AS enough FROM documents""",
    "prompt_format": """WITH t AS (SELECT *, 'Analyze the following ' AS a, ' code and understand its semantic meaning:' || chr(10) || '```' AS b, chr(10) || '```' || chr(10) || 'Semantic representation:' AS z FROM benchmark)
SELECT item_id, md5(a || 'assembly' || b || 'asm' || chr(10) || text || z) AS asm_md5, md5(a || 'source' || b || 'c' || chr(10) || text || z) AS c_md5, replace(substr(text, 1, 50), chr(10), ' ') AS preview,
 md5(item_id || chr(10) || text) AS named_md5 FROM t""",
    "rag_context": """SELECT conv_id, md5(string_agg('[SOURCE:' || CASE WHEN turn % 2 = 0 THEN conv_id || '-' || turn ELSE 'doc_' || nth END || ']' || chr(10) || text, chr(10) || chr(10) ORDER BY turn)) AS context_md5, count(*)::INT AS n_docs
FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS nth FROM conversations WHERE turn < 5) GROUP BY conv_id""",
    "rag_answers": f"""WITH w AS (SELECT item_id AS id, text, {_WORDS} AS ws FROM benchmark),
v AS (SELECT id, text, list_transform(range(32), lambda b: len(list_filter(ws, lambda w: ('0x' || substr(md5(w), 1, 8))::BIGINT % 32 = b))::DOUBLE) AS v FROM w),
s AS (SELECT q.id AS q, k.id, k.text, round(list_cosine_similarity(q.v, k.v), 6) AS sim FROM v q, v k),
r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY sim DESC, id) AS rank FROM s QUALIFY rank <= 5),
c AS (SELECT q, string_agg('[SOURCE:' || id || ']' || chr(10) || text, chr(10) || chr(10) ORDER BY rank) AS context, string_agg(id || ':source ' || rank, ',' ORDER BY rank) AS cited,
  count(*) AS n, string_split(max(CASE WHEN rank = 1 THEN text END), chr(10))[1] AS line FROM r GROUP BY q),
j AS (SELECT *, len(list_filter(regexp_split_to_array(line, '\\s+'), lambda w: w <> '')) AS own, len(list_filter(regexp_split_to_array(context || chr(10) || chr(10) || line, '\\s+'), lambda w: w <> '')) AS whole FROM c)
SELECT q AS question_id, line AS function_code, 'first of ' || n || ' sources' AS explanation, CASE WHEN line <> '' THEN least(5, 1 + floor(20 * own / whole))::INT ELSE 0 END AS judge_score,
 own || ' words' AS judge_reason, line <> '' AS judge_is_grounded, cited, md5(context) AS context_md5 FROM j""",
    "json_field_flatten": "SELECT event_id, (props->>'$.k')::INT AS k FROM events",
    "function_numbers": "SELECT item_id, i::INT AS function_id, length(parts[i])::INT AS n_chars FROM (SELECT item_id, string_split(text, '. ') AS parts FROM benchmark), unnest(range(1, len(parts) + 1)) AS t(i)",
    "ring_buffer_events": "SELECT * FROM (SELECT event_id, user_id, row_number() OVER (ORDER BY event_id) - 1 AS position, (row_number() OVER (ORDER BY event_id) - 1) % 256 AS slot FROM events) QUALIFY row_number() OVER (ORDER BY position DESC) <= 256",
    "tumbling_counts": "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS window_start, event_type, count(*) AS n_events, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
    "sliding_counts": """SELECT strftime(w, '%Y-%m-%d %H:%M:%S') AS window_start, count(*) AS n_events FROM (
 SELECT time_bucket(INTERVAL 30 MINUTE, ts) - s * INTERVAL 30 MINUTE AS w FROM events, (SELECT unnest([0, 1]) AS s)) GROUP BY 1""",
    "sessions": """WITH g AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts >= lag(ts) OVER w + INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS session_start, count(*) AS n_events FROM s GROUP BY user_id, s""",
    "schedules": """SELECT e AS epoch, round((e + 1) / 20.0::DOUBLE, 6) AS linear, round(sqrt((e + 1) / 20.0::DOUBLE), 6) AS sqrt, least(1.0, (e // 3 + 1) * 0.25)::DOUBLE AS step, 1.0::DOUBLE AS "all",
 round(greatest(0.02, 0.05 * (1 - e / 20.0::DOUBLE)), 6) AS temperature FROM (SELECT unnest(range(20)) AS e)""",
    "learning_rates": """SELECT s AS step, round(CASE WHEN s < 20 THEN 20.0::DOUBLE * s / 20 ELSE greatest(0, 10.0::DOUBLE * (1 + cos(pi() * (s - 20) / 180))) END, 6) AS lr_millionths FROM (SELECT unnest(range(200)) AS s)""",
    "adapter_targets": """SELECT layer, module, 'model.layers.' || layer || '.' || CASE WHEN module IN ('gate_proj', 'up_proj', 'down_proj') THEN 'mlp' ELSE 'self_attn' END || '.' || module AS name
 FROM (SELECT unnest(range(14, 28)) AS layer), (SELECT unnest(['q_proj', 'k_proj', 'v_proj', 'o_proj', 'gate_proj', 'up_proj', 'down_proj']) AS module)""",
    "model_memory": "SELECT b AS billions, q AS quant, b * CASE q WHEN '4bit' THEN 0.5 WHEN '8bit' THEN 1.0 ELSE 2.0 END::DOUBLE + 2 AS memory_gb FROM (SELECT unnest(range(1, 31)) AS b), (SELECT unnest(['4bit', '8bit', 'bf16']) AS q)",
    "durations": "SELECT event_id, (s // 3600) AS hours, (s % 3600 // 60) AS minutes, s % 60 AS seconds FROM (SELECT event_id, floor(event_id * 3.7::DOUBLE)::BIGINT AS s FROM events)",
    "pooling": """WITH e AS (SELECT vec_id, 3 + label % 5 AS k, embedding::DOUBLE[] AS v FROM embeddings)
SELECT vec_id, round(v[(k - 1) * 8 + 1], 6) AS last, round(v[57], 6) AS "end", round(list_sum(list_transform(range(0, k), lambda i: v[i * 8 + 1])) / k, 6) AS mean,
 round(list_sum(list_transform(range(0, k), lambda i: v[i * 8 + 1] * (i + 1))) / (k * (k + 1) / 2), 6) AS weighted FROM e""",
    "hashed_embeddings": f"""SELECT item_id, 1.0::DOUBLE AS norm, len(list_distinct(list_transform({_WORDS}, lambda w: ('0x' || substr(md5(w), 1, 8))::BIGINT % 16)))::INT AS n_filled FROM benchmark""",
    "simhash_documents": SIMHASH_CTE + "SELECT doc_id, simhash::VARCHAR AS simhash FROM fingerprints",
    "objdump_parse": """WITH p AS (SELECT item_id, string_split(text, '. ') AS parts FROM benchmark)
SELECT item_id, i::INT AS function_id, 'f' || (i - 1) AS name, printf('%016x', i - 1) AS start_addr, md5(rtrim(replace(parts[i], ' ', chr(10)), ' ' || chr(10))) AS body_md5 FROM p, unnest(range(1, len(parts) + 1)) AS t(i)""",
    "c_function_scan": """WITH p AS (SELECT item_id, list_filter(string_split(regexp_replace(text, '[^a-zA-Z ]', '', 'g'), ' '), lambda w: w <> '') AS ws FROM benchmark)
SELECT item_id, i::INT AS function_id, 'f_' || ws[i] AS name, md5('if (a) { return ' || (i - 1) || '; }' || chr(10) || '  return ''}'';') AS body_md5 FROM p, unnest(range(1, len(ws) + 1)) AS t(i)""",
    "demangle": "SELECT doc_id, source || '::' || lang || '(int)' AS demangled, source AS kept FROM documents",
    "source_rows": """WITH p AS (SELECT doc_id, source, lang, string_split(text, chr(10) || chr(10)) AS parts FROM documents)
SELECT source || '$d' || doc_id || '$f' || (i - 1) AS key, array_to_string(list_sort([lang, 'd' || doc_id || '.x.c']), ',') AS key_words, 'd' || doc_id || '$f' || (i - 1) AS signature, 'f' || (i - 1) AS function_name
FROM p, unnest(range(1, len(parts) + 1)) AS t(i) WHERE len(string_split(parts[i], chr(10))) >= 5""",
}
