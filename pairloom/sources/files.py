"""Readers and sinks: CSV, JSON documents, sources, listings."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions import parsing, text
from ..operators.scan import running_total
from .vector_store import VectorStore

__all__ = [
    "VectorStore", "assembly_rows", "explode_functions", "function_counts", "functions_of_lines", "listing_rows", "not_done", "read_csv", "read_documents", "read_files", "read_lines", "read_listings",
    "read_project_documents", "source_documents", "source_rows", "write_csv", "write_documents",
]


def read_csv(spark: SparkSession, path: str, schema: str, comment: str | None = None, inline: bool = False) -> DataFrame:
    """Header, multi-line quoted fields; lines that begin with ``comment`` are left out.

    With ``inline`` a comment also ends a line within a field, unless it stands in quotes, as
    data frame libraries read it: what is left of the line is its fields, missing ones are
    null. Such files are read whole, a row a file, so they have to fit into one.
    """
    options = {"header": "true", "multiLine": "true", "quote": '"', "escape": '"', "recursiveFileLookup": "true"}
    if comment and inline:
        mark = re.escape(comment)
        content = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True).select(F.regexp_replace("value", "\r\n?", "\n").alias("text"))
        bare = F.regexp_replace("text", f'("(?:[^"]|"")*+")|{mark}[^\n]*', "$1")
        records = F.filter(F.regexp_extract_all(bare, F.lit('((?:[^"\n]|"(?:[^"]|"")*+")++)'), F.lit(1)), lambda r: F.trim(r) != "")
        rows = content.select(F.explode(F.slice(records, F.lit(2), F.greatest(F.size(records) - 1, F.lit(0)))).alias("r"))
        return rows.select(F.from_csv("r", schema, {"quote": '"', "escape": '"', "multiLine": "true"}).alias("c")).select("c.*")
    if comment:
        options["comment"] = comment
    return spark.read.options(**options).schema(schema).csv(path)


def write_csv(df: DataFrame, path: str, append: bool = False) -> None:
    df.write.mode("append" if append else "overwrite").options(header="true", quote='"', escape='"').csv(path)


def read_documents(spark: SparkSession, path: str, schema: str = schemas.SRC_DOC, glob: str = "*.json") -> DataFrame:
    """One row per JSON document, with its path."""
    df = spark.read.options(multiLine="true", recursiveFileLookup="true", pathGlobFilter=glob).schema(schema).json(path)
    return df.withColumn("path", F.col("_metadata.file_path"))


def write_documents(df: DataFrame, path: str) -> None:
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).write.mode("overwrite").text(path)


def _decoded(content: Column, errors: str) -> Column:
    """UTF-8 to text. Bytes that are none: ``strict`` fails, ``replace`` puts U+FFFD, ``ignore`` leaves them out."""
    if errors == "strict":
        return F.decode(content, "UTF-8")
    replaced = F.make_valid_utf8(content.cast("string"))
    if errors == "replace":
        return replaced
    if errors == "ignore":
        # only texts with such bytes go through Python
        return F.when(F.is_valid_utf8(content.cast("string")), content.cast("string")).otherwise(F.pandas_udf(_lenient, "string")(content))
    raise ValueError(f"unknown treatment of errors {errors!r}")


def read_files(spark: SparkSession, path: str, extensions: tuple[str, ...] = text.SOURCE_EXTENSIONS, recursive: bool = True, errors: str = "replace") -> DataFrame:
    """path, content of the files whose name ends in one of the extensions, in any case."""
    either = lambda e: "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in e)
    glob = "*{" + ",".join(map(either, extensions)) + "}"
    df = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).option("pathGlobFilter", glob).load(path)
    return df.select("path", _decoded(F.col("content"), errors).alias("content"))


def _lenient(contents: pd.Series) -> pd.Series:
    return contents.map(lambda raw: bytes(raw).decode("utf-8", "ignore"), na_action="ignore")


def read_listings(spark: SparkSession, path: str, glob: str = "*.s", errors: str = "replace") -> DataFrame:
    """path, content; ``errors`` says what becomes of bytes that are no UTF-8: strict, replace, ignore."""
    df = spark.read.format("binaryFile").options(recursiveFileLookup="true", pathGlobFilter=glob).load(path)
    return df.select("path", _decoded(F.col("content"), errors).alias("content"))


def source_documents(files: DataFrame, extractor: str = "scanner") -> DataFrame:
    """Source files to documents with their functions."""
    parsed = files.withColumn("f", parsing.source_functions(F.col("content")))
    functions = F.transform("f", lambda x: F.struct(x["function_id"].alias("function_id"), x["name"].alias("function_name"), x["signature"].alias("signature"), x["body"].alias("body")))
    meta = F.struct(
        F.col("path").alias("source_file"), F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss").alias("extraction_timestamp"),
        F.size("f").alias("total_functions"), F.lit(extractor).alias("extractor"),
    )
    return parsed.select(meta.alias("metadata"), functions.alias("functions"))


def explode_functions(docs: DataFrame, name: str = "function_name", body: str = "body") -> DataFrame:
    """path and one row per function that has a name and a body."""
    rows = docs.select("path", F.explode("functions").alias("f"))
    return rows.select("path", "f.*").where((F.coalesce(name, F.lit("")) != "") & (F.coalesce(body, F.lit("")) != ""))


def listing_rows(listings: DataFrame, key: str = "path", content: str = "content") -> DataFrame:
    """key, function_id, name, body, error: a row per function, or one that says why there is none."""
    parsed = listings.select(F.col(key).alias(key), F.col(content).alias("__c"), parsing.listing_functions(F.col(content)).alias("__f"))
    error = F.when(F.col("__c").isNull(), "unreadable").when(F.size("__f") == 0, "no functions found")
    rows = parsed.select(key, error.alias("error"), F.explode_outer("__f").alias("f"))
    return rows.select(key, "f.function_id", "f.name", "f.body", "error")


def read_lines(spark: SparkSession, path: str, glob: str = "*.s") -> DataFrame:
    """path, n, line: a row per line of the listings; n grows with the lines of a file.

    Files are read in splits, so one long listing is many tasks' work. n is the byte at
    which the line's split begins plus the line's place in the task: a task reads no more
    lines than a split has bytes, so n stays below that of the next split.
    """
    lines = spark.read.options(recursiveFileLookup="true", pathGlobFilter=glob).text(path)
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return lines.select(F.col("_metadata.file_path").alias("path"), (F.col("_metadata.file_block_start") + place).alias("n"), F.regexp_replace("value", r"\r$", "").alias("line"))


def functions_of_lines(lines: DataFrame, key: str = "path", position: str = "n", line: str = "line") -> DataFrame:
    """key, function_id, name, start_addr, signature, body: listings of any length, a row per line.

    A line belongs to the function whose first line is the last one before it; the number
    of first lines so far, a running total over blocks of lines, says which. Rows are
    gathered by function, never by listing. Lines before the first function are dropped.
    """
    first = F.col(line).rlike(parsing.LISTING_HEAD)
    rows = running_total(lines.select(key, position, line), key, position, first.cast("int"), "function_id").where("function_id > 0")
    f = rows.groupBy(key, "function_id").agg(F.array_sort(F.collect_list(F.struct(position, F.coalesce(line, F.lit("")).alias("line")))).alias("l"))
    head = F.element_at("l", 1)["line"]
    body = F.array_join(F.transform(F.slice("l", F.lit(2), F.greatest(F.size("l") - 1, F.lit(0))), lambda x: x.line), "\n")
    name = F.regexp_extract(head, parsing.LISTING_HEAD, 2)
    return f.select(key, F.col("function_id").cast("int").alias("function_id"), name.alias("name"), F.regexp_extract(head, parsing.LISTING_HEAD, 1).alias("start_addr"), name.alias("signature"), F.regexp_replace(body, r"\s+$", "").alias("body"))


def read_project_documents(spark: SparkSession, root: str, schema: str = schemas.SRC_DOC) -> DataFrame:
    """JSON documents exactly two levels below the root (project/file.json), with project and path."""
    df = spark.read.option("multiLine", "true").schema(schema).json(f"{root.rstrip('/')}/*/*.json")
    return df.withColumn("path", F.col("_metadata.file_path")).withColumn("project", F.element_at(F.split("path", "/"), -2))


def function_counts(docs: DataFrame) -> DataFrame:
    return docs.select("path", F.coalesce(F.size("functions"), F.lit(0)).alias("n_functions"))


def not_done(inputs: DataFrame, manifest: DataFrame, key: str) -> DataFrame:
    """Inputs that no earlier run has recorded."""
    return inputs.join(manifest.select(key).distinct(), key, "left_anti")


def assembly_rows(raw: DataFrame, path: Column | None = None) -> DataFrame:
    """Raw per-object rows to keyed rows; null and short bodies are left out one by one."""
    p = F.col("_metadata.file_path") if path is None else path
    rows = raw.where(F.col("full_define").isNotNull() & text.enough_instructions(F.col("full_define"))).withColumns({"__p": p, "__n": parsing.readable_name(F.col("function_name"))})
    opti = text.opt_level(F.col("__p"))
    key = text.compose_key(text.project(F.col("__p")), text.file_stem(F.col("__p")), F.col("__n"))
    return rows.select(key.alias("key"), F.concat_ws("$", "__n", opti).alias("signature"), F.col("__n").alias("function_name"), F.col("full_define").alias("assembly_code"), opti.alias("opti_level"))


def source_rows(docs: DataFrame, project: Column) -> DataFrame:
    """Source documents to keyed rows with key words and simhash; main and short bodies are left out."""
    rows = docs.select("path", F.explode("functions").alias("f")).select("path", "f.*")
    rows = rows.where(text.worth_keeping(F.col("function_name"), F.col("body"))).withColumn("__project", project)
    stem = text.file_stem(F.col("path"))
    return rows.select(
        text.compose_key(F.col("__project"), stem, F.col("function_name")).alias("key"), text.path_keywords(F.col("path"), F.col("__project")).alias("key_words"),
        F.concat_ws("$", stem, "function_name").alias("signature"), "function_name", F.col("body").alias("source_code"), text.unsigned(parsing.simhash64(F.col("body"))).alias("hash"),
    )
