"""Interfaces to systems outside the engine, with offline stand-ins."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .operators.vectors import hashed_embedding, let


class EmbeddingProvider(Protocol):
    def embed(self, text: Column) -> Column: ...


class LanguageModelProvider(Protocol):
    def answer(self, prompt: Column) -> Column: ...


class DisassemblerProvider(Protocol):
    def functions(self, objects: DataFrame) -> DataFrame: ...


class Retriever(Protocol):
    def __call__(self, questions: DataFrame) -> DataFrame: ...


class HashedEmbedding:
    """Counts of hashed words, unit length."""

    def __init__(self, dim: int = 64):
        self.dim = dim

    def embed(self, text: Column) -> Column:
        return hashed_embedding(text, self.dim)


class FixedAnswers:
    """The same answer to every prompt; null stands for a failed call."""

    def __init__(self, answer: str | None):
        self.text = answer

    def answer(self, prompt: Column) -> Column:
        return F.when(prompt.isNotNull(), F.lit(self.text))


class ExtractiveAnswers:
    """Answers with the first line of the first source in the prompt, and cites every source. No source, no answer."""

    def answer(self, prompt: Column) -> Column:
        return let(prompt, self._answer)

    def _answer(self, prompt: Column) -> Column:
        sources = F.regexp_extract_all(prompt, F.lit(r"(?m)^\[SOURCE:([^\]\n]*)\]$"), F.lit(1))
        line = F.regexp_extract(prompt, r"(?m)^\[SOURCE:[^\]\n]*\]\n([^\n]*)", 1)
        citations = F.transform(sources, lambda x, i: F.struct(x.alias("source_id"), F.concat(F.lit("source "), (i + 1).cast("string")).alias("why")))
        explanation = F.concat(F.lit("first of "), F.size(sources).cast("string"), F.lit(" sources"))
        return F.when(F.size(sources) > 0, F.to_json(F.struct(line.alias("function_code"), explanation.alias("explanation"), citations.alias("citations"))))


class OverlapJudge:
    """Judges the last line of the prompt: grounded if it also stands earlier, with a score of its share of the prompt's words."""

    def answer(self, prompt: Column) -> Column:
        return let(prompt, lambda p: let(F.regexp_extract(p, r"([^\n]*)$", 1), lambda last: self._answer(p, last)))

    def _answer(self, prompt: Column, last: Column) -> Column:
        earlier = F.left(prompt, F.char_length(prompt) - F.char_length(last))
        grounded = (last != "") & (F.instr(earlier, last) > 0)
        words = lambda t: F.size(F.filter(F.split(t, r"\s+"), lambda w: w != ""))
        score = F.when(grounded, F.least(F.lit(5), F.lit(1) + F.floor(F.lit(20) * words(last) / F.greatest(words(prompt), F.lit(1))).cast("int"))).otherwise(0)
        return F.to_json(F.struct(score.alias("score"), F.concat(words(last).cast("string"), F.lit(" words")).alias("reason"), grounded.alias("is_grounded")))


class SymbolTables:
    """Functions of object files by their symbol tables; stands in for a disassembler. ``objects``: path."""

    def __init__(self, timeout: float = 300, code: bool = True):
        self.timeout, self.code = timeout, code

    def functions(self, objects: DataFrame) -> DataFrame:
        from .sources import object_files as of

        timeout, code = self.timeout, self.code

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for path in b.column("path").to_pylist():
                    yield from of.batches_of([(path, None)], timeout, code)

        return objects.where("path IS NOT NULL").select("path").mapInArrow(run, of.SCHEMA)


def generate_and_judge(questions: DataFrame, docs: DataFrame, retriever: Retriever, generator: LanguageModelProvider, judge: LanguageModelProvider, most: int = 5) -> DataFrame:
    """Retrieve once, generate, judge: question_id, context, function_code, explanation, citations, judge fields."""
    from .functions.text import join_docs, judge_fields

    hits = retriever(questions).where(F.col("rank") <= most).join(docs.select(F.col("id").alias("k_id"), "text"), "k_id")
    context = hits.groupBy("q_id").agg(F.array_sort(F.collect_list(F.struct("rank", F.col("k_id").alias("id"), "text"))).alias("d"))
    rows = context.select("q_id", join_docs(F.col("d")).alias("context"))
    rows = rows.withColumn("g", judge_fields(generator.answer(F.col("context"))))
    rows = rows.withColumn("j", judge_fields(judge.answer(F.concat_ws("\n\n", "context", "g.function_code"))))
    return rows.select(
        F.col("q_id").alias("question_id"), "context", "g.function_code", "g.explanation", "g.citations",
        F.col("j.score").alias("judge_score"), F.col("j.reason").alias("judge_reason"), F.col("j.is_grounded").alias("judge_is_grounded"),
    )
