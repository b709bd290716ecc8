from __future__ import annotations

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairloom.llm import language_id

WORDS = {"xx": "foo bar baz qux quux", "yy": "alpha beta gamma delta omega", "zz": "éin zwöi dröi viër fünf"}


def rows(n=40):
    rng = np.random.default_rng(2)
    return [(i * 3 + k, " ".join(rng.choice(w.split(), rng.integers(3, 30))), lang) for i in range(n) for k, (lang, w) in enumerate(WORDS.items())]


@pytest.mark.parametrize("n", [2, 3, 7, 8, 30])
def test_codewords(n):
    code = language_id.codewords(n)
    assert set(np.unique(code)) == {-1, 1} and (np.abs(code.sum(0)) < n).all()
    d = [(code[i] != code[j]).sum() for i in range(n) for j in range(i)]
    assert min(d) >= (1 if n == 2 else 2)


def test_learns_and_flags(spark):
    df = spark.createDataFrame(rows(), "doc_id long, text string, lang string")
    model = language_id.learn(df)
    other = [(1, "foo qux bar"), (2, "delta beta"), (3, "fünf éin"), (4, None), (5, ""), (6, "12 34 !"), (1, "foo qux bar"), (None, "omega alpha " * 20_000)]
    got = language_id.predict(spark.createDataFrame(other, "doc_id long, text string"), model).collect()
    by = {(r.doc_id, r.lang_pred) for r in got}
    assert by == {(1, "xx"), (2, "yy"), (3, "zz"), (4, "und"), (5, "und"), (6, "und"), (None, "yy")} and len(got) == 8
    assert all(0 <= r.score <= 1 for r in got) and all(r.score == 0 for r in got if r.lang_pred == "und")


def test_ambiguity_follows_the_margin(spark):
    model = language_id.learn(spark.createDataFrame(rows(), "doc_id long, text string, lang string"))
    df = spark.createDataFrame([(1, "foo bar alpha beta éin fünf"), (2, "foo bar baz qux quux")], "doc_id long, text string")
    got = {r.doc_id: r for r in language_id.predict(df, model, close=0.5).collect()}
    assert got[1].margin < got[2].margin and not got[2].ambiguous


def test_nothing_or_one_language_to_learn(spark):
    df = spark.createDataFrame([(1, None, "xx"), (2, "abc", None)], "doc_id long, text string, lang string")
    assert language_id.learn(df) is None
    assert {r.lang_pred for r in language_id.predict(df, None).collect()} == {"und"}
    one = spark.createDataFrame([(i, "foo bar", "xx") for i in range(20)], "doc_id long, text string, lang string")
    got = language_id.predict(one, language_id.learn(one)).collect()
    assert {r.lang_pred for r in got} == {"xx"} and not any(r.ambiguous for r in got)
    assert language_id.predict(one.where("doc_id < 0"), None).count() == 0


def test_held_out_rule(spark):
    df = spark.range(50).union(spark.sql("SELECT CAST(NULL AS LONG)"))
    for r in df.select("id", language_id.held_out(F.col("id")).alias("h")).collect():
        assert r.h == (r.id is not None and zlib.crc32(str(r.id).encode()) % 4 == 2)


def test_keep_identified(spark):
    df = spark.createDataFrame([(*r, 1, 2) for r in rows()], "doc_id long, text string, lang string, row int, id int")
    more = df.union(spark.createDataFrame([(900, "...", "xx", 1, 2), (901, None, None, None, None)], df.schema))
    got = language_id.keep_identified(more, language_id.learn(df))
    assert got.columns == df.columns and sorted(r.doc_id for r in got.collect()) == sorted(r[0] for r in rows())


def test_held_out_accuracy(spark):
    got = language_id.op6_language_id(spark, "/root/testdata/sf0.01").where("held_out")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    assert got.join(docs, "doc_id").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0] > 0.98


def test_a_language_of_long_texts_only_is_learned(spark):
    long = "der und das nicht ist ein schoen " * 400
    rows = [(i, "the and of that is not a fine one " * 4, "en") for i in range(40)] + [(100 + i, f"{i} " + long, "de") for i in range(40)]
    model = language_id.train(spark.createDataFrame(rows, "id long, text string, lang string"))
    assert model.langs == ("de", "en")


def test_grams_are_counted_once_at_chunk_borders():
    text = "ab" * (1 << 20)
    raw = b" " + text.encode() + b" "
    expected = np.zeros(language_id.BUCKETS)
    for size, code in ((1, lambda g: g[0]), (2, lambda g: g[0] * 257 + g[1] + (1 << 17)), (3, lambda g: (g[0] * 65599 + g[1]) * 65599 + g[2])):
        seen = {}
        for i in range(len(raw) - size + 1):
            g = raw[i : i + size]
            seen[g] = seen.get(g, 0) + 1
        for g, n in seen.items():
            if size == 1 and g == b" " or size > 1 and g[:2] == b"  ":
                continue
            factor = 2246822519 if size == 3 else 2654435769
            expected[((code(g) * factor) & 0xFFFFFFFF) >> 20] += n
    assert np.allclose(language_id.ngram_counts(text), np.sqrt(expected / expected.sum()))
