from __future__ import annotations

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from pairloom.llm import near_dedup
from pairloom.llm.common import Scratch
from pairloom.llm.decontaminate import item_words


def test_against_brute_force(spark, sf_dir):
    """Each stage against its definition on the stage's own input."""
    tmp = Scratch(spark, "t")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text for r in docs.collect()}
        docs = tmp.save(stage(spark, docs, sf_dir), name)
        if name != "packing":
            assert docs.columns == columns
        kept[name] = (before, {r.doc_id for r in docs.select("doc_id").collect()})

    before, after = kept["language_id"]
    assert after == set(before)
    before, after = kept["exact_dedup"]
    last = {}
    for i, t in before.items():
        low = t.encode().lower()
        last[low] = max(last.get(low, i), i)
    assert after == set(last.values())
    before, after = kept["near_dedup"]
    sets = {i: near_dedup.shingle_set(t, 5) for i, t in before.items()}
    comp = {i: i for i in before}

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i

    ids = sorted(before)
    for i in ids:
        for j in ids:
            if j < i and sets[i] and sets[j]:
                n = len(sets[i] & sets[j])
                if 10 * n >= 8 * (len(sets[i]) + len(sets[j]) - n):
                    a, b = sorted((root(i), root(j)))
                    comp[b] = a
    assert after == {root(i) for i in ids}
    before, after = kept["decontaminate"]
    items = [f" {' '.join(item_words(r.text))} " for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    dirty = {i for i, t in before.items() if any(x in f" {' '.join(item_words(t))} " for x in items)}
    assert not after & dirty and len(set(before) - after) <= len(dirty) + 2
    before, after = kept["packing"]
    assert after == set(before)
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    total = sum(len(t.encode(x, add_special_tokens=False).ids) + 1 for x in before.values())
    assert docs.agg({"length": "sum"}).first()[0] == total


def test_empty_and_odd_documents(spark, tmp_path):
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(1, None, None, None, None), (None, "Some words are here", "en", "s", 5), (2, "Some words are here", "en", "s", 5), (2, "Some words are here", "en", "s", 5), (3, "", "en", "s", 0), (4, "1 2 3", "xx", None, 5)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, extra string"
    for data in ([], [(*r, "x") for r in rows]):
        docs = spark.createDataFrame(data, schema)
        tmp = Scratch(spark, "t")
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            docs = tmp.save(stage(spark, docs, str(tmp_path)), str(k))
        assert docs.select("doc_id").distinct().count() == (1 if data else 0)


def test_run(spark, sf_dir):
    got = corpus_pipeline.run(spark, sf_dir)
    assert got.count() > 0 and [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "near_dedup", "decontaminate", "packing"]
