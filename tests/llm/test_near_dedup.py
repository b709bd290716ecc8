from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from oracle import assert_same
from pairloom.llm import near_dedup


def brute(rows, k, num, den):
    sets = [near_dedup.shingle_set(t, k) for _, t in rows]
    comp = list(range(len(rows)))

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j]:
                n = len(sets[i] & sets[j])
                if den * n >= num * (len(sets[i]) + len(sets[j]) - n):
                    comp[root(i)] = root(j)
    out = []
    for i, (d, _) in enumerate(rows):
        if not sets[i]:
            out.append((d, 0, d))
        else:
            out.append((d, len(sets[i]), min((rows[j][0] for j in range(len(rows)) if sets[j] and root(j) == root(i) and rows[j][0] is not None), default=None)))
    return sorted(out, key=str)


def result(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in df.collect()), key=str)


def corpus(seed, groups=6, size=25, words=60):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = []
    for _ in range(groups):
        base = [rng.choice(vocabulary) for _ in range(words)]
        for _ in range(size):
            w = list(base)
            for _ in range(rng.randrange(0, 7)):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            if rng.random() < 0.3:
                w = w[: rng.randrange(len(w) - 8, len(w))]
            rows.append(" ".join(w))
    rows += [rows[0], rows[0].upper(), "one", "one two", "ONE two", "", " \n\t", None]
    return list(enumerate(rows, 10))


@pytest.mark.parametrize(("shingle", "threshold"), [(3, 0.85), (5, 0.8)])
def test_no_link_is_lost(spark, tmp_path, shingle, threshold):
    rows = corpus(shingle)
    df = spark.createDataFrame([(*r, b"x", 1) for r in rows], "doc_id long, text string, set_key binary, n int").repartition(3).sortWithinPartitions("doc_id")
    df.write.mode("overwrite").parquet(path := str(tmp_path / "docs"))
    got = near_dedup.near_duplicates(spark.read.parquet(path), shingle=shingle, threshold=threshold)
    assert result(got) == brute(rows, shingle, round(threshold * 100), 100)


def test_last_step_alone_finds_all(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "ROUNDS", 0)
    monkeypatch.setattr(near_dedup, "TILE", 500)
    rows = corpus(9, groups=3, size=40)
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle=3, threshold=0.85)
    assert result(got) == brute(rows, 3, 85, 100)


def test_table_count_reaches_the_miss_probability():
    for t, rows, miss in ((0.85, 3, 1e-4), (0.8, 3, 1e-4), (0.5, 2, 1e-2)):
        m = near_dedup.tables_for(t, rows, miss)
        assert 1 - (1 - (1 - t**rows) ** m) ** 2 <= miss < 1 - (1 - (1 - t**rows) ** (m - 1)) ** 2


def test_nulls_and_repeated_rows(spark):
    rows = [(None, "a b c d"), (5, "a b c d"), (5, "a b c d"), (None, "z y x"), (None, None), (3, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(near_dedup.near_duplicates(df, shingle=3)) == brute(rows, 3, 80, 100)
    kept = near_dedup.keep_one_each(df.withColumn("row", F.lit("own")), shingle=3)
    assert kept.columns == ["doc_id", "text", "row"] and kept.count() == 4
    empty = df.where("doc_id = 0")
    assert near_dedup.near_duplicates(empty).count() == 0 and near_dedup.keep_one_each(empty).count() == 0


def test_components_of_a_chain(spark):
    from pairloom.llm.common import Scratch

    n = 40
    links = spark.createDataFrame([(i, i + 1) for i in range(n) if i != 20], "a long, b long")
    got = {r.row: r.component for r in near_dedup.components(links, Scratch(spark, "t"), "c").collect()}
    assert all(c == (0 if i <= 20 else 21) for i, c in got.items()) and len(got) == n + 1


def test_hashes_follow_the_sets():
    h = near_dedup.Hasher()
    a, b = (near_dedup.shingle_hashes(h(near_dedup.words_of(t)), 3) for t in ("a b c d", "A b  C d"))
    assert np.array_equal(a, b) and len(a) == 2
    assert len(near_dedup.shingle_hashes(h([]), 3)) == 0
    assert not np.array_equal(near_dedup.shingle_hashes(h([b"a"]), 3), near_dedup.shingle_hashes(h([b"a", b"a"]), 3))


def test_query(spark, sf_dir):
    assert_same(spark, sf_dir, near_dedup.op10_near_dedup, near_dedup.OP10_SQL)


def test_passes_may_see_other_splits(spark, sf_dir, tmp_path, monkeypatch):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").repartition(12)
    docs.write.parquet(path := str(tmp_path / "docs"))
    before = spark.conf.get("spark.sql.leafNodeDefaultParallelism", None)
    save, calls = near_dedup.Scratch.save, []

    def changing(self, df, name):
        calls.append(name)
        out = save(self, df, name)
        spark.conf.set("spark.sql.leafNodeDefaultParallelism", "9")
        spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
        return out

    try:
        expected = result(near_dedup.near_duplicates(spark.read.parquet(path)))
        kept = {r.doc_id for r in near_dedup.keep_one_each(spark.read.parquet(path)).collect()}
        spark.conf.set("spark.sql.leafNodeDefaultParallelism", "2")
        monkeypatch.setattr(near_dedup.Scratch, "save", changing)
        assert result(near_dedup.near_duplicates(spark.read.parquet(path))) == expected and calls
        spark.conf.set("spark.sql.leafNodeDefaultParallelism", "2")
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        assert {r.doc_id for r in near_dedup.keep_one_each(spark.read.parquet(path)).collect()} == kept == {i for i, _, c in expected if i == c}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.set("spark.sql.leafNodeDefaultParallelism", before) if before else spark.conf.unset("spark.sql.leafNodeDefaultParallelism")


def test_clashing_columns_and_repeated_rows_keep_their_values(spark):
    rows = [(5, "a b c d", "x", 1), (5, "a b c d", "x", 1), (6, "a b c d", "y", 2), (7, "q", "z", 3), (8, "", "e", 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, __row string, key int")
    got = near_dedup.keep_one_each(df, shingle=3)
    assert sorted(map(tuple, got.collect())) == [rows[0], rows[3], rows[4]] and got.columns == df.columns


def test_few_outside_a_large_group(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "ROUNDS", 0)
    monkeypatch.setattr(near_dedup, "TILE", 300)
    rng = random.Random(4)
    base = [f"w{rng.randrange(500)}" for _ in range(60)]
    rows = [(i, " ".join(base[:50] + [f"x{i}"] + base[50:])) for i in range(60)]
    rows += [(100 + i, " ".join(base[:52] + [f"y{j}" for j in range(4)] + [f"z{i}"])) for i in range(4)]
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle=3, threshold=0.8)
    assert result(got) == brute(rows, 3, 80, 100)


def test_a_member_meets_one_head_a_round(spark, monkeypatch):
    rng = random.Random(9)
    base = [f"w{i}" for i in range(60)]
    texts = []
    for i in range(80):
        words = list(base)
        for _ in range(rng.randrange(1, 4)):
            words[rng.randrange(60)] = f"x{i}-{rng.random()}"
        texts.append((i, " ".join(words)))
    df = spark.createDataFrame(texts, "doc_id long, text string")
    met, save = {}, near_dedup.Scratch.save

    def watched(self, rows, name):
        out = save(self, rows, name)
        if name.startswith("round-") or name == "open":
            met[name] = [(r.a, r.b) for r in out.select("a", "b").collect()]
        return out

    monkeypatch.setattr(near_dedup.Scratch, "save", watched)
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(df, shingle=2, threshold=0.8).collect()}
    sets = [near_dedup.shingle_set(t, 2) for _, t in texts]
    want = list(range(80))
    for i in range(80):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                low, high = sorted((want[i], want[j]))
                want = [low if c == high else c for c in want]
    assert got == dict(enumerate(want))
    rounds = [pairs for name, pairs in met.items() if name != "open"]
    assert len(rounds) == near_dedup.ROUNDS and met["round-0"]
    assert all(len({a for a, _ in pairs}) == len(pairs) for pairs in rounds)
    assert len(set(met["open"])) == len(met["open"])
