from __future__ import annotations

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairloom import schemas
from pairloom.operators import integrate, losses, metrics, mining, vectors
from pairloom.operators.ordinal import with_ordinal
from pairloom.plans import corpus_queries
from pairloom.sources import files
from pairloom.streaming import ingest


def test_first_match(spark):
    left = spark.createDataFrame([("k", "O0"), ("k", "O1"), ("k", "O2"), ("l", "O0")], "key string, opti string")
    right = spark.createDataFrame([("k", 2, "second"), ("k", 1, "first"), ("r", 1, "x")], "key string, ord int, src string")
    got = integrate.first_match_join(left, right, "key", "ord").collect()
    assert sorted((r.opti, r.src) for r in got) == [("O0", "first"), ("O1", "first"), ("O2", "first")]


def test_first_match_of_equal_rows(spark, tmp_path):
    rows = [(1, 1, 1, n) for n in range(40, 0, -1)] + [(2, 1, 2, 7)]
    lines = spark.createDataFrame(rows, "l_partkey long, l_orderkey long, l_linenumber int, l_suppkey long")
    lines.coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(1, "a"), (2, "b")], "p_partkey long, p_name string").write.parquet(f"{tmp_path}/part.parquet")
    # in whatever order rows arrive, the first in the file is taken
    assert sorted((r.key, r.l_suppkey) for r in corpus_queries.merge_first_match_many(spark, str(tmp_path)).collect()) == [(1, 40), (2, 7)]
    left = spark.createDataFrame([("k",), ("n",)], "key string")
    right = spark.createDataFrame([("k", 1, "b", 2), ("k", 1, "a", 3), ("k", None, "0", 0), ("n", None, "z", 1)], "key string, ord int, src string, at int")
    for parts in (1, 3):
        given = right.repartition(parts, "at")
        assert sorted((r.key, r.src) for r in integrate.first_match_join(left, given, "key", "ord", "at").collect()) == [("k", "b"), ("n", "z")]
        assert sorted((r.key, r.src) for r in integrate.first_match_join(left, given.drop("at"), "key", "ord").collect()) == [("k", "a"), ("n", "z")]


def test_keep_first_with_nulls(spark):
    df = spark.createDataFrame([("a", 2), ("a", 1), (None, 4), (None, 3)], "k string, o int")
    assert sorted(r.o for r in integrate.keep_first(df, "k", "o").collect()) == [1, 3]


@pytest.mark.parametrize(("n", "sizes"), [(10, (7, 2, 1)), (90, (62, 18, 10)), (1, (0, 0, 1))])
def test_ordered_splits(spark, n, sizes):
    got = {r.split: r["count"] for r in integrate.ordered_splits(spark.range(n), "id").groupBy("split").count().collect()}
    assert (got.get("train", 0), got.get("eval", 0), got.get("test", 0)) == sizes


def test_ordinal_is_a_permutation(spark):
    got = with_ordinal(spark.range(1000).withColumn("h", F.md5(F.col("id").cast("string"))), "h").orderBy("h").select("ordinal").collect()
    assert [r[0] for r in got] == list(range(1000))


def test_negatives_never_share_a_key(spark):
    df = spark.createDataFrame([(i, f"k{i % 3}") for i in range(30)], "id long, k string")
    keys = {r.id: r.k for r in df.collect()}
    got = integrate.negative_pairs(df, "id", "k", attempts=6).collect()
    assert got and all(keys[r.id] != keys[r.partner] for r in got)
    assert integrate.negative_pairs(df.where("id = 0"), "id", "k").count() == 0
    assert integrate.negative_pairs(df.where("k = 'k0'"), "id", "k").count() == 0


@pytest.mark.parametrize(("n", "hot"), [(600, 480), (600, 599), (40, 20)])
def test_every_row_with_a_candidate_gets_a_negative(spark, n, hot):
    df = spark.createDataFrame([(i, "hot" if i < hot else None if i % 2 else f"k{i % 7}") for i in range(n)], "id long, k string")
    keys = {r.id: r.k for r in df.collect()}
    got = integrate.negative_pairs(df, "id", "k").collect()
    assert sorted(r.id for r in got) == list(range(n))
    assert all(keys[r.id] != keys[r.partner] for r in got)
    assert integrate.labelled_pairs(df.withColumns({"l": F.col("k"), "r": F.col("k")}), "id", "k", "l", "r").where("label = 0").count() == 2 * n


def test_interleave_drops_null_groups(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, "a"), (4, "b"), (5, "b"), (6, "c"), (7, None)], "id long, g string")
    got = {r.id: (r.new_group_id, r.original_group_rank) for r in integrate.interleave(df, "g", "id").collect()}
    assert got == {1: (0, 0), 2: (1, 0), 3: (2, 0), 4: (0, 1), 5: (1, 1), 6: (0, 2)}


def test_locate(spark):
    counts = spark.createDataFrame([(0, 3), (1, 0), (2, 5)], "file long, n long")
    got = integrate.locate(counts, spark.range(-1, 10).withColumnRenamed("id", "idx"), "file", "n").collect()
    assert sorted((r.idx, r.file, r.local_idx) for r in got) == [(0, 0, 0), (1, 0, 1), (2, 0, 2), (3, 2, 0), (4, 2, 1), (5, 2, 2), (6, 2, 3), (7, 2, 4)]


def _pairs(spark, labels, seed=0, size=4, dim=3):
    rng = np.random.default_rng(seed)
    a, s = rng.normal(size=(2, len(labels), dim))
    rows = [(i // size, i, a[i].tolist(), s[i].tolist(), labels[i]) for i in range(len(labels))]
    return a, s, spark.createDataFrame(rows, "batch long, i long, a array<double>, s array<double>, label int")


def _sim(a, s):
    a, s = (x / np.linalg.norm(x, axis=1, keepdims=True) for x in (a, s))
    return a @ s.T


def _lse(x, axis):
    return np.log(np.exp(x).sum(axis))


def test_losses_against_numpy(spark):
    labels = [1, 0, 1, 1]
    a, s, df = _pairs(spark, labels)
    m, y = _sim(a, s), np.array(labels)
    x, d = m / 0.05, np.diag(m)
    rows, cols = _lse(x, 1) - np.diag(x), _lse(x, 0) - np.diag(x)
    off = np.where(np.eye(4, dtype=bool), -np.inf, m).max(1)
    expected = {
        "infonce": (rows.mean() + cols.mean()) / 2,
        "hard_infonce": (rows.mean() + cols.mean()) / 2 + np.maximum((off - d + 0.2) / 0.05, 0).mean(),
        "labeled_infonce": rows[y == 1].mean(),
        "cosine_embedding": np.where(y == 1, 1 - d, np.maximum(d - 0.2, 0)).mean(),
        "labeled_contrastive": (1 - d[y == 1]).mean() + np.maximum(d[y == 0] + 0.3, 0).mean(),
        "multiple_negatives": (_lse(20 * m, 1) - 20 * d).mean(),
    }
    for name, value in expected.items():
        assert losses.loss(name, df).first().loss == pytest.approx(value, abs=2e-6), name
    with pytest.raises(ValueError):
        losses.loss("none", df)


def test_losses_with_one_class(spark):
    for labels in ([1] * 4, [0] * 4):
        _, _, df = _pairs(spark, labels)
        assert losses.labeled_infonce(df).first().loss == (0.0 if labels[0] == 0 else pytest.approx(losses.labeled_infonce(df).first().loss))
        assert losses.weighted_infonce(df).first().loss >= 0 and losses.simple_contrastive(df).first().loss is not None
        assert losses.labeled_triplet(df).count() == 0


def test_zero_vectors_and_pooling(spark):
    row = spark.sql("SELECT array(0.0, 0.0) AS z, array(array(1D, 2D), array(3D, 4D), array(5D, 6D)) AS h, array(1, 1, 0) AS m").select(
        vectors.normalize(F.col("z")), *[vectors.pool(F.col("h"), F.col("m"), s) for s in ("last", "end", "mean", "weighted")]
    ).first()
    assert row[0] == [0.0, 0.0] and row[1] == [3.0, 4.0] and row[2] == [5.0, 6.0] and row[3] == [2.0, 3.0]
    assert row[4] == pytest.approx([7 / 3, 10 / 3])
    with pytest.raises(ValueError):
        vectors.pool(F.col("h"), F.col("m"), "other")


def test_projection_head(spark):
    rng = np.random.default_rng(1)
    w = {"w1": rng.normal(size=(5, 3)), "b1": rng.normal(size=5), "w2": rng.normal(size=(2, 5)), "b2": rng.normal(size=2), "gamma": np.ones(2), "beta": np.zeros(2)}
    df = spark.createDataFrame([(1, [1.0, 2.0, 3.0])], "id long, embedding array<double>")
    got = df.transform(vectors.project(w)).first()
    assert got.id == 1 and len(got.embedding) == 2 and sum(got.embedding) == pytest.approx(0, abs=1e-6)


def test_top_k_ties_and_ranks(spark):
    q = spark.createDataFrame([(0, [1.0, 0.0])], "id long, v array<double>")
    k = spark.createDataFrame([(5, [1.0, 0.0]), (3, [2.0, 0.0]), (4, [0.0, 1.0])], "id long, v array<double>")
    got = vectors.top_k(q, k, 2, "id", "id", "v").orderBy("rank").collect()
    assert [(r.k_id, r.sim) for r in got] == [(3, 1.0), (5, 1.0)]
    truth = spark.createDataFrame([(0, 5)], "q_id long, k_id long")
    assert vectors.target_ranks(q, k, truth, "id", "id", "v").first()["rank"] == 2


def test_recall_rises_with_k(spark):
    report = metrics.retrieval_report(spark.createDataFrame([(r,) for r in (1, 2, 7, 50, 400)], "rank long")).first()
    assert report.recall_at_1 <= report.recall_at_5 <= report.recall_at_10 <= report.recall_at_100 == 0.8
    assert report.median_rank == 7


def test_best_epoch_and_curriculum(spark):
    df = spark.createDataFrame([(1, 0.5), (2, 0.7), (3, 0.7)], "e int, m double")
    assert metrics.best_epoch(df, "e", "m").first().best_epoch == 2
    scored = spark.createDataFrame([(i, float(i)) for i in range(8)], "id long, score double")
    assert sorted(r.id for r in mining.curriculum_prefix(scored, 0.25, "id", "score").collect()) == [6, 7]
    assert sorted(r.id for r in mining.curriculum_prefix(scored, 0.25, "id", "score", easy_first=False).collect()) == [0, 1]
    assert mining.stage_table(spark).count() == 3


def test_rag_answers_asks_every_item(spark, sf_dir):
    from pairloom.plans import corpus_queries

    items = [r.item_id for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id").collect()]
    assert sorted(r.question_id for r in corpus_queries.rag_answers(spark, sf_dir).collect()) == sorted(items)


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "id long, k string, score double")
    assert with_ordinal(empty, "id").count() == 0
    assert integrate.ordered_splits(empty, "id").count() == 0
    assert integrate.negative_pairs(empty, "id", "k").count() == 0
    assert mining.ring_buffer(empty, "id", 3).count() == 0


def test_documents_round_trip(spark, tmp_path):
    src = tmp_path / "src" / "proj" / "lib"
    src.mkdir(parents=True)
    (src / "a.b.c").write_text("int f(void)\n{\n int a;\n int b;\n int c;\n int d;\n return 1;\n}\nint main(void) { return 0; }\n")
    (src / "notes.txt").write_text("no")
    docs = files.source_documents(files.read_files(spark, str(tmp_path / "src")))
    assert docs.first().metadata.total_functions == 2
    files.write_documents(docs, str(tmp_path / "json"))
    back = files.read_documents(spark, str(tmp_path / "json"), glob="*.txt")
    assert back.first().functions[0].function_name == "f"
    keyed = files.source_rows(back.withColumn("path", F.col("metadata.source_file")), F.lit("proj")).collect()
    assert [r.key for r in keyed] == ["proj$a$f"] and keyed[0].key_words == ["a.b.c", "lib"] and keyed[0].hash >= 0


def test_csv_and_assembly(spark, tmp_path):
    raw = spark.createDataFrame([("_ZN1a1bEv", "1|2|3|4|5|6|7", "0x0", "x"), ("g", "1|2|3|4|5|6", "0x1", "x"), ("h", None, "0x2", "x"), ("k", "mov #4|\n2|3|4|5|6|7", "0x3", "x")], schemas.IDA_RAW)
    files.write_csv(raw, str(tmp_path / "out" / "proj" / "-O2" / "m.csv"))
    back = files.read_csv(spark, str(tmp_path / "out"), schemas.IDA_RAW, comment="#")
    rows = files.assembly_rows(back, F.lit("/out/proj/-O2/m.csv")).orderBy("key").collect()
    assert [(r.key, r.signature) for r in rows] == [("proj$m$a::b", "a::b$O2"), ("proj$m$k", "k$O2")]
    assert "#4" in rows[1].assembly_code


def test_vector_store(spark, tmp_path):
    store = files.VectorStore(spark, str(tmp_path / "store"), 2)
    rows = [("p", "f", "n1", "c1", [1.0, 0.0]), ("p", "f", "n2", "c2", [0.0, 1.0]), ("p", "f", "bad", "c3", [1.0])]
    store.insert(spark.createDataFrame(rows, "project_name string, file_name string, function_name string, function_code string, embedding array<float>"))
    assert store.count() == 2
    hits = store.search(spark.createDataFrame([(0, [0.9, 0.1])], "q_id long, embedding array<float>"), k=2).orderBy("rank").collect()
    assert [h.function_name for h in hits] == ["n1", "n2"] and hits[0].sim > hits[1].sim
    store.drop()
    assert not (tmp_path / "store").exists()


def test_manifest(spark):
    inputs = spark.createDataFrame([("a",), ("b",)], "path string")
    assert [r.path for r in files.not_done(inputs, inputs.where("path = 'a'"), "path").collect()] == ["b"]


def test_ingest_resumes(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    run = lambda: ingest.ingest_documents(spark, str(src), str(tmp_path / "out"), str(tmp_path / "ck"), "x int", 1).awaitTermination()
    (src / "1.json").write_text(json.dumps({"x": 1}))
    (src / "2.json").write_text(json.dumps({"x": 2}))
    run()
    (src / "3.json").write_text(json.dumps({"x": 3}))
    run()
    assert sorted(r.x for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [1, 2, 3]


def test_ring_buffer_stream(spark, tmp_path):
    for i in range(3):
        spark.range(i * 4, i * 4 + 4).selectExpr("0L AS k", "id AS o", "CAST(id AS DOUBLE) AS v").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    rows = spark.readStream.schema("k long, o long, v double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = ingest.ring_buffer_stream(rows, "k", "o", "v", 5)
    q = out.writeStream.outputMode("update").format("memory").queryName("ring").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "ck")).start()
    q.awaitTermination()
    got = spark.sql("SELECT o FROM ring").collect()
    assert sorted(r.o for r in got[-5:]) == [7, 8, 9, 10, 11]
