from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairloom.operators.vectors import best_of_rows
from pairloom.sources.vector_store import NAMES, VectorStore

SCHEMA = "project_name string, file_name string, function_name string, function_code string, embedding array<float>"


def functions(spark, x, at=0):
    return spark.createDataFrame([("p", "f", f"n{i + at}", f"c{i + at}", v) for i, v in enumerate(x.tolist())], SCHEMA)


def asked(spark, x):
    return spark.createDataFrame(list(enumerate(x.tolist())), "q_id long, embedding array<double>")


def exact(x, q, k):
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    sim = np.round(unit(q.astype(float)) @ unit(x.astype(float)).T, 6)
    return [{f"n{j}" for j in np.argsort(-row, kind="stable")[:k]} for row in sim]


def names(hits):
    out = {}
    for r in hits.collect():
        out.setdefault(r.q_id, set()).add(r.function_name)
    return out


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(40, 24))
    return (centres[rng.integers(0, 40, 2400)] + 0.35 * rng.normal(size=(2400, 24))).astype(np.float32)


def test_two_inserts_one_search_of_pruned_partitions(spark, tmp_path, vectors):
    store = VectorStore(spark, f"file://{tmp_path}/store", 24, lists=32)
    store.insert(functions(spark, vectors[:800]))
    first = store.probes(0.95)
    store.insert(functions(spark, vectors[800:], 800))
    assert store.count() == 2400 and 1 <= first < 32
    q = vectors[::60]
    hits = store.search(asked(spark, q), 10)
    got, want = names(hits), exact(vectors, q, 10)
    assert np.mean([len(got[i] & w) / 10 for i, w in enumerate(want)]) >= 0.9
    assert names(store.search(asked(spark, q), 10, probes=32)) == dict(enumerate(want))
    # one query reads its own lists only: the files of others may hold anything
    one = store.search(asked(spark, q[:1]), 10, probes=3)
    assert "PartitionFilters: [list" in one._jdf.queryExecution().executedPlan().toString()
    near = store._asked(asked(spark, q[:1]), "q_id", "embedding", store.centres(), 3)
    looked = {f"list={r.list}" for r in near.select("list").distinct().collect()}
    assert len(looked) == 3
    for folder in (tmp_path / "store" / "rows").glob("list=*"):
        for f in folder.glob("*.parquet") if folder.name not in looked else ():
            f.write_bytes(b"no parquet")
    spark.catalog.clearCache()
    assert names(store.search(asked(spark, q[:1]), 10, probes=3)) == names(one)
    with pytest.raises(Exception, match="(?i)parquet"):
        store.search(asked(spark, q[:1]), 10, probes=32).collect()


def test_insert_again_and_equal_functions(spark, tmp_path):
    store = VectorStore(spark, f"file://{tmp_path}/store", 2)
    rows = [("p", "f", "g", "x", [1.0, 0.0]), ("p", "f", "g", "x", [0.5, 0.0]), ("p", "f", "g", None, [0.0, 1.0]), ("p", "f", None, "x", [0.0, 1.0]), ("p", "fg", "", "x", [1.0, 1.0])]
    bad = [("p", "f", "h", "x", None), ("p", "f", "h", "x", [1.0]), ("p", "f", "h", "x", [1.0, float("nan")]), ("p", "f", "h", "x", [1.0, None])]
    df = spark.createDataFrame(rows + bad, SCHEMA).withColumn("list", F.lit("clash"))
    assert store.insert(df).count() == 4
    store.insert(df)
    assert store.count() == 4
    assert store.table().where("function_code = 'x' AND function_name = 'g'").first().embedding == [0.5, 0.0]
    assert store.search(spark.createDataFrame([(1, None), (2, [1.0])], "q_id long, embedding array<double>"), 3).count() == 0


def test_empty_first_insert_and_rebuild(spark, tmp_path, vectors):
    store = VectorStore(spark, f"file://{tmp_path}/store", 24, lists=8)
    assert store.insert(functions(spark, vectors[:0].reshape(0, 24))).count() == 0
    assert store.search(asked(spark, vectors[:2]), 3).count() == 0
    store.insert(functions(spark, vectors[:300]))
    store.rebuild()
    assert len(store.centres()) == 8 and store.count() == 300
    assert names(store.search(asked(spark, vectors[:5]), 5, probes=8)) == dict(enumerate(exact(vectors[:300], vectors[:5], 5)))
    with pytest.raises(ValueError):
        store.probes(1.5)
    store.drop()
    assert not (tmp_path / "store").exists()


def test_best_of_rows():
    sim = np.array([[3.0, 5, 5, 1], [-np.inf, 2, -np.inf, -np.inf]])
    row, column = best_of_rows(sim, np.array([0, 3, 2, 1]), 2)
    assert list(zip(row.tolist(), column.tolist(), strict=True)) == [(0, 2), (0, 1), (1, 1)]
    assert NAMES[0] == "project_name"
