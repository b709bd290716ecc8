from __future__ import annotations

import numpy as np
import pytest

from pairloom.llm import hash_forest
from pairloom.llm.hash_forest import BITS, Forest


def frame(spark, rows, kind="double"):
    return spark.createDataFrame([(i, v, "x", 1) for i, v in rows], f"vec_id long, embedding array<{kind}>, key string, h int")


def brute(rows, queries, k):
    ok = {}
    for i, v in rows:
        if v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            ok.setdefault((i, tuple(v)), np.array(v, float))
    out = {}
    for i, v in queries:
        near = sorted((-round(float(np.dot(v, x)), 9), j) for (j, _), x in ok.items() if j != i)[:k]
        out[i] = near
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((-round(r.score, 9), r.vec_id))
        assert r["rank"] == len(out[r.query_id])
    return out


@pytest.fixture(scope="module")
def clustered():
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(30, 12))
    x = centres[rng.integers(0, 30, 3000)] + 0.2 * rng.normal(size=(3000, 12))
    return x * rng.uniform(0.5, 2, (3000, 1))


def test_recall_and_work_on_clusters(spark, clustered):
    rows = list(enumerate(clustered.tolist()))
    forest = Forest(frame(spark, rows), k=10, block=128)
    assert forest.prefix > 2
    queries = [r for r in rows if r[0] % 20 == 0]
    got, want = found(forest.search(frame(spark, queries))), brute(rows, queries, 10)
    recall = np.mean([len(set(got[i]) & set(want[i])) / 10 for i in want])
    assert recall >= 0.9
    # structured vectors need few candidates
    q = forest._queries(frame(spark, queries), "vec_id", "embedding").drop("id")
    assert forest.fit(q, forest.counts(q), 0.95) < 3000


def test_with_all_entries_it_is_exact(spark, clustered):
    rows = list(enumerate(clustered[:400].tolist()))
    rows += [(1000 + i, rows[7][1]) for i in range(60)]  # a group of equal vectors
    rows += [(2000, None), (2001, []), (2002, [0.0] * 12), (2003, [1.0] * 11 + [None]), (2004, [1.0] * 11 + [float("nan")]), (2005, [float("inf")] * 12), (2006, [1.0]), (None, rows[7][1]), (7, rows[7][1])]
    queries = [rows[7], rows[20], (1003, rows[7][1])]
    got = found(Forest(frame(spark, rows), k=20, block=32).search(frame(spark, [*queries, (5000, None), (5001, [1.0])]), wanted=10**9))
    assert got == brute([r for r in rows if r[0] is not None and r[0] != 2006], queries, 20)
    assert [v for _, v in got[20]] == sorted((v for _, v in got[20]), key=lambda v: next(s for s, w in got[20] if w == v))


def test_counts_are_those_of_shared_prefixes(spark, clustered):
    rows = list(enumerate(clustered[:300].tolist()))
    forest = Forest(frame(spark, rows), trees=3, block=40)
    q = forest._queries(frame(spark, rows[:10]), "vec_id", "embedding")
    x = np.array([v for _, v in rows])
    entries = hash_forest.strings(x, forest.longest, forest.normals, query=False)
    asked = {bytes(r.key): (np.array(r.hashes), r.id) for r in q.collect()}
    for r in forest.counts(q.drop("id")).collect():
        h, _ = asked[bytes(r.key)]
        want = [sum(int(((entries[:, t] >> (BITS - d)) == (h[t] >> (BITS - d))).sum()) for t in range(3)) for d in range(BITS + 1)]
        assert list(r.c) == want


def test_fewer_candidates_than_asked_for_and_empty(spark):
    rows = [(0, [1.0, 0.0]), (20, [0.0, 1.0]), (21, [1.0, 1.0])]
    assert found(Forest(frame(spark, rows)).search(frame(spark, rows[:2]))) == brute(rows, rows[:2], 20)
    empty = Forest(frame(spark, []))
    assert empty.search(frame(spark, rows)).count() == 0
    assert Forest(frame(spark, rows)).search(frame(spark, [])).count() == 0


def test_query_has_the_recall(spark, sf_dir):
    got = found(hash_forest.op12_hash_forest(spark, sf_dir))
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    queries = [r for r in rows if r[0] % 20 == 0]
    want = brute(rows, queries, 20)
    assert set(got) == set(want) and all(len(v) == 20 for v in got.values())
    assert np.mean([len({v for _, v in got[i]} & {v for _, v in want[i]}) / 20 for i in want]) >= 0.9
