from __future__ import annotations

import numpy as np
import pytest

from pairloom.operators import momentum, vectors


def table(spark, rng, n):
    v = rng.integers(-2, 3, (n, 6)).astype(float)
    v[:20] = v[20:40]
    return v, spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(n, None)], "id long, v array<double>")


def sims(v):
    u = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
    return np.round(u @ u.T, 6)


@pytest.fixture
def small(monkeypatch):
    """Sizes at which a few hundred rows take many cells, slices and blocks."""
    for name, value in (("HELD", 300), ("CELL", 2000), ("SLICE", 256), ("BLOCK", 16)):
        monkeypatch.setattr(vectors, name, value)


def test_a_cell_holds_a_bounded_part_of_the_queries(spark, small):
    _, df = table(spark, np.random.default_rng(1), 600)
    rows = df.where("v IS NOT NULL").selectExpr("id AS n", "v")
    q, k, cells = vectors.grid(rows, rows)
    held = q.groupBy("cell").count().toPandas()["count"]
    assert cells >= 12 and held.max() * 6 <= 2 * 300
    met = q.selectExpr("cell", "n AS a").join(k.selectExpr("cell", "n AS b"), "cell")
    assert met.count() == met.distinct().count() == 600 * 600


@pytest.mark.parametrize("own", [False, True])
def test_nearest_with_many_ties(spark, small, own):
    v, df = table(spark, np.random.default_rng(2), 300)
    sim = sims(v)
    want = set()
    for q, row in enumerate(sim):
        order = [k for k in sorted(range(len(v)), key=lambda k: (-row[k], k)) if not (own and k == q)]
        want |= {(q, k, row[k], r + 1) for r, k in enumerate(order[:7])}
    assert {tuple(r) for r in vectors.top_k(df, df, 7, "id", "id", "v", exclude_self=own).collect()} == want
    assert {tuple(r) for r in vectors.ann_top_k(df, df, 7, "id", "id", "v", lists=5, probes=5, exclude_self=own).collect()} == want


def test_ranks_with_many_ties(spark, small):
    v, df = table(spark, np.random.default_rng(3), 300)
    sim = sims(v)
    truth = spark.createDataFrame([(i, (i * 7) % 300) for i in range(300)], "q_id long, k_id long")
    want = {(i, 1 + sum((sim[i, k], -k) > (sim[i, (i * 7) % 300], -((i * 7) % 300)) for k in range(300))) for i in range(300)}
    assert {tuple(r) for r in vectors.target_ranks(df, df, truth, "id", "id", "v").collect()} == want


def test_a_looked_into_list_is_not_sent_for_itself(spark):
    _, df = table(spark, np.random.default_rng(4), 200)
    found = vectors.ann_top_k(df, df, 3, "id", "id", "v", lists=16, probes=16)
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()


def test_vectors_of_different_lengths_are_an_error(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0]), (3, [1.0, 0.0, 0.0])], "id long, v array<double>")
    with pytest.raises(Exception, match="vectors of 1 to 3 numbers"):
        vectors.top_k(df.coalesce(1), df.coalesce(1), 1, "id", "id", "v").collect()


def test_keys_of_a_queue_travel_once_for_each_block_of_rows(spark):
    n = spark.range(40_000)
    rows, keys = n.selectExpr("id AS i", "array(1D) AS a", "array(1D) AS s"), n.selectExpr("id AS j", "array(1D) AS ka", "array(1D) AS ks")
    x, y, cells = momentum.dealt(rows, keys, 32, 65_536, momentum.ROWS)
    assert x.count() == 40_000 * cells // 3 and y.count() <= 3 * 40_000
    assert x.groupBy("cell").count().toPandas()["count"].max() <= momentum.ROWS


def test_queue_in_shares(spark, monkeypatch):
    for name, value in (("BLOCK", 16), ("SLICE", 8), ("CELL", 1000)):
        monkeypatch.setattr(momentum, name, value)
    rng = np.random.default_rng(5)
    a, s = rng.normal(size=(2, 200, 4))
    df = spark.createDataFrame([(i + 40, x.tolist(), y.tolist()) for i, (x, y) in enumerate(zip(a, s, strict=True))], "i long, a array<double>, s array<double>")
    keys = df.selectExpr("i AS j", "a AS ka", "s AS ks")
    got = {r.i: r for r in momentum.queue_terms(df, keys, 8, 0.5, 50, block=32).collect()}
    assert set(got) == set(range(48, 240))
    for i, r in got.items():
        end = i // 8 * 8 - 40
        near = slice(max(0, end - 50), end)
        for m, z, logits in ((r.m_a2s, r.z_a2s, s[near] @ a[i - 40] / 0.5), (r.m_s2a, r.z_s2a, a[near] @ s[i - 40] / 0.5)):
            assert (m, z) == pytest.approx((logits.max(), np.exp(logits - logits.max()).sum()), rel=1e-9)
