from __future__ import annotations

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pairloom.functions import parsing
from pairloom.operators import hamming, losses, momentum


def signed(x):
    return x - (1 << 64) if x >> 63 else x


# --- queues of earlier rows ---------------------------------------------------------


def pair_frame(spark, n, size, dim=6, moving=True, seed=2):
    rng = np.random.default_rng(seed)
    x = {c: rng.normal(size=(n, dim)) * rng.uniform(0.5, 3, (n, 1)) for c in ("a", "s", "am", "sm")}
    columns = ["a", "s", "am", "sm"] if moving else ["a", "s"]
    rows = [(i // size, i, *(x[c][i].tolist() for c in columns)) for i in range(n)]
    return spark.createDataFrame(rows, "batch long, i long, " + ", ".join(f"{c} array<double>" for c in columns)), {c: v / np.linalg.norm(v, axis=1, keepdims=True) for c, v in x.items()}


def stepped(x, n, size, tau, queue, initial=None):
    """The queue as a ring that each batch enters after it was judged."""
    held = {k: [None] * queue for k in ("am", "sm")}
    for t, (a, s) in enumerate(initial or []):
        if t < queue:
            held["am"][t], held["sm"][t] = a / np.linalg.norm(a), s / np.linalg.norm(s)
    out, at = [], 0
    for b in range(-(-n // size)):
        rows = range(b * size, min(n, (b + 1) * size))
        result = []
        for q, k, other in (("a", "sm", "sm"), ("s", "am", "am")):
            past = [v for v in held[other] if v is not None]
            ce, hit = [], []
            for i in rows:
                logits = np.array([x[q][i] @ x[k][i], *(x[q][i] @ v for v in past)]) / tau
                ce.append(np.log(np.exp(logits - logits.max()).sum()) + logits.max() - logits[0])
                hit.append(logits.argmax() == 0)
            result += [np.mean(ce), np.mean(hit)]
        out.append((b, *result))
        for i in rows:
            held["am"][at % queue], held["sm"][at % queue] = x["am"][i], x["sm"][i]
            at += 1
    return out


@pytest.mark.parametrize(("queue", "block", "initial"), [(24, 8, 0), (24, 5, 24), (50, 16, 30), (1000, 16, 40), (8, 64, 0)])
def test_queue_step_by_step(spark, queue, block, initial):
    n, size, tau = 90, 8, 0.2
    df, x = pair_frame(spark, n, size)
    start = frame = None
    if initial:
        rng = np.random.default_rng(5)
        start = [(rng.normal(size=6), rng.normal(size=6)) for _ in range(initial)]
        frame = spark.createDataFrame([(t, a.tolist(), s.tolist()) for t, (a, s) in enumerate(start)], "slot long, a array<double>, s array<double>")
    want = stepped(x, n, size, tau, queue, start)
    loss = {r.batch: r for r in momentum.momentum(df, size, tau, queue, frame, block).collect()}
    accuracy = {r.batch: r for r in momentum.momentum_accuracy(df, size, tau, queue, frame, block).collect()}
    assert set(loss) == set(accuracy) == {w[0] for w in want}
    for b, ce1, acc1, ce2, acc2 in want:
        assert (loss[b].loss_a2s, loss[b].loss_s2a) == pytest.approx((ce1, ce2), abs=2e-6)
        assert loss[b].loss == pytest.approx((ce1 + ce2) / 2, abs=2e-6)
        assert (accuracy[b].acc_a2s, accuracy[b].acc_s2a) == pytest.approx((acc1, acc2), abs=2e-6)


def test_large_logits_do_not_overflow(spark):
    df, x = pair_frame(spark, 40, 8, moving=False)
    x = x | {"am": x["a"], "sm": x["s"]}
    got = {r.batch: r.loss for r in losses.loss("momentum", df, batch_size=8, tau=1e-4, queue=16).collect()}
    for b, ce1, _, ce2, _ in stepped(x, 40, 8, 1e-4, 16):
        assert got[b] == pytest.approx((ce1 + ce2) / 2, rel=1e-9, abs=1e-5)


def test_a_row_travels_once_for_each_block_of_rows(spark):
    df, _ = pair_frame(spark, 640, 4, moving=False)
    keys = df.select(F.col("i").alias("j"), F.col("a").alias("ka"), F.col("s").alias("ks"))
    terms = momentum.queue_terms(df.select("i", "a", "s"), keys, batch_size=4, tau=0.1, queue=256, block=64)
    plan = terms._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan
    blocks = momentum.packed(keys, "j", ["ka", "ks"], 64)
    assert blocks.count() == 10 and terms.count() == 636


def test_empty_queue_table(spark):
    df, _ = pair_frame(spark, 8, 8, moving=False)
    assert momentum.momentum(df.limit(0), 8).count() == 0
    only = momentum.momentum(df, 8).first()
    assert (only.loss, only.loss_a2s, only.loss_s2a) == (0, 0, 0)
    assert momentum.momentum_accuracy(df, 8).first().acc_a2s == 1


# --- fingerprints -------------------------------------------------------------------


def brute_pairs(values, within):
    distinct = sorted({v for v in values if v is not None})
    return {(a, b, (a ^ b).bit_count() if (a ^ b) >= 0 else ((a ^ b) % (1 << 64)).bit_count()) for i, a in enumerate(distinct) for b in distinct[i + 1 :] if ((a ^ b) % (1 << 64)).bit_count() <= within}


def fingerprints(rng, n):
    centres = [rng.getrandbits(64) for _ in range(n // 10)]
    out = []
    for _ in range(n):
        v = rng.choice(centres)
        for _ in range(rng.randrange(6)):
            v ^= 1 << rng.randrange(64)
        out.append(signed(v))
    return [*out, None, 0, -1, out[0], out[0]]


@pytest.mark.parametrize("within", [0, 1, 3, 5])
def test_close_fingerprints(spark, within):
    values = fingerprints(random.Random(within), 400)
    df = spark.createDataFrame([(v, "x") for v in values], "h long, key string")
    got = {(r.a, r.b, r.distance) for r in hamming.close_fingerprints(df, "h", within).collect()}
    assert got == brute_pairs(values, within)


@pytest.mark.parametrize("full", [4, 30])
def test_crowded_buckets_are_split_without_loss(spark, full):
    # most fingerprints agree in their upper 48 bits: every first table has a full bucket
    rng = random.Random(7)
    values = [signed(0xABCD_1234_5678_0000 | rng.getrandbits(16)) for _ in range(300)] + [signed(rng.getrandbits(64)) for _ in range(100)]
    df = spark.createDataFrame([(v,) for v in values], "h long")
    got = {(r.a, r.b, r.distance) for r in hamming.close_fingerprints(df, "h", 3, full=full).collect()}
    assert got == brute_pairs(values, 3) and len(got) > 100


def test_more_rows_get_longer_keys():
    assert len(hamming.first_masks(3, 1000)) == 4
    few, many = (64 - max(m.bit_count() for m in hamming.first_masks(3, n)) for n in (1000, 10**9))
    assert few > many and len(hamming.first_masks(3, 10**9)) <= hamming.TABLES
    for n in (1, 10**6, 10**12):
        masks = hamming.first_masks(2, n)
        for d in ((1 << 3) | (1 << 60), 1, (1 << 31) | (1 << 32)):
            assert any(not m & d for m in masks)


def test_classes_and_links(spark):
    rows = [(5, 0b1111), (3, 0b1111), (9, 0b0111), (1, None), (7, 1 << 40), (8, 0b1111 | 1 << 50)]
    df = spark.createDataFrame(rows, "id long, h long")
    assert {tuple(r) for r in hamming.near_classes(df, "id", "h", 1).collect()} == {(5, 3, 2), (3, 3, 2), (9, 9, 1), (1, None, 0), (7, 7, 0), (8, 8, 1)}
    assert {tuple(r) for r in hamming.class_pairs(df, "id", "h", 2).collect()} == {(3, 9, 1), (3, 8, 1), (8, 9, 2)}
    assert hamming.near_classes(df.limit(0), "id", "h").count() == hamming.class_pairs(df.limit(0), "id", "h").count() == 0


def test_fingerprints_of_groups_of_texts():
    rng = random.Random(4)
    texts = ["", "a", "ab c", "abcd", None, "ééé 漢字 𝒜𝒷𝒸𝒹", "the the the the", "_-_"] + ["".join(rng.choice("ab cé漢𝒜.") for _ in range(rng.randrange(60))) for _ in range(600)]
    got = parsing._simhash(pd.Series(texts))
    assert [None if pd.isna(h) else int(h) for h in got] == [None if t is None else signed(parsing.simhash(t)) for t in texts]
    wide = ["".join(map(chr, range(0x4E00, 0x9FA5))) + "".join(map(chr, range(0xAC00, 0xD7A3))) + "".join(map(chr, range(0x20000, 0x2A6D6))), "abcd"]
    assert [int(h) for h in parsing._simhash(pd.Series(wide))] == [signed(parsing.simhash(t)) for t in wide]


def test_class_pairs_compute_a_fingerprint_once(spark, tmp_path):
    def note(s: pd.Series) -> pd.Series:
        with open(f"{tmp_path}/calls", "a") as f:
            f.write("x\n" * len(s))
        return s

    df = spark.range(50).withColumn("h", F.pandas_udf(note, "long")("id"))
    hamming.class_pairs(df, "id", "h", 1).count()
    with open(f"{tmp_path}/calls") as f:
        assert len(f.readlines()) == 50
