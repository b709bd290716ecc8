from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest

from oracle import assert_same
from pairloom.llm import substring_dedup


def brute(rows, window):
    split = [(d, (t or "").encode().split()) for d, t in rows]
    key = lambda d: float("inf") if d is None else d
    first = {}
    for d, w in split:
        for i in range(len(w) - window + 1):
            g = tuple(w[i : i + window])
            first[g] = min(first.get(g, float("inf")), key(d))
    out = []
    for d, w in split:
        gone = set()
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < key(d):
                gone.update(range(i, i + window))
        out.append((d, len(w), len(gone), b" ".join(x for i, x in enumerate(w) if i not in gone).decode()))
    return sorted(out, key=str)


def corpus(seed):
    rng = random.Random(seed)
    passages = [[f"p{k}_{i}" for i in range(rng.randrange(10, 40))] for k in range(6)]
    rows = []
    for d in range(60):
        w = []
        for _ in range(rng.randrange(0, 4)):
            w += [f"u{rng.randrange(10**6)}" for _ in range(rng.randrange(0, 15))]
            p = rng.choice(passages)
            a = rng.randrange(0, 6)
            w += p[a : len(p) - rng.randrange(0, 6)]
        rows.append((d if d % 10 else d * 2, rng.choice([" ", "  ", "\n"]).join(w)))
    same = " ".join(f"s{i}" for i in range(30))
    return rows + [(200, same), (200, same), (201, same), (None, same), (None, same), (202, None), (203, ""), (204, "é x"), (205, "r " * 5000)]


def result(df):
    return sorted(((r.id, r.n_words, r.n_removed, r.kept) for r in df.collect()), key=str)


@pytest.mark.parametrize("window", [13, 5])
def test_against_brute_force(spark, window):
    rows = corpus(window)
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, key int, kept string").repartition(5)
    assert result(substring_dedup.remove_repeats(df, window=window)) == brute(rows, window)


def test_small_batches(spark, monkeypatch):
    rows = corpus(3)
    monkeypatch.setattr(substring_dedup, "BATCH_WORDS", 40)
    held = list(substring_dedup._filled(iter([]), 13))
    assert held == []
    assert result(substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))) == brute(rows, 13)


def test_every_window_holds_one_block():
    for start in range(30):
        assert sum(p % 7 == 0 and start <= p and p + 7 <= start + 13 for p in range(50)) == 1


def test_blobs_round_trip():
    rng = np.random.default_rng(1)
    h, keys, ids = rng.integers(0, 1 << 48, 500, dtype=np.uint64), rng.integers(0, 9, 500), rng.integers(0, 9, 500)
    ids = keys * 10
    for wide in (False, True):
        got = set()
        for m in substring_dedup._dealt(h, keys, ids, 7, wide):
            for part, blob in zip(m.column("part"), m.column("blob"), strict=True):
                x, k, i = substring_dedup._read_blob(blob.as_py(), wide)
                assert set(((x >> np.uint64(16)) % np.uint64(7)).tolist()) == {part.as_py()}
                got |= set(zip(x.tolist(), k.tolist(), i.tolist(), strict=True))
        assert got == set(zip(h.tolist(), keys.tolist(), ids.tolist(), strict=True))


def test_windows_of_equal_first_hash_are_told_apart():
    u = np.uint64
    h, keys, ids = np.array([5, 5, 5], u), np.array([1, 2, 3]), np.array([1, 2, 3])
    sent = list(substring_dedup._dealt(h, keys, ids, 1, True, np.array([7, 8, 7], np.uint32)))
    answers = [m for m in substring_dedup.repeated_windows(iter(sent), 4) if m.num_rows]
    got = substring_dedup._answers_of(pa.chunked_array([m.column("blob") for m in answers]))
    assert {k: v.tolist() for k, v in got.items()} == {3: [5]}


def test_false_first_hashes_remove_nothing(monkeypatch):
    """With a first hash that is the same for all windows, the second still keeps different windows apart."""
    true_rolling = substring_dedup.rolling
    calls = []

    def weak(words, width):
        out = true_rolling(words, width)
        calls.append(width)
        return out * np.uint64(0) if width == 13 and calls.count(13) % 2 else out

    monkeypatch.setattr(substring_dedup, "rolling", weak)
    texts = [" ".join(f"{c}{i}" for i in range(13)) for c in "aba"]
    z = substring_dedup.zstandard.ZstdCompressor()
    docs = pa.table({"key": pa.array([1, 2, 3]), "id": pa.array([1, 2, 3]), "packed": pa.array([z.compress(t.encode()) for t in texts], pa.binary())})
    words = substring_dedup.Words()
    hits = {k: (true_rolling(words(t.encode().split())[:, 0].copy(), 7) & np.uint64((1 << 48) - 1)) >> np.uint64(1) for k, t in zip((1, 2, 3), texts, strict=True)}
    blobs = [m.column("blob") for m in substring_dedup._settled(np.repeat([1, 2, 3], 7), np.concatenate(list(hits.values())), 1)]
    found = substring_dedup._extend(docs, pa.table({"blob": pa.chunked_array(blobs)}), 7, 13, 1, 1)
    settled = [m.column("blob") for m in found if m.num_rows and m.column("part")[0].as_py() < 0]
    assert set(substring_dedup._answers_of(pa.chunked_array(settled))) == {3}


def test_empty(spark):
    assert substring_dedup.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    with pytest.raises(ValueError):
        substring_dedup.remove_repeats(spark.createDataFrame([], "doc_id long, text string"), window=12)


def test_query(spark, sf_dir):
    assert_same(spark, sf_dir, substring_dedup.op9_substring_dedup, substring_dedup.OP9_SQL)
