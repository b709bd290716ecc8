from __future__ import annotations

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from pairloom.llm import packing


@pytest.mark.parametrize("seed", range(4))
def test_cells(seed):
    rng = random.Random(seed)
    lengths = [rng.choice([1, rng.randrange(1, 50), rng.randrange(1, 700)]) for _ in range(300)]
    pieces = packing.pack_cell(lengths, 128)
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for d, s, n, q, o in pieces:
        by_doc[d].append((s, n))
        by_seq[q].append((o, n))
    for d, total in enumerate(lengths):
        at = 0
        for s, n in sorted(by_doc[d]):
            assert s == at and n > 0
            at += n
        assert at == total
    used = []
    for p in by_seq.values():
        at = 0
        for o, n in sorted(p):
            assert o == at
            at += n
        assert at <= 128
        used.append(at)
    assert sum(used) == sum(lengths) and 128 * len(used) - sum(used) < 2 * 128


def test_costs_are_balanced():
    rng = random.Random(1)
    lengths = [rng.randrange(1, 120) for _ in range(2000)]
    cost = defaultdict(float)
    for _, _, n, q, _ in packing.pack_cell(lengths, 1024):
        cost[q] += n + 1e-3 * n * n
    in_order, at = defaultdict(float), 0
    for n in lengths:
        in_order[at // 1024] += n + 1e-3 * n * n
        at += n
    full = sorted(cost.values())[1:]
    assert max(full) - min(full) < max(in_order.values()) - sorted(in_order.values())[1]


def test_pieces_of_texts(spark):
    rows = [(1, "Hello, hello world!"), (2, None), (3, ""), (1, "Hello, hello world!"), (None, "x " * 6000), (4, "été\n\nÉTÉ")]
    df = spark.createDataFrame([(*r, 7, 8) for r in rows], "doc_id long, text string, start int, offset int").coalesce(1)
    got = packing.pack(df, cell_tokens=3000).collect()
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    parts = defaultdict(int)
    for i, text in rows:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        mine = [r for r in got if r.doc_id == i and r.doc_tokens == len(ids)]
        assert sum(r.length for r in mine) == len(ids) * sum(a == i and b == text for a, b in rows)
        for r in mine:
            assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
    for r in got:
        parts[r.sequence_id] += r.length
    assert max(parts.values()) <= 2048
    assert packing.pack(df.where("doc_id = 0")).count() == 0


def test_query(spark, sf_dir):
    got = packing.op5_packing(spark, sf_dir).toPandas()
    assert got.groupby("doc_id").length.sum().equals(got.groupby("doc_id").doc_tokens.first().rename("length"))
    filled = got.groupby("sequence_id").length.sum()
    assert (filled <= 2048).all() and filled.sum() > 0.98 * 2048 * len(filled)


def by_the_rule(lengths, capacity):
    """The stated rule by plain search: (document, start, length, sequence)."""
    rest, full, out = [], 0, []
    for d, n in enumerate(lengths):
        whole = n // capacity if n > capacity else 0
        out += [(d, k * capacity, capacity, full + k) for k in range(whole)]
        full += whole
        if n - whole * capacity:
            rest.append((-(n - whole * capacity), d, whole * capacity))
    count = -(-sum(-r[0] for r in rest) // capacity)
    room, cost = [capacity] * count, [0.0] * count
    while rest:
        rest.sort()
        n, d, start = rest.pop(0)
        n = -n
        fits = [s for s in range(count) if room[s] >= n] or [s for s in range(count) if room[s]]
        s = min(fits, key=lambda s: (cost[s], s))
        part = min(n, room[s])
        out.append((d, start, part, full + s))
        room[s] -= part
        cost[s] += 1.0 * part + 1e-3 * part * part
        if part < n:
            rest.append((part - n, d, start + part))
    return sorted(out)


@pytest.mark.parametrize("seed", range(5))
def test_the_cheapest_sequence_with_room_is_chosen(seed):
    rng = random.Random(seed)
    lengths = [rng.choice([rng.randrange(1, 10), rng.randrange(1, 60), rng.randrange(1, 150)]) for _ in range(250)]
    assert sorted(p[:4] for p in packing.pack_cell(lengths, 100)) == by_the_rule(lengths, 100)
