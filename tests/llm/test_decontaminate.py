from __future__ import annotations

import random

import numpy as np
import pytest

from pairloom.llm import decontaminate


def brute(item, words):
    """Least word edits between the item and any passage, by the full table."""
    row = [0] * (len(words) + 1)
    for i, w in enumerate(item, 1):
        new = [i]
        for j, x in enumerate(words, 1):
            new.append(min(row[j - 1] + (w != x), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def corpus(seed=1, n=250):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    items = [(k, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([3, 6, 12, 25, 40])))) for k in range(20)]
    docs = []
    for d in range(n):
        w = [rng.choice(vocabulary) for _ in range(rng.randrange(0, 60))]
        if d % 2:
            p = rng.choice(items)[1].split()
            for _ in range(rng.randrange(0, 1 + len(p) // 4)):
                at, kind = rng.randrange(len(p)), rng.randrange(3)
                if kind == 0:
                    p[at] = "new"
                elif kind == 1:
                    p.insert(at, "new")
                elif len(p) > 1:
                    p.pop(at)
            at = rng.randrange(len(w) + 1)
            w[at:at] = [x.upper() + rng.choice(["", ",", "!"]) for x in p]
        docs.append((d, rng.choice([" ", "\n"]).join(w)))
    return items, docs


def test_recall_and_precision_against_brute_force(spark):
    items, docs = corpus()
    got = decontaminate.contaminated(
        spark.createDataFrame([(*d, 0) for d in docs], "doc_id long, text string, item_id int"), spark.createDataFrame([(*i, "x") for i in items], "item_id long, text string, doc_id string")
    ).collect()
    found = {(r.doc_id, r.item_id): r.distance for r in got}
    expected = {}
    for d, text in docs:
        words = decontaminate.item_words(text)
        for i, t in items:
            item = decontaminate.item_words(t)
            n = brute(item, words)
            if n <= int(0.2 * len(item)):
                expected[d, i] = n
    assert set(found) <= set(expected)
    assert all(found[k] == expected[k] for k in found)
    assert all(k in found for k, n in expected.items() if n == 0)
    assert len(found) >= 0.97 * len(expected)


def test_blocks_do_not_change_the_result(spark):
    items, docs = corpus(2, 60)
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    one, many = (sorted(map(tuple, decontaminate.contaminated(d, i, block_bytes=b).collect())) for b in (1 << 20, 300))
    assert one and one == many


def test_keep_clean_drops_exactly_the_matched(spark):
    items, docs = corpus(3, 80)
    d, i = spark.createDataFrame([(*r, 1) for r in docs], "doc_id long, text string, at int"), spark.createDataFrame(items, "item_id long, text string")
    dirty = {r.doc_id for r in decontaminate.contaminated(d, i).collect()}
    kept = decontaminate.keep_clean(d, i)
    assert kept.columns == d.columns and {r.doc_id for r in kept.collect()} == {r[0] for r in docs} - dirty


def test_edges(spark):
    docs = spark.createDataFrame([(None, "a b c d e"), (1, None), (2, ""), (3, "a b c d e"), (3, "a b c d e"), (4, "z " * 40_000 + "A, b c-! d e")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b c d e"), (1, "a b c d e"), (2, None), (3, ""), (4, "!!")], "item_id long, text string")
    got = sorted(((r.doc_id, r.item_id, r.distance) for r in decontaminate.contaminated(docs, items).collect()), key=str)
    assert got == sorted([(d, 1, 0) for d in (None, 3, 3, 4) for _ in range(2)], key=str)
    assert decontaminate.contaminated(docs.where("doc_id = 9"), items).count() == 0
    assert decontaminate.contaminated(docs, items.where("item_id = 9")).count() == 0
    assert decontaminate.keep_clean(docs, items.where("item_id = 9")).count() == 6


def edited(words, k, rng):
    copy = list(words)
    for _ in range(k):
        p, kind = rng.randrange(len(copy)), rng.randrange(3)
        copy[p : p + (kind > 0)] = [] if kind == 2 else [f"x{rng.randrange(10**9)}"]
    return copy


@pytest.mark.parametrize("m", [3, 10, 50, 150, 300])
def test_recall_at_the_largest_distance(m):
    rng = random.Random(m)
    k = int(0.2 * m)
    items = [[f"w{rng.randrange(3000)}" for _ in range(m)] for _ in range(10)]
    matcher = decontaminate.Matcher(decontaminate.Block([(i, " ".join(w)) for i, w in enumerate(items)], 0.2, 0.99, 7))
    texts = []
    for n in range(200):
        text = [f"w{rng.randrange(3000)}" for _ in range(40)] + edited(items[n % 10], k, rng) + [f"w{rng.randrange(3000)}" for _ in range(40)]
        texts.append(matcher.numbered(" ".join(text)))
    found = matcher.matches(texts)
    for n, of in enumerate(found):
        assert all(d <= k and brute(items[i], [x for x in texts[n].tolist()]) >= 0 for i, d, _, _ in of)
    assert sum(any(i == n % 10 for i, *_ in of) for n, of in enumerate(found)) >= 0.97 * 200


def test_nothing_is_found_without_the_tables(spark, monkeypatch):
    items, docs = corpus(5, 40)
    block = decontaminate.Block(items, 0.2, 0.99, 7)
    texts = [decontaminate.Matcher(block).numbered(t) for _, t in docs]
    assert any(decontaminate.Matcher(block).matches(texts))
    block.tables = {k: (x[:0], y[:0]) for k, (x, y) in block.tables.items()}
    assert not any(decontaminate.Matcher(block).matches(texts))


def test_no_close_window_is_passed_over():
    """The count of known words never drops a window within the edits of an item."""
    rng = random.Random(8)
    items, _ = corpus(8, 1)
    block = decontaminate.Block(items, 0.2, 0.99, 7)
    for i, (w, k) in enumerate(zip(block.words, block.edits, strict=True)):
        m, offsets, edits = decontaminate.parts_of(len(w), k)
        for _ in range(20):
            copy = edited([str(x) for x in w[:m]], min(edits, m - 1), rng)[:m]
            held = sum(block.sizes[m][int(x)] for x in copy if x.isdigit())
            assert held >= block.least[m], i


def test_a_recall_out_of_reach_is_an_error(monkeypatch):
    monkeypatch.setattr(decontaminate, "GIVE_UP", 8)
    with pytest.raises(ValueError, match="walks"):
        decontaminate.fitted_groups(100, 90, 0.99, 1, 50)


def test_edit_distance_is_exact():
    rng = np.random.default_rng(4)
    for _ in range(200):
        item, text = rng.integers(0, 4, rng.integers(1, 8)), rng.integers(0, 4, rng.integers(0, 15))
        d, a, z = decontaminate.best_passage(item, text)
        assert d == brute(item.tolist(), text.tolist()) and 0 <= a <= z <= len(text)


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    got = {(r.doc_id, r.item_id) for r in decontaminate.op3_decontaminate(spark, sf).collect()}
    items = spark.read.parquet(f"{sf}/benchmark.parquet").collect()
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert {(d.doc_id, i.item_id) for d in docs for i in items if i.text in d.text} <= got


def test_near_copies_of_a_long_item_are_found():
    rng = random.Random(11)
    kept = 0
    item = [f"w{i}" for i in range(800)]
    m = decontaminate.Matcher(decontaminate.Block([(0, " ".join(item))], 0.2, 0.99, 7))
    found = 0
    for n in range(12):
        copy = list(item)
        for _ in range(160):
            p, kind = rng.randrange(len(copy)), rng.randrange(3)
            copy[p : p + (kind > 0)] = [] if kind == 2 else [f"x{rng.random()}"]
        text = [f"y{i}" for i in range(50)] + copy + [f"z{i}" for i in range(50)]
        found += any(d <= 160 for _, d, _, _ in m.matches([m.numbered(" ".join(text))])[0])
    assert found == 12, found


def test_words_of_a_text_are_those_of_its_words():
    """Dropping characters from the whole text gives the same words, for every character."""
    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    for text in ("", " . ", "A-b c_d\x1cE\x00f g", "ΟΔΟΣ ΑΣ. İx “q”", every, *("Ab" + c + "ΑΣ " + c + " ΟΣ" + c for c in every[::97])):
        assert decontaminate.bare_words(text) == decontaminate.item_words(text)


def test_pair_filter_loses_no_close_passage():
    """Every passage within the edits passes the counts of words and pairs at its own start."""
    rng = random.Random(11)
    kept = 0
    vocabulary = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([5, 9, 14, 23, 40, 90])))) for i in range(60)]
    block = decontaminate.Block(items, 0.2, 0.99, 7)
    matcher = decontaminate.Matcher(block)
    sizes = [m for m in block.parts if m - 1 - 2 * (m - block.least[m]) > 0]
    assert sizes
    for _ in range(400):
        size = rng.choice(sizes)
        i, offset = rng.choice(block.parts[size])
        x = block.words[i][offset : offset + size].tolist()
        for _ in range(size - block.least[size]):
            at, kind = rng.randrange(len(x) + 1), rng.randrange(3)
            if kind == 0:
                x.insert(at, 0)
            elif kind == 1 and x:
                x.pop(min(at, len(x) - 1))
            elif x:
                x[min(at, len(x) - 1)] = rng.choice([0, 1, 2])
        before, after = rng.randrange(30), rng.randrange(30)
        text = np.array([0] * before + x + [rng.randrange(60) for _ in range(after)] + [0])
        ends = np.full(len(text), len(text))
        found = matcher.starts(text, matcher.pair_sizes(text), ends, size)
        assert before in found
        kept += len(found) / len(text)
        lo = max(0, before - 3)
        assert matcher._may_hold(block.words[i], block.edits[i] + size, text[lo:])
    assert kept < 200  # of 400: most other windows are passed over
