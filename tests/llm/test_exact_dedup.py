from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

from oracle import assert_same
from pairloom.llm import exact_dedup

ROWS = [(1, "Ab c"), (2, "aB C"), (3, "x"), (4, None), (5, ""), (6, "É"), (7, "é"), (None, "x"), (8, "y" * 50_000), (8, "y" * 50_000), (9, "y" * 50_000 + "z")]


def low(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def brute(rows):
    out = []
    for i, t in rows:
        same = [a for a, b in rows if low(b) == low(t)]
        out.append((i, max((a for a in same if a is not None), default=None), len(same), hashlib.sha256(low(t).encode()).hexdigest()))
    return sorted(out, key=str)


def result(df):
    return sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in df.collect()), key=str)


def test_against_brute_force(spark):
    df = spark.createDataFrame([(i, t, "n", 0) for i, t in ROWS], "doc_id long, text string, norm string, digest int")
    got = exact_dedup.exact_duplicates(df)
    assert result(got) == brute(ROWS)
    kept = got.where("kept")
    assert kept.count() == kept.select("text_sha256").distinct().count() == len({low(t) for _, t in ROWS})


def test_batches_share_state(spark):
    df = spark.createDataFrame([(i, f"t{i % 7}") for i in range(200)], "doc_id long, text string").repartition(8)
    got = exact_dedup.exact_duplicates(df, batch_bytes=1, state_partitions=2)
    assert result(got) == brute([(i, f"t{i % 7}") for i in range(200)])


def test_bytes_are_checked_on_hits(spark):
    rows = [(i, f"text {i // 2}") for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = exact_dedup.exact_duplicates(df, digest=F.substring(F.md5("norm"), 1, 1))
    assert result(got) == brute(rows)


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert exact_dedup.exact_duplicates(df).count() == 0 and exact_dedup.keep_distinct(df).count() == 0


def test_keep_distinct_keeps_columns(spark):
    df = spark.createDataFrame([(*r, "k", 5) for r in ROWS], "doc_id long, text string, keeper string, __n int")
    got = exact_dedup.keep_distinct(df)
    assert got.columns == df.columns and got.count() == len({low(t) for _, t in ROWS})
    assert {r.doc_id for r in got.where("text = 'aB C' OR text = 'Ab c'").collect()} == {2}


def test_query(spark, sf_dir):
    assert_same(spark, sf_dir, exact_dedup.op1_exact_dedup, exact_dedup.OP1_SQL)


def test_a_second_call_continues_the_state(spark, tmp_path):
    store = f"file://{tmp_path}/store"
    schema = "doc_id long, text string"
    first, second = [(1, "a"), (2, "A"), (3, "b")], [(9, "a"), (0, "b"), (5, "c")]
    one = result(exact_dedup.exact_duplicates(spark.createDataFrame(first, schema), store=store, state_partitions=2))
    assert one == brute(first)
    two = exact_dedup.exact_duplicates(spark.createDataFrame(second, schema), store=store, state_partitions=2)
    assert result(two) == [r for r in brute(first + second) if r[0] in (9, 0, 5)]
    assert {r.doc_id for r in two.where("kept").collect()} == {9, 5}


def test_bytes_are_checked_against_earlier_calls(spark, tmp_path):
    store = f"file://{tmp_path}/store"
    schema = "doc_id long, text string"
    short = F.substring(F.md5("norm"), 1, 1)
    rows = [[(10 * c + i, f"text {(3 * c + i) // 2}") for i in range(10)] for c in range(2)]
    for c in range(2):
        got = exact_dedup.exact_duplicates(spark.createDataFrame(rows[c], schema), digest=short, store=store, state_partitions=2)
        known = {r[0] for r in rows[c]}
        assert result(got) == [r for r in brute([x for part in rows[: c + 1] for x in part]) if r[0] in known]


@pytest.mark.parametrize(("where", "batch"), [("state_settings", 1), ("_unequal", 1), ("_unequal", None), ("keyed_state", None)])
def test_a_failed_call_is_repeated(spark, tmp_path, monkeypatch, where, batch):
    store = f"file://{tmp_path}/store"
    schema = "doc_id long, text string"
    first, second = [(1, "a"), (2, "A"), (3, "b")], [(9, "a"), (0, "b"), (5, "c"), (5, "c"), (None, "a")]
    call = lambda rows, n: exact_dedup.exact_duplicates(spark.createDataFrame(rows, schema), store=store, state_partitions=2, batch=None if batch is None else n)
    assert result(call(first, 0)) == brute(first)

    def fails(*args, **options):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(exact_dedup, where, fails)
        with pytest.raises(RuntimeError, match="lost"):
            call(second, 1)
    want = [r for r in brute(first + second) if r[0] in (9, 0, 5, None)]
    for _ in range(2):
        # after the failure, and once more after a whole call
        again = call(second, 1)
        assert result(again) == sorted(want, key=str)
        assert sorted(r.text_sha256 for r in again.where("kept").collect()) == sorted({r[3] for r in want if r[1] in (9, 5)})


def test_content_half_written_does_not_count(spark, tmp_path):
    store = f"file://{tmp_path}/store"
    schema = "doc_id long, text string"
    (tmp_path / "store" / "entering" / "7").mkdir(parents=True)
    (tmp_path / "store" / "entering" / "7" / "part-0.parquet").write_bytes(b"cut")
    got = exact_dedup.exact_duplicates(spark.createDataFrame([(1, "a"), (2, "a")], schema), store=store, batch=7)
    assert result(got) == brute([(1, "a"), (2, "a")])


def test_repeated_rows_stay_linear(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "PIECE", 500)
    sizes = []
    save = exact_dedup.Scratch.save

    def counting(self, df, name):
        out = save(self, df, name)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(exact_dedup.Scratch, "save", counting)
    df = spark.range(100_000).selectExpr("7L as doc_id", "'same text' as text")
    got = exact_dedup.exact_duplicates(df)
    assert got.where("group_size = 100000 and keep_id = 7").count() == 100_000 and got.where("kept").count() == 1
    assert max(sizes) <= 100_000
    assert exact_dedup.keep_distinct(df).count() == 1


def test_clashing_columns_keep_their_values(spark):
    rows = [(1, "x", "own", "hash", 5, "d"), (2, "X", "mine", "h", 6, "e"), (3, "y", "own", "hash", 7, "f")]
    df = spark.createDataFrame(rows, "doc_id long, text string, __own string, __hash string, __n int, key string")
    assert sorted(map(tuple, exact_dedup.keep_distinct(df).collect())) == rows[1:]
