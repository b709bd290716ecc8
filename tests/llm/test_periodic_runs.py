from __future__ import annotations

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from oracle import assert_same
from pairloom.llm import periodic_runs
from pairloom.llm.periodic_runs import collapsed, runs


def brute(x, min_length=6, min_exponent=4):
    n, out = len(x), []
    for q in range(1, n // min_exponent + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and x[j] == x[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(min_length, min_exponent * q):
                w = x[i : i + length]
                if not any(w[r:] == w[:-r] for r in range(1, q)):
                    out.append((i, length, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def kept(x, found):
    return [w for i, w in enumerate(x) if not any(s + q <= i < s + n for s, n, q in found)]


def made(rng):
    n, k = rng.randint(0, 70), rng.choice([1, 2, 2, 3, 5])
    x = [b"w%d" % rng.randrange(k) for _ in range(n)]
    if n and rng.random() < 0.5:
        a = rng.randrange(n)
        p = 1 + rng.randrange(max(1, (n - a) // 2))
        x = x[:a] + [x[a + (i - a) % p] for i in range(a, n)]
    return x


@pytest.mark.parametrize(("min_length", "min_exponent"), [(6, 4), (1, 2), (4, 3), (10, 5)])
def test_runs_against_brute_force(min_length, min_exponent):
    rng = random.Random(min_exponent)
    for _ in range(300):
        docs = [made(rng) for _ in range(rng.randint(1, 6))]
        got = runs(docs, min_length, min_exponent)
        assert got == [brute(d, min_length, min_exponent) for d in docs]
        assert [collapsed(d, f) for d, f in zip(docs, got, strict=True)] == [kept(d, f) for d, f in zip(docs, got, strict=True)]


def test_groups_of_documents_do_not_matter(monkeypatch):
    rng = random.Random(9)
    docs = [made(rng) for _ in range(60)]
    whole = runs(docs)
    monkeypatch.setattr(periodic_runs, "GROUP_WORDS", 50)
    assert runs(docs) == whole


def test_long_texts():
    fibonacci = [b"a"], [b"a", b"b"]
    while len(fibonacci[1]) < 3000:
        fibonacci = fibonacci[1], fibonacci[1] + fibonacci[0]
    docs = [[b"x"] * 30_000, [b"%d" % (i % 7000) for i in range(30_000)], fibonacci[1]]
    assert runs(docs) == [[(0, 30_000, 1)], [(0, 30_000, 7000)], []]
    assert runs(docs[2:], min_length=2, min_exponent=3)[0][:3] == brute(fibonacci[1][:60], 2, 3)[:3]


ROWS = [(1, "a b " * 9), (2, None), (3, ""), (4, " \t\n\x0b\x0c\r "), (None, "x x x x x x x"), (5, "é é é " * 8), (6, "one two three"), (6, "one two three"), (7, "y\x1cy " * 6)]


def test_rows_and_hazards(spark):
    df = spark.createDataFrame([(i, t, "c", 1) for i, t in ROWS], "doc_id long, text string, runs string, n_words int")
    got = sorted(((r.id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in periodic_runs.periodic_runs(df).collect()), key=str)
    want = []
    for i, t in ROWS:
        x = (t or "").encode().split()
        f = brute(x)
        want.append((i, len(x), f, b" ".join(kept(x, f)).decode()))
    assert got == sorted(want, key=str)
    assert periodic_runs.periodic_runs(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        periodic_runs.periodic_runs(df, min_exponent=1)


def test_ends_made_periodic(spark):
    rows = [(i, " ".join(f"w{j}" for j in range(i % 97))) for i in range(400)] + [(None, "a b c")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.t) for r in df.select("doc_id", periodic_runs.periodic_text(F.col("doc_id"), F.col("text")).alias("t")).collect()}
    want, changed = set(), 0
    for i, t in rows:
        x, h = t.split(), zlib.crc32(str(i).encode())
        if i is not None and h % 10 == 0 and x:
            g, n = h // 10, len(x)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            t, changed = " ".join(x[:a] + [x[a + (k - a) % p] for k in range(a, n)]), changed + 1
        want.add((i, t))
    assert got == want and changed > 20


def test_query_against_sql(spark, sf_dir):
    assert_same(spark, sf_dir, periodic_runs.op13_periodic_runs, periodic_runs.OP13_SQL)


def test_greatest_exponent_and_ties(spark, tmp_path):
    text = "p q p q p q p q z z2 r s r s r s r s"  # two runs of exponent 4
    assert zlib.crc32(b"1") % 10
    spark.createDataFrame([(1, text)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    r = periodic_runs.op13_periodic_runs(spark, str(tmp_path)).first()
    assert (r.n_runs, r.start, r.length, r.period, r.exponent_milli) == (2, 0, 8, 2, 4000)
    assert r.runs_sha256 == hashlib.sha256(b"0,8,2\n10,8,2\n").hexdigest()
    assert r.collapsed_sha256 == hashlib.sha256(b"p q z z2 r s").hexdigest()
