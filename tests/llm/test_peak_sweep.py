from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from oracle import assert_same
from pairloom.llm import peak_sweep

SCHEMA = "grp int, lo long, hi long, w long"


def brute(rows, grain):
    out = []
    for g in {r[0] for r in rows}:
        events = {}
        for _, lo, hi, w in (r for r in rows if r[0] == g):
            lo, hi = (None if x is None else x // grain * grain for x in (lo, hi))
            if lo is None or (hi is not None and hi <= lo):
                continue
            for at, sign in ((lo, 1), (hi, -1)):
                if at is not None:
                    n, c = events.get(at, (0, 0))
                    events[at] = n + sign, c + sign * (w or 0)
        n = c = high = 0
        own = []
        moments = sorted(at for at, d in events.items() if d != (0, 0))
        for at, following in zip(moments, [*moments[1:], None], strict=True):
            n, c = n + events[at][0], c + events[at][1]
            high = max(high, n)
            own.append((g, at, following, n, c, high))
        top = max((r[4] for r in own), default=None)
        out += [(*r, r[4] == top) for r in own]
    return sorted(out, key=str)


def swept(spark, rows, **options):
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"slot": F.lit("x"), "chunk": F.lit(None), "n0": F.lit(7)})
    return sorted((tuple(r) for r in peak_sweep.sweep(df, **options).collect()), key=str)


@pytest.mark.parametrize("seed", range(3))
def test_against_brute_force(spark, seed):
    rng = random.Random(seed)
    rows = []
    for _ in range(400):
        lo = rng.choice([None, rng.randrange(-5000, 200_000)]) if rng.random() < 0.1 else rng.randrange(-5000, 200_000)
        hi = None if rng.random() < 0.1 else (lo or 0) + rng.randrange(-5, 40_000)
        rows.append((rng.choice([0, 0, 0, 1, 2, None]), lo, hi, rng.choice([None, 0, 5, -3, rng.randrange(1 << 45)])))
    rows += rows[:50]
    # chunks of 4 slots: three levels of carrying, and chunks without a change between
    assert swept(spark, rows, grain=10, chunk_slots=4) == brute(rows, 10)


def test_weights_are_summed_exactly(spark):
    rows = [(1, 0, None, (1 << 61) + 1), (1, 60, None, -(1 << 61)), (1, 120, 180, 3)]
    assert swept(spark, rows) == brute(rows, 60)


def test_changes_that_cancel_out(spark):
    # the second begins where the first ends: the number stays, the weight changes only if it differs
    assert swept(spark, [(1, 0, 60, 5), (1, 60, 120, 5)]) == [(1, 0, 120, 1, 5, 1, True), (1, 120, None, 0, 0, 1, False)]
    assert swept(spark, [(1, 0, 60, -5), (1, 60, None, -4)]) == [(1, 0, 60, 1, -5, 1, False), (1, 60, None, 1, -4, 1, True)]
    assert swept(spark, [(1, 30, 59, 5)]) == []


def test_empty(spark):
    assert swept(spark, []) == []


def test_seconds_of_both_kinds_of_timestamps(spark):
    df = spark.sql("SELECT timestamp_ntz'1969-12-31 23:59:30.5' AS a, timestamp'1969-12-31 23:59:30.5' AS b, timestamp_ntz'2024-02-29 12:00:01' AS c")
    got = df.select(*(peak_sweep.utc_seconds(F.col(c)) for c in "abc")).first()
    assert tuple(got) == (-30, -30, int(dt.datetime(2024, 2, 29, 12, 0, 1, tzinfo=dt.UTC).timestamp()))


def test_query_against_sql(spark, sf_dir):
    assert_same(spark, sf_dir, peak_sweep.op11_peak_sweep, peak_sweep.OP11_SQL)


def test_query_with_broken_rows(spark, tmp_path):
    t = lambda s: None if s is None else dt.datetime.fromisoformat(f"2024-01-{s}")
    sales = [(1, 1, 10.0, "01T00:00:30"), (2, None, None, "01T00:01:59"), (3, 9, float("nan"), "02T00:00"), (4, 2, 0.005, "01T00:00"), (5, 1, 1.0, None), (4, 2, 0.005, "01T00:00"), (6, 3, 7.0, "20T00:00")]
    lines = [(1, "03T00:00"), (1, "02T00:00:59"), (None, "01T00:00"), (6, "01T00:00"), (3, None)]
    spark.createDataFrame([(a, b, c, t(d), 1) for a, b, c, d in sales], "sale_id long, client_id long, total double, sold_at timestamp_ntz, hi int").write.parquet(f"{tmp_path}/sales.parquet")
    spark.createDataFrame([(a, t(d), "x") for a, d in lines], "sale_id long, shipped_at timestamp_ntz, client_id string").write.parquet(f"{tmp_path}/sale_lines.parquet")
    spark.createDataFrame([(1, 4), (1, 4), (2, None), (None, 8), (3, 5)], "client_id long, nation_id int").write.parquet(f"{tmp_path}/clients.parquet")
    base = 1704067200
    got = {(r.nation_id, r.from_s - base, r.n_open, r.open_cents) for r in peak_sweep.op11_peak_sweep(spark, str(tmp_path)).collect()}
    # sale 1 in nation 4 until 8 days from the first; 4 twice, 2 and 3 without a nation; 5 and 6 take no part
    assert got == {
        (4, 0, 1, 1000), (4, 8 * 86400, 0, 0), (-1, 0, 2, 2), (-1, 60, 3, 2), (-1, 86400, 4, 2),
        (-2, 0, 3, 1002), (-2, 60, 4, 1002), (-2, 86400, 5, 1002), (-2, 8 * 86400, 4, 2),
    }
