from __future__ import annotations

import random

from pairloom.streaming import progress

SCHEMA = "run string, step long, metric double"


def feed(spark, tmp_path, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")


def run(spark, tmp_path, name, per_trigger=1, earlier=None):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", per_trigger).parquet(f"{tmp_path}/in")
    q = progress.follow(stream, f"{tmp_path}/{name}/state", f"{tmp_path}/{name}/out", earlier)
    q.awaitTermination()
    return {r.run: (r.best_step, r.best_metric, r.n_seen, r.since_best) for r in progress.current(spark, f"{tmp_path}/{name}/state").collect()}


def brute(rows, earlier=()):
    out = {}
    for r, s, m in earlier:
        if m is not None and (r not in out or (m, -s) > (out[r][1], -out[r][0])):
            out[r] = (s, m, 0, 0)
    for batch in rows:
        for r, s, m in sorted(batch, key=lambda x: x[1] or 0):
            if r is None or s is None or m is None:
                continue
            step, best, seen, since = out.get(r, (None, None, 0, 0))
            out[r] = (s, m, seen + 1, 0) if best is None or m > best else (step, best, seen + 1, since + 1)
    return out


def test_stop_and_start_again(spark, tmp_path):
    rng = random.Random(5)
    batches = [[(rng.choice("abc"), k * 10 + j, rng.choice([None, 0.5, rng.random()])) for j in range(10)] for k in range(4)]
    batches[1] += [(None, 3, 9.0), ("d", None, 9.0), ("e", 1, None)]
    for b in batches[:2]:
        feed(spark, tmp_path, b)
    assert run(spark, tmp_path, "two") == brute(batches[:2])
    for b in batches[2:]:
        feed(spark, tmp_path, b)
    stopped_once = run(spark, tmp_path, "two")
    assert stopped_once == brute(batches) == run(spark, tmp_path, "one")
    # every improvement is larger than the one before, and the last is the best
    better = {}
    for r in progress.improvements(spark, f"{tmp_path}/two/state").orderBy("run", "metric").collect():
        better.setdefault(r.run, []).append((r.step, r.metric))
    assert {k: v[-1] for k, v in better.items()} == {k: v[:2] for k, v in stopped_once.items()}
    out = spark.read.parquet(f"{tmp_path}/two/out")
    assert out.select("batch").distinct().count() == 4


def test_initial_state_from_a_table(spark, tmp_path):
    earlier = [("a", 7, 0.9), ("a", 3, 0.9), ("a", 1, 0.2), ("b", 2, None), ("old", 1, 0.4)]
    rows = [("a", 10, 0.5), ("a", 11, 0.95), ("b", 4, 0.1), ("old", 2, 0.3)]
    feed(spark, tmp_path, rows)
    got = run(spark, tmp_path, "x", earlier=spark.createDataFrame(earlier, SCHEMA))
    assert got == brute([rows], earlier) == {"a": (11, 0.95, 2, 0), "b": (4, 0.1, 1, 0), "old": (1, 0.4, 1, 1)}
