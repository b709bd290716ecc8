from __future__ import annotations

import random

from pyspark.sql import functions as F

from pairloom.operators.sketches import DISTINCT_ERROR, RANK_ERROR, BatchStatistics

SCHEMA = "g string, k string, x double, n_rows string"


def test_merged_batches_are_near_exact_ones(spark, tmp_path):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "a", "b", None]), str(rng.randrange(5000)), rng.choice([None, float("nan"), rng.gauss(0, 9), rng.gauss(5, 1)]), "clash") for _ in range(20_000)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("p", F.floor(F.rand(3) * 5)).cache()
    stats = BatchStatistics(spark, f"{tmp_path}/s", ["g"], ["k"], ["x"])
    for k in range(5):
        stats.add(df.where(F.col("p") == k), k)
    stats.add(df.where("p = 2"), 2)  # once more
    for r in stats.merged((0.1, 0.5)).collect():
        own = [x for x in rows if x[0] == r.g]
        numbers = sorted(x for _, _, x, _ in own if x is not None and x == x)
        assert (r.n_batches, r.n_rows, r.n_x, r.min_x, r.max_x) == (5, len(own), len(numbers), numbers[0], numbers[-1])
        distinct = len({k for _, k, _, _ in own})
        assert abs(r.distinct_k - distinct) <= DISTINCT_ERROR * distinct
        for share, value in zip((0.1, 0.5), r.quantiles_x, strict=True):
            assert abs(sum(x <= value for x in numbers) / len(numbers) - share) <= RANK_ERROR
    df.unpersist()


def test_stream_adds_each_batch_once(spark, tmp_path):
    stats = BatchStatistics(spark, f"{tmp_path}/s", distinct=["k"], numeric=["x"])
    for part in range(3):
        spark.createDataFrame([("g", f"{part}-{j}", float(j), "") for j in range(10)], SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        stats.follow(stream, f"{tmp_path}/ck").awaitTermination()
    r = stats.merged().first()
    assert (r.n_batches, r.n_rows, r.distinct_k, r.n_x, r.min_x, r.max_x) == (3, 30, 30, 30, 0.0, 9.0)


def test_groups_without_numbers(spark, tmp_path):
    stats = BatchStatistics(spark, f"{tmp_path}/s", ["g"], ["k"], ["x"])
    stats.add(spark.createDataFrame([("a", None, None, "")], SCHEMA), 0)
    stats.add(spark.createDataFrame([], SCHEMA), 1)
    r = stats.merged().first()
    assert (r.n_batches, r.n_rows, r.distinct_k, r.n_x, r.min_x, r.quantiles_x) == (1, 1, 0, 0, None, None)
