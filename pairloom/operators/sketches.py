"""Statistics that add up over appended batches.

Each batch leaves one row a group: counts, bounds, an HLL sketch of each column whose
distinct values are asked for, a KLL sketch of each column whose quantiles are. Rows of
batches are merged, never recounted: counts and bounds exactly, distinct counts with a
relative standard error of 1.3 per cent at ``LG_K`` = 12, quantiles with a rank error under
``RANK_ERROR`` at ``K`` = 400 (99 per cent of the time). A batch is named by its caller;
adding it again replaces it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LG_K = 12
K = 400
#: four standard errors of a distinct count
DISTINCT_ERROR = 0.052
RANK_ERROR = 0.01


class BatchStatistics:
    """Statistics kept under ``path``, a folder for each batch."""

    def __init__(self, spark: SparkSession, path: str, by: list[str] | None = None, distinct: list[str] | None = None, numeric: list[str] | None = None):
        self.spark, self.path = spark, path.rstrip("/")
        self.by, self.distinct, self.numeric = by or [], distinct or [], numeric or []

    def add(self, batch: DataFrame, name: str | int) -> None:
        """Sums up a batch; partial sketches meet in the shuffle, so no group's rows do."""
        sums = [F.count(F.lit(1)).alias("n_rows")]
        for c in self.distinct:
            sums.append(F.hll_sketch_agg(F.col(c).cast("string"), F.lit(LG_K)).alias(f"hll_{c}"))
        for c in self.numeric:
            x = F.col(c).cast("double")
            x = F.when(~F.isnan(x), x)
            sums += [F.count(x).alias(f"n_{c}"), F.min(x).alias(f"min_{c}"), F.max(x).alias(f"max_{c}"), F.kll_sketch_agg_double(x, F.lit(K)).alias(f"kll_{c}")]
        batch.groupBy(*self.by).agg(*sums).write.mode("overwrite").parquet(f"{self.path}/batch={name}")

    def follow(self, stream: DataFrame, checkpoint: str):
        """Starts a query that adds each micro-batch of a stream once, on what is there."""
        return stream.writeStream.foreachBatch(self.add).trigger(availableNow=True).option("checkpointLocation", checkpoint).start()

    def merged(self, shares: tuple[float, ...] = (0.25, 0.5, 0.75)) -> DataFrame:
        """A row for each group: n_batches, n_rows, distinct_c; n_c, min_c, max_c and quantiles_c (an array, as ``shares``).

        A group without a number has null bounds and quantiles; without any batch there is no row.
        """
        rows = self.spark.read.parquet(self.path)
        sums = [F.count_distinct("batch").alias("n_batches"), F.sum("n_rows").alias("n_rows")]
        for c in self.distinct:
            sums.append(F.coalesce(F.hll_sketch_estimate(F.hll_union_agg(f"hll_{c}")), F.lit(0)).alias(f"distinct_{c}"))
        for c in self.numeric:
            full = F.when(F.col(f"n_{c}") > 0, F.col(f"kll_{c}"))
            sums += [F.sum(f"n_{c}").alias(f"n_{c}"), F.min(f"min_{c}").alias(f"min_{c}"), F.max(f"max_{c}").alias(f"max_{c}"), F.kll_merge_agg_double(full).alias(f"kll_{c}")]
        merged = rows.groupBy(*self.by).agg(*sums)
        for c in self.numeric:
            quantiles = F.array(*(F.kll_sketch_get_quantile_double(F.col(f"kll_{c}"), F.lit(s)) for s in shares))
            merged = merged.withColumn(f"quantiles_{c}", F.when(F.col(f"n_{c}") > 0, quantiles)).drop(f"kll_{c}")
        return merged
