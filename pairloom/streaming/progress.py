"""Best metric so far of each run, as state that outlives the query.

A stream of measurements (run, step, metric) keeps for each run its best metric, the step
that reached it, how many measurements came since, and the list of improvements. The state
lies in the checkpoint, so a query started again goes on where it stopped, and it can be
read back as a table. Runs of earlier times come in as initial state.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SCHEMA = "run string, best_step long, best_metric double, n_seen long, since_best long"


class BestSoFar(StatefulProcessor):
    """A larger metric is better; of equal ones the first in order of arrival, and in a batch of step, stays."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.best = handle.getValueState("best", "step long, metric double, seen long, since long")
        self.improvements = handle.getListState("improvements", "step long, metric double")

    def handleInitialState(self, key: tuple, initialState: pd.DataFrame, timerValues) -> None:  # noqa: N802, N803
        rows = initialState[initialState["metric"].notna()]
        if len(rows):
            best = rows.sort_values(["metric", "step"], ascending=[False, True]).iloc[0]
            self.best.update((int(best["step"]), float(best["metric"]), 0, 0))
            self.improvements.appendValue((int(best["step"]), float(best["metric"])))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        step, metric, seen, since = self.best.get() if self.best.exists() else (None, None, 0, 0)
        came = pd.concat(list(rows))
        came = came[came["metric"].notna() & came["step"].notna()].sort_values("step", kind="stable")
        for s, m in zip(came["step"], came["metric"], strict=True):
            seen += 1
            if metric is None or m > metric:
                step, metric, since = int(s), float(m), 0
                self.improvements.appendValue((step, metric))
            else:
                since += 1
        if metric is not None:
            self.best.update((step, metric, seen, since))
            yield pd.DataFrame({"run": [key[0]], "best_step": [step], "best_metric": [metric], "n_seen": [seen], "since_best": [since]})

    def close(self) -> None:
        pass


def best_so_far(measured: DataFrame, earlier: DataFrame | None = None) -> DataFrame:
    """``measured``: a stream of run, step, metric (nulls and NaN count for nothing); ``earlier``: the same as a table.

    A row for each run and batch: its best so far, how many were seen, and how many since the
    best. A batch's rows of one run pass through one task.
    """
    narrow = lambda df: df.where("run IS NOT NULL").select(F.col("run").cast("string").alias("run"), F.col("step").cast("long").alias("step"), F.col("metric").cast("double").alias("metric"))
    if earlier is not None:
        # one row a run is all that its state needs
        first = narrow(earlier).where("metric IS NOT NULL AND NOT isnan(metric)").groupBy("run").agg(F.max(F.struct("metric", -F.col("step"))).alias("b"))
        first = first.select("run", (-F.col("b")["col2"]).alias("step"), F.col("b.metric").alias("metric"))
        earlier = first.groupBy("run")
    return narrow(measured).groupBy("run").transformWithStateInPandas(statefulProcessor=BestSoFar(), outputStructType=SCHEMA, outputMode="Update", timeMode="None", initialState=earlier)


def follow(measured: DataFrame, checkpoint: str, sink: str, earlier: DataFrame | None = None):
    """Starts the query on what is there; its rows are appended to the table ``sink``, each batch once."""
    spark = measured.sparkSession
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    try:
        def write(batch: DataFrame, batch_id: int) -> None:
            # a batch that is repeated after a failure takes the place of its first attempt
            batch.write.mode("overwrite").parquet(f"{sink}/batch={batch_id}")

        return best_so_far(measured, earlier).writeStream.foreachBatch(write).outputMode("update").trigger(availableNow=True).option("checkpointLocation", checkpoint).start()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def current(spark: SparkSession, checkpoint: str) -> DataFrame:
    """run, best_step, best_metric, n_seen, since_best: the state as a table."""
    state = spark.read.format("statestore").option("stateVarName", "best").load(checkpoint)
    return state.select(F.col("key.run").alias("run"), F.col("value.step").alias("best_step"), F.col("value.metric").alias("best_metric"), F.col("value.seen").alias("n_seen"), F.col("value.since").alias("since_best"))


def improvements(spark: SparkSession, checkpoint: str) -> DataFrame:
    """run, step, metric: every measurement that was the best when it came."""
    state = spark.read.format("statestore").option("stateVarName", "improvements").load(checkpoint)
    return state.select(F.col("key.run").alias("run"), F.col("list_element.step").alias("step"), F.col("list_element.metric").alias("metric"))
